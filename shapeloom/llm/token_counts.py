"""Token counts under a unigram model, by dynamic programming over a trie.

Pre-tokens are the words between white space, each with a leading ``▁``.  The distinct ones that a worker
hasn't counted yet go into its trie, which the tasks that it runs one after the other share.  A node's forward score is the best log-probability of a segmentation of
its prefix; it needs the scores of the nodes above it only, so it is computed once, when the node is made,
whatever the number of pre-tokens below.  The node that ends a pre-token keeps its count of tokens.

The vocabulary is a sentencepiece file; nothing is trained.  Its pieces stand by rank, and the model takes
Zipf-Mandelbrot probabilities p(r) ~ 1 / (r + 2.7) for them.  A character that no piece has costs one token
for each of its UTF-8 bytes, each 10 below the least probable piece.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import REMEMBERED, _Remember

MARK = "▁"
#: Nodes after which a worker's trie starts anew.
NODES = 400_000
#: Characters of a pre-token that have nodes; those behind them have their scores alone.
DEPTH = 1000


def unigram_scores(path: str) -> dict[str, float]:
    """Log-probability by piece of the normal pieces of a sentencepiece file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    total = log(sum(1 / (r + 2.7) for r in range(len(pieces))))
    return {p: -log(r + 2.7) - total for r, p in enumerate(pieces)}


class CountingTrie:
    def __init__(self, scores: dict[str, float], nodes: int = NODES) -> None:
        self.most = nodes
        #: by each end of a piece: the score, if it is a piece itself
        self.ends: dict[str, float | None] = {p[k:]: None for p in scores for k in range(len(p))} | scores
        self.byte = min(scores.values()) - 10
        self.longest = max(map(len, scores))
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.forward, self.count = [0.0], [0]

    def insert(self, word: str) -> tuple[int, float]:
        """Tokens and log-probability of the best segmentation of a pre-token."""
        if len(self.forward) > self.most:
            self.clear()
        path, child, forward, count, ends = [0], self.child, self.forward, self.count, self.ends
        for d, c in enumerate(word[:DEPTH], 1):
            at = path[-1] << 21 | ord(c)
            node = child.get(at)
            if node is None:
                # a single character without a piece falls back to its bytes
                n = len(c.encode())
                best, tokens = forward[path[-1]] + n * self.byte, count[path[-1]] + n
                for k in range(d - 1, -1, -1):
                    s = ends.get(word[k:d], 0.0)
                    if s == 0.0:  # no piece ends like this, nor with more in front
                        break
                    if s is not None and (s := forward[path[k]] + s) >= best:
                        best, tokens = s, count[path[k]] + 1
                node = child[at] = len(forward)
                forward.append(best)
                count.append(tokens)
            path.append(node)
        if len(word) <= DEPTH:
            return count[path[-1]], forward[path[-1]]
        # only the scores that a piece can reach back to are held
        reach = deque(((forward[p], count[p]) for p in path[-self.longest :]), self.longest)
        for d in range(DEPTH + 1, len(word) + 1):
            n = len(word[d - 1].encode())
            best, tokens = reach[-1][0] + n * self.byte, reach[-1][1] + n
            for k in range(1, len(reach) + 1):
                s = ends.get(word[d - k : d], 0.0)
                if s == 0.0:
                    break
                if s is not None and (s := reach[-k][0] + s) >= best:
                    best, tokens = s, reach[-k][1] + 1
            reach.append((best, tokens))
        return reach[-1][1], reach[-1][0]


#: By path: what a worker has counted, whatever the task.
_KNOWN: dict[str, _Remember] = {}


def known_words(path: str) -> _Remember:
    """(tokens, log-probability) by pre-token without its mark; bounded, and kept as long as the worker lives."""
    if path not in _KNOWN:
        trie = CountingTrie(unigram_scores(path))
        _KNOWN[path] = _Remember(lambda w: trie.insert(MARK + w), 2 * REMEMBERED)
    return _KNOWN[path]


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_words(path)
        for batch in batches:
            n_words, n_tokens, score = [], [], []
            for value in batch.column(1):
                words = (value.as_py() or "").split()
                if max(map(len, words), default=0) > DEPTH:
                    got = [known[w] if len(w) <= DEPTH else known.compute(w) for w in words]
                else:
                    got = list(map(known.__getitem__, words))
                n, s = zip(*got) if got else ((), ())
                n_words.append(len(words))
                n_tokens.append(sum(n))
                score.append(sum(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(score, pa.float64())], ["doc_id", "n_words", "n_tokens", "log_prob"])

    return run


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens and log_prob (natural logarithm, of the best segmentations) of each whole text.

    A null or empty text has none of either; a very long text, or word, is counted whole in bounded memory.  Of equally
    probable segmentations the one with the longest last piece counts.  Null ids pass through, repeated rows are counted alike, an empty
    table gives an empty result, other columns are not looked at.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(_count(path), "doc_id long, n_words long, n_tokens long, log_prob double")
