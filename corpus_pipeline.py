"""From raw documents to token ids: language ID, exact dedup, near dedup, decontamination, BPE.

``STAGES`` are (name, function); a function takes (spark, docs, sf_dir) and returns what it keeps, with the
columns of documents; the last returns the encoded texts.  Each stage's result is written as Parquet and read
again before the next one starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapeloom.llm import scratch
from shapeloom.llm.bpe import bpe_encode
from shapeloom.llm.decontaminate import contamination
from shapeloom.llm.exact_dedup import exact_dedup
from shapeloom.llm.langid import UNDETERMINED, held_out, predict, train
from shapeloom.llm.near_dup import near_duplicates
from shapeloom.llm.queries import vocabulary

#: A document is rejected whose best language isn't more probable than by chance, which is 1 of L languages, by this
#: share of the rest (0.3 with four languages): short and mixed but clean texts often stay below one half.
ABOVE_CHANCE = 1 / 15
#: The languages compete with one another alone, so a text in none of them can be of high probability for one.  A
#: document is rejected, too, of whose letters a smaller share occurs in any row that was learned from.
LEAST_KNOWN = 0.5
#: Keys of at most so many bytes are broadcast to leave their documents out; more are joined by a shuffle.
BROADCAST_BYTES = 64 << 20
#: Near duplicates: runs of so many words, and percent of them in common.
WIDTH, PERCENT = 5, 80


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _join(docs: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    """``docs`` whose columns ``on`` are (left_semi) or aren't (left_anti) among ``keys``, which are written."""
    names = [_free(docs, f"key_{k}") for k in range(len(on))]
    keys = keys.toDF(*names)
    small = 100 * keys.count() <= BROADCAST_BYTES
    condition = [F.col(a) == F.col(b) for a, b in zip(on, names)]
    return docs.join(F.broadcast(keys) if small else keys, condition, how)


def least_score(languages: int) -> float:
    """Of so many languages; 1 of one language, which is always as probable."""
    chance = 1 / max(1, languages)
    return chance + ABOVE_CHANCE * (1 - chance)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, in a script that wasn't learned, or in no language that is probable, go.

    So do null and empty texts.  Rows without an id, or repeated, are judged like others; very long texts are read whole;
    without a row to learn from none stays; columns of any name are kept.
    """
    model = train(docs.where(~held_out()))
    pred, score = _free(docs, "lang_pred"), _free(docs, "lang_score")
    judged = predict(docs, model, pred_col=pred, score_col=score, least_known=LEAST_KNOWN)
    return judged.where((F.col(pred) != UNDETERMINED) & (F.col(score) >= least_score(len(model.languages)))).drop(pred, score)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays: the one with the largest id.  Rows without an id stay.

    Null and empty texts are equal.  Of a row that is repeated one occurrence stays, whatever its other columns; very long
    texts are compared whole.  An empty table stays empty; columns of any name are kept.
    """
    sha, columns = _free(docs, "text_sha"), docs.columns
    rows = exact_dedup(docs).where("doc_id is not null").groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    rows = scratch.table(rows.where("not kept or n > 1"), "exact-rows")
    lowered = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    stay = _join(docs.withColumn(sha, F.sha2(lowered.cast("binary"), 256)), rows.where("not kept").select("doc_id", "text_sha256"), ["doc_id", sha], "left_anti")
    repeated = rows.where("kept").select("doc_id", "text_sha256")
    if repeated.isEmpty():
        return stay.select(columns)
    # rows that occur several times, with their ids
    once = _join(stay, repeated, ["doc_id", sha], "left_semi").dropDuplicates(["doc_id", sha])
    return _join(stay, repeated, ["doc_id", sha], "left_anti").select(columns).union(once.select(columns))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id.

    Rows without an id, and texts without a word, stay.  Rows with one id are one document and go or stay together, also
    with different texts; of very long texts the whole sets are compared.  An empty table stays empty; columns of any name
    are kept.
    """
    dropped = near_duplicates(docs, WIDTH, PERCENT).where("not kept").select("doc_id")
    return _join(docs, scratch.table(dropped, "near-dropped"), ["doc_id"], "left_anti")


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go; items without an id are known by the hash of their text.

    Documents are known by id and text: of rows with one id only those with a passage go.  Null and empty texts stay; very
    long ones are searched whole.  Without items all stay; columns of any name are kept.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    benchmark = benchmark.withColumn("item_id", F.coalesce(F.col("item_id").cast("long"), F.xxhash64("text")))
    key = _free(docs, "text_key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    leaking = contamination(keyed, benchmark, id_col=key).select("doc_id").distinct()
    return _join(keyed, scratch.table(leaking, "leaking"), [key], "left_anti").drop(key)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, decoded_sha256 of every row: null and empty texts have no tokens, rows without
    an id or repeated are rows like others, very long texts are encoded whole; other columns go."""
    return bpe_encode(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language ID", language_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("BPE", bpe_stage),
]
#: No SQL for the language model, the edit search and the tokens: see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage has written goes when the next one's result is there."""
    before = set(scratch.held())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.table(docs, f"stage-{k}")
            scratch.release(p for p in scratch.held()[:-1] if p not in before)
    return docs
