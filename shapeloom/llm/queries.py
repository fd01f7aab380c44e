"""The queries of this subpackage's operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_encode
from .decontaminate import contamination
from .exact_dedup import exact_dedup
from .langid import language_id
from .license_scan import license_scan
from .near_dup import near_duplicates
from .pii import find_pii
from .token_counts import token_counts
from .url_filter import url_filter
from .warc import read_warc, write_warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


#: (action, host, path)
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = read_warc(write_warc(_table(spark, sf_dir, "pages")), with_payload=False)
    # a record that breaks a rule fails the query
    checked = F.when(F.col("error").isNull(), F.col("record_type")).otherwise(F.raise_error("error"))
    return back.select("page_id", "payload_bytes", "payload_digest", checked.alias("record_type"), "refers_to")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe_encode(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), with_ids=False)
    return encoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(_table(spark, sf_dir, "pages"), URL_RULES)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base places are the exact ones of the four phrases of the contract."""
    found = license_scan(_table(spark, sf_dir, "documents"))
    base = F.expr("filter(hits, h -> h.edits = 0 AND h.phrase IN ('gnu general public license', 'apache license', 'cc by', 'mit license'))")
    labels = lambda hits: F.array_join(F.array_sort(F.array_distinct(hits["label"])), ",")
    # how much of the best notice stands unchanged
    score = F.array_max(F.transform("hits", lambda h: F.greatest(F.lit(0.0), 1 - h["edits"] / F.length(h["phrase"]))))
    return found.withColumn("base", base).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.first_word").alias("first_word"), F.array_max("base.first_word").alias("last_word"),
        labels(F.col("base")).alias("base_labels"), labels(F.col("hits")).alias("labels"), F.coalesce(score, F.lit(0.0)).alias("score"),
    )


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(_table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin("email", "ip", "card", "phone"))
    return found.select("doc_id", *map(count, ("email", "ip", "card", "phone")), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_warc": op4_warc,
    "op5_decontamination": op5_decontamination,
    "op6_bpe": op6_bpe,
    "op7_url_filter": op7_url_filter,
    "op8_near_dedup": op8_near_dedup,
    "op9_license_scan": op9_license_scan,
    "op10_pii": op10_pii,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {
    "op2_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {_LOWER} AS x FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               row_number() OVER (PARTITION BY x ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(x) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY x)""",
    "op7_url_filter": """
        WITH cut AS (SELECT row_number() OVER () AS k, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        u AS (SELECT k, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
        r(action, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        hit AS (SELECT k, arg_max(h || p, length(h) + length(p)) AS rule, arg_max(action, length(h) + length(p)) AS action
                FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY k)
        SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM u LEFT JOIN hit USING (k)""",
    "op8_near_dedup": rf"""
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT DISTINCT k, doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS shingle FROM d),
        n AS (SELECT k, any_value(doc_id) AS doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.k AS j, b.k, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.k <> b.k GROUP BY 1, 2),
        e AS (SELECT DISTINCT x.doc_id AS u, y.doc_id AS v FROM p JOIN n x ON x.k = p.j JOIN n y ON y.k = p.k
              WHERE x.doc_id <> y.doc_id AND 100 * common >= 85 * (x.n + y.n - common)),
        r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents WHERE doc_id IS NOT NULL UNION SELECT e.v, r.c FROM r JOIN e ON r.doc_id = e.u),
        m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY 1)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, coalesce(d.doc_id = m.c, true) AS kept
        FROM d LEFT JOIN n ON n.k = d.k LEFT JOIN m ON m.doc_id = d.doc_id""",
    "op4_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS last FROM p)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                 1 + ((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31), 1)), '') AS payload_digest,
               CASE WHEN last IS NOT NULL AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to FROM d""",
}
