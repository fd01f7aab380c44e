"""Documents with everything that can go wrong."""

from pyspark.sql import functions as F

#: Column names that the operators use inside.
CLASHING = ("rep", "hub", "hubs", "key", "digest", "local", "sha", "component", "lang_pred", "lang_score", "score", "text_sha", "text_key", "gone", "kept", "kept_id", "keep_id", "n", "sig", "bands", "ids", "text_sha256", "held_out", "spans", "id")
LONG = "lorem ipsum dolor " * 20_000 + "x" * 30_000

ROWS = [
    (1, "Hello World again and again", "en"), (2, "hello world AGAIN and again", "en"), (3, None, "en"), (4, "", None), (5, LONG, "en"), (6, LONG, "de"), (7, "Ünï çødé ÜNÏ", "de"),
    (8, "ünï çødé ÜNÏ", None), (9, "!!! 123", "de"), (None, "hello world again and again", "en"), (None, None, None), (7, "Ünï çødé ÜNÏ", "de"), (10, "one", "en"), (11, "one two", "en"),
]


def documents(spark, rows=ROWS):
    df = spark.createDataFrame([(i, t, lang, f"s{k}", len(t or "")) for k, (i, t, lang) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(f"my {c}") for c in CLASHING})


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
