"""Edge rows that every operator on documents has to take."""

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("h", T.StringType()),
    ]
)
LONG = " ".join(f"word{i % 997} gap{i}" for i in range(40_000)) + "."
ROWS = [
    (1, None, None, None, None, None),
    (2, "", "", "", 0, ""),
    (3, " \t\n\x0b\f\r ", "en", "s", 7, "x"),
    (4, LONG, "en", "s", len(LONG), "x"),
    (5, LONG, "en", "s", len(LONG), "x"),
    (6, "a b c a b c a b c " * 40, "en", None, 1, "x"),
    (7, "Ünïcode — text with € and 😀 faces.\n" * 30, "de", "s", 1, "x"),
    (8, "password = \"abcdef123\" AKIA" + "Z9" * 10 + " " + "deadbeef" * 4 + " 😀 token=ab secret=token: abcdefgh api_key:AAAAAA==", "en", "s", 1, "x"),
    (9, "<|endoftext|> a  b\n\n c d e's I'll \x1c x <|endoftext|>", "en", "s", 1, "x"),
    (10, "same text " * 30, "en", "s", 1, "x"),
    (11, "same text " * 30, "en", "s", 1, "x"),
    (12, "Write to joe.smith@example.com or +1(555)123-4567, host 10.0.0.1, card 4111111111111111, Mr. John Smith. " * 3, "en", "s", 1, "x"),
    (13, "x\n" * 200, "en", "s", 1, "x"),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def saved(spark, tmp_path, rows=ROWS):
    """A folder with a documents table of the edge rows."""
    frame(spark, rows).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)
