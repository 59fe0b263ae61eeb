"""Trees of files as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talonscan.functions.paths import base_name, language

#: Folders never read, names of bundles and generated files, and the size beyond which a file is not read.
EXCLUDED = (
    "node_modules .git build dist vendor __pycache__ .next .nuxt .svelte-kit target bin obj coverage .turbo .venv venv .vercel .clerk .wrangler .netlify .amplify .serverless .firebase .expo .output".split()
)
GENERATED = [r"\.min\.(js|mjs|cjs|css)\z", r"\.bundle\.(js|mjs|cjs)\z", r"-bundle\.(js|mjs|cjs)\z", r"\.production(\.min)?\.(js|mjs|cjs)\z", r"\.umd(\.min)?\.(js|mjs|cjs)\z", r"\.esm(\.min)?\.(js|mjs|cjs)\z"]
MAX_BYTES = 500 * 1024


def _tree(spark: SparkSession, path: str, recursive: bool, excluded: list[str], max_bytes: int) -> DataFrame:
    """Files outside of excluded folders: (file, language, content, length, modificationTime, skipped), file relative to ``path``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    root = "/" + path.split("://", 1)[-1].strip("/") + "/"
    file = F.element_at(F.split(F.regexp_replace("path", r"^[a-z0-9]+:/+", "/"), F.lit("\\Q" + root + "\\E"), 2), -1)
    named = raw.select(file.alias("file"), "content", "length", "modificationTime").withColumn("language", language(F.col("file")))
    folder = F.split(F.regexp_replace("file", "[^/]*$", ""), "/")
    generated = F.exists(F.array(*[base_name(F.col("file")).rlike("(?i)" + p) for p in GENERATED]), lambda x: x)
    skipped = F.when(F.col("language").isNull(), "unsupported").when(generated, "generated").when(F.col("length") > max_bytes, "too large")
    return named.where(~F.arrays_overlap(folder, F.array(*[F.lit(x) for x in excluded]))).withColumn("skipped", skipped)


def survey_tree(spark: SparkSession, path: str, recursive: bool = True, excluded: list[str] = EXCLUDED, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(file, language, size, skipped) of all files outside of excluded folders; ``skipped`` tells why a file is not read, null if it is. No content is read."""
    return _tree(spark, path, recursive, excluded, max_bytes).select("file", "language", F.col("length").alias("size"), "skipped")


def read_tree(spark: SparkSession, path: str, recursive: bool = True, excluded: list[str] = EXCLUDED, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(file, content, language, size, modified) of files that are read, file relative to ``path``.

    Size is filtered in the reader, so bytes of files that are too large are never read. Bytes that are no UTF-8 become U+FFFD.
    """
    kept = _tree(spark, path, recursive, excluded, max_bytes).where(F.col("length") <= max_bytes).where("skipped is null")
    return kept.select("file", F.decode("content", "UTF-8").alias("content"), "language", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
