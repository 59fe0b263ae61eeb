"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts are runs of anything but these characters.
WORD_SPLIT = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor can reach.

    ``spark.checkpoint.dir`` names it on a cluster; a folder of our own is used
    only where that setting is absent (tests, single machine).
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        found = "file://" + tempfile.mkdtemp(prefix="talonscan-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def crc32_sql(text: str) -> str:
    """DuckDB expression for the unsigned CRC-32 of an ASCII string, bit by bit."""
    bits = f"list_transform(range(0, 8 * strlen({text})), lambda b: (ascii(substr({text}, cast(b // 8 + 1 as bigint), 1)) >> cast(b % 8 as int)) & 1)"
    step = "lambda c, m: xor(c >> 1, case when (c & 1) <> m then 3988292384 else 0 end)"
    return f"xor(list_reduce(list_concat([4294967295::bigint], {bits}), {step}), 4294967295)"


def materialize(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives executor loss. ``by`` is a column of few values to file rows by."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written = path
    return back


def discard(df: DataFrame) -> None:
    """Removes a table that ``materialize`` wrote and that nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._written)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps, which it does when unreferenced plans are collected."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def complete_groups(batches, least: int, take):
    """Feeds Arrow rows sorted by their first column to ``take`` as tables of whole groups, of ``least`` rows or more."""
    import pyarrow as pa

    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= least:
            whole = pa.Table.from_batches(held).combine_chunks()
            key = whole.column(0).to_numpy()
            cut = int(key.searchsorted(key[-1]))
            if cut:
                yield from take(whole.slice(0, cut))
            held = whole.slice(cut).to_batches()
            size -= cut
    if size:
        yield from take(pa.Table.from_batches(held).combine_chunks())


def min_label_components(links: DataFrame) -> DataFrame:
    """Connected components by minimum-label propagation with pointer jumping.

    ``links`` has (item bigint, hub bigint) rows: an item belongs to a hub, and items of
    one hub are connected. Hubs are item ids too. Returns (item, root), root being the
    smallest item id reachable. Labels are combined before they are shuffled; the joins on a hub or root, of which one may
    have very many members, are between plain shuffled tables, so that Spark's skew join splits it. Every round
    is written out, and the driver sees only a count. Null items or hubs are ignored.
    """
    links = links.where("item is not null and hub is not null and item <> hub")
    edges = materialize(
        links.select(F.col("item").alias("a"), F.col("hub").alias("b"))
        .union(links.select(F.col("hub").alias("a"), F.col("item").alias("b")))
        .distinct(),
        "edges",
    )
    labels = materialize(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")).withColumnRenamed("a", "item"), "labels")
    written = labels
    while True:
        near = (
            edges.join(labels, edges["b"] == labels["item"])
            .groupBy("a")
            .agg(F.min("root").alias("near"))
        )
        hop = (
            labels.join(near, labels["item"] == near["a"], "left")
            .select("item", F.col("root").alias("was"), F.least("root", F.coalesce("near", "root")).alias("step"))
        )
        jump = labels.select(F.col("item").alias("at"), F.col("root").alias("far"))
        new = materialize(
            hop.join(jump, F.col("step") == F.col("at"), "left").select(
                "item", F.least("step", F.coalesce("far", "step")).alias("root"), "was"
            ),
            "labels",
        )
        changed = new.where("root <> was").limit(1).count()
        discard(written)
        written, labels = new, new.select("item", "root")
        if not changed:
            discard(edges)
            return labels
