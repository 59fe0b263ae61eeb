"""Queries on tables of a shape that the small ones do not have, against their SQL."""

import time

import duckdb
from pyspark.sql import functions as F

from talonscan.operators import surface
from talonscan.plans import registry

SF = "/root/testdata/sf0.001"


def same_as_sql(spark, name, folder, parts=()):
    """The rows of a query over a folder, which are those of its SQL; ``parts`` are tables that are directories."""
    got = registry.queries()[name](spark, folder)
    db = duckdb.connect()
    for t in "supplier part lineitem documents".split():
        db.execute(f"create view {t} as select * from '{folder}/{t}.parquet{'/*.parquet' if t in parts else ''}'")
    want = db.execute(registry.oracle_sql()[name])
    got, want = (sorted(tuple(map(str, r)) for r in x) for x in (got.select(*[d[0] for d in want.description]).collect(), want.fetchall()))
    assert got == want
    return got


def folder_of(tmp_path, **tables):
    """A folder with the tables of SF, some of them replaced by a query over it."""
    db = duckdb.connect()
    for t in "supplier part lineitem documents".split():
        db.execute(f"copy ({tables.get(t, 'select * from {t}').format(t=f"'{SF}/{t}.parquet'")}) to '{tmp_path}/{t}.parquet' (format parquet)")
    return str(tmp_path)


def test_baseline_without_fixed_findings(spark, tmp_path):
    folder = folder_of(tmp_path, lineitem="select * replace (timestamp '1996-06-01' as l_shipdate) from {t}")
    assert same_as_sql(spark, "baseline_diff", folder) == [("fixed", "0"), ("unchanged", "6000")]
    (tmp_path / "empty").mkdir()
    assert same_as_sql(spark, "baseline_diff", folder_of(tmp_path / "empty", lineitem="select * from {t} where false")) == [("fixed", "0")]


def test_streams_of_a_table_in_parts(spark, tmp_path):
    folder = folder_of(tmp_path, documents="select * from {t} where false")
    (tmp_path / "documents.parquet").unlink()
    spark.read.parquet(f"{SF}/documents.parquet").repartition(3).write.parquet(f"{folder}/documents.parquet")
    assert same_as_sql(spark, "stream_findings", folder, ["documents"])


def test_stream_of_equal_rows(spark, tmp_path):
    """Rows with one id and text, or without an id, are rows of the table each."""
    docs = "select * from {t} union all select * from {t} where doc_id < 50 union all select * replace (null as doc_id) from {t} where doc_id < 20 union all select * replace (null as doc_id) from {t} where doc_id < 20"
    assert same_as_sql(spark, "stream_findings", folder_of(tmp_path, documents=docs))


def test_merged_tags_of_many_rows(spark):
    """Time goes with the distinct tags of a rule, not with the rows that name them."""
    tags = spark.range(200_000).select(F.lit("R").alias("rule_id"), F.array(F.concat(F.lit("t"), F.col("id") % 3), F.lit("gdpr"), F.lit(None).cast("string")).alias("tags"))
    found = spark.range(20_000).select(F.lit("R").alias("rule_id"), F.array(F.lit("t1")).alias("tags"), "id")
    began = time.time()
    got = surface.tagged(found, tags).groupBy("tags").count().collect()
    assert [(r.tags, r["count"]) for r in got] == [(["t1", "gdpr", "t0", "t2", None], 20_000)]
    assert time.time() - began < 30


def test_triage_of_repeated_and_missing_keys(spark, tmp_path):
    part = "select * from {t} union all select * from {t} where p_partkey < 60 union all select * replace (null as p_partkey) from {t} where p_partkey < 20 union all select * replace (-p_partkey - 1 as p_partkey) from {t} where p_partkey < 20"
    assert same_as_sql(spark, "prompt_triage", folder_of(tmp_path, part=part))


def test_triage_broadcasts_no_requests(spark):
    """Only the index of rules is broadcast, however small Spark takes the table of requests for."""
    plan = registry.queries()["prompt_triage"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") == 1 and "BuildLeft" not in plan
