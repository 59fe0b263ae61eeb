"""Manifests and lock files as rows (file, name, version, ecosystem)."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECTIONS = ["dependencies", "devDependencies", "peerDependencies", "optionalDependencies"]
NAMES = r"(?:^|/)(?:package\.json|package-lock\.json|yarn\.lock|pnpm-lock\.ya?ml|requirements[^/]*\.txt|go\.mod)$"


def clean_version(version: Column) -> Column:
    """The first dotted number of a range; null for tags, links and paths."""
    found = F.regexp_extract(version, r"^[\s^~>=<v]*(\d+(?:\.\d+)*(?:[-+][0-9A-Za-z.+-]+)?)", 1)
    return F.nullif(found, F.lit(""))


def _named(files: DataFrame, pattern: str) -> DataFrame:
    return files.where(F.col("file").rlike(rf"(?:^|/){pattern}$"))


def package_json(files: DataFrame) -> DataFrame:
    schema = ", ".join(f"{s} map<string,string>" for s in SECTIONS)
    parsed = _named(files, r"package\.json").select("file", F.from_json("content", schema).alias("j"))
    held = F.flatten(F.array(*[F.coalesce(F.map_entries(F.col(f"j.{s}")), F.expr("cast(array() as array<struct<key:string,value:string>>)")) for s in SECTIONS]))
    rows = parsed.select("file", F.explode(held).alias("e"))
    return rows.select("file", F.col("e.key").alias("name"), clean_version(F.col("e.value")).alias("version"), F.lit("npm").alias("ecosystem"))


def nested_packages(text: str | None):
    """(name, version) of the dependencies of a version 1 lock at any depth; none where the text is no such JSON."""
    try:
        lock = json.loads(text or "")
    except (ValueError, RecursionError):
        return
    todo = [lock]
    while todo:
        held = todo.pop()
        held = held.get("dependencies") if isinstance(held, dict) else None
        for name, entry in held.items() if isinstance(held, dict) else ():
            if isinstance(entry, dict):
                if isinstance(entry.get("version"), str) and entry["version"]:
                    yield name, entry["version"]
                todo.append(entry)


def package_lock(files: DataFrame) -> DataFrame:
    """Versions 2 and 3: keys of packages name paths below node_modules. Version 1, where packages give nothing: dependencies, which nest to any depth and so go through Python."""
    parsed = _named(files, r"package-lock\.json").select("file", "content", F.from_json("content", "packages map<string, struct<version: string>>")["packages"].alias("p"))
    name = lambda at: F.regexp_extract(at, r"node_modules/((?:@[^/]+/)?[^/]+)$", 1)
    pairs = F.transform(F.map_entries("p"), lambda e: F.struct(name(e["key"]).alias("name"), e["value"]["version"].alias("version")))
    own = parsed.select("file", "content", F.filter(pairs, lambda e: (e["name"] != "") & e["version"].isNotNull()).alias("own"))

    def nested(batches):
        for batch in batches:
            rows = [(f, *x) for f, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in nested_packages(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], ["file", "name", "version"])

    older = own.where("coalesce(size(own), 0) <= 0").select("file", "content").mapInArrow(nested, "file string, name string, version string")
    return own.select("file", F.inline("own")).unionByName(older).withColumn("ecosystem", F.lit("npm"))


def pnpm_lock(files: DataFrame) -> DataFrame:
    """Keys name@version, quoted or not, with or without a slash before."""
    shape = r"""^\s+['"]?/?(@?[a-zA-Z0-9][\w./-]*?)@(\d[^:'"\s]*)['"]?\s*:"""
    rows = _lines(_named(files, r"pnpm-lock\.ya?ml")).where(F.col("line").rlike(shape))
    version = clean_version(F.regexp_extract("line", shape, 2))
    return rows.select("file", F.regexp_extract("line", shape, 1).alias("name"), version.alias("version"), F.lit("npm").alias("ecosystem")).where("version is not null").distinct()


def _lines(files: DataFrame) -> DataFrame:
    return files.select("file", F.posexplode(F.split("content", r"\r?\n", -1)).alias("pos", "line"))


def yarn_lock(files: DataFrame) -> DataFrame:
    """Both formats: a version line belongs to the last header above it."""
    lines = _lines(_named(files, r"yarn\.lock")).where(r"line rlike '^(?:\\S.*:|\\s+version:?\\s)'")
    head = F.when(F.col("line").rlike(r"^\S"), F.regexp_extract("line", r"""^"?((?:@[^/@"]+/)?[^@"\s]+)@""", 1))
    w = Window.partitionBy("file").orderBy("pos")
    rows = lines.withColumn("name", F.last(head, ignorenulls=True).over(w)).where(r"line rlike '^\\s+version'")
    version = F.regexp_extract("line", r"""version:?\s+"?([^"\s]+)""", 1)
    return rows.select("file", "name", version.alias("version"), F.lit("npm").alias("ecosystem")).where("name <> ''").distinct()


def requirements(files: DataFrame) -> DataFrame:
    found = F.regexp_extract("line", r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)", 1)
    version = F.nullif(F.regexp_extract("line", r"==\s*([^\s;,#]+)", 1), F.lit(""))
    rows = _lines(_named(files, r"requirements[^/]*\.txt"))
    return rows.select("file", F.lower(found).alias("name"), version.alias("version"), F.lit("PyPI").alias("ecosystem")).where("name <> ''")


def go_mod(files: DataFrame) -> DataFrame:
    shape = r"^\s*(?:require\s+)?([\w.-]+\.[\w.-]+/[^\s]+)\s+v([^\s/]+)"
    rows = _lines(_named(files, r"go\.mod")).where(F.col("line").rlike(shape) & ~F.col("line").rlike("^\\s*(?:replace|exclude|module)\\b|=>"))
    return rows.select("file", F.regexp_extract("line", shape, 1).alias("name"), F.regexp_extract("line", shape, 2).alias("version"), F.lit("Go").alias("ecosystem"))


def manifests(files: DataFrame) -> DataFrame:
    """All formats; each package once for a file. Files that are no manifest go first."""
    files = files.where(F.col("file").rlike(NAMES)).select("file", "content")
    out = package_json(files)
    for read in (package_lock, yarn_lock, pnpm_lock, requirements, go_mod):
        out = out.unionByName(read(files))
    return out.distinct()
