"""What projects import, declare and define themselves: packages that nothing declares.

Names that a configuration of the compiler makes local (``paths``, and whatever lies in ``baseUrl``) are no packages. The configurations of a
project are few; what lies in their folders comes from the paths of its files, by an equi join on project and folder.
"""

from __future__ import annotations

import json
import posixpath
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talonscan.operators.context import TOKENS
from talonscan.sources.manifests import package_json

#: Statements that import, modules that are part of the runtime, extensions of code.
STATEMENTS = [
    r"^\s*(?:import|export)\b[^'\";]*?\bfrom\s+['\"]([^'\"]+)['\"]",
    r"^\s*import\s+['\"]([^'\"]+)['\"]",
    r"^\s*(?:await\s+)?import\s*\(\s*['\"]([^'\"]+)['\"]\s*\)",
    r"^\s*(?:(?:const|let|var)\s+[^=\n]+=\s*)?require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)",
]
BUILT_IN = set(
    "assert async_hooks buffer child_process cluster console constants crypto dgram diagnostics_channel dns domain events fs http http2 https inspector module net os path perf_hooks process "
    "punycode querystring readline repl stream string_decoder sys test timers tls trace_events tty url util v8 vm wasi worker_threads zlib".split()
)
CODE = r"\.(?:ts|tsx|js|jsx|mjs|cjs|mts|cts)\z"
CONFIGS = ["tsconfig.json", "jsconfig.json"]
SKIPPED = ["node_modules", ".git", ".next", "build", "dist", "coverage"]
_STATEMENTS = [re.compile(p, re.M) for p in STATEMENTS]


def bare_code(text: str) -> str:
    """Code without comments and templates; line breaks stay."""
    kept = lambda m: m[0] if m[0][0] in "'\"" else re.sub(r"[^\n]+", " ", m[0])
    return TOKENS.sub(kept, text)


def statement_imports(text: str | None) -> list[str]:
    """Packages that statements of a text import, sorted."""
    found = set()
    code = bare_code(text or "")
    for pattern in _STATEMENTS:
        for m in pattern.finditer(code):
            spec = m[1]
            if spec.startswith(("@/", "~", ".", "/", "#", "node:")):
                continue
            root = "/".join(spec.split("/")[: 2 if spec[0] == "@" else 1])
            if root and root not in BUILT_IN:
                found.add(root)
    return sorted(found)


def imported(files: DataFrame) -> DataFrame:
    """(project, file, content) to distinct (project, name)."""

    @F.arrow_udf("array<string>")
    def read(texts: pa.Array) -> pa.Array:
        return pa.array([statement_imports(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    code = files.where(F.col("file").rlike(CODE) & F.col("content").rlike(r"\b(?:import|require|export)\b"))
    return code.select("project", F.explode(read("content")).alias("name")).distinct()


def read_config(file: str, text: str) -> tuple[list[str], str] | None:
    """Names that ``paths`` makes local, and the folder whose entries are; None for text that is no configuration. Comments and trailing commas are allowed."""
    plain = TOKENS.sub(lambda m: "" if m[0].startswith("/") else m[0], text or "")
    try:
        given = json.loads(re.sub(r",(\s*[}\]])", r"\1", plain))
    except (ValueError, RecursionError):
        given = None
    options = given.get("compilerOptions") if isinstance(given, dict) else None
    options = options if isinstance(options, dict) else {}
    paths = options.get("paths") if isinstance(options.get("paths"), dict) else {}
    names = sorted({n for k in paths if (n := re.sub(r"/\*?$", "", k).split("/")[0])})
    base = options.get("baseUrl") if isinstance(options.get("baseUrl"), str) else "."
    folder = posixpath.normpath(posixpath.join(posixpath.dirname(file), base))
    return names, "" if folder == "." else folder


def local_names(files: DataFrame) -> DataFrame:
    """Distinct (project, name) that configurations of the compiler make local."""

    def run(batches):
        for b in batches:
            read = [read_config(f, t) for f, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in read], pa.list_(pa.string())), pa.array([f for _, f in read], pa.string())], ["project", "names", "folder"])

    named = F.element_at(F.split("file", "/"), -1)
    parts = F.split("file", "/")
    usable = ~F.arrays_overlap(parts, F.array(*map(F.lit, SKIPPED)))
    configs = files.where(named.isin(CONFIGS) & usable).select(F.col("project").cast("string").alias("project"), "file", "content").mapInArrow(run, "project string, names array<string>, folder string")
    places = files.select(F.col("project").cast("string").alias("project"), "file").where(usable).join(configs.select("project").distinct(), "project", "left_semi")
    # each file is an entry, or below an entry, of each folder above it
    n = F.size(parts)
    entry = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i - 1), "/").alias("folder"), F.get(parts, i - 1).alias("name"), (i == n).alias("leaf")))
    entries = places.select("project", F.inline(entry)).where(~F.col("leaf") | F.col("name").rlike(CODE))
    entries = entries.select("project", "folder", F.when(F.col("leaf"), F.regexp_replace("name", CODE, "")).otherwise(F.col("name")).alias("name")).distinct()
    inside = entries.join(configs.select("project", "folder").distinct(), ["project", "folder"], "left_semi").select("project", "name")
    return configs.select("project", F.explode("names").alias("name")).unionByName(inside).distinct()


def declared(files: DataFrame) -> DataFrame:
    """Distinct (project, name): dependencies of any manifest of the project, and the manifests' own names."""
    manifests = files.where(F.col("file").rlike(r"(?:^|/)package\.json$") & ~F.arrays_overlap(F.split("file", "/"), F.array(*map(F.lit, SKIPPED))))
    keyed = manifests.select(F.concat_ws("/", F.col("project").cast("string"), F.lit("package.json")).alias("file"), "content")
    project = F.regexp_replace("file", r"/package\.json\z", "")
    own = keyed.select(project.alias("project"), F.get_json_object("content", "$.name").alias("name")).where("name is not null")
    return package_json(keyed).select(project.alias("project"), "name").unionByName(own).distinct()


def undeclared(files: DataFrame, allowed: list[str] = ()) -> DataFrame:
    """(project, file, content) to (project, name) of packages that a project imports and neither declares nor defines."""
    files = files.select(F.col("project").cast("string").alias("project"), "file", "content").where("file is not null")
    names = imported(files).where(~F.col("name").isin(list(allowed)) if allowed else F.lit(True))
    return names.join(declared(files), ["project", "name"], "left_anti").join(local_names(files), ["project", "name"], "left_anti")
