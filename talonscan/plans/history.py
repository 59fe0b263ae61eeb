"""Histories of repositories that Spark writes from the suppliers, and what has to be found in them. Same form as ``registry``.

Each supplier is a repository of three commits, as files of loose objects: a secret that goes, one that stays, files that come and go in folders.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from talonscan.operators import review, rules
from talonscan.plans.kernel import literals
from talonscan.sources import git

KEY = [("Key", "critical", r"\bAKIA[0-9A-Z]{16}\b")]
#: Files of each commit; {k} is the supplier's number.
VERSIONS = [
    {"src/k.txt": "id = AKIA{k:016d}", "readme": "hello {k}", "same/deep/x.txt": "x"},
    {"src/k.txt": "id = none", "readme": "hello {k}", "same/deep/x.txt": "x", "src/new/y.txt": "y {k}"},
    {"src/k.txt": "id = none", "same/deep/x.txt": "x", "src/new/y.txt": "y AKIAX{k:015d}", "src/new/z": "z"},
]
#: commit, path, status.
CHANGED = [
    (1, "readme", "A"), (1, "same/deep/x.txt", "A"), (1, "src/k.txt", "A"), (2, "src/k.txt", "M"), (2, "src/new/y.txt", "A"), (3, "readme", "D"), (3, "src/new/y.txt", "M"), (3, "src/new/z", "A"),
]
SECRETS = [("src/k.txt", "2026-01-01", "2026-01-01", "removed"), ("src/new/y.txt", "2026-01-03", "2026-01-03", "active")]
START, DAY = 1767225600, 86400


def loose_files(k: int):
    """(path, content) of the object files of a supplier's repository."""
    made = {}

    def put(kind: str, body: bytes) -> str:
        whole = f"{kind} {len(body)}\0".encode() + body
        id_ = hashlib.sha1(whole).hexdigest()
        made[id_] = zlib.compress(whole)
        return id_

    def tree(files: dict[str, str]) -> str:
        rows, folders = [], {}
        for path, text in files.items():
            folder, _, rest = path.partition("/")
            if rest:
                folders.setdefault(folder, {})[rest] = text
            else:
                rows.append((path, b"100644", put("blob", text.encode())))
        rows += [(name, b"40000", tree(inside)) for name, inside in folders.items()]
        return put("tree", b"".join(mode + b" " + name.encode() + b"\0" + bytes.fromhex(id_) for name, mode, id_ in sorted(rows)))

    parent = ""
    for n, version in enumerate(VERSIONS):
        who = f"a <a@example.com> {START + n * DAY} +0000"
        root = tree({p: t.format(k=k) for p, t in version.items()})
        parent = put("commit", f"tree {root}\n{parent}author {who}\ncommitter {who}\n\nstep {n + 1}\n".encode())
        parent = f"parent {parent}\n"
    return [(f"/r/s{k}/.git/objects/{i[:2]}/{i[2:]}", data) for i, data in made.items()]


def _objects(s, d):
    def run(batches):
        for b in batches:
            rows = [r for k in b.column(0).to_pylist() for r in loose_files(k)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["path", "content"])

    return git.objects(s.read.parquet(f"{d}/supplier.parquet").select("s_suppkey").mapInArrow(run, "path string, content binary"))


def _changes(s, d):
    held = _objects(s, d)
    found = git.changes(held).join(git.commits(held).select("repo", F.col("id").alias("commit"), "message"), ["repo", "commit"])
    nth = F.regexp_extract("message", r"(\d+)", 1).cast("int")
    return found.groupBy(nth.alias("nth"), "path", "status").agg(F.count("*").alias("repositories"))


def _secrets(s, d):
    held = _objects(s, d)
    blobs = git.texts(held).select(F.concat_ws(" ", "repo", "blob").alias("file"), "content")
    hit = rules.all_matches(blobs, KEY).select(F.split_part("file", F.lit(" "), F.lit(1)).alias("repo"), F.split_part("file", F.lit(" "), F.lit(2)).alias("blob"), F.col("match").alias("secret"))
    at = git.commits(held).select("repo", F.col("id").alias("commit"), "committed")
    path = F.concat_ws("/", "repo", "path").alias("file")
    seen = git.changes(held).where("blob is not null").join(hit, ["repo", "blob"]).join(at, ["repo", "commit"]).select(path, "secret", F.col("committed").alias("seen_at"))
    now = git.files_of(held, git.tips(held)).join(hit, ["repo", "blob"]).select(path, "secret")
    rows = review.secret_history(seen, now)
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return rows.groupBy(F.regexp_replace("file", "^[^/]*/", "").alias("path"), day("first_seen"), day("last_seen"), "status").agg(F.count("*").alias("repositories"))


def queries():
    return {"history_changes": _changes, "history_secrets": _secrets}


def oracle_sql():
    each = lambda columns, rows: f"with e({columns}) as (values {literals(rows)}) select {columns}, count(*) as repositories from e, supplier group by all"
    return {"history_changes": each("nth, path, status", CHANGED), "history_secrets": each("path, first_seen, last_seen, status", SECRETS)}
