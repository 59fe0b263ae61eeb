"""Repositories as tables: objects, commits, entries of trees, changes of commits, the index.

Loose objects and packs are read by Spark's file reader, a file a row; each object becomes a row, so history is data like any other. What a commit
changes is found by a walk of all commits at once down their trees: a round joins the entries of the trees that differ from those of the parent's,
so there are as many rounds as folders are deep, and a tree that is the same is never opened.

Defined results: objects that cannot be read are left out; a commit is held against its first parent, a first commit against nothing; links to other
repositories are no files.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import OrderedDict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talonscan.functions.tables import discard, written

OBJECT = "repo string, id string, type string, data binary"
KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
#: Bytes of objects that a task keeps while it reads a pack, since later ones may build on them.
KEPT = 1 << 26
PIECE = 1 << 16


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, content) of the object files below folders like ``<repository>/.git``."""
    folders = [f"{p.rstrip('/')}/objects" for p in paths]
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folders).where(F.col("path").rlike(r"/objects/(?:[0-9a-f]{2}/[0-9a-f]{38}|pack/[^/]+\.pack)$")).select("path", "content")


def loose_object(data: bytes) -> tuple[str, bytes] | None:
    try:
        head, body = zlib.decompress(data).split(b"\0", 1)
    except (zlib.error, ValueError):
        return None
    return head.split(b" ")[0].decode("ascii", "replace"), body


class Pack:
    """Objects of a pack by their offset. Those built on others are made from them, which are read again where they are no longer kept."""

    def __init__(self, data: bytes) -> None:
        self.data, self.kept, self.size, self.known = data, OrderedDict(), 0, {}

    def inflate(self, at: int) -> tuple[bytes, int]:
        stream, out = zlib.decompressobj(), []
        while not stream.eof:
            if at >= len(self.data):
                raise zlib.error("end of pack")
            piece = self.data[at : at + PIECE]
            out.append(stream.decompress(piece))
            at += len(piece) - len(stream.unused_data)
        return b"".join(out), at

    def _head(self, at: int) -> tuple[int, int]:
        byte = self.data[at]
        kind = byte >> 4 & 7
        while byte & 128:
            at += 1
            byte = self.data[at]
        return kind, at + 1

    def read(self, start: int) -> tuple[str, bytes, int]:
        """(type, data, offset behind) of the object at an offset."""
        if start in self.kept:
            self.kept.move_to_end(start)
            return self.kept[start]
        chain, at = [], start
        while True:
            kind, head = self._head(at)
            if kind == 6:
                back, head = self._back(head)
                chain.append((head, at))
                at -= back
            elif kind == 7:
                chain.append((head + 20, at))
                at = self.known[self.data[head : head + 20]]
            else:
                break
        name, (data, end) = KINDS[kind], self.inflate(head)
        for body, _ in reversed(chain):
            delta, end = self.inflate(body)
            data = patched(data, delta)
        self.kept[start] = name, data, end
        self.size += len(data)
        while self.size > KEPT and len(self.kept) > 1:
            self.size -= len(self.kept.popitem(last=False)[1][1])
        return name, data, end

    def _back(self, at: int) -> tuple[int, int]:
        byte = self.data[at]
        back = byte & 127
        while byte & 128:
            at += 1
            byte = self.data[at]
            back = (back + 1 << 7) | byte & 127
        return back, at + 1

    def objects(self):
        count, at = int.from_bytes(self.data[8:12]), 12
        for _ in range(count):
            name, data, end = self.read(at)
            own = hashlib.sha1(f"{name} {len(data)}\0".encode() + data)
            self.known[own.digest()] = at
            yield own.hexdigest(), name, data
            at = end


def patched(base: bytes, delta: bytes) -> bytes:
    """An object made of copies from another and of new bytes."""
    at, out = 0, []
    for _ in range(2):  # both sizes
        while delta[at] & 128:
            at += 1
        at += 1
    while at < len(delta):
        op = delta[at]
        at += 1
        if op & 128:
            given = [0] * 7
            for bit in range(7):
                if op >> bit & 1:
                    given[bit] = delta[at]
                    at += 1
            first, size = int.from_bytes(bytes(given[:4]), "little"), int.from_bytes(bytes(given[4:]), "little") or 0x10000
            out.append(base[first : first + size])
        else:
            out.append(delta[at : at + op])
            at += op
    return b"".join(out)


def _read(batches):
    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary() if k == 3 else pa.string()) for k in range(4)], ["repo", "id", "type", "data"])

    for batch in batches:
        rows, size = [], 0
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            repo, _, name = path.rpartition("/objects/")
            repo = repo.removesuffix("/.git").rpartition("/")[2]
            if name.endswith(".pack"):
                found = Pack(content).objects()
            else:
                one = loose_object(content)
                found = [(name.replace("/", ""), *one)] if one else []
            try:
                for id_, kind, data in found:
                    rows.append((repo, id_, kind, data))
                    size += len(data)
                    if size > 1 << 24:
                        yield made(rows)
                        rows, size = [], 0
            except (zlib.error, IndexError, KeyError):
                continue  # the rest of a broken pack
        yield made(rows)


def objects(files: DataFrame) -> DataFrame:
    """(path, content) of object files to (repo, id, type, data), once an object. ``repo`` is the folder that holds ``.git``. A filter on type comes before the shuffle that drops repeats."""
    return files.select("path", "content").mapInArrow(_read, OBJECT).dropDuplicates(["repo", "id", "type"])


def commits(objects_: DataFrame) -> DataFrame:
    """(repo, id, tree, parents, committed, message)."""
    text = F.decode("data", "UTF-8")
    rows = objects_.where("type = 'commit'").select("repo", "id", F.split(text, "\n\n", 2).alias("p"))
    head = F.get("p", F.lit(0))
    when = F.regexp_extract(head, r"(?m)^committer .* (\d+) [+-]\d{4}$", 1).try_cast("bigint")
    return rows.select("repo", "id", F.regexp_extract(head, r"(?m)^tree ([0-9a-f]{40})$", 1).alias("tree"), F.regexp_extract_all(head, F.lit(r"(?m)^parent ([0-9a-f]{40})$"), F.lit(1)).alias("parents"), F.timestamp_seconds(when).alias("committed"), F.coalesce(F.get("p", F.lit(1)), F.lit("")).alias("message"))


def tree_entries(data: bytes) -> list[dict]:
    out, at = [], 0
    while at < len(data):
        space, end = data.index(b" ", at), data.index(b"\0", at)
        out.append({"mode": data[at:space].decode(), "name": data[space + 1 : end].decode("utf-8", "replace"), "id": data[end + 1 : end + 21].hex()})
        at = end + 21
    return out


def entries(objects_: DataFrame) -> DataFrame:
    """(repo, tree, mode, name, id) of trees."""

    @F.arrow_udf("array<struct<mode:string,name:string,id:string>>")
    def read(data: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("mode", pa.string()), ("name", pa.string()), ("id", pa.string())]))
        return pa.array([tree_entries(d) for d in data.to_pylist()], kind)

    return objects_.where("type = 'tree'").select("repo", F.col("id").alias("tree"), F.inline(read("data")))


def tree_changes(pairs: DataFrame, listed: DataFrame) -> DataFrame:
    """Pairs (repo, key, new, old) of trees, either null, to (repo, key, path, status, blob, was): files that differ, with A, M or D. ``listed`` are entries."""
    listed = written(listed.where("mode <> '160000'").select("repo", "tree", "name", (F.col("mode") == "40000").alias("folder"), "id"), "entries")
    frontier = pairs.where("not (new <=> old)").select("repo", "key", F.lit("").alias("at"), "new", "old")
    frontier, found, used = written(frontier, "frontier"), [], [listed]
    while True:
        used.append(frontier)
        side = lambda which: frontier.where(f"{which} is not null").join(listed, (frontier["repo"] == listed["repo"]) & (frontier[which] == listed["tree"])).select(frontier["repo"], "key", "at", "name", "folder", "id")
        a, b = side("new"), side("old").select(F.col("repo").alias("_r"), F.col("key").alias("_k"), F.col("at").alias("_a"), F.col("name").alias("_n"), F.col("folder").alias("_f"), F.col("id").alias("_i"))
        # a name that turns from file to folder is both a loss and a gain
        on = (a["repo"] == b["_r"]) & (a["key"] == b["_k"]) & (a["at"] == b["_a"]) & (a["name"] == b["_n"]) & (a["folder"] == b["_f"])
        both = a.join(b, on, "full").where("not (id <=> _i)")
        c = F.coalesce
        rows = both.select(c("repo", "_r").alias("repo"), c("key", "_k").alias("key"), F.concat(c("at", "_a"), c("name", "_n")).alias("path"), c("folder", "_f").alias("folder"), F.col("id").alias("new"), F.col("_i").alias("old"))
        step = written(rows, "step")
        status = F.when(F.col("old").isNull(), "A").when(F.col("new").isNull(), "D").otherwise("M")
        found.append(step.where("not folder").select("repo", "key", "path", status.alias("status"), F.col("new").alias("blob"), F.col("old").alias("was")))
        deeper = step.where("folder")
        if not deeper.limit(1).count():
            break
        frontier = written(deeper.select("repo", "key", F.concat("path", F.lit("/")).alias("at"), "new", "old"), "frontier")
    for table in used:
        discard(table)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def changes(objects_: DataFrame) -> DataFrame:
    """(repo, commit, path, status, blob, was) of every commit against its first parent."""
    all_ = commits(objects_)
    parent = all_.select(F.col("repo").alias("_r"), F.col("id").alias("_id"), F.col("tree").alias("old"))
    pairs = all_.select("repo", F.col("id").alias("key"), F.col("tree").alias("new"), F.get("parents", F.lit(0)).alias("first"))
    pairs = pairs.join(parent, (F.col("repo") == F.col("_r")) & (F.col("first") == F.col("_id")), "left")
    return tree_changes(pairs.select("repo", "key", "new", "old"), entries(objects_)).withColumnRenamed("key", "commit")


def files_of(objects_: DataFrame, heads: DataFrame) -> DataFrame:
    """All files of commits (repo, commit): (repo, commit, path, blob)."""
    at = commits(objects_).join(heads.select(F.col("repo").alias("_r"), "commit"), (F.col("repo") == F.col("_r")) & (F.col("id") == F.col("commit")))
    pairs = at.select("repo", F.col("commit").alias("key"), F.col("tree").alias("new"), F.lit(None).cast("string").alias("old"))
    return tree_changes(pairs, entries(objects_)).select("repo", F.col("key").alias("commit"), "path", "blob")


def tips(objects_: DataFrame) -> DataFrame:
    """(repo, commit) of commits that no commit is built on."""
    all_ = commits(objects_)
    parents = all_.select(F.col("repo").alias("_r"), F.explode("parents").alias("_p")).distinct()
    return all_.join(parents, (F.col("repo") == F.col("_r")) & (F.col("id") == F.col("_p")), "left_anti").select("repo", F.col("id").alias("commit"))


def texts(objects_: DataFrame) -> DataFrame:
    """(repo, blob, content) of blobs that hold no zero byte; bytes that are no UTF-8 become U+FFFD."""
    return objects_.where("type = 'blob'").where(F.expr("position(x'00' in data) = 0")).select("repo", F.col("id").alias("blob"), F.decode("data", "UTF-8").alias("content"))


def index_entries(data: bytes) -> list[dict]:
    """(path, blob) of an index of version 2 or 3; none of another."""
    if data[:4] != b"DIRC" or int.from_bytes(data[4:8]) not in (2, 3):
        return []
    out, at = [], 12
    for _ in range(int.from_bytes(data[8:12])):
        flags = int.from_bytes(data[at + 60 : at + 62])
        name = at + 62 + (2 if flags & 0x4000 else 0)
        end = data.index(b"\0", name)
        out.append({"path": data[name:end].decode("utf-8", "replace"), "blob": data[at + 40 : at + 60].hex()})
        at += (end - at + 8) // 8 * 8
    return out


def staged(indexes: DataFrame, head_files: DataFrame) -> DataFrame:
    """(repo, content) of indexes and (repo, path, blob) of the files of their heads to (repo, path, status, blob): what the next commit changes."""

    @F.arrow_udf("array<struct<path:string,blob:string>>")
    def read(data: pa.Array) -> pa.Array:
        return pa.array([index_entries(d or b"") for d in data.to_pylist()], pa.list_(pa.struct([("path", pa.string()), ("blob", pa.string())])))

    now = indexes.select("repo", F.inline(read("content")))
    was = head_files.select(F.col("repo").alias("_r"), F.col("path").alias("_p"), F.col("blob").alias("_b"))
    both = now.join(was, (F.col("repo") == F.col("_r")) & (F.col("path") == F.col("_p")), "full").where("not (blob <=> _b)")
    status = F.when(F.col("_b").isNull(), "A").when(F.col("blob").isNull(), "D").otherwise("M")
    return both.select(F.coalesce("repo", "_r").alias("repo"), F.coalesce("path", "_p").alias("path"), status.alias("status"), "blob")
