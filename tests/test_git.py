"""The git source on repositories that git itself wrote."""

import os
import subprocess

import pytest
from pyspark.sql import functions as F

from talonscan.sources import git

ENV = {**os.environ, "GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@example.com", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@example.com", "GIT_CONFIG_GLOBAL": "/dev/null", "GIT_CONFIG_NOSYSTEM": "1"}


def run(folder, *words, at=0):
    when = f"{1767225600 + at * 86400} +0000"
    return subprocess.run(["git", *words], cwd=folder, check=True, capture_output=True, text=True, env=ENV | {"GIT_AUTHOR_DATE": when, "GIT_COMMITTER_DATE": when}).stdout


def write(folder, files):
    for name, text in files.items():
        path = folder / name
        if text is None:
            path.unlink()
            continue
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())


STEPS = [
    {"a.txt": "one\n" * 500, "dir/b.txt": "b", "dir/sub/c.txt": "c", "bin": b"\0\1"},
    {"a.txt": "one\n" * 500 + "two\n", "dir/sub/c.txt": None, "dir/sub2/d ü.txt": "d"},
    {"a.txt": "zero\n" + "one\n" * 500 + "two\n", "dir/b.txt": None, "dir/b.txt/now-a-folder": "x"},
]


@pytest.fixture(params=["loose", "packed"])
def repository(tmp_path, request):
    folder = tmp_path / "repo"
    folder.mkdir()
    run(folder, "init", "-q", "-b", "main")
    for n, files in enumerate(STEPS):
        write(folder, files)
        run(folder, "add", "-A")
        run(folder, "commit", "-q", "-m", f"step {n}\n\nbody", at=n)
    if request.param == "packed":
        run(folder, "gc", "-q", "--aggressive")
    return folder


def test_history_is_as_git_shows_it(spark, repository):
    held = git.objects(git.read_files(spark, [f"{repository}/.git"])).cache()
    log = [x.split() for x in run(repository, "log", "--format=%H %T %ct").splitlines()]
    got = {(r.id, r.tree, r.t) for r in git.commits(held).withColumn("t", F.unix_timestamp("committed").cast("string")).collect()}
    assert got == {tuple(x) for x in log}
    assert {r.message for r in git.commits(held).collect()} == {f"step {n}\n\nbody\n" for n in range(3)}
    want = set()
    for commit, _, _ in log:
        raw = run(repository, "-c", "core.quotepath=off", "diff-tree", "-r", "--root", "--no-commit-id", "--no-renames", commit)
        want |= {(commit, line.split("\t")[1], line.split()[4]) for line in raw.splitlines()}
    assert {(r.commit, r.path, r.status) for r in git.changes(held).collect()} == want
    head = run(repository, "rev-parse", "HEAD").strip()
    assert [tuple(r) for r in git.tips(held).collect()] == [("repo", head)]
    listed = {(x.split("\t")[1], x.split()[2]) for x in run(repository, "-c", "core.quotepath=off", "ls-tree", "-r", "HEAD").splitlines()}
    assert {(r.path, r.blob) for r in git.files_of(held, git.tips(held)).collect()} == listed
    texts = {r.blob: r.content for r in git.texts(held).collect()}
    assert {texts.get(b) for p, b in listed if p == "a.txt"} == {STEPS[2]["a.txt"]} and not any(p == "bin" and b in texts for p, b in listed)


def test_staged_changes(spark, repository):
    write(repository, {"a.txt": "new", "fresh/e.txt": "e", "dir/sub2/d ü.txt": None})
    run(repository, "add", "-A")
    held = git.objects(git.read_files(spark, [f"{repository}/.git"]))
    index = spark.createDataFrame([("repo", (repository / ".git/index").read_bytes())], "repo string, content binary")
    found = {(r.path, r.status) for r in git.staged(index, git.files_of(held, git.tips(held))).collect()}
    raw = run(repository, "-c", "core.quotepath=off", "diff", "--cached", "--name-status", "--no-renames")
    assert found == {tuple(reversed(x.split("\t"))) for x in raw.splitlines()} and len(found) == 3


def test_broken_files_are_left_out(spark):
    rows = [("/r/x/.git/objects/ab/" + "c" * 38, bytearray(b"no zlib")), ("/r/x/.git/objects/pack/p.pack", bytearray(b"PACK\0\0\0\2\0\0\0\5")), ("/r/x/.git/objects/pack/q.pack", bytearray(b""))]
    assert git.objects(spark.createDataFrame(rows, "path string, content binary")).count() == 0
    assert git.index_entries(b"DIRC\0\0\0\4") == [] and git.index_entries(b"") == []


def test_a_pack_larger_than_what_is_kept(spark, repository, monkeypatch):
    monkeypatch.setattr(git, "KEPT", 10)
    packs = list((repository / ".git/objects/pack").glob("*.pack"))
    for p in packs:
        want = {line.split()[0] for line in run(repository, "verify-pack", "-v", str(p.with_suffix(".idx"))).splitlines() if len(line.split()[0]) == 40}
        assert {i for i, _, _ in git.Pack(p.read_bytes()).objects()} == want
