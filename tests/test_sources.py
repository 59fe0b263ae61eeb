"""Files, manifests, diffs, patterns, taint and streams on small fixtures."""

import datetime
import re

from pyspark.sql import functions as F

from talonscan.functions.patterns import glob_regex, java_regex
from talonscan.operators import config, middleware, packages, routes, rules, taint
from talonscan.sources import diffs, files, manifests
from talonscan.streaming import incremental


def test_read_tree(spark, tmp_path):
    for name, text in {"src/a.ts": "const x = 1\n", "node_modules/p/b.js": "no", "Dockerfile": "FROM a", "c.bin": "no", "d.min.js": "no", "big.py": "x" * 2000}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = files.read_tree(spark, str(tmp_path), max_bytes=1000).select("file", "content", "language").collect()
    assert sorted(map(tuple, got)) == [("Dockerfile", "FROM a", "dockerfile"), ("src/a.ts", "const x = 1\n", "typescript")]


def test_scan_directory(spark, tmp_path):
    """From a tree to its report: what is excluded is not counted, what is skipped is, with a reason."""
    from talonscan.operators import directory, kernel

    texts = {
        "src/a.ts": "eval(x);\neval(y); eval(z);\n", "src/b.mts": "const a = 1;", "src/c.js": "// eval(x)", "node_modules/p/x.js": "eval(x)", ".svelte-kit/y.js": "eval(x)", "obj/z.js": "eval(x)",
        "lib/v.umd.min.js": "eval(x)", "lib/w-bundle.js": "eval(x)", "lib/x.production.cjs": "eval(x)", "lib/UP.MIN.JS": "eval(x)", "logo.svg": "<svg/>", "big.py": "x" * 3000, "Dockerfile": "FROM a",
    }
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    pack = [kernel.Rule("VG014", "high", r"\beval\s*\(", ("javascript", "typescript")), kernel.Rule("VG200", "low", r"\AFROM\s", ("dockerfile",))]
    got = directory.scan_directory(spark, str(tmp_path), pack, max_bytes=2000)
    assert {(r.file, r.skipped) for r in got.skipped.collect()} == {("logo.svg", "unsupported"), ("big.py", "too large"), *((f"lib/{n}", "generated") for n in ("v.umd.min.js", "w-bundle.js", "x.production.cjs", "UP.MIN.JS"))}
    row = got.report.collect()[0]
    assert (row.scanned, row.skipped, row.unsupported, row.generated, row.total, row.high, row.files, row.score, row.grade, row.pack) == (4, 1, 1, 4, 3, 2, 2, 50, "C", 2)
    assert [tuple(r) for r in got.ranking.collect()] == [("src/a.ts", 2), ("Dockerfile", 1)]
    assert {r.file for r in got.hashes.collect()} == {"src/a.ts", "src/b.mts", "src/c.js", "Dockerfile"}


def test_manifests(spark):
    rows = [
        ("a/package.json", '{"dependencies":{"x":"^1.2.3","@s/y":"latest"},"devDependencies":{"z":"~4"}}'),
        ("b/package.json", "no json"),
        ("package-lock.json", '{"packages":{"":{"version":"1"},"node_modules/q":{"version":"2.0.1"},"node_modules/q/node_modules/@s/r":{"version":"3.1"}}}'),
        ("old/package-lock.json", '{"dependencies":{"a":{"version":"1.0.0","dependencies":{"b":{"version":"2.0.0","dependencies":{"c":{"version":"3.0.0"}}},"d":"odd"}},"e":{"requires":{}}}}'),
        ("deep/package-lock.json", "[" * 100_000), ("listed/package-lock.json", '[{"dependencies": {}}]'),
        ("pnpm-lock.yaml", "lockfileVersion: 9\npackages:\n  '@s/n@1.2.3':\n    resolution: {integrity: x}\n  /o@4.5.6(react@18.0.0):\n  p@7.8.9:\n  p@link:x:\nq@1.0.0:\n"),
        ("yarn.lock", 'l@^1.0.0, l@^1.1.0:\n  version "1.1.5"\n  resolved "u"\n\n"@s/m@npm:^2":\n  version: 2.2.2\n'),
        ("requirements.txt", "Flask==2.0 # c\n# no\nrequests>=1\n-r other.txt\n"),
        ("go.mod", "module example.com/m\n\ngo 1.20\n\nrequire (\n\tgithub.com/a/b v1.2.3\n)\nrequire golang.org/x/y v0.1.0 // indirect\n"),
        ("other.txt", "x==1"), ("null/package.json", None),
    ]
    got = manifests.manifests(spark.createDataFrame(rows, "file string, content string")).collect()
    assert {tuple(r) for r in got} == {
        ("a/package.json", "x", "1.2.3", "npm"), ("a/package.json", "@s/y", None, "npm"), ("a/package.json", "z", "4", "npm"),
        ("package-lock.json", "q", "2.0.1", "npm"), ("package-lock.json", "@s/r", "3.1", "npm"),
        ("old/package-lock.json", "a", "1.0.0", "npm"), ("old/package-lock.json", "b", "2.0.0", "npm"), ("old/package-lock.json", "c", "3.0.0", "npm"),
        ("pnpm-lock.yaml", "@s/n", "1.2.3", "npm"), ("pnpm-lock.yaml", "o", "4.5.6", "npm"), ("pnpm-lock.yaml", "p", "7.8.9", "npm"),
        ("yarn.lock", "l", "1.1.5", "npm"), ("yarn.lock", "@s/m", "2.2.2", "npm"),
        ("requirements.txt", "flask", "2.0", "PyPI"), ("requirements.txt", "requests", None, "PyPI"),
        ("go.mod", "github.com/a/b", "1.2.3", "Go"), ("go.mod", "golang.org/x/y", "0.1.0", "Go"),
    }


def test_versions(spark):
    order = ["0.9", "1.2.3-beta.1", "1.2.3", "v1.2.3.4", "1.2.10", "1.10", "2"]
    keys = [tuple(r.k) for r in spark.createDataFrame([(n, v) for n, v in enumerate(order)], "n int, v string").orderBy("n").select(packages.version_key(F.col("v")).alias("k")).collect()]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    odd = spark.createDataFrame([("latest",), ("",), (None,), ("99999999999.1",)], "v string").select(packages.version_key(F.col("v")).alias("k")).collect()
    assert [r.k[:2] for r in odd] == [[0, 0], [0, 0], [0, 0], [0, 1]]


def test_diff(spark):
    text = "--- a/f\n+++ b/f\n@@ -1,2 +1,3 @@\n keep\n+two\n-gone\n+three\n\\ No newline\n@@ -9 +20 @@ f()\n+twenty\n"
    df = spark.createDataFrame([("f", text), ("g", None), ("h", "")], "file string, diff string")
    assert sorted(map(tuple, diffs.added_lines(df).collect())) == [("f", 2), ("f", 3), ("f", 20)]
    assert sorted(map(tuple, diffs.hunks(df).collect())) == [("f", 1, 3), ("f", 20, 1)]


def test_patterns(spark):
    for source, flags, text, want in [
        ("^[a[]$", "", "[", True), ("a{b}", "", "a{b}", True), ("a$", "", "a\n", False), ("a$", "m", "a\n", True), ("A", "i", "a", True),
        (r"a\sb", "", "a b", True), ("[&&a]", "", "&", True), ("x{2,}", "", "xx", True), ("[]", "", "a", False), (r"a\Sb", "", "a b", False),
    ]:
        df = spark.createDataFrame([(text,)], "t string")
        assert df.where(df.t.rlike(java_regex(source, flags))).count() == want, source
    assert re.search(glob_regex("src/*.ts"), "src/a/b.ts") and not re.search(glob_regex("src/*.ts"), "x/src/a.ts")
    assert re.search(glob_regex("b.ts"), "a/b.ts") and not re.search(glob_regex("b.ts"), "a/bxts")


def test_matches_and_lines(spark):
    df = spark.createDataFrame([("f", "a\nb\nx\ny\nx\ny"), ("g", ""), ("h", None)], "file string, content string")
    got = rules.all_matches(df, [("R", "low", "x\ny"), ("S", "low", "[ab]")]).select("file", "rule_id", "nth", "line", "match").collect()
    assert sorted(map(tuple, got)) == [("f", "R", 0, 3, "x\ny"), ("f", "R", 1, 5, "x\ny"), ("f", "S", 0, 1, "a"), ("f", "S", 1, 2, "b")]


def test_load_pack(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"rule_id":"A","severity":"low","pattern":"a$","flags":"i"}\n{"rule_id":"B","severity":"high","pattern":"b"}\n')
    assert rules.load_pack(spark, str(tmp_path / "p.json")) == [("A", "low", r"(?i)a\z"), ("B", "high", "b")]


def test_taint():
    code = "const a = req.body.x;\nconst b = a + 1;\nconst c = b;\neval(c);\neval(ab);\nconst s = parseInt(a);\neval(s);\nredirect(req.query.u);"
    assert list(taint.flows(code)) == [
        ("http-input", 1, "c", "code-injection", "critical", 4, ["a", "b", "c"]),
        ("http-input", 8, None, "open-redirect", "medium", 8, []),
    ]
    assert not list(taint.flows(None)) and not list(taint.flows(""))
    long = "const v0 = req.body;\n" + "".join(f"const v{i + 1} = v{i};\n" for i in range(3000)) + "eval(v3000)"
    assert len(next(taint.flows(long))[-1]) == 3001


def test_imports_and_routes(spark):
    code = "import a from 'x/y'\nimport './z'\nconst q = require(\"@s/p/q\")\nawait import('node:fs')"
    df = spark.createDataFrame([("app/(g)/api/u/route.ts", code + "\nexport async function GET() {}\nexport const POST = 1"), ("app/n/route.ts", None)], "file string, content string")
    assert {r.name for r in packages.import_roots(df).collect()} == {"x", "@s/p"}
    assert sorted((r.url, r.method) for r in routes.routes(df).collect()) == [("/api/u", "GET"), ("/api/u", "POST")]


def test_streams(spark, tmp_path):
    at = datetime.datetime(2026, 1, 1)
    rows = [("f", "licensed under x", at), ("f", "licensed under x", at), ("g", None, at)]
    spark.createDataFrame(rows, incremental.FILES).write.parquet(str(tmp_path / "in"))
    found = incremental.scan_stream(incremental.read_files(spark, str(tmp_path / "in")))
    run = found.writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    assert [tuple(r) for r in spark.table("found").collect()] == [("f", 1, "T005", "info")]


def test_long_lines(spark):
    """One line of a million characters neither overflows a stack nor loses what is in it."""
    n = 1_000_000
    lines = ["await " + "a." * (n // 2) + "requireAuth()", "await " + "a" * n, "session" + " " * n, "x" * n + " Unauthorized"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, t string")
    got = rows.select("i", middleware.has_guard(rows.t, ["mine"]).alias("g")).collect()
    assert sorted(map(tuple, got)) == [(0, True), (1, False), (2, False), (3, True)]
    changes = [("f", "debug " + "x" * n, "y" * n + " privileged: true"), ("g", "a", "sameSite" + "." * n), ("h", None, "`" + "x" * n)]
    found = config.config_changes(spark.createDataFrame(changes, "file string, before string, after string")).collect()
    assert [(r.file, r.title) for r in found] == [("f", "Privileged mode enabled")]
    host = spark.createDataFrame([("s", '{"hooks": {"Stop": [{"command": "' + "a; " * (n // 3) + '"}]}, "allowedTools": ["' + "t" * n + '*"]}')], "file string, content string")
    assert [r.rule_id for r in config.host_settings(host).collect()] == ["VG884"]


def test_flows_across_files_grow_in_proportion():
    """Calls and functions of a long file are found without counting from its start."""
    import time

    from talonscan.operators import crossfile

    def took(n):
        text = "import { f } from './g';\nconst a = req.body.x;\n" + "".join(f"f(a, {k});\nexport function g{k}(q) {{\n  eval(q);\n}}\n" for k in range(n))
        began = time.process_time()
        assert len(list(crossfile.calls("a.ts", text))) == n and len(list(crossfile.entries("a.ts", text))) == n
        return time.process_time() - began

    took(100)
    assert took(8000) < 7 * took(2000) + 0.5
