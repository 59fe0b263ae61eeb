"""The pattern kernel at the size that users have: large packs, large files, adversarial texts."""

import json
import time

import pytest
from pyspark.sql import functions as F

from talonscan.operators import context, kernel, prefilter, rules, signs
from talonscan.plans import pack
from talonscan.plans.kernel import SCRIPT, WORD

COLUMNS = "file string, path string, language string, framework string, content string"
RULES = [kernel.Rule("VG014", "high", r"\beval\s*\(", SCRIPT), kernel.Rule("VG001", "critical", r"(?i)(?:password|secret)\s*=\s*[\"'][^\"'\n]{6,}[\"']", SCRIPT), kernel.Rule("VG950", "high", r"\.findUnique\s*\(\s*\{", SCRIPT)]


def frame(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def large(n):
    """n blocks with two matches each, comments, strings, templates and a directive now and then."""
    out = []
    for k in range(n):
        out.append(f"async function f{k}(ctx, a) {{ eval(a{k}); }} // {k % 9}\n/* eval(no) */ const s{k} = 'it\\'s', t = `{k}`;\n")
        out.append(f"const secret{k} = 1; const password = \"a1b2c3{k}\"; db.t.findUnique({{ where: {{ id: a{k}.id }} }});" + (f" // {WORD}\n" if k % 50 == 0 else "\n"))
    return "".join(out)


def timed(spark, text):
    kernel.scan(frame(spark, [("w", "a.ts", "typescript", None, "eval(x)")]), RULES).count()
    began = time.time()
    found = kernel.scan(frame(spark, [("f", "src/a.ts", "typescript", None, text)]), RULES).groupBy("rule_id").count().collect()
    return time.time() - began, {r.rule_id: r["count"] for r in found}


def test_a_large_file_takes_seconds(spark):
    """500 KB with 10,000 matches; four times the text may take little more than four times as long."""
    small, _ = timed(spark, large(840))
    took, found = timed(spark, large(3360))
    assert len(large(3360)) > 500_000
    silenced = len([k for k in range(3360) if k % 50 == 0])
    assert found == {"VG014": 3360, "VG001": 3360 - silenced, "VG950": 3360 - silenced}
    assert took < 8 and took < 5 * small + 2


@pytest.mark.parametrize("make", [lambda t: rules.all_matches(t, [("A", "low", "a."), ("B", "low", "\n")]), lambda t: t.select(kernel.block_comments(F.col("content")).alias("c")), lambda t: t.select(kernel.directives(F.col("content"), WORD).alias("c"))])
def test_helpers_grow_in_proportion(spark, make):
    def took(n):
        text = "".join(f"ab /* c\n d */ 'x' // {WORD} VG001\n" for _ in range(n))
        began = time.time()
        make(spark.createDataFrame([("f", text)], "file string, content string")).write.format("noop").mode("overwrite").save()
        return time.time() - began

    took(100)
    assert took(16_000) < 6 * took(4_000) + 2


def test_one_line_of_many_matches(spark):
    text = "eval(a);'" * 20_000
    took, found = timed(spark, text)
    assert found == {"VG014": 20_000} and took < 8


def test_a_pack_of_375_rules_over_1000_files(spark, tmp_path):
    """The pack comes from a file, in the syntax of the rules' own language; every rule hits one file at least."""
    names = pack.WORDS
    lines = [json.dumps({"rule_id": f"P{n:03d}", "severity": "low", "pattern": rf"\b{p}\d+\s*\((?:[^()]|\([^()]*\))*\)", "flags": "i" if n % 2 else "", "languages": ["typescript"]}) for n, p in enumerate(names)]
    (tmp_path / "pack.json").write_text("\n".join(lines))
    loaded = kernel.load_rules(spark, str(tmp_path / "pack.json"))
    assert len(loaded) == 375 and all(prefilter.required(r.pattern) for r in loaded)
    body = "export function f(a: string) {\n  const rows = a.split(',').map((x) => x.trim());\n  return rows.length;\n}\n" * 8
    files = [(f"f{k}", f"src/f{k}.ts", "typescript", None, body + f"{names[k % 375]}{k}(1, (2));\n" + body) for k in range(1000)]
    frame(spark, files).repartition(4).write.parquet(str(tmp_path / "files"))
    table = spark.read.parquet(str(tmp_path / "files"))
    kernel.scan(table.limit(8), loaded).count()
    began = time.time()
    found = {(r.file, r.rule_id) for r in kernel.scan(table, loaded).collect()}
    took = time.time() - began
    assert found == {(f"f{k}", f"P{k % 375:03d}") for k in range(1000)}
    assert took < 12


HOSTILE = [
    "a" * 50_000, " " * 50_000, "(" * 20_000, "[" * 20_000, "{" * 20_000, '"' * 20_000, "`" * 20_000, "'" * 20_000, "\\" * 20_000, "/" * 20_000, "/*" * 20_000, "\n" * 50_000, "a=" * 20_000, "${" * 20_000,
    "import " * 5_000, "const a: " + "b " * 20_000, "eval " * 5_000, "eval(" * 5_000, "password='" * 3_000, "FROM a AS b\n" * 3_000, "// " + WORD + " VG001\n" * 5_000,
]


def test_hostile_texts(spark):
    """No text makes a rule, a guard or a sign take long."""
    files = frame(spark, [(str(n), "src/a.ts", "typescript", None, t) for n, t in enumerate(HOSTILE)])
    everything = RULES + pack.PACK
    kernel.scan(files.limit(1), everything).count()
    for n in range(len(HOSTILE)):
        began = time.time()
        kernel.scan(files.where(F.col("file") == str(n)), everything).count()
        assert time.time() - began < 6, HOSTILE[n][:20]


def test_literals_never_hide_a_match(spark):
    """Any text that a pattern matches holds one of its literals."""
    import re

    for pattern, text in [(r"(?i)PassWord|tok_?en", "x TOKEN"), (r"[Ee]val\s*\(", "Eval ("), (r"(?:ab|cd)+e?", "cd"), (r"x{0,2}yz", "yz"), (r"(?=foo)f", "foo"), (r"\x{A0}key", " key"), (r"a[bB]c", "aBc")]:
        assert re.search(pattern.replace(r"\x{A0}", " "), text)
        need = prefilter.required(pattern)
        assert need is None or any(w in text.lower() for w in need), pattern
    assert prefilter.required(r"\d+|abc") is None and prefilter.required("(") is None


#: For each gate: a path and text for which it is silent, and one for which it is not.
GATED = {
    "VG21": [("ci.yml", "x"), (".github/workflows/a.yml", "x")], "VG137": [("vite.config.ts", "x"), ("src/a.ts", "x")], "VG1005": [("src/a.ts", "x"), ("src/a.ts", "supabase x")],
    "VG955": [("src/a.ts", "x"), ("app/api/a/route.ts", "x")], "VG506": [("a.json", "x"), ("vercel.json", "x")], "VG041": [("a/demo/b.ts", "x"), ("src/a.ts", "x")],
    "VG708": [("src/a.ts", "x"), ("src/a.ts", "x from 'expo-auth'")], "VG030": [("src/a.ts", "x app.use(rateLimit())"), ("src/a.ts", "x")], "VG1010": [("src/a.ts", "x z.object y.parse("), ("src/a.ts", "x z.object")],
    "VG601": [("src/a.ts", "x stripe.webhooks.constructEvent"), ("src/a.ts", "x")], "VG420": [("src/a.ts", "x await requireAuth()"), ("src/a.ts", "x")], "VG426": [("src/a.ts", "x role === 'a'"), ("src/a.ts", "x")],
    "VG1008": [("a/scripts/b.ts", "x"), ("src/a.ts", "x")], "VG124": [("a/seeds/b.ts", "x"), ("src/a.ts", "x")], "VG970": [("a/templates/b.ts", "x"), ("src/a.ts", "x")], "VG961": [("a/cron/b.ts", "x"), ("src/a.ts", "x")],
    "VG132": [("app/a/route.ts", "x"), ("src/a.ts", "x")], "VG155": [("src/a.ts", "x Bearer"), ("src/a.ts", "x")], "VG863": [("a.json", '"x"'), ("package.json", '"x"')], "VG439": [("a/migrations/b.sql", "x"), ("a/b.sql", "x")],
    "VG543": [("schema_a.sql", "x"), ("a.sql", "x")], "VG146": [("a.ts", "x"), (".env.local", "x")], "VG200": [("Dockerfile", "x\nUSER app"), ("Dockerfile", "x")], "VG206": [("Dockerfile", "x\nHEALTHCHECK y"), ("Dockerfile", "x")],
    "VG407": [("a.tsx", "x useState()"), ("a.tsx", "x")], "VG964": [("app/page.tsx", "x"), ("components/a.tsx", "x")], "VG977": [("a.ts", "x from 'react-native'"), ("a.ts", "x")], "VG012": [("a.ts", "x DOMPurify.sanitize("), ("a.ts", "x")],
    "VG120": [("a.ts", "x validateUrl"), ("a.ts", "x")], "VG993": [("a.ts", "x randomUUID("), ("a.ts", "x")], "VG106": [("a.ts", "x timingSafeEqual"), ("a.ts", "x")], "VG968": [("a.ts", "x verifyCron("), ("a.ts", "x")],
    "VG425": [("a.ts", "x validateRedirect("), ("a.ts", "x")], "VG105": [("a.ts", "x createHmac"), ("a.ts", "x createHmac jwt.sign ")], "VG989": [("src/pages/a.ts", "x"), ("src/a.ts", "x")], "VG678": [("aClient.tsx", "x"), ("a.tsx", "x")],
    "VG131": [("a.ts", "x\nexport async function GET(r) { return 1; }"), ("a.ts", "x\nexport async function GET(r) { db.delete(1); }")], "VG140": [("a.ts", "x"), ("a.ts", "x parseXml(")], "VG903": [("yarn.lock", "x"), ("package.json", "x")],
    "VG430": [("a.ts", "x createClient service_role"), ("a.ts", "x")], "VG448": [("a.ts", "x createAdminClient"), ("a.ts", "x")], "VG705": [("a.ts", "x"), ("android/a.ts", "x")], "VG003": [("a.test.ts", "x"), ("a.ts", "x")],
}


def test_every_gate_has_a_silent_file_and_one_that_is_not(spark):
    covered = {n for n, (ids, _) in enumerate(signs.GATES) for g in GATED if signs.covers(ids, g if g != "VG21" else "VG210")}
    assert covered == set(range(len(signs.GATES)))
    for rule, pair in GATED.items():
        rule = "VG210" if rule == "VG21" else rule
        one = kernel.Rule(rule, "low", "x", ("any", "yaml"))
        files = [(str(n), path, "yaml" if rule == "VG210" else "any", None, text) for n, (path, text) in enumerate(pair)]
        rows = frame(spark, files).withColumn("framework", F.lit(None).cast("string"))
        found = {r.file for r in kernel.scan(rows, [one]).collect()}
        assert found == {"1"}, (rule, found)


def test_directives_and_comments():
    lines = f"a\n// {WORD} vg001\n// more\nb\n\nc\nd // {WORD}\n# {WORD}-next-line VG2\ne".split("\n")
    assert context.directives(lines, WORD) == [(2, "vg001"), (4, "vg001"), (7, None), (9, "VG2")]
    assert context.block_comments("'/*' // /*\n/* a\n*/ x /* b") == [(2, 3), (3, 3)]


def test_empty_pack_and_null_contents(spark):
    rows = [("a", None, "typescript", None, None), ("b", None, None, None, "eval(x)"), ("c", None, "typescript", None, "")]
    assert kernel.scan(frame(spark, rows), RULES).collect() == [] and kernel.scan(frame(spark, rows), []).collect() == []
