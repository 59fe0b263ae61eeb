"""Registered queries that have to read all findings, against plain Python."""

from collections import Counter, defaultdict

from talonscan.plans import registry

SF = "/root/testdata/sf0.001"


def test_policy_gate_reads_all_findings(spark):
    total, blocking = Counter(), Counter()
    for r in registry.findings(spark, SF).select("file", "severity").collect():
        total[r.file] += 1
        blocking[r.file] += r.severity in ("critical", "high")
    got = {r.file: (r.blocking, r.total, r.blocked) for r in registry.queries()["policy_gate"](spark, SF).collect()}
    assert got == {k: (blocking[k], n, blocking[k] > 0) for k, n in total.items()}


def test_staged_score_reads_all_findings(spark):
    lost, files = Counter(), defaultdict(set)
    for r in registry.findings(spark, SF).select("module", "file", "severity").collect():
        lost[r.module] += {"critical": 10, "high": 3, "medium": 1}.get(r.severity, 0)
        files[r.module].add(r.file)
    got = {r.module: r.score for r in registry.queries()["staged_score"](spark, SF).collect()}
    assert got == {m: max(int(100 - lost[m] / (4000 * len(f)) * 20 + 0.5), 0) for m, f in files.items()}
