"""Queries over the star-schema tables for the security-analytics operators, and their SQL.

The tables hold no source code, so findings, packages and logs are derived from keys by expressions that both engines share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talonscan.operators import findings as fo
from talonscan.operators import packages as pk
from talonscan.operators import rules, stats
from talonscan.plans import audit, config, fixes, history, kernel, more, pack, policies, prompts, protection, reviews, streams, surface, whole

FINDINGS = """
select concat('src/f', cast(l_orderkey % 700 as string), '.ts') as file, l_linenumber * 10 + l_suppkey % 7 as line,
  concat('R', cast(l_partkey % 90 as string)) as rule_id, l_partkey % 5 as dup_class, l_partkey % 90 % 4 as specificity,
  case when l_quantity >= 45 then 'critical' when l_quantity >= 35 then 'high' when l_quantity >= 20 then 'medium' when l_quantity >= 10 then 'low' else 'info' end as severity,
  concat(cast(l_orderkey as string), '-', cast(l_linenumber as string)) as match_pos, concat('x', cast(l_suppkey % 9 as string)) as match,
  case l_suppkey % 4 when 0 then 'code' when 1 then 'secrets' when 2 then 'dependencies' else 'config' end as section,
  l_orderkey % 40 as module, l_shipdate as seen_at
from lineitem"""
LOG = """
select event_id as scan_id, ts, event_type as tool, user_id % 17 as n_findings, event_id * 7 % 101 as score from events"""
DUCK = {"string": "varchar"}
POPULAR = ["anna", "brass", "steel", "nickel", "copper", "green", "linen", "lemon"]


def _duck(sql: str) -> str:
    for a, b in DUCK.items():
        sql = sql.replace(f"as {a})", f"as {b})")
    return sql


def _view(spark: SparkSession, sf_dir: str, table: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace(f"from {table}", "from {t}"), t=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def table_of(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "lineitem", FINDINGS)


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "events", LOG)


def _files(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.concat(F.lit("d"), "doc_id").alias("file"), F.col("text").alias("content"))


def _rule_counts(spark, sf_dir):
    return rules.line_matches(_files(spark, sf_dir)).groupBy("rule_id", "severity").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"))


def _split_at(spark, sf_dir):
    f = findings(spark, sf_dir)
    return f.where("seen_at < '1997-01-01'"), f.where("seen_at >= '1996-01-01'")


def _baseline(spark, sf_dir):
    return fo.baseline_totals(fo.baseline_diff(*_split_at(spark, sf_dir), ["rule_id", "file", "match"]))


def _added(spark, sf_dir):
    lines = _view(spark, sf_dir, "orders", "select concat('src/f', cast(o_orderkey % 700 as string), '.ts') as file, o_custkey % 80 as line from orders")
    return fo.added_lines_only(findings(spark, sf_dir), lines).select("file", "line", "rule_id", "match_pos")


def _hunks(spark, sf_dir):
    hunks = _view(spark, sf_dir, "customer", "select concat('src/f', cast(c_custkey % 700 as string), '.ts') as file, c_nationkey * 3 as start, 5 as count from customer")
    return fo.in_hunks(findings(spark, sf_dir), hunks).select("file", "line", "rule_id", "match_pos")


def _suppressed(spark, sf_dir):
    d = _view(
        spark, sf_dir, "customer",
        "select concat('src/f', cast(c_custkey % 700 as string), '.ts') as file, c_nationkey * 3 as line, case when c_custkey % 3 = 0 then concat('R', cast(c_custkey % 90 as string)) end as rule from customer",
    )
    return fo.suppressed(findings(spark, sf_dir), d).groupBy("rule_id").agg(F.count("*").alias("n"))


def _controls(spark, sf_dir):
    f = findings(spark, sf_dir).withColumn("controls", F.array(F.concat(F.lit("C"), F.col("dup_class")), F.concat(F.lit("S"), F.col("specificity"))))
    return fo.by_control(f)


def _compare(spark, sf_dir):
    return fo.compare_sections(*_split_at(spark, sf_dir))


def _advisories(spark, sf_dir):
    version = "concat(cast(p_size % 4 as string), '.', cast(p_size % 13 as string), '.', cast(p_partkey % 11 as string))"
    packages = _view(spark, sf_dir, "part", f"select p_brand as name, {version} as version from part")
    known = _view(spark, sf_dir, "part", "select distinct p_brand as name, concat('ADV-', p_brand) as advisory, '1.2.0' as introduced, '2.10.3' as fixed from part")
    return pk.advisories_hit(packages, known).groupBy("name", "advisory").agg(F.count("*").alias("n"))


def _phantom(spark, sf_dir):
    used = _view(spark, sf_dir, "lineitem", "select distinct l_orderkey % 50 as project, concat('p', cast(l_partkey % 60 as string)) as name from lineitem")
    held = _view(spark, sf_dir, "orders", "select distinct o_orderkey % 50 as project, concat('p', cast(o_custkey % 45 as string)) as name from orders")
    return pk.phantom_imports(used, held)


def _typosquats(spark, sf_dir):
    names = _view(spark, sf_dir, "part", "select distinct lower(split(p_name, ' ')[0]) as name from part").union(
        _view(spark, sf_dir, "supplier", "select distinct concat(substr('steelcoppergreen', cast(1 + s_suppkey % 5 as int), 6), '') as name from supplier")
    )
    return pk.typosquats(names.distinct(), POPULAR)


def queries():
    f = findings
    return {
        "severity_pivot": lambda s, d: fo.severity_pivot(f(s, d), "module"),
        "file_ranking_top10": lambda s, d: fo.file_ranking(f(s, d)),
        "rule_ranking_top5": lambda s, d: fo.rule_ranking(f(s, d)),
        "exact_dedup": lambda s, d: fo.exact_dedup(f(s, d)).groupBy("severity").agg(F.count("*").alias("n")),
        "domination_dedup": lambda s, d: fo.dominated_dedup(f(s, d)).groupBy("rule_id").agg(F.count("*").alias("n")),
        "score_and_grade": lambda s, d: fo.scores(f(s, d), "module"),
        "audit_hash": lambda s, d: fo.result_hash(f(s, d), "file"),
        "audit_hash_sections": lambda s, d: fo.result_hash(f(s, d), "section"),
        "audit_sections": lambda s, d: fo.audit_totals(f(s, d)),
        "audit_compare": _compare,
        "baseline_diff": _baseline,
        "diff_aware_findings": _added,
        "pr_hunk_findings": _hunks,
        "inline_suppression": _suppressed,
        "compliance_by_control": _controls,
        "rule_match_counts": _rule_counts,
        "rule_match_lines": lambda s, d: rules.line_matches(_files(s, d)),
        "advisory_range_join": _advisories,
        "phantom_imports": _phantom,
        "typosquat_edit_distance": _typosquats,
        "stats_monthly": lambda s, d: stats.monthly(log(s, d)),
        "last_90_grades": lambda s, d: stats.daily_grades(log(s, d)),
        "grade_trend": lambda s, d: stats.month_trend(log(s, d)),
    } | more.queries() | reviews.queries() | kernel.queries() | surface.queries() | config.queries() | protection.queries() | audit.queries() | pack.queries() | fixes.queries() | whole.queries() | policies.queries() | history.queries() | prompts.queries() | streams.queries()


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fo.scores(findings(spark, sf_dir), "module")


_COUNTS = ", ".join(f"count(*) filter (severity = '{s}') as {s}" for s in ("critical", "high", "medium", "low", "info"))
_RANK = "case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 else 4 end"


def oracle_sql():
    f = f"with f as ({_duck(FINDINGS)}) "
    g = f"with g as ({LOG}) "
    density = "(15.0 * critical + 5.0 * high + 0.5 * medium) / greatest(files, 1)"
    cap = "case when critical > 0 then least({0}, 60) when high > 0 then least({0}, 75) else {0} end"
    linear = cap.format(f"greatest(floor(100 - least({density}, 5.0) * 20 + 0.5), 0)")
    expo = cap.format(f"greatest(floor(100 * exp(-({density}) / 3) + 0.5), 0)")
    file_of = "concat('src/f', cast({0} % 700 as varchar), '.ts')"
    lines = "lines as (select concat('d', cast(doc_id as varchar)) as file, unnest(string_split(text, chr(10))) as code, unnest(generate_series(1, len(string_split(text, chr(10))))) as line from documents)"
    hits = " union all ".join(f"select file, line::bigint as line, '{i}' as rule_id, '{s}' as severity from lines where regexp_matches(code, '{p.replace(chr(39), chr(39) * 2)}')" for i, s, p in rules.PACK)
    matches = f"with {lines}, m as ({hits}) "
    near = " union all ".join(f"select name, {i} as i, '{p}' as similar_to, levenshtein(name, '{p}') as d from n" for i, p in enumerate(POPULAR))
    both = "a as (select file, rule_id, match from f where seen_at < '1997-01-01'), b as (select file, rule_id, match from f where seen_at >= '1996-01-01')"
    ver = "(cast(split_part(version, '.', 1) as int) * 1000000 + cast(split_part(version, '.', 2) as int) * 1000 + cast(split_part(version, '.', 3) as int))"
    return {
        "severity_pivot": f + f"select module, {_COUNTS}, count(*) as total from f group by module",
        "file_ranking_top10": f + "select file, count(*) as n from f group by file order by n desc, file limit 10",
        "rule_ranking_top5": f + f"select rule_id, severity, count(*) as n, count(distinct file) as files from f group by rule_id, severity order by {_RANK}, n desc, rule_id limit 5",
        "exact_dedup": f + "select severity, count(*) as n from (select *, row_number() over (partition by file, line, rule_id order by match_pos, severity) as k from f) where k = 1 group by severity",
        "domination_dedup": f + "select rule_id, count(*) as n from f where not exists (select 1 from f g where g.file = f.file and g.line = f.line and g.dup_class = f.dup_class and g.specificity > f.specificity) group by rule_id",
        "score_and_grade": f + f""", s as (select module, {_COUNTS}, count(distinct file) as files from f group by module),
            p as (select module, files, cast({linear} as bigint) as linear, cast({expo} as bigint) as exponential from s)
            select *, case when linear >= 90 then 'A' when linear >= 75 then 'B' when linear >= 50 then 'C' when linear >= 25 then 'D' else 'F' end as grade from p""",
        "audit_hash": f + "select file, substr(sha256(string_agg(k, '|' order by k)), 1, 16) as hash from (select file, concat_ws(':', rule_id, severity, file, cast(line as varchar)) as k from f) group by file",
        "audit_hash_sections": f + ", k as (select section, file, concat_ws(':', rule_id, severity, file, cast(line as varchar)) as k from f), h as (select section, file, substr(sha256(string_agg(k, '|' order by k)), 1, 16) as h from k group by section, file) select section, substr(sha256(string_agg(h, '|' order by h)), 1, 16) as hash from h group by section",
        "audit_sections": f + f"select section, {_COUNTS}, count(*) as total from f group by rollup (section)",
        "audit_compare": f + """, a as (select section, count(*) as was from f where seen_at < '1997-01-01' group by section), b as (select section, count(*) as now from f where seen_at >= '1996-01-01' group by section)
            select section, coalesce(was, 0) as was, coalesce(now, 0) as now, case when coalesce(now, 0) = 0 then 'resolved' when now < coalesce(was, 0) then 'improved' when now > coalesce(was, 0) then 'regressed' else 'unchanged' end as status from a full join b using (section)""",
        "baseline_diff": f + f", {both} select case when (file, rule_id, match) in (select (file, rule_id, match) from a) then 'unchanged' else 'new' end as status, count(*)::bigint as n from b group by 1 union all select 'fixed', count(*) from a where (file, rule_id, match) not in (select (file, rule_id, match) from b)",
        "diff_aware_findings": f + f"select file, line, rule_id, match_pos from f where (file, line) in (select {file_of.format('o_orderkey')}, o_custkey % 80 from orders)",
        "pr_hunk_findings": f + f"select file, line, rule_id, match_pos from f where exists (select 1 from customer where {file_of.format('c_custkey')} = file and line >= c_nationkey * 3 and line < c_nationkey * 3 + 5)",
        "inline_suppression": f + f"select rule_id, count(*) as n from f where not exists (select 1 from customer where {file_of.format('c_custkey')} = file and line = c_nationkey * 3 and (c_custkey % 3 <> 0 or concat('R', cast(c_custkey % 90 as varchar)) = rule_id)) group by rule_id",
        "compliance_by_control": f + ", c as (select concat('C', cast(dup_class as varchar)) as control, severity, rule_id from f union all select concat('S', cast(specificity as varchar)), severity, rule_id from f) select control, count(*) as n, count(distinct rule_id) as rules, case when bool_or(severity = 'critical') then 'FAIL' else 'REVIEW' end as status from c group by control",
        "rule_match_counts": matches + "select rule_id, severity, count(*) as n, count(distinct file) as files from m group by rule_id, severity",
        "rule_match_lines": matches + "select * from m",
        "advisory_range_join": f"with p as (select p_brand as name, concat(cast(p_size % 4 as varchar), '.', cast(p_size % 13 as varchar), '.', cast(p_partkey % 11 as varchar)) as version from part) select name, concat('ADV-', name) as advisory, count(*) as n from p where {ver} >= 1002000 and {ver} < 2010003 group by name",
        "phantom_imports": "select distinct l_orderkey % 50 as project, concat('p', cast(l_partkey % 60 as varchar)) as name from lineitem where (l_orderkey % 50, concat('p', cast(l_partkey % 60 as varchar))) not in (select o_orderkey % 50, concat('p', cast(o_custkey % 45 as varchar)) from orders)",
        "typosquat_edit_distance": f"with n as (select lower(split_part(p_name, ' ', 1)) as name from part union select substr('steelcoppergreen', (1 + s_suppkey % 5)::int, 6) from supplier), o as ({near}), b as (select name, similar_to, d, row_number() over (partition by name order by d, i) as k from o where d <= 2) select name, similar_to, case when d = 1 then 0.9::double else 0.7::double end as confidence from b where k = 1 and d > 0",
        "stats_monthly": g + "select strftime(ts, '%Y-%m') as month, tool, count(*) as scans, sum(n_findings)::bigint as findings from g group by 1, 2",
        "last_90_grades": g + "select day, score from (select strftime(ts, '%Y-%m-%d') as day, score, row_number() over (partition by strftime(ts, '%Y-%m-%d') order by ts desc, scan_id desc) as k from g) where k = 1 order by day desc limit 90",
        "grade_trend": g + """, m as (select strftime(ts, '%Y-%m') as month, arg_min(score, (ts, scan_id)) as first_score, arg_max(score, (ts, scan_id)) as last_score from g group by 1)
            select *, case when last_score > first_score then 'improving' when last_score < first_score then 'declining' else 'stable' end as trend from m""",
    } | more.oracle_sql() | reviews.oracle_sql() | kernel.oracle_sql() | surface.oracle_sql() | config.oracle_sql() | protection.oracle_sql() | audit.oracle_sql() | pack.oracle_sql() | fixes.oracle_sql() | whole.oracle_sql() | policies.oracle_sql() | history.oracle_sql() | prompts.oracle_sql() | streams.oracle_sql(matches)
