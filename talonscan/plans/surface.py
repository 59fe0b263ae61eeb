"""Queries of ``operators.surface``, and their SQL. Same form as ``registry``."""

from __future__ import annotations

from pyspark.sql import functions as F

from talonscan.operators import findings as fo
from talonscan.operators import surface

POPULAR = ["steelplate", "brass-tube", "nickel.js", "copperwire"]
NAMES = ["node-steelplate", "steel-plate", "brasstube-js", "@x/nickel", "nickel", "copperwire", "copper_wire-node", "tin"]
ROUTES = "select distinct concat('app/', 'm', cast(p_partkey % 5 as string), '/', lower(replace(p_brand, '#', '-')), '/f', cast(p_size as string), '/route.ts') as file from part"
LAYOUTS = "select distinct concat('app/', 'm', cast(p_partkey % 5 as string)) as folder, p_partkey % 5 = 1 as guarded from part where p_partkey % 5 <> 4 union select distinct concat('app/', 'm', cast(p_partkey % 5 as string), '/', lower(replace(p_brand, '#', '-'))), p_brand like '%2' from part where p_brand not like '%3'"


def queries():
    from talonscan.plans.registry import _view, findings, table_of

    def imitations(s, d):
        names = table_of(s, d, "part").select(F.get(F.array(*[F.lit(n) for n in NAMES]), (F.col("p_partkey") % len(NAMES)).cast("int")).alias("name")).distinct()
        popular = table_of(s, d, "part").select(F.get(F.array(*[F.lit(n) for n in POPULAR]), (F.col("p_partkey") % len(POPULAR)).cast("int")).alias("popular")).distinct()
        return surface.imitations(names, popular)

    def layouts(s, d):
        part = table_of(s, d, "part")
        rows = s.sql(ROUTES.replace("from part", "from {t}"), t=part)
        return surface.layouts_over(rows, s.sql(LAYOUTS.replace("from part", "from {t}"), t=part))

    def gone(s, d):
        f = findings(s, d)
        return surface.resolved(f.where("seen_at < '1997-01-01'"), f.where("seen_at >= '1996-01-01'"), ["rule_id", "file"])

    def within(s, d):
        f = findings(s, d)
        return surface.only_known(f, f.where("specificity > 0"), "module", "rule_id")

    def tags(s, d):
        f = findings(s, d).select("file", "line", "rule_id", "match_pos", F.array(F.concat(F.lit("t"), F.col("dup_class").cast("string"))).alias("tags"))
        more = _view(s, d, "supplier", "select concat('R', cast(s_suppkey % 60 as string)) as rule_id, array(concat('t', cast(s_suppkey % 60 % 3 as string)), 'gdpr') as tags from supplier")
        return surface.tagged(f, more).groupBy(F.array_join("tags", "+").alias("tags")).agg(F.count("*").alias("n"))

    def top_rules(s, d):
        return fo.rule_ranking(findings(s, d), 10)

    def bare_code(s, d):
        rows = table_of(s, d, "part").select(F.concat(F.lit("a(); // "), F.col("p_name"), F.lit("\nb('http://x'); /* "), F.col("p_type"), F.lit("\n*/ c();")).alias("code"))
        return rows.groupBy(surface.without_comments(F.col("code")).alias("code"), surface.line_count(F.col("code")).cast("bigint").alias("lines")).agg(F.count("*").alias("n"))

    return {
        "imitated_packages": imitations,
        "layout_guards": layouts,
        "resolved_findings": gone,
        "known_rules_only": within,
        "merged_tags": tags,
        "rule_ranking_top10": top_rules,
        "code_without_comments": bare_code,
    }


def oracle_sql():
    from talonscan.plans.registry import _RANK, FINDINGS, _duck

    f = f"with f as ({_duck(FINDINGS)})"
    return {
        "imitated_packages": "select * from (values ('node-steelplate', 'steelplate'), ('steel-plate', 'steelplate'), ('brasstube-js', 'brass-tube'), ('@x/nickel', 'nickel.js'), ('nickel', 'nickel.js'), ('copper_wire-node', 'copperwire')) as v(name, similar_to)",
        "layout_guards": f"with r as ({_duck(ROUTES)}), l as ({_duck(LAYOUTS)}), n as (select file, arg_max(guarded, length(folder)) as guarded from r join l on starts_with(file, folder || '/') group by file) select file, coalesce(guarded, false) as guarded from r left join n using (file)",
        "resolved_findings": f + " select distinct rule_id, file from f where seen_at < '1997-01-01' and (rule_id, file) not in (select (rule_id, file) from f where seen_at >= '1996-01-01')",
        "known_rules_only": f + " select module, bool_and(rule_id in (select rule_id from f where specificity > 0)) as within from f group by module",
        "merged_tags": f + """, m as (select distinct concat('R', cast(s_suppkey % 60 as varchar)) as rule_id, concat('t', cast(s_suppkey % 60 % 3 as varchar)) as t from supplier),
            r as (select 't' || dup_class as own, m.t from f left join m using (rule_id))
            select case when t is null then own when t = own then own || '+gdpr' else own || '+gdpr+' || t end as tags, count(*) as n from r group by 1""",
        "rule_ranking_top10": f + f" select rule_id, severity, count(*) as n, count(distinct file) as files from f group by rule_id, severity order by {_RANK}, n desc, rule_id limit 10",
        "code_without_comments": "select 'a(); ' || chr(10) || 'b(''http://x'');  c();' as code, 3::bigint as lines, count(*) as n from part",
    }
