"""Configuration: what a change weakens, and hooks, tools and servers of host settings.

Every test is a predicate of one projection, so a file is read once and nothing is shuffled.

Defined results: a null text is an empty one; a settings file that is no JSON gives one ``VG-HOST-001`` row; members of another shape
than expected give no rows; equal entries give a row each. An object with one key twice counts as no JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talonscan.functions.patterns import java_regex
from talonscan.operators.rules import all_matches

# What makes a change a downgrade. (category, title, severity, what the text has to be about or None, ways), and each way is
# (has to be in the text before, must not be there, has to be in the text after, must not be there).
DOWNGRADES = [
    ("cors", "CORS relaxed to wildcard", "high", None, [(None, None, r"Access-Control-Allow-Origin.*\*", None)]),
    ("csp", "CSP weakened", "high", r"(?i)Content-Security-Policy", [
        ("Content-Security-Policy", None, None, "Content-Security-Policy"), (None, "unsafe-inline", "unsafe-inline", None), (None, "unsafe-eval", "unsafe-eval", None)]),
    ("headers", "HSTS removed", "high", None, [("Strict-Transport-Security", None, None, "Strict-Transport-Security")]),
    ("debug", "Debug mode enabled", "medium", "debug|DEBUG", [(None, None, r"(?i)debug\s*[:=]\s*true|DEBUG\s*[:=]\s*(?:true|1|\"1\")", None)]),
    ("cookies", "Cookie security downgraded", "high", None, [
        (r"secure\s*:\s*true", None, r"secure\s*:\s*false", None), (r"httpOnly\s*:\s*true", None, r"httpOnly\s*:\s*false", None), (r"(?i)sameSite.*(?:strict|lax)", None, r"(?i)sameSite.*none", None)]),
    ("tls", "TLS weakened", "critical", None, [(None, None, r"force_https\s*=\s*false|rejectUnauthorized\s*:\s*false|NODE_TLS_REJECT_UNAUTHORIZED.*0", None)]),
    ("config", "Source maps enabled", "medium", None, [(None, None, r"productionBrowserSourceMaps\s*:\s*true", None)]),
    ("config", "Framework version exposed", "low", None, [(r"poweredByHeader\s*:\s*false", None, r"poweredByHeader\s*:\s*true", None)]),
    ("config", "Image wildcard added", "high", "(?i)remotePatterns", [(None, None, r"hostname\s*:\s*[\"'](?:\*\*|\*)[\"']", None)]),
    ("docker", "Privileged mode enabled", "critical", None, [(None, None, r"privileged\s*:\s*true", None)]),
    ("network", "Bound to all interfaces", "medium", None, [(None, r"0\.0\.0\.0", r"0\.0\.0\.0", None)]),
    ("headers", "X-Frame-Options removed", "medium", None, [("X-Frame-Options", None, None, "X-Frame-Options")]),
    ("headers", "X-Content-Type-Options removed", "medium", None, [("X-Content-Type-Options", None, None, "X-Content-Type-Options")]),
    ("headers", "Referrer-Policy removed", "medium", None, [("Referrer-Policy", None, None, "Referrer-Policy")]),
    ("headers", "Permissions-Policy removed", "medium", None, [("Permissions-Policy", None, None, "Permissions-Policy")]),
]
SECRET_VALUE = r"(?:SECRET|KEY|TOKEN|PASSWORD|CREDENTIAL)\w*\s*[:=]\s*[\"']?([A-Za-z0-9_\-]{12,})"
# Commands of hooks and servers, and paths that are nobody's business.
NETWORK = r"\b(?:curl|wget|nc|ncat|netcat|fetch|http|telnet)\b"
CHAIN = r"(?:\||\$\(|`[^`]+`|;\s*\w|&&\s*\w|>\s*\/)"
CHANGES_FILES = r"\b(?:cp|mv|rm|chmod|chown|sed|tee|dd)\b"
PIPED = r"\|\s*(?:bash|sh|zsh|python|node|eval|exec)\b"
DANGEROUS = r"\b(?:eval|base64|decode|exec\s*\(|os\.system|subprocess)\b"
SENSITIVE = r"(?:\.ssh|\.gnupg|\.aws|\.kube|\/etc(?:\/|\b)|\.config\/gcloud)"
#: Variables that move traffic of an assistant elsewhere, and the host they may name.
API_HOSTS = {"ANTHROPIC_BASE_URL": "api.anthropic.com"}


def _has(text: Column, pattern: str) -> Column:
    flags = "i" if pattern.startswith("(?i)") else ""
    return text.rlike(java_regex(pattern.removeprefix("(?i)"), flags))


def config_changes(changes: DataFrame) -> DataFrame:
    """(file, before, after) to a row for each downgrade and each secret value that the text before does not have."""
    rows = changes.select("file", *[F.coalesce(c, F.lit("")).alias(c) for c in ("before", "after")])
    before, after = F.col("before"), F.col("after")
    found = []
    for category, title, severity, about, ways in DOWNGRADES:
        hit = F.lit(False)
        for was, was_not, now, now_not in ways:
            tests = [_has(t, p) for t, p in ((before, was), (after, now)) if p] + [~_has(t, p) for t, p in ((before, was_not), (after, now_not)) if p]
            way = F.lit(True)
            for test in tests:
                way = way & test
            hit = hit | way
        if about:
            hit = (_has(before, about) | _has(after, about)) & hit
        found.append(F.when(hit, F.struct(F.lit(category).alias("category"), F.lit(title).alias("title"), F.lit(severity).alias("severity"))))
    values = lambda t: F.regexp_extract_all(t, F.lit(java_regex(SECRET_VALUE, "i")), F.lit(1))
    fresh = F.filter(values(after), lambda v: ~F.array_contains(F.col("held"), v))
    secret = F.struct(F.lit("secrets").alias("category"), F.lit("New secret hardcoded").alias("title"), F.lit("critical").alias("severity"))
    rows = rows.withColumn("held", values(before))
    return rows.select("file", F.inline(F.concat(F.array_compact(F.array(*found)), F.transform(fresh, lambda v: secret))))


def _finding(test: Column, rule: str, severity: str, confidence: str) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence")))


def _trusted(name: Column, trusted: list[str]) -> Column:
    """Named itself, or below the prefix of an entry that ends in ``/*``."""
    fine = name.isin(*trusted) if trusted else F.lit(False)
    for entry in trusted:
        if entry.endswith("/*"):
            fine = fine | name.startswith(entry[:-2])
    return fine


def host_settings(files: DataFrame, trusted: list[str] = (), api_hosts: dict[str, str] = API_HOSTS) -> DataFrame:
    """(file, content) of settings to (file, subject, rule_id, severity, confidence); the subject is a hook, a tool or a server."""
    texts, kind, t = "map<string,string>", F.col("kind"), F.col("subject")
    row = "struct<kind: string, subject: string, text: string>"
    none = F.expr("cast(array() as array<struct<rule_id: string, severity: string, confidence: string>>)")
    part = lambda name, subject, text: F.struct(F.lit(name).alias("kind"), subject.alias("subject"), text.alias("text"))
    read = F.from_json("content", f"hooks {texts}, allowedTools string, mcpServers {texts}, servers {texts}")
    parsed = files.select("file", F.try_parse_json("content").isNull().alias("broken"), read.alias("j"))
    held = [
        F.transform(F.map_entries("j.hooks"), lambda e: part("hook", e["key"], e["value"])),
        F.transform(F.from_json("j.allowedTools", "array<string>"), lambda x: part("tool", x, F.lit(None).cast("string"))),
        F.transform(F.map_entries(F.coalesce("j.mcpServers", "j.servers")), lambda e: part("server", e["key"], e["value"])),
    ]
    fine = F.concat(*[F.coalesce(x, F.expr(f"cast(array() as array<{row}>)")) for x in held])
    parts = parsed.select("file", F.inline(F.when(F.col("broken"), F.array(part("broken", F.lit(""), F.lit(None).cast("string")))).otherwise(fine)))

    def hook(h):
        c = h["command"]
        network = _has(c, "(?i)" + NETWORK)
        return F.array(
            _finding(_has(c, CHAIN), "VG884", "critical", "high"),
            _finding(network, "VG890", "critical", "high"),
            _finding(_has(c, PIPED), "VG891", "high", "high"),
            _finding((t == "PostToolUse") & _has(c, CHANGES_FILES), "VG895", "high", "high"),
            _finding(_has(c, "(?i)" + DANGEROUS) & ~network, "VG884", "high", "medium"),
        )

    tools = F.array(
        _finding(t == "*", "VG885", "medium", "high"),
        _finding((t != "*") & t.contains("*") & (F.length(F.replace(t, F.lit("*"), F.lit(""))) < 10), "VG893", "medium", "medium"),
    )
    parts = parts.withColumn("s", F.when(kind == "server", F.from_json("text", f"command string, args array<string>, url string, env {texts}")))
    parts = parts.withColumn("h", F.when(kind == "hook", F.from_json("text", "array<struct<command: string>>")))
    c = F.concat(F.coalesce("s.command", F.lit("")), F.lit(" "), F.coalesce(F.array_join("s.args", " "), F.lit("")))
    url = F.lower(F.coalesce("s.url", F.lit("")))

    def moved(key, value):
        away = F.lit(False)
        for variable, host in api_hosts.items():
            away = away | (F.upper(key).contains(variable) & ~value.contains(host))
        return away

    overrides = F.transform(F.map_entries(F.map_filter("s.env", moved)), lambda e: _finding(F.lit(True), "VG882", "high", "medium"))
    servers = F.concat(F.array(
        _finding(url.startswith("file://"), "VG892", "high", "high"),
        _finding(url.startswith("http://"), "VG892", "medium", "medium"),
        _finding(_has(c, "(?i)" + NETWORK) & _has(c, CHAIN), "VG890", "high", "medium"),
        _finding(_has(c, "(?i)" + SENSITIVE) | _has(F.col("text"), "(?i)" + SENSITIVE), "VG894", "high", "high"),
    ), F.coalesce(overrides, none))
    broken = F.array(_finding(F.lit(True), "VG-HOST-001", "info", "high"))
    found = F.when(kind == "hook", F.flatten(F.transform("h", hook))).when(kind == "tool", tools).when((kind == "server") & ~_trusted(t, trusted), servers).when(kind == "broken", broken)
    return parts.select("file", "subject", F.inline(F.array_compact(found)))


# Files of a host that set its environment, and what they set: base URLs, exported keys, keys that are shown; hosts of the machine itself.
ENVIRONMENTS = [".env", ".env.local", ".env.production", ".env.development"]
PROFILES = [".bashrc", ".zshrc", ".profile", ".bash_profile", ".zprofile"]
HOST_FILES = [".gemini/settings.json", ".codeium/windsurf/mcp_config.json"]
PROVIDERS = {"ANTHROPIC": (["api.anthropic.com"], "VG882"), "OPENAI": (["api.openai.com"], "VG883")}
BASE_URL = r"(?i)(?:{0}_BASE_URL|{0}_API_BASE)\s*=\s*['\"]?(https?://[^\s'\"#]+)"
KEY_EXPORT = r"(?i)export\s+(?:{0}_API_KEY|{0}_KEY)\s*=\s*['\"]?[^\s'\"]+"
KEY_SHOWN = r"(?i)(?:echo|cat|printenv|env\s|set\s)[\s|]*(?:\$(?:{0}|CLAUDE|API)_\w+|\$\{{(?:{0}|CLAUDE|API)_\w+\}})"
OWN_HOST = r"^(?:localhost|127\.0\.0\.1|0\.0\.0\.0|::1)"


def host_exports(files: DataFrame, trusted: list[str] = (), providers: dict[str, tuple[list[str], str]] = PROVIDERS) -> DataFrame:
    """(file, content) of a host to (file, line, rule_id, kind, severity, verdict, confidence, subject): base URLs that lead elsewhere, exported keys, keys that are shown.

    ``providers`` gives official hosts and the rule for each prefix of variables; ``trusted`` are base URLs that may be set. Exports and shown keys count in
    shell profiles. Null content has none; ``subject`` is the host, else the variable.
    """
    name = F.regexp_replace("file", "^.*/", "")
    either = "(?:" + "|".join(providers) + ")"
    profile = name.isin(PROFILES)
    inside = F.exists(F.array(*[F.col("file").endswith(p) for p in HOST_FILES]), lambda x: x)
    set_ = files.where(profile | name.isin(ENVIRONMENTS) | inside).select("file", "content")
    patterns = [("url", "high", BASE_URL.format(either)), ("export", "high", KEY_EXPORT.format(either)), ("shown", "medium", KEY_SHOWN.format(either))]
    found = all_matches(set_, patterns, cut=2000).withColumnRenamed("rule_id", "kind").where((F.col("kind") == "url") | F.regexp_replace("file", "^.*/", "").isin(PROFILES))
    url = F.regexp_extract("match", BASE_URL.format(either), 1)
    variable = F.upper(F.regexp_extract("match", r"(?i)((?:" + "|".join([*providers, "CLAUDE", "API"]) + r")_\w+)", 1))
    host = F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#]*@)?(\[[^\]]*\]|[^/:?#]+)", 1))
    official, rule = F.lit(False), F.lit(None).cast("string")
    for prefix, (hosts, id_) in providers.items():
        mine = variable.startswith(prefix)
        official = official | (mine & F.exists(F.array(*map(F.lit, hosts)), lambda h: (host == h) | host.endswith(F.concat(F.lit("."), h))))
        rule = F.when(mine, id_).otherwise(rule)
    is_url = F.col("kind") == "url"
    kept = found.where(~is_url | ~(official | (url.isin(list(trusted)) if trusted else F.lit(False))))
    local = is_url & host.rlike(OWN_HOST)
    first = next(iter(providers.values()))[1]
    return kept.select(
        "file", "line", F.when(is_url, rule).otherwise(F.lit(first)).alias("rule_id"), "kind", F.when(local, "medium").otherwise(F.col("severity")).alias("severity"),
        F.when(local, "observed").otherwise("risky").alias("verdict"), F.when(is_url, "medium").when(F.col("kind") == "export", "high").otherwise("low").alias("confidence"), F.when(is_url, host).otherwise(variable).alias("subject"),
    )
