"""Verdicts on shell commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RISKS = ["critical", "high", "medium", "low", "none"]
#: Pattern, category, verdict, risk; of equal risks the first counts.
COMMANDS = [
    (r"\brm\s+(-[a-zA-Z]*f[a-zA-Z]*\s+)?(-[a-zA-Z]*r[a-zA-Z]*\s+)?\/(?!\w)", "filesystem-destroy", "deny", "critical"),
    (r"\brm\s+-[a-zA-Z]*r[a-zA-Z]*f[a-zA-Z]*\s+(?:~|\/home|\$HOME)", "filesystem-destroy", "deny", "critical"),
    (r"\brm\s+-[a-zA-Z]*r[a-zA-Z]*f[a-zA-Z]*\s+\.\s*\z", "filesystem-destroy", "deny", "critical"),
    (r"\bmkfs\b|\bdd\s+.*of=\/dev", "filesystem-destroy", "deny", "critical"),
    (r">\s*\/dev\/sd[a-z]|>\s*\/dev\/nvme", "filesystem-destroy", "deny", "critical"),
    (r"\bgit\s+push\s+.*--force(?!-with-lease)", "git-rewrite", "ask", "high"),
    (r"\bgit\s+reset\s+--hard", "git-rewrite", "ask", "high"),
    (r"\bgit\s+clean\s+-[a-zA-Z]*f", "git-rewrite", "ask", "high"),
    (r"\bgit\s+rebase\b", "git-rewrite", "ask", "medium"),
    (r"\bgit\s+filter-branch\b|\bgit-filter-repo\b", "git-rewrite", "ask", "high"),
    (r"\bnpm\s+publish\b", "deploy", "ask", "high"),
    (r"\bvercel\s+--prod\b|\bvercel\s+deploy\s+--prod", "deploy", "ask", "high"),
    (r"\bdocker\s+push\b", "deploy", "ask", "high"),
    (r"\bterraform\s+(?:apply|destroy)\b", "deploy", "ask", "high"),
    (r"\bkubectl\s+delete\b", "deploy", "ask", "high"),
    (r"\benv\b|\bprintenv\b|\bset\b.*\|", "secret-exposure", "ask", "medium"),
    (r"\bcat\s+.*\.env\b|\bcat\s+.*secret|\bcat\s+.*credential", "secret-exposure", "ask", "high"),
    (r"\becho\s+.*(?:SECRET|KEY|TOKEN|PASSWORD|CREDENTIAL)", "secret-exposure", "ask", "high"),
    (r"\bcurl\s+.*-(?:d|X\s*POST)\s+.*(?:pastebin|requestbin|webhook\.site|ngrok|pipedream)", "exfiltration", "deny", "critical"),
    (r"\bcurl\s+.*--upload-file", "exfiltration", "ask", "high"),
    (r"\bwget\s+-O\s*-\s*.*\|\s*(?:bash|sh|zsh)", "remote-exec", "deny", "critical"),
    (r"\bcurl\s+.*\|\s*(?:bash|sh|zsh)", "remote-exec", "deny", "critical"),
    (r"\bchmod\s+777\b", "permission", "ask", "medium"),
    (r"\bchown\s+-R\s+root", "permission", "ask", "medium"),
    (r"\bsudo\s", "privilege-escalation", "ask", "medium"),
    (r"\bkill\s+-9\b|\bkillall\b|\bpkill\b", "process", "ask", "medium"),
    (r"\bsystemctl\s+(?:stop|restart|disable)\b", "process", "ask", "medium"),
    (r"(?i)\bdrop\s+(?:database|table|schema)\b", "database", "deny", "critical"),
    (r"(?i)\btruncate\s+table\b", "database", "ask", "high"),
    (r"(?i)\bDELETE\s+FROM\s+\w+\s*;?\s*\z", "database", "ask", "high"),
]
SECRET_FILES = [".env", ".env.local", ".env.production", "credentials.json", "serviceAccountKey.json"]
DEPLOY_FILES = ["vercel.json", "fly.toml", "Dockerfile", "docker-compose.yml", "workflows"]
TOUCHES = [r"\.github\/workflows|\.gitlab-ci|Jenkinsfile|\.circleci", r"\|\s*(?:nc|netcat|ncat|socat)\b"]
PROTECTED = ["main", "master", "production"]


def details(command: Column) -> Column:
    """Number of circumstances that a command touches: secret files, deploy and CI configuration, network tools, encoded traffic."""
    tests = [command.contains(n) for n in SECRET_FILES + DEPLOY_FILES] + [command.rlike(p) for p in TOUCHES]
    tests.append(command.contains("base64") & command.rlike("curl|wget|nc"))
    return sum((t.cast("int") for t in tests), F.lit(0))


def verdict(command: Column, branch: Column) -> Column:
    """Struct of verdict, risk, category, confidence and the number of matching patterns.

    The first of the worst patterns decides. Every match that was no worse than one before it is one more circumstance, and each
    circumstance makes a verdict other than allow surer.
    """
    rows = [
        F.when(command.rlike(p), F.struct(F.lit(RISKS.index(r)).alias("rank"), F.lit(i).alias("at"), F.lit(v).alias("verdict"), F.lit(c).alias("category")))
        for i, (p, c, v, r) in enumerate(COMMANDS)
    ]
    found = F.struct(F.filter(F.array(*rows), lambda h: h.isNotNull()).alias("hits"))

    def judged(x):
        hits = x["hits"]
        worst = F.array_min(hits)
        further = F.size(F.filter(hits, lambda h, i: F.exists(F.slice(hits, F.lit(1), i), lambda g: g["rank"] <= h["rank"])))
        push = F.coalesce(worst.isNull() & branch.isin(PROTECTED) & command.rlike(r"\bgit\s+push\b"), F.lit(False))
        safe = worst.isNull() & ~push
        base = F.when(worst.isNull(), 0.9).otherwise(0.85)
        context = details(command) + further
        confidence = F.when(~safe & (context > 0), F.least(F.lit(0.95), base + context * 0.02)).otherwise(base)
        return F.struct(
            F.when(safe, "allow").when(push, "ask").otherwise(worst["verdict"]).alias("verdict"),
            F.when(safe, "none").when(push, "medium").otherwise(F.get(F.array(*[F.lit(r) for r in RISKS]), worst["rank"])).alias("risk"),
            F.when(safe, "safe").when(push, "protected-branch").otherwise(worst["category"]).alias("category"),
            F.round(confidence, 2).alias("confidence"),
            F.size(hits).cast("bigint").alias("n_matched"),
        )

    return F.get(F.transform(F.array(found), judged), 0)  # the hits are found once


def check_commands(commands: DataFrame) -> DataFrame:
    """(command, branch) with the verdict's columns added; a null command is safe. Each distinct command is judged once."""
    every = commands.select("command", "branch").distinct()
    judged = every.select(F.col("command").alias("_c"), F.col("branch").alias("_b"), verdict(F.coalesce("command", F.lit("")), F.col("branch")).alias("_v"))
    same = F.col("command").eqNullSafe(F.col("_c")) & F.col("branch").eqNullSafe(F.col("_b"))
    return commands.join(judged, same, "left").select(*[commands[c] for c in commands.columns], "_v.*")
