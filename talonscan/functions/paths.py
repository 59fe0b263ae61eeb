"""File paths: language, test files, routes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extension to language.
LANGUAGES = {
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript",
    "py": "python", "go": "go", "java": "java", "rb": "ruby", "php": "php", "sh": "shell", "bash": "shell", "sql": "sql",
    "html": "html", "yml": "yaml", "yaml": "yaml", "tf": "terraform", "json": "json", "toml": "toml",
}
TEST_PATH = r"(?:^|/)(?:tests?|__tests__|__mocks__|fixtures|e2e)/|\.(?:test|spec)\.[a-z]+$"


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def language(path: Column) -> Column:
    """Language of a path, null where unknown; Dockerfiles by their name."""
    name = base_name(path)
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    docker = name.startswith("Dockerfile") | name.endswith(".dockerfile")
    return F.when(docker, "dockerfile").otherwise(F.try_element_at(known, F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))))


def is_test_path(path: Column) -> Column:
    return path.rlike(TEST_PATH)


def looks_minified(content: Column) -> Column:
    """5000 characters or more, and a line of over 1000."""
    return (F.length(content) >= 5000) & F.exists(F.split(content, "\n", -1), lambda line: F.length(line) > 1000)


def route_url(path: Column) -> Column:
    """URL of a file of an app directory: without the prefix, the file name and (groups)."""
    inner = F.regexp_replace(path, r"^(?:.*?/)?app/", "")
    inner = F.regexp_replace(inner, r"(?:^|/)(?:route|page|layout)\.[jt]sx?$", "")
    inner = F.regexp_replace(inner, r"\([^)]+\)/?", "")
    return F.concat(F.lit("/"), F.regexp_replace(inner, r"^/+|/+$", ""))
