"""Flows of request data into functions of other files of a project.

Python sees one file at a time and gives small rows: calls of imported functions with request data in an argument, and exported functions
whose parameter reaches a sink or the returned value. What meets what is an equi join on (project, module, name) in Spark. Files that receive data
through a returned value are read a second time with those variables as further sources.

Differences on purpose: names are compared as whole words; a default import meets the default export whatever its local name; calls may span lines.
Defined results: null content has no flows; equal flows are one row; a body or list of arguments that never closes ends with the text.
"""

from __future__ import annotations

import posixpath
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talonscan.operators.taint import _SINKS, WORD, _source

# What makes a value safe on its way through a function.
SAFE = re.compile(r"(?i)validate\w*\s*\(|sanitize\w*\s*\(|safeParse\s*\(|parseBody\s*\(|DOMPurify|encodeURIComponent\s*\(|\.hostname\s*!==?\s*|\.origin\s*!==?\s*|allowlist|whitelist|allowedHosts")
EXTENSION = re.compile(r"\.[cm]?[jt]sx?$")
_IMPORT = re.compile(r"\bimport\s+(?:([\w$]+)\s*,\s*)?(?:\{([^}]*)\}|\*\s*as\s+([\w$]+)|([\w$]+))\s+from\s+['\"]([^'\"]+)['\"]")
_REQUIRE = re.compile(r"\b(?:const|let|var)\s+(?:\{([^}]*)\}|([\w$]+))\s*=\s*require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)")
_EXPORTED = re.compile(r"\bexport\s+(default\s+)?(?:async\s+)?(?:function|const|let|var|class)\s+([\w$]+)")
_EXPORT_LIST = re.compile(r"\bexport\s*\{([^}]*)\}(?!\s*from)")
_EXPORT_NAME = re.compile(r"\bexport\s+default\s+([\w$]+)\s*;?\s*$", re.M)
_MODULE_LIST = re.compile(r"\bmodule\.exports\s*=\s*\{([^}]*)\}")
_MODULE_ONE = re.compile(r"\bmodule\.exports\s*=\s*([\w$]+)\s*;?\s*$", re.M)
_MODULE_MEMBER = re.compile(r"\bexports\.([\w$]+)\s*=\s*([\w$]+)")
_FUNCTION = re.compile(r"\bfunction\s+([\w$]+)\s*\(([^)]*)\)|\b(?:const|let|var)\s+([\w$]+)\s*=\s*(?:async\s+)?(?:\(([^)]*)\)\s*(?::\s*[\w$<>\[\]]+\s*)?=>|function\s*\(([^)]*)\))")
_ASSIGN = re.compile(r"\b(?:const|let|var)\s+([\w$]+)\s*=\s*(.*)")
_RETURN = re.compile(r"\breturn\s+(.+?)[\s;}]*$")
_SEVERITY = {t: s for t, s, _ in _SINKS}
CALLS = "project string, file string, module string, name string, line bigint, arg int, source string, source_line bigint, variable string, receives string"
ENTRIES = "project string, sink_file string, module string, name string, arg int, sink string, sink_line bigint"


def module_of(file: str, target: str) -> str:
    """Path without extension that a relative import of the file names; others as they are."""
    if not target.startswith("."):
        return target
    path = posixpath.normpath(posixpath.join(posixpath.dirname(file), target))
    return EXTENSION.sub("", re.sub(r"^(?:\.\./)+", "", path))


def _pairs(text: str, between: str):
    for part in text.split(","):
        first, *rest = re.split(between, part.strip())
        if first:
            yield first, (rest[0] if rest else first)


def imports(file: str, text: str):
    """(local name, exported name, module); a whole module is ``*``."""
    for m in _IMPORT.finditer(text):
        module = module_of(file, m[5])
        for local in filter(None, (m[1], m[4])):
            yield local, "default", module
        if m[3]:
            yield m[3], "*", module
        for name, local in _pairs(m[2] or "", r"\s+as\s+"):
            yield local, name, module
    for m in _REQUIRE.finditer(text):
        module = module_of(file, m[3])
        if m[2]:
            yield m[2], "default", module
            yield m[2], "*", module
        for name, local in _pairs(m[1] or "", r"\s*:\s*"):
            yield local, name, module


def exports(text: str) -> dict[str, set[str]]:
    """Local name to the names it is exported by."""
    out: dict[str, set[str]] = {}
    add = lambda local, name: out.setdefault(local, set()).add(name)
    for m in _EXPORTED.finditer(text):
        add(m[2], "default" if m[1] else m[2])
    for m in _EXPORT_LIST.finditer(text):
        for local, name in _pairs(m[1], r"\s+as\s+"):
            add(local, name)
    for m in _MODULE_LIST.finditer(text):
        for name, local in _pairs(m[1], r"\s*:\s*"):
            add(local, name)
    for m in (*_EXPORT_NAME.finditer(text), *_MODULE_ONE.finditer(text)):
        add(m[1], "default")
    for m in _MODULE_MEMBER.finditer(text):
        add(m[2], m[1])
    return out


def _closed(text: str, at: int, opening: str, closing: str) -> int:
    """Position after the bracket that closes the one before ``at``."""
    depth = 1
    for m in re.compile(f"[{re.escape(opening + closing)}]").finditer(text, at):
        depth += 1 if m[0] == opening else -1
        if not depth:
            return m.end()
    return len(text)


def functions(text: str):
    """(name, parameters, start, end) of functions; start is where the body begins."""
    for m in _FUNCTION.finditer(text):
        listed = next((x for x in (m[2], m[4], m[5]) if x is not None), "")
        brace = text.find("{", m.end())
        line = text.find("\n", m.end())
        line = len(text) if line < 0 else line
        plain = brace < 0 or (m[4] is not None and brace > line)
        yield m[1] or m[3], [re.split(r"[:\s=?]", p.strip())[0] for p in listed.split(",")], m.end(), line if plain else _closed(text, brace + 1, "{", "}")


def _carriers(parameter: str, lines: list[str], safe: bool) -> set[str]:
    held = {parameter}
    for line in lines:
        m = _ASSIGN.search(line)
        clean = safe and SAFE.search(line)
        if m and not clean and held.intersection(WORD.findall(m[2])):
            held.add(m[1])
        if clean:
            held.difference_update(WORD.findall(line))
    return held


def entries(file: str, text: str):
    """(module, name, arg, sink, sink line) of exported functions; sink ``return`` where the argument comes back."""
    names = exports(text)
    breaks = [m.start() for m in re.finditer("\n", text)] if names else []
    for name, parameters, start, end in functions(text) if names else ():
        first = bisect_left(breaks, start) + 1
        lines = text[start:end].split("\n")
        for k, parameter in enumerate(parameters if name in names else ()):
            if not parameter:
                continue
            held = _carriers(parameter, lines, True)
            hit = next(((t, n) for n, line in enumerate(lines, first) for t, _, p in _SINKS if p.search(line) and held.intersection(WORD.findall(line))), None)
            held = _carriers(parameter, lines, False)
            back = any(m and held.intersection(WORD.findall(re.sub(r"[\w$]+\s*\([^)]*\)", "", m[1]))) for m in map(_RETURN.search, lines))
            for exported in sorted(names[name]):
                if hit:
                    yield EXTENSION.sub("", file), exported, k, *hit
                if back:
                    yield EXTENSION.sub("", file), exported, k, "return", first


_MARK = re.compile(r"[()\[\]{},]")


def _arguments(text: str, begin: int = 0) -> list[str]:
    """Arguments of a call, from behind its bracket; commas inside brackets do not part them."""
    out, depth = [], 0
    for m in _MARK.finditer(text, begin):
        if m[0] in "([{":
            depth += 1
        elif m[0] == ",":
            if not depth:
                out.append(text[begin : m.start()])
                begin = m.end()
        else:
            depth -= 1
            if depth < 0:
                return [*out, text[begin : m.start()]]
    return [*out, text[begin:]]


def calls(file: str, text: str, further: list[str] = ()):
    """(module, name, line, arg, source, source line, variable, receives) of calls of imported functions with tainted arguments.

    ``further`` are ``name:line`` of variables that hold returned request data.
    """
    known = list(imports(file, text))
    if not known:
        return
    lines = text.split("\n")
    tainted, users, assigned = {}, {}, []
    for n, line in enumerate(lines, 1):
        m = _ASSIGN.search(line)
        if m:
            kind = _source(m[2])
            if kind:
                tainted.setdefault(m[1], (kind, n))
            assigned.append((m[1], n, m[2]))
    for name, n in (x.rsplit(":", 1) for x in further):
        tainted.setdefault(name, ("return-propagated", int(n)))
    for name, n, rest in assigned:
        for word in set(WORD.findall(rest)):
            users.setdefault(word, []).append((name, n))
    queue = list(tainted)
    for word in queue:
        for name, n in users.get(word, ()):
            if name not in tainted:
                tainted[name] = ("propagated", n)
                queue.append(name)
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    for local, exported, module in known:
        member = r"\s*\.\s*([\w$]+)" if exported == "*" else ""
        for m in re.finditer(rf"(?<![\w$.]){re.escape(local)}{member}\s*\(", text):
            n = bisect_right(starts, m.start())
            into = _ASSIGN.search(lines[n - 1])
            for k, arg in enumerate(_arguments(text, m.end())):
                held = next((w for w in WORD.findall(arg) if w in tainted), None)
                kind, at = tainted[held] if held else (_source(arg), n)
                if kind:
                    yield module, m[1] if member else exported, n, k, kind, at, held or "", into[1] if into else ""


def _rows(read, schema: str, inputs: int):
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}

    def run(batches):
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            rows = [(p, f, *x) for p, f, *given in zip(*columns[:inputs]) for x in read(f, *given)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)], [n for n, _ in fields])

    return run


def cross_file_flows(files: DataFrame) -> DataFrame:
    """(project, file, content) to (project, file, source, source_line, variable, line, name, sink, severity, sink_file, sink_line)."""
    files = files.where("file is not null and content is not null").select(F.col("project").cast("string").alias("project"), "file", "content")
    callers = files.where(F.col("content").rlike(r"\bimport\s|\brequire\s*\("))
    given = callers.mapInArrow(_rows(calls, CALLS, 3), CALLS)
    open_ = files.where(F.col("content").rlike(r"\bexports?\b")).mapInArrow(_rows(entries, ENTRIES, 3), ENTRIES).distinct()
    keys = ["project", "module", "name", "arg"]
    returned = given.where("receives <> ''").join(open_.where("sink = 'return'").select(*keys), keys, "left_semi")
    seeds = returned.groupBy("project", "file").agg(F.sort_array(F.collect_set(F.concat_ws(":", "receives", "line"))).alias("further"))
    again = callers.join(seeds, ["project", "file"]).mapInArrow(_rows(calls, CALLS, 4), CALLS)
    met = given.unionByName(again).join(open_.where("sink <> 'return'"), keys)
    severity = F.create_map(*[F.lit(x) for pair in _SEVERITY.items() for x in pair])[F.col("sink")]
    return met.select("project", "file", "source", "source_line", "variable", "line", "name", "sink", severity.alias("severity"), "sink_file", "sink_line").distinct()
