"""A tolerant reading of ECMAScript as a table of nodes, and questions about it that patterns cannot answer.

Tokens come from one regular expression, brackets are matched by a stack, and calls, declarations, assignments and functions
are rows that point at tokens. Nothing has to be well formed: an unclosed bracket closes at the end of the file. All of it is linear in the text, but
for initialisers, which are read again for each function they are nested in. This runs for a file only where a rule that asks hits it.

Defined results: on doubt a question gets the answer that keeps the finding.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import cached_property
from typing import NamedTuple

#: Methods that are sinks of queries, that find, that change; fields that name an owner; methods that take a callback for each element.
SINKS = set("query execute findUnique findFirst findMany delete update create upsert aggregate count groupBy createMany updateMany deleteMany raw $queryRaw $executeRaw $queryRawUnsafe $executeRawUnsafe".split())
FINDS = set("findUnique findFirst findById findOne getOne".split())
CHANGES = set("delete update destroy remove deleteMany updateMany deleteOne updateOne".split())
OWNERS = set(
    "userId user_id ownerId owner_id authorId author_id createdById createdBy created_by accountId account_id tenantId tenant_id orgId org_id organizationId "
    "projectId project_id workspaceId workspace_id teamId team_id memberId member_id programId customerId".split()
)
RAW_SQL = {"query", "execute", "raw", "$queryRawUnsafe", "$executeRawUnsafe"}
EACH = set("map forEach some every filter find findIndex reduce flatMap".split())
#: Roots of route parameters, comparisons of an owner, words of a session, values under a request's control, names of checks.
ROUTE = {"params", "searchParams"}
OWNER_COMPARED = re.compile(r"\.\s*(?:userId|ownerId|authorId|createdById|teamId|workspaceId|orgId|organizationId|tenantId|memberId|accountId|projectId)\b\s*(?:===|!==|==|!=)", re.I | re.A)
SESSION = re.compile(r"\b(?:session|ctx|auth|currentUser|viewer|member|account|workspace|team|org|self|me|user)\b", re.I | re.A)
REQUEST = re.compile(r"\b(?:req|request|params|searchParams)\b", re.A)
CHECKS = re.compile(r"^(?:authoris|authoriz)e|^(?:is|assert|ensure|require|check|verify|can|has|validate|guard|protect|enforce)[A-Za-z]*(?:owner|admin|member|access|permission|auth|allowed|belongs|role)", re.I)

_TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*(?:[^*]|\*(?!/))*(?:\*/|\Z))
    |(?P<string>'(?:[^'\\\n]|\\[\s\S])*+(?:'|$|\Z)|"(?:[^"\\\n]|\\[\s\S])*+(?:"|$|\Z))
    |(?P<template>`)
    |(?P<name>[A-Za-z_$\u0080-￿][\w$\u0080-￿]*)
    |(?P<number>\d[\w.]*)
    |(?P<mark>=>|===|!==|==|!=|<=|>=|\?\.|\?\?=?|&&=?|\|\|=?|\.\.\.|[-+*/%&|^]=|\+\+|--|[\s\S])""",
    re.X | re.M,
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_CLOSER = {"(": ")", "[": "]", "{": "}"}
#: Words before which a slash begins a regular expression, and that are no callees.
_WORDS = set("return typeof case in of delete void throw new instanceof do else yield await".split())
_NO_CALL = set("if for while switch catch function return typeof await with super import".split())
_GOES_ON = set(". ?. + - * / % & | ^ ? : => && || ?? , = ( [ ` == === != !== < > <= >= as instanceof in satisfies += -= *= ||= &&= ??=".split())


class Call(NamedTuple):
    name: str
    dotted: bool
    at: int  # token of the name
    open: int
    close: int
    start: int  # first token of the whole expression


class Function(NamedTuple):
    kind: str
    start: int
    end: int
    names: list[str]  # parameters that are plain names


class Tree:
    """Tokens and nodes of one text."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.kinds, self.words, self.starts, self.ends = [], [], [], []
        self._read(0, len(text), False)
        self._match()
        self._by_line: dict[int, dict[int, int]] = {}
        self._compared: dict[int, bool] = {}

    def _put(self, kind: str, a: int, b: int) -> None:
        self.kinds.append(kind)
        self.words.append(self.text[a:b])
        self.starts.append(a)
        self.ends.append(b)

    def _read(self, at: int, end: int, inside: bool) -> int:
        """Tokens up to ``end``; parts of templates between ``${`` and ``}`` are read like other code, by a stack of brace depths."""
        text, depths, depth = self.text, [], 0
        while at < end:
            last = self.words[-1] if self.words else ""
            if text[at] == "/" and (not self.words or last in _WORDS or self.kinds[-1] == "mark" and last not in (")", "]", "}")):
                m = _REGEX.match(text, at)
                if m:
                    self._put("regex", at, m.end())
                    at = m.end()
                    continue
            m = _TOKEN.match(text, at)
            kind, b = m.lastgroup, m.end()
            if kind == "template" or (depths and text[at] == "}" and depth == depths[-1]):
                if kind != "template":
                    depths.pop()
                    self._put("mark", at, b)
                    at = b
                    plain = False
                else:
                    plain, b = True, at + 1
                    begun = at
                    at = b
                while at < end and text[at] != "`":
                    if text[at] == "\\":
                        at += 2
                    elif text.startswith("${", at):
                        break
                    else:
                        nxt = re.compile(r"[`\\$]").search(text, at + 1)
                        at = nxt.start() if nxt else end
                if at < end and text[at] == "`":
                    at += 1
                    self._put("plain" if plain else "tail", begun if plain else b, at)
                elif at < end:
                    self._put("head", begun if plain else b, at)
                    self._put("mark", at + 1, at + 2)  # the brace
                    depths.append(depth)
                    at += 2
                else:
                    at = end
                    self._put("plain" if plain else "tail", begun if plain else b, end)
                continue
            if kind != "space":
                if m[0] == "{":
                    depth += 1
                elif m[0] == "}":
                    depth -= 1
                self._put(kind, at, b)
            at = b
        return at

    def _match(self) -> None:
        n = len(self.words)
        self.pair, stack = [n] * n, []
        self.within = [-1] * n  # the open bracket around a token
        for i, (w, k) in enumerate(zip(self.words, self.kinds)):
            if k == "mark" and w in ")]}":
                while stack and _CLOSER[self.words[stack[-1]]] != w:
                    stack.pop()
                if stack:
                    self.pair[i] = stack.pop()
                    self.pair[self.pair[i]] = i
                else:
                    self.pair[i] = -1
            self.within[i] = stack[-1] if stack else -1
            if k == "mark" and w in "([{":
                stack.append(i)

    def word(self, i: int) -> str:
        return self.words[i] if 0 <= i < len(self.words) else ""

    def kind(self, i: int) -> str:
        return self.kinds[i] if 0 <= i < len(self.kinds) else ""

    def source(self, a: int, b: int) -> str:
        """Text of tokens a to b, b excluded."""
        return self.text[self.starts[a] : self.ends[min(b, len(self.ends)) - 1]] if a < b and a < len(self.starts) else ""

    @cached_property
    def line_starts(self) -> list[int]:
        return [0, *[m.end() for m in re.finditer("\n", self.text)]]

    def line(self, token: int) -> int:
        return bisect_right(self.line_starts, self.starts[token])

    def parts(self, a: int, b: int) -> list[tuple[int, int]]:
        """Ranges between commas outside of brackets."""
        out, i, first = [], a, a
        while i < b:
            if self.kinds[i] == "mark" and self.words[i] in "([{" and self.pair[i] > i:
                i = min(self.pair[i], b)
            elif self.words[i] == "," and self.kinds[i] == "mark":
                out.append((first, i))
                first = i + 1
            i += 1
        if first < b:
            out.append((first, b))
        return out

    def expression_end(self, i: int) -> int:
        """Token behind the expression that begins at i, with statements that end at a line break."""
        first = i
        while i < len(self.words):
            w = self.words[i] if self.kinds[i] == "mark" else ""
            if w in (",", ";", ")", "]", "}"):
                break
            if i > first and "\n" in self.text[self.ends[i - 1] : self.starts[i]]:
                if self.words[i - 1] not in _GOES_ON and self.words[i] not in _GOES_ON:
                    break
            if w and w in "([{" and self.pair[i] > i:
                i = min(self.pair[i], len(self.words))
            i += 1
        return min(i, len(self.words))

    def bound_names(self, a: int, b: int) -> list[str]:
        """Names that a binding pattern binds: not the keys, not the defaults."""
        if b - a == 1:
            return [self.words[a]] if self.kinds[a] == "name" else []
        out = []
        if self.words[a] in ("{", "["):
            for x, y in self.parts(a + 1, min(self.pair[a], b)):
                x += self.words[x] == "..."
                ends = [i for i in range(x, y) if self.words[i] in (":", "=") and self.within[i] == a]
                if ends and self.words[ends[0]] == ":":
                    x, ends = ends[0] + 1, ends[1:]
                out += self.bound_names(x, ends[0] if ends else y) if x < y else []
        return out

    @cached_property
    def calls(self) -> list[Call]:
        """In the order of a walk from the root: by start, the wider first."""
        found = []
        for i, k in enumerate(self.kinds):
            if k != "name" or self.words[i] in _NO_CALL:
                continue
            j = i + 1
            if self.word(j) == "?." and self.word(j + 1) == "(":
                j += 1
            if self.word(j) == "<":  # type arguments
                depth, t = 0, j
                while t < len(self.words) and t < j + 64 and (self.kinds[t] in ("name", "string", "number") or self.words[t] in "<>[],.|&{}:;"):
                    depth += {"<": 1, ">": -1}.get(self.words[t], 0)
                    t += 1
                    if depth == 0:
                        break
                j = t if depth == 0 else j
            if self.word(j) != "(" or self.kind(j) != "mark":
                continue
            before, close = self.word(i - 1), self.pair[j]
            dotted = before in (".", "?.")
            if not dotted and (before in ("function", "new") or before == "*" and self.word(i - 2) == "function" or self.word(close + 1) == "{"):
                continue
            found.append(Call(self.words[i], dotted, i, j, close, self._chain_start(i)))
        return sorted(found, key=lambda c: (c.start, -c.close))

    def _chain_start(self, i: int) -> int:
        while self.word(i - 1) in (".", "?."):
            i -= 2
            while self.kind(i) == "mark" and self.words[i] in ("!", ")", "]"):
                i = i - 1 if self.words[i] == "!" else max(self.pair[i], 0)
                if self.words[i] in ("(", "[") and (self.kind(i - 1) == "name" and self.words[i - 1] not in _NO_CALL and self.words[i - 1] not in _WORDS or self.word(i - 1) in (")", "]", "?.")):
                    i -= 1 + (self.word(i - 1) == "?.")
                else:
                    break
            if self.kind(i) == "tail":  # back to the head of the template
                while i > 0 and self.kind(i) != "head":
                    i -= 1
        return i - 1 if self.word(i - 1) == "new" else i

    @cached_property
    def bindings(self) -> list[tuple[list[str], int, int]]:
        """Names, and the tokens of what they are set to: declarations with initialisers and assignments to plain names, in order."""
        found = []
        for i, w in enumerate(self.words):
            if w in ("const", "let", "var") and self.kinds[i] == "name" and self.word(i - 1) != ".":
                at = i + 1
                while at < len(self.words):
                    end = self.pair[at] + 1 if self.words[at] in ("{", "[") else at + 1
                    t = end
                    if self.word(t) == ":":  # a type, to the sign at this depth
                        while t < len(self.words) and self.words[t] not in ("=", ";", ")") and not (self.words[t] == "," and self.within[t] == self.within[at]):
                            t = self.pair[t] + 1 if self.words[t] in ("{", "[", "(") and self.pair[t] > t else t + 1
                    if self.word(t) != "=":
                        break
                    stop = self.expression_end(t + 1)
                    found.append((self.bound_names(at, min(end, len(self.words))), t + 1, stop))
                    if self.word(stop) != ",":
                        break
                    at = stop + 1
            elif w == "=" and self.kinds[i] == "mark" and self.kind(i - 1) == "name" and self.word(i - 2) not in (".", "?.", "const", "let", "var"):
                found.append(([self.words[i - 1]], i + 1, self.expression_end(i + 1)))
        return found

    def set_to(self, name: str) -> tuple[int, int] | None:
        """What the first declaration of the name sets it to."""
        for names, a, b in self.bindings:
            if names == [name] and self.words[a - 2] != "}" and self._declared(a):
                return a, b
        return None

    def _declared(self, a: int) -> bool:
        i = a - 2
        while i > 0 and self.words[i] not in ("const", "let", "var", ";", "{", "}"):
            i -= 1
        return self.word(i) in ("const", "let", "var")

    @cached_property
    def functions(self) -> list[Function]:
        found = []
        for i, w in enumerate(self.words):
            if w == "=>" and self.kinds[i] == "mark":
                j = i - 1
                if self.word(j) != ")":  # a return type
                    t = j
                    while t > 0 and self.words[t] not in (")", ";", "{", "}", ",", "="):
                        t -= 1
                    j = t if self.word(t) == ")" and self.word(t + 1) == ":" else j
                a = max(self.pair[j], 0) if self.word(j) == ")" else j
                names = self._parameters(a + 1, j) if self.word(j) == ")" else [self.words[j]]
                body = self.pair[i + 1] + 1 if self.word(i + 1) == "{" else self.expression_end(i + 1)
                found.append(Function("arrow", a - (self.word(a - 1) == "async"), body, names))
            elif w == "(" and self.kinds[i] == "mark" and self.pair[i] > i:
                close = self.pair[i]
                j = close + 1
                if self.word(j) == ":":  # a return type, up to the body
                    while j < len(self.words) and self.words[j] not in ("{", ";", ")", "=>", ","):
                        j += 1
                if self.word(j) != "{" or self.word(i - 1) in ("if", "for", "while", "switch", "catch", "with"):
                    continue
                named = i - 1 if self.kind(i - 1) == "name" and self.words[i - 1] != "function" else i
                star = self.word(named - 1) == "*"
                word = named - 1 - star
                if self.word(word) == "function" or self.word(i - 1) == "function":
                    word = word if self.word(word) == "function" else i - 1
                    a = word - (self.word(word - 1) == "async")
                    kind = "declaration" if named < i and self.word(a - 1) in ("", ";", "}", "{", "export", "default", ")") else "expression"
                    found.append(Function(kind, a, self.pair[j] + 1, self._parameters(i + 1, close)))
                elif named < i and self.words[named] not in _WORDS:
                    a = named - (self.word(named - 1) == "async")
                    found.append(Function("method", a, self.pair[j] + 1, self._parameters(i + 1, close)))
        return found

    def _parameters(self, a: int, b: int) -> list[str]:
        return [self.words[x] for x, y in self.parts(a, b) if self.kinds[x] == "name" and (y - x == 1 or self.words[x + 1] in (":", "=", "?"))]

    def around(self, token: int, kinds: tuple[str, ...] = ("declaration", "expression", "arrow", "method"), name: str | None = None) -> Function | None:
        """The innermost function that holds a token."""
        at = bisect_right(self._nested[0], token) - 1
        while at >= 0:
            f = self._nested[1][at]
            if token < f.end and f.kind in kinds and (name is None or name in f.names):
                return f
            at = self._nested[2][at]
        return None

    @cached_property
    def _nested(self) -> tuple[list[int], list[Function], list[int]]:
        """Starts, functions by start, and for each the one around it."""
        rows, above, stack = sorted(self.functions, key=lambda f: (f.start, -f.end)), [], []
        for n, f in enumerate(rows):
            while stack and rows[stack[-1]].end <= f.start:
                stack.pop()
            above.append(stack[-1] if stack else -1)
            stack.append(n)
        return [f.start for f in rows], rows, above

    def properties(self, brace: int) -> list[tuple[str | None, int, int]]:
        """(name, value tokens) of an object; a name that stands alone has no value tokens."""
        out = []
        for a, b in self.parts(brace + 1, self.pair[brace]):
            named = self.words[a] if self.kinds[a] == "name" else None
            if b - a == 1:
                out.append((named, b, b))
            elif self.word(a + 1) == ":":
                out.append((named, a + 2, b))
        return out

    # The questions.

    def parameter_reaches_sink(self) -> bool:
        """Whether route parameters flow into the arguments of a query, through names set to expressions that mention them."""
        of_word: dict[str, list[int]] = {}
        for n, (_, a, b) in enumerate(self.bindings):
            for w in set(_names(self.source(a, b))):
                of_word.setdefault(w, []).append(n)
        seen, todo = set(ROUTE), list(ROUTE)
        while todo:
            for n in of_word.get(todo.pop(), ()):
                new = set(self.bindings[n][0]) - seen
                seen |= new
                todo += new
        return any(not seen.isdisjoint(_names(self.source(c.open + 1, c.close))) for c in self.calls if c.name in SINKS and c.close > c.open + 1)

    def call_near(self, line: int, methods: set[str]) -> Call | None:
        if id(methods) not in self._by_line:
            first: dict[int, int] = {}
            for n, c in enumerate(self.calls):
                if c.name in methods:
                    first.setdefault(self.line(c.start), n)
            self._by_line[id(methods)] = first
        near = [n for x in (line - 1, line, line + 1) if (n := self._by_line[id(methods)].get(x)) is not None]
        return self.calls[min(near)] if near else None

    def _owned(self, brace: int) -> bool:
        for name, a, b in self.properties(brace):
            if name in OWNERS and (a == b or not REQUEST.search(self.source(a, b))):
                return True
            if a < b and self.words[a] == "{" and self.pair[a] == b - 1 and self._owned(a):
                return True
        return False

    def _where(self, call: Call) -> int | None:
        """The brace of the object that a query is restricted by."""
        if self.word(call.open + 1) != "{":
            return None
        return next((a for name, a, b in self.properties(call.open + 1) if name == "where" and a < b and self.words[a] == "{"), None)

    def _compared_later(self, call: Call) -> bool:
        f = self.around(call.at)
        key = f.start if f else -1
        if key not in self._compared:
            body = self.source(f.start, f.end) if f else self.text
            self._compared[key] = any(OWNER_COMPARED.search(x) and SESSION.search(x) for x in body.split("\n"))
        return self._compared[key]

    @cached_property
    def _checks(self) -> list[Call]:
        return [c for c in self.calls if CHECKS.search(c.name)]

    def _checked_before(self, call: Call) -> bool:
        """A check by name that gets a word of the session and the very id of the query."""
        brace = self._where(call)
        if brace is None:
            brace = call.open + 1 if self.word(call.open + 1) == "{" else None
        f = self.around(call.at)
        if brace is None or f is None:
            return False
        key = next((self.source(a, b) for name, a, b in self.properties(brace) if name == "id" and a < b), "")
        if not key or ("." not in key and len(key) < 5):
            return False
        for c in self._checks:
            if f.start <= c.at < f.end and c.start < call.start:
                given = self.source(c.open + 1, c.close)
                if SESSION.search(given) and key in given:
                    return True
        return False

    def find_is_guarded(self, line: int) -> bool:
        call = self.call_near(line, FINDS)
        if call is None:
            return False
        where = self._where(call)
        return (where is not None and self._owned(where)) or self._compared_later(call) or self._checked_before(call)

    def change_is_guarded(self, line: int) -> bool:
        call = self.call_near(line, CHANGES)
        return call is not None and (self._compared_later(call) or self._checked_before(call))

    def bare_sql(self) -> list[tuple[int, str]]:
        """(line, name) of queries whose first argument is a plain name."""
        given = [(c, self.parts(c.open + 1, c.close)) for c in self.calls if c.dotted and c.name in RAW_SQL]
        return [(self.line(p[0][0]), self.words[p[0][0]]) for _, p in given if p and p[0][1] - p[0][0] == 1 and self.kinds[p[0][0]] == "name"]

    def _constant_list(self, a: int, b: int) -> bool:
        if b - a == 1 and self.kinds[a] == "name":
            if re.fullmatch(r"[A-Z][A-Z0-9_]+", self.words[a]):
                return True
            a, b = self.set_to(self.words[a]) or (b, b)
        if self.word(a) != "[":
            return False
        parts = self.parts(a + 1, self.pair[a])
        return bool(parts) and all(y - x == 1 and self.kinds[x] in ("string", "plain") for x, y in parts)

    def regexp_is_constant(self, line: int) -> bool:
        """Whether ``new RegExp`` near the line is given a literal, a name set to one, a part of another pattern, or the elements of a constant list."""
        made = (i for i, w in enumerate(self.words) if w == "RegExp" and self.word(i - 1) == "new" and self.word(i + 1) == "(" and self.pair[i + 1] > i + 2)
        at = next((i for i in made if abs(self.line(i - 1) - line) <= 1), None)
        if at is None:
            return False
        a, b = self.parts(at + 2, self.pair[at + 1])[0]
        if b - a == 1 and self.kinds[a] in ("string", "plain"):
            return True
        if b - a > 2 and self.words[b - 1] in ("source", "flags") and self.words[b - 2] in (".", "?."):
            return True
        if b - a != 1 or self.kinds[a] != "name":
            return False
        known = self.set_to(self.words[a])
        if known and known[1] - known[0] == 1 and self.kinds[known[0]] in ("string", "plain"):
            return True
        f = self.around(at, ("arrow", "expression"), self.words[a])
        if f is None or self.word(f.start - 1) not in ("(", ","):
            return False
        opened = self.within[f.start]
        method = opened - 1
        if self.word(opened) != "(" or self.word(method) not in EACH or self.word(method - 1) not in (".", "?."):
            return False
        return self._constant_list(self._chain_start(method), method - 1)


def _names(text: str) -> list[str]:
    return re.findall(r"[\w$]+", text) + re.findall(r"\w+", text)
