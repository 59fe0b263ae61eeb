"""Patterns from outside: ECMAScript regular expressions and globs as Java ones."""

from __future__ import annotations

import re

#: White space of ECMAScript that Java's \s lacks, as class members.
WIDE_SPACE = r"\s\x{A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def java_regex(source: str, flags: str = "") -> str:
    """Java form of an ECMAScript pattern; flags i, m and s become inline ones, g is the caller's."""
    out, i, in_class = [], 0, False
    while i < len(source):
        c = source[i]
        if c == "\\" and i + 1 < len(source):
            pair = source[i : i + 2]
            if pair == r"\s":
                out.append(WIDE_SPACE if in_class else f"[{WIDE_SPACE}]")
            elif pair == r"\S" and not in_class:
                out.append(f"[^{WIDE_SPACE}]")
            else:
                out.append(pair)
            i += 2
            continue
        if in_class:
            if c == "[":
                c = r"\["
            elif c == "&" and source[i + 1 : i + 2] == "&":
                c = r"\&"
            elif c == "]":
                in_class = False
        elif c == "[":
            in_class = True
            if source[i + 1 : i + 2] == "]":  # empty class: never matches
                out.append("(?!)")
                in_class, i = False, i + 2
                continue
        elif c == "{" and not re.match(r"\{\d+(?:,\d*)?\}", source[i:]):
            c = r"\{"
        elif c == "$" and "m" not in flags:
            c = r"\z"
        out.append(c)
        i += 1
    inline = "".join(f for f in "ims" if f in flags)
    return (f"(?{inline})" if inline else "") + "".join(out)


def glob_regex(glob: str, anchored: bool = True) -> str:
    """A star stands for anything, also for slashes; a glob without a star is looked for anywhere."""
    literal = ".*".join(re.escape(part) for part in glob.split("*"))
    return f"^{literal}$" if anchored and "*" in glob else literal


# Tokens of matchers (the rest of a path, one segment of it), and signs of a matcher that is a regular expression itself.
REST, SEGMENT = r"/:\w+\*", r":\w+"
REGULAR = r"[(|]|\.\*|\\[dwsDWS]|\[\^?"
_MATCHER = re.compile(rf"(?P<rest>{REST})|(?P<segment>{SEGMENT})|(?P<other>[\s\S])")
_MEANS = {"rest": "(?:/.*)?", "segment": "[^/]+"}


def _compiles(pattern: str) -> bool:
    try:
        re.compile(re.sub(r"\(\?<(?=[A-Za-z])", "(?P<", pattern))
    except re.error:
        return False
    return True


def matcher_pattern(matcher: str) -> str | None:
    """Java regex of the URLs that a matcher of routes covers; None if neither reading of it, as tokens or as a regular expression, makes sense."""
    as_tokens = "".join(_MEANS.get(m.lastgroup, m[0]) for m in _MATCHER.finditer(matcher))
    preferred = matcher if re.search(REGULAR, matcher) else as_tokens
    for reading in dict.fromkeys((preferred, as_tokens, matcher)):
        if _compiles(f"^{reading}$"):
            return java_regex(f"^{reading}$")
    return None
