"""Which rules a text can match at all, by literals that every match of a rule has to hold.

Each pattern gives a set of literals of which a match holds at least one. All literals of a pack make one automaton, which reads a text once;
rules of which it meets a literal, and those that have none, are candidates. So most rules never run on most files, and
no expression grows with the pack.
"""

from __future__ import annotations

import re
from functools import lru_cache
from re import _constants as K
from re import _parser

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A rule that needs one of more literals than this is always a candidate.
MOST = 64


def required(pattern: str) -> frozenset[str] | None:
    """Lower-case ASCII literals of which any match of a Java pattern holds one, whatever its case; None where there is no such set.

    A pattern that cannot be read is one without literals.
    """
    source = re.sub(r"\\x\{([0-9A-Fa-f]{1,4})\}", lambda m: "\\u" + m[1].zfill(4), pattern).replace(r"\z", r"\Z").replace("(?<", "(?P<").replace("(?P<=", "(?<=").replace("(?P<!", "(?<!")
    try:
        found = _best(_parser.parse(source))
    except (re.error, OverflowError, RecursionError):
        return None
    return found if found and len(found) <= MOST else None


def _worth(literals: frozenset[str]) -> tuple[int, int]:
    return min(map(len, literals)), -len(literals)


def _letter(op, value) -> str | None:
    """The one character that an item stands for, but for its case."""
    if op is K.LITERAL and value < 128:
        return chr(value).lower()
    if op is K.IN and all(o is K.LITERAL and v < 128 for o, v in value):
        chars = {chr(v).lower() for _, v in value}
        return chars.pop() if len(chars) == 1 else None
    return None


def _best(items) -> frozenset[str] | None:
    sets, run = [], ""
    for op, value in items:
        letter = _letter(op, value)
        if letter is not None:
            run += letter
            continue
        if op is K.AT:  # takes no room
            continue
        if run:
            sets.append(frozenset([run]))
            run = ""
        inner = None
        if op is K.SUBPATTERN:
            inner = _best(value[3])
        elif op is K.ATOMIC_GROUP:
            inner = _best(value)
        elif op is K.BRANCH:
            each = [_best(v) for v in value[1]]
            inner = frozenset().union(*each) if all(each) else None
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT) and value[0] >= 1:
            inner = _best(value[2])
        if inner:
            sets.append(inner)
    if run:
        sets.append(frozenset([run]))
    return max(sets, key=_worth, default=None)


@lru_cache(maxsize=4)
def _automaton(words: tuple[tuple[str, tuple[int, ...]], ...]):
    found = ahocorasick.Automaton()
    for word, rules in words:
        found.add_word(word, rules)
    found.make_automaton()
    return found


def candidates(patterns: list[str], languages: list[tuple[str, ...]], content: Column, language: Column) -> Column:
    """array<int>: numbers of the rules for the language that the content can match, ascending; empty for null content or language."""
    needed: dict[str, list[int]] = {}
    always: list[int] = []
    for n, p in enumerate(patterns):
        for word in required(p) or ():
            needed.setdefault(word, []).append(n)
        if not required(p):
            always.append(n)
    words = tuple((w, tuple(r)) for w, r in sorted(needed.items()))
    spoken: dict[str, frozenset[int]] = {x: frozenset(n for n, of in enumerate(languages) if x in of) for of in languages for x in of}

    @F.arrow_udf("array<int>")
    def met(contents: pa.Array, names: pa.Array) -> pa.Array:
        automaton, out = _automaton(words) if words else None, []
        for text, name in zip(contents.to_pylist(), names.to_pylist()):
            able = spoken.get(name, frozenset())
            if text is None or not able:
                out.append([])
                continue
            hit = set(always)
            if automaton is not None:
                for rules in {rules for _, rules in automaton.iter(text.lower())}:
                    hit.update(rules)
            out.append(sorted(hit & able))
        return pa.array(out, pa.list_(pa.int32()))

    return met(content, language)
