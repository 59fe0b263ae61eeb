"""What surrounds a match in its file: lines, comments, directives, strings, and the guards that drop a match.

A file that some rule hits is indexed once: line breaks, quotes and comments by position, so that each match is placed by bisection. What
depends on a line alone is kept for the line's other matches. So a file costs time in proportion to its size and its matches.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from functools import cached_property

from talonscan.operators.syntax import Tree

WHITE = " \t\n\x0b\f\r"
#: Strings, line comments and block comments of C-like languages, each to its end or to the end of the file.
TOKENS = re.compile(r"""//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+(?:\*/|\Z)|'(?:[^'\\]++|\\[\s\S])*+(?:'|\Z)|"(?:[^"\\]++|\\[\s\S])*+(?:"|\Z)|`(?:[^`\\]++|\\[\s\S])*+(?:`|\Z)""")
#: How comment lines begin, names of display strings, paths and words of harmless values, languages with block comments.
COMMENT = r"^\s*(?://|#|\*|<!--|/\*)"
SHOWN = r"^(?:fixCode|fix|description|exploit|audit|title|message|label|reason|details|summary|hint)\s*[:=]"
RULE_ID = r"^\s*id\s*:\s*[\"']VG"
I18N_PATH = r"(?i)(?:/i18n/|/locales?/|/translations?/|/event[-_]tracker/|/analytics/events/|/messages/[a-z]{2}(?:[-_][A-Z]{2})?\.[jt]sx?\Z)"
SEED_PATH = r"(?i)(?:^|/)(?:scripts|seeds?|fixtures?|__fixtures__|bookingScenario|setupAndTeardown)\b|(?:^|/)seed[-_.][\w-]*\.[jt]sx?\Z"
BUILD_PATH = r"(?i)(?:^|/)(?:Gruntfile|gulpfile|webpack\.config|rollup\.config|vite\.config|esbuild|metro\.config)\.[cm]?[jt]s\Z"
HARMLESS = r"(?:^|\s|\b)(?:testing|example|mock|placeholder|sample|demo|fake|dummy|stub|fixture)[A-Z_]"
HARMLESS_VALUE = r"(?i)^(?:mock|example|sample|demo|fake|dummy|stub|placeholder|changeme|change-me|your[-_]|xxx|todo|replace[-_]?me)"
SAYS = r"(?i)(?:message|msg|error|\berr\b|label|title|hint|text|placeholder|description|tooltip|notice|warning|caption|heading|prompt|copy)"
SENTENCE = r"^[A-Za-z][A-Za-z .,!?'’()-]*\s[A-Za-z .,!?'’()-]+\Z"
CHECKSUM = r"(?i)(?:readFileSync|createReadStream|\bBuffer\b|\.update\s*\(\s*(?:buffer|buf|fileBuffer)|fs\.read|\.md5\b|checksum|etag|integrity|cacheKey|cache[_-]?key|contentHash|fileHash|subresource)"
PASSWORD = r"(?i)(?:password|passwd|\bpwd\b|credential|user\.pass|loginPass)"
CONFIRM = r"(?i)(?:cpassword|confirm[_]?password|password[_]?confirm(?:ation)?|password2|repeat[_]?password|retype[_]?password|verify[_]?password)"
USER_INPUT = r"\b(?:req|request|body|query|params|searchParams)\.\w+|^(?:userInput|userMessage|userPrompt|prompt|input|message)\b|\buser(?:Input|Message|Prompt|Query|Text|Content|Data)\b"
#: Fixed values of guards: credentials that are names, numbers and sentences; assigned literals; stages; exempt versions; hashes; comparisons; enums.
STRING_OF_TEN = r"""[:=]\s*["'`]([^"'`]{10,})["'`]"""
ASSIGNED = r"""\b([A-Za-z_][A-Za-z0-9_]*)\s*[:=]\s*["']({value})["']"""
NUMBER_NAMED = r"""\b[A-Z][A-Z0-9_]*\s*=\s*["']\d+["']"""
QUOTED = r"""[:=]\s*["']([^"'\n]{3,})["']"""
LITERAL_SET = r"""\b(?:const|let|var)\s+(?=(\w+)\s*(?::\s*[\w<>\[\],\s]+\s*)?=\s*(?:"[^"]*"|'[^']*'|`[^`$]*`)\s*;?)"""
LIST_SET = r"\b(?:const|let|var)\s+(?=([\w$]+)\s*(?::\s*[\w<>\[\],\s|.]+)?\s*=\s*\[)"
URL_SET = r"""(?<!\w)([A-Za-z_$]\w*)\s*=\s*(?:["'`]https?://|process\.env\b)"""
URL_NAME = r"\(\s*([A-Za-z_$]\w*)\s*[,)]"
STAGES = r"(?im)^FROM\s+\S+\s+AS\s+(\w[\w.-]*)"
STAGE = r"(?i)^(?:FROM\s+)?([^:@\s]*)"
EXEMPT = r'"(?:engines|overrides|resolutions|pnpm)"\s*:\s*\{'
SECRET_VALUE = r"""(?i)(?:SECRET|PASSWORD|TOKEN|KEY|CREDENTIAL)\w*\s*[=:]\s*["']?([^"'\s]+)"""
VERIFIED = r"(?i)jwt\.verify\s*\(|jwtVerify\s*\(|jose[\s\S]{0,60}?(?:jwtVerify|verify)"
SAME_WORD = r"""(?i)(?:password|passwd|pwd)\s*(?:===|!==|==|!=)\s*(['"])\1"""
CONSTANT_AFTER = r"""^\s*:\s*(?:true|false|null|-?\d+(?:\.\d+)?|'[^'`$+]*'|"[^"`$+]*")\s*[},\]]"""
ENUM_NAME = r"""(?:z\.enum\s*\(\s*(?:\.\.\.)?|enum["']\s*:\s*)([a-z_$][\w$]*)"""
ENUM_PATH = r"z\.enum\s*\(\s*[\w$]+(?:\.[\w$]+)+"
#: Bound parameters and harmless interpolations of SQL, other calls that look like SQL, bracket assignments, names of cleaned values.
BOUND = r"\b(?:bind|replacements)\s*:"
PLACEHOLDER = r"[=\s](?:\$\d+|:[a-zA-Z_]\w*)\b"
CLEANED = r"(?i)\$\{\s*[\w$.]*(?:hash|sha\d*|md5|bcrypt|argon2?|hmac|digest|encode|escape|encodeURIComponent|toString|String|Number|parseInt|parseFloat)\b"
QUESTION_MARKS = r"""\.map\s*\(\s*\(?[\w,\s]*\)?\s*=>\s*["']\?["']|^\$\{\s*["']\?["']\s*\}\Z"""
SQL_WORD = r"(?i)\b(?:SELECT|INSERT|UPDATE|DELETE|FROM|WHERE|JOIN|UNION|DROP|TRUNCATE|ALTER|CREATE\s+TABLE)\b"
HTTP_CLIENT = r"(?i)(?:this\.)?(?:http|httpClient|httpService|api|client)\.(?:get|post|put|delete|patch|head|options)\s*\("
HTTP_IMPORT = r"(?i)from\s+['\"]@angular/common/http['\"]|import\s+.*HttpClient"
HTTP_PATH = r"(?i)\.(?:service|component|directive|pipe|guard|resolver|interceptor)\.ts\Z"
FETCHES = r"(?i)(?:fetch|axios|got|ky|undici|requests?)\s*[.\(]|axios\.(?:get|post|put|delete|patch)"
URL_FIRST = r"""\(\s*[`'"]\s*/[a-zA-Z0-9_\-/{}$]"""
VERB_OF_THIS = r"(?i)(?:^|[\s=])(?:return\s+|await\s+)?this\.(?:get|post|put|delete|patch|head|options|fetch|request)\s*\("
SOQL = (r"(?i)from\s+[\"']@?jsforce[\w@/-]*[\"']", r"(?i)sanitiz\w*Soql\w*")
STRUCTURED = r"(?i)\boutput\s*:\s*Output\.(?:array|object|enum)\s*\("
STRIPPED_ROLE = r"(?i)\b(?:convertToUI|filterMessages|pickRole|sanitizeMessages|publicMessages|visibleMessages|userMessages|convertMessages)"
KEY_SET = r"\w+\s*\[\s*(?:key|field|prop|name|column|attr|param)\s*\]\s*=(?!=)"
ESCAPED_PATTERN = r"\bnew\s+RegExp\s*\(\s*(?:escaped|escape\w*|sanitized|sanitiz\w*|safe[A-Z_]\w*|validated)\w*\b"
ESCAPED_PART = r"\$\{\s*(?:escaped|escape\w*|sanitized|sanitiz\w*|safe[A-Z_]\w*|validated)"
DOC_LINE = r"^\s*\*\s|^\s*/\*\*|^\s*\*/"
ACCEPTED_HTML = r"(?i)biome-ignore\s+lint/security/noDangerouslySetInnerHtml\b|eslint-disable(?:-next-line)?\b[^\n]{0,200}react/no-danger\b"
LITERAL_HTML = r"""\.\w+\s*=\s*(?:"[^"\n]*"|'[^'\n]*')\s*;?\s*\Z"""
PRIVATE = r'"private"\s*:\s*true\b'
PUBLISHED = r'(?i)"(?:bin|exports|module|types|typings)"\s*:'
BUILT_MAIN = r'(?i)"main"\s*:\s*"(?:dist|build|lib|out)/'
STARTED = r'(?i)"start"\s*:\s*"(?:[A-Z_][A-Z0-9_]*=\S+\s+)*(?:node|nodemon|tsx|ts-node|next|nest|vite|remix|astro)\b'
BOUNDED = r"(?i)\bin\s*:\s*[\[a-zA-Z_$]|\b(?:id|[a-zA-Z]+Id)\s*(?::\s*(?:\{?\s*in\s*:|[a-zA-Z_$])|[,}])"
PARAMETER_AND_SINK = (r"\b(?:params|searchParams)\b", r"\b(?:query|execute|findUnique|findFirst|findMany|delete|update|create|upsert|aggregate|count|groupBy)\s*\(")


def found(pattern: str, text: str, group: int = 0) -> str:
    """What the pattern, or its group, finds first; empty if nothing."""
    m = re.search(pattern, text, re.A)
    return (m[group] or "") if m else ""


def says(pattern: str, text: str) -> bool:
    return re.search(pattern, text, re.A) is not None


def block_comments(content: str) -> list[tuple[int, int]]:
    """First and last line, from 1, of each block comment outside of strings and line comments."""
    if "/*" not in content:
        return []
    out, line, at = [], 1, 0
    for m in TOKENS.finditer(content):
        line += content.count("\n", at, m.start())
        last = line + content.count("\n", m.start(), m.end())
        if m[0].startswith("/*"):
            out.append((line, last))
        line, at = last, m.end()
    return out


def directives(lines: list[str], word: str) -> list[tuple[int, str | None]]:
    """Lines, from 1, that comments with the word silence, for one rule or (None) all.

    ``word-next-line`` is for the next line; a comment behind code is for its line; a comment line is for itself and the next five lines
    of code among ten, not beyond an empty line; comment lines between are passed over.
    """
    pattern = re.compile(rf"(?i)(?://|#|<!--)\s*{re.escape(word)}(?:-next-line)?\s*(VG\d+)?", re.A)
    out = []
    for n, line in enumerate(lines):
        m = pattern.search(line)
        if not m:
            continue
        rule = m[1] or None
        if f"{word}-next-line" in line:
            out.append((n + 2, rule))
            continue
        out.append((n + 1, rule))
        if re.match(r"\s*(?://|#|<!--)", line, re.A):
            code = []
            for k in range(n + 1, min(n + 11, len(lines))):
                if not lines[k].strip(WHITE):
                    break
                if not re.match(r"\s*(?://|#|<!--|\*)", lines[k], re.A):
                    code.append(k + 1)
            out += [(k, rule) for k in code[:5]]
    return out


class Source:
    """An indexed file. Lines count from 1."""

    def __init__(self, content: str, path: str | None, language: str, word: str) -> None:
        self.content, self.path, self.language, self.word = content, path, language, word
        self.lines = content.split("\n")
        self.starts = [0]
        for line in self.lines:
            self.starts.append(self.starts[-1] + len(line) + 1)
        self._kept: dict[tuple, object] = {}

    def once(self, key: str, line: int, make: Callable[[], object]):
        """A value of a line, found once."""
        if (key, line) not in self._kept:
            self._kept[key, line] = make()
        return self._kept[key, line]

    def line_at(self, at: int) -> int:
        return bisect_right(self.starts, at, 0, len(self.lines))

    def around(self, line: int, back: int, ahead: int) -> str:
        return "\n".join(self.lines[max(line - 1 - back, 0) : line + ahead])

    @cached_property
    def tree(self) -> Tree:
        return Tree(self.content)

    @cached_property
    def _silenced(self) -> dict[int, set[str | None]]:
        out: dict[int, set[str | None]] = {}
        if self.word.lower() in self.content.lower():
            for line, rule in directives(self.lines, self.word):
                out.setdefault(line, set()).add(rule and rule.upper())
        return out

    def silenced(self, line: int, rule: str) -> bool:
        return line in self._silenced and not self._silenced[line].isdisjoint((None, rule))

    @cached_property
    def _comments(self) -> list[tuple[int, int]]:
        return block_comments(self.content) if self.language in ("javascript", "typescript", "go") else []

    def commented(self, line: int) -> bool:
        if says(COMMENT, self.lines[line - 1]):
            return True
        n = bisect_right(self._comments, (line, len(self.starts) + 1)) - 1
        return n >= 0 and self._comments[n][1] >= line

    @cached_property
    def _quotes(self) -> dict[str, list[int]]:
        return {q: [m.start() for m in re.finditer(rf"(?<!\\){q}", self.content)] for q in "`'\""}

    def _odd(self, quote: str, first: int, at: int) -> bool:
        return (bisect_left(self._quotes[quote], at) - bisect_left(self._quotes[quote], first)) % 2 == 1

    def in_string(self, line: int, at: int) -> bool:
        """Whether a place lies in a template, in joined or escaped strings, or in a display string."""
        text = self.lines[line - 1]

        def joined():
            return (text.lstrip(" ")[:1] in ("'", '"') and text.rstrip(WHITE).endswith("+")) or says("^\\s*\\+\\s*[\"']", text)

        def escaped():
            first = re.search("[\"'`]", text)
            return first is not None and text.find("\\n", first.end()) >= 0

        def shown():
            for k, x in enumerate(reversed(self.lines[max(line - 20, 0) : line])):
                if says(SHOWN, x.lstrip(WHITE)):
                    return True
                if says(RULE_ID, x) or (k >= 2 and x.lstrip(WHITE).startswith("{")):
                    return False
            return False

        if self._odd("`", 0, at) or self.once("joined", line, joined) or self.once("shown", line, shown):
            return True
        first = self.starts[line - 1]
        return bool(self.once("escaped", line, escaped)) and (self._odd("'", first, at) or self._odd('"', first, at))

    @cached_property
    def minified(self) -> bool:
        return len(self.content) >= 5000 and any(len(x) > 1000 for x in self.lines)

    def names(self, pattern: str) -> set[str]:
        return self.once(pattern, 0, lambda: set(re.findall(pattern, self.content, re.A)))

    def has(self, *patterns: str) -> bool:
        return all(self.once(p, 0, lambda p=p: says(p, self.content)) for p in patterns)


def harmless_value(line: str, path: str) -> bool:
    """Whether a line that looks like a credential is a sentence, a name, a slug, a placeholder, a number or a message of the interface."""
    plain = lambda s: re.sub("[^a-z0-9]", "", s.lower())

    def pair(value):
        m = re.search(ASSIGNED.replace("{value}", value), line, re.A)
        return (m[1], m[2]) if m else ("", "")

    if len(re.split(r"\s+", found(STRING_OF_TEN, line, 1), flags=re.A)) >= 4 or says(I18N_PATH, path) or says(SEED_PATH, path) or says(HARMLESS, line):
        return True
    name, value = pair(r"[\w-]+")
    key, slug = pair("[a-z][a-z-]*")
    label, words = pair("[^\"']{3,}")
    return (
        (name != "" and plain(name) == plain(value))
        or (key[:1].isupper() and says(r"^[a-z]+(?:-[a-z]+)+\Z", slug))
        or says(HARMLESS_VALUE, found(QUOTED, line, 1))
        or says(NUMBER_NAMED, line)
        or (says(SAYS, label) and says(SENTENCE, words))
    )


class Match:
    """A match in its file."""

    def __init__(self, source: Source, text: str, at: int, line: int) -> None:
        self.of, self.text, self.at, self.line = source, text, at, line
        self.path = source.path or ""
        self.code = source.lines[line - 1]

    def name(self, pattern: str) -> str:
        return found(pattern, self.text, 1)

    def once(self, key: str, make: Callable[[], object]):
        return self.of.once(key, self.line, make)

    def is_(self, pattern: str) -> bool:
        """Whether the line fits."""
        return bool(self.once(pattern, lambda: says(pattern, self.code)))


def _exempt_version(m: Match) -> bool:
    if not m.path.endswith("package.json"):
        return False
    for x in reversed(m.of.lines[max(m.line - 6, 0) : m.line]):
        if says(EXEMPT, x):
            return True
        if says(r"^\s*\}", x):
            return False
    return False


def _placeholders(m: Match) -> bool:
    """SQL in a template of which every part is harmless, and bound, or makes question marks only."""
    content = m.of.content
    first = content.find("`", m.at)
    if first < 0:
        return False
    last = content.find("`", first + 1)
    template = content[first + 1 : last] if last >= 0 else ""
    call = content[m.at : (last if last >= 0 else m.at) + 200]
    parts = re.findall(r"\$\{[^}]*\}", template)
    bound = says(BOUND, call) or says(PLACEHOLDER, template)
    return bool(parts) and (bound and all(says(CLEANED, p) for p in parts) or all(says(QUESTION_MARKS, p) for p in parts))


def _other_call(m: Match) -> bool:
    """A call that looks like SQL and is one of HTTP, or of a store of keys."""
    if m.is_(HTTP_CLIENT) and (m.of.has(HTTP_IMPORT) or says(HTTP_PATH, m.path)):
        return True
    weak = found(r"^\w+", m.text).lower() in ("get", "run", "all")
    return not m.is_(SQL_WORD) and (m.is_(FETCHES) or m.is_(URL_FIRST) or m.is_(VERB_OF_THIS) or weak)


def _fixed_prompt(m: Match) -> bool:
    parts = re.findall(r"\$\{([^}]+)\}", m.of.around(m.line, 0, 6))
    return bool(parts) and not any(says(USER_INPUT, p.strip(WHITE)) for p in parts)


def _application(m: Match) -> bool:
    of = m.of
    return of.has(PRIVATE) or (not of.has(PUBLISHED) and not of.has(BUILT_MAIN) and of.has(STARTED))


def _enum_of_constants(m: Match) -> bool:
    name = m.name(ENUM_NAME)
    return (name != "" and name in m.of.names(LIST_SET)) or (m.is_(ENUM_PATH) and (m.is_(r"\.enumValues\b") or m.of.has(r"\bas\s+const\b")))


def _no_flow(m: Match) -> bool:
    return m.path != "" and m.of.has(*PARAMETER_AND_SINK) and not m.of.once("reaches", 0, m.of.tree.parameter_reaches_sink)


def _checksum(m: Match) -> bool:
    window = m.of.around(m.line, 4, 4)
    return (says(BUILD_PATH, m.path) or bool(m.once("sum", lambda: says(CHECKSUM, window)))) and not m.once("pass", lambda: says(PASSWORD, window))


#: (rules, whether a match is dropped). A question of syntax is asked of files with a path only.
GUARDS: list[tuple[str, Callable[[Match], bool]]] = [
    ("VG126 VG120", lambda m: m.of.minified),
    ("VG202", lambda m: m.name(STAGE).lower() in {x.lower() for x in m.of.names(STAGES)}),
    ("VG409", lambda m: m.name(r"\(\s*(\w+)") in m.of.names(LITERAL_SET)),
    ("VG120", lambda m: m.name(URL_NAME) in m.of.names(URL_SET)),
    ("VG020", _exempt_version),
    ("VG001 VG062", lambda m: bool(m.once("harmless", lambda: harmless_value(m.code, m.path)))),
    ("VG514", lambda m: says(r"^\$\{?\w+\}?\Z", m.name(SECRET_VALUE))),
    ("VG1083", lambda m: says(r"\.decode\s*\(", m.text) and m.of.has(VERIFIED)),
    ("VG138", lambda m: m.is_(CONFIRM) or m.is_(SAME_WORD)),
    ("VG1002", lambda m: says(CONSTANT_AFTER, m.of.content[m.at + len(m.text) : m.at + len(m.text) + 80])),
    ("VG060", _checksum),
    ("VG106", lambda m: m.is_(r"\b\w*Ref\.current\b")),
    ("VG1021", _enum_of_constants),
    ("VG850", _fixed_prompt),
    ("VG010 VG123", lambda m: _placeholders(m) or m.of.has(*SOQL)),
    ("VG010", _other_call),
    ("VG406", _no_flow),
    ("VG950", lambda m: m.path != "" and m.of.tree.find_is_guarded(m.line)),
    ("VG951", lambda m: m.path != "" and m.of.tree.change_is_guarded(m.line)),
    ("VG126", lambda m: m.is_(ESCAPED_PATTERN) or (m.path != "" and m.of.tree.regexp_is_constant(m.line))),
    ("VG999", lambda m: says(STRUCTURED, m.text)),
    ("VG1027", lambda m: says(STRIPPED_ROLE, m.of.around(m.line, 0, 3))),
    ("VG152", lambda m: not says(KEY_SET, m.of.content[m.at : m.at + len(m.text) + 10])),
    ("VG1009", lambda m: m.is_(ESCAPED_PART)),
    ("VG426", lambda m: m.is_(DOC_LINE)),
    ("VG012 VG408 VG042 VG852", lambda m: says(ACCEPTED_HTML, m.of.around(m.line, 3, 3))),
    ("VG012", lambda m: m.is_(LITERAL_HTML) and m.is_(r"\.innerHTML\s*=")),
    ("VG863", _application),
    ("VG955", lambda m: says(BOUNDED, m.text)),
]
