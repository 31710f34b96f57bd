"""Secret scans (operator 10).

Three base patterns give spans of kinds assign, access and hex.  Assignment-aware lexing
adds spans of kind literal: source and configuration syntax is read as pairs of a target
name and a value (`name = "x"`, `"name": "x"`, `name: x`, `name := x`, `export NAME=x`, with
type annotations and sums of literals); names that stand for constants are propagated to
the places that use them, through other names too; and a literal is reported when the
target's parts (camelCase and snake_case are taken apart) and the literal's own look score
SCORE or more together.

Strings may be triple-quoted or go over several lines; what such a string holds is lexed,
too.  Values have any length: the end of an unquoted run is found once for all targets in
it, and values that end together are scored together, which keeps lexing linear.

Texts are screened as bytes: without `=`, `:` or `</` there is nothing to lex, and a run of
hexadecimal digits or an access key id is found before any pattern runs.

Defined cases: null counts as empty; empty texts have no spans.  Spans are code points,
end exclusive, ordered by start, then by kind as listed.  Each row is scanned by itself:
repeated rows have equal spans, null and repeated ids don't matter, an empty table gives an
empty result, and a very long text takes time in proportion to its length.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import ids_and_text, strings

KINDS = ("assign", "access", "hex", "literal")
SCORE = 0.5
MASK = "[SECRET]"
DIGESTS = "struct<n_assign:long,n_access:long,n_hex:long,base_sha256:string,spans:string>"
SPANS = "array<struct<kind:string,start:int,end:int,first:int,last:int>>"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_WORDS_OF_ASSIGN = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
_HEX_MAP = bytes(0x68 if chr(x) in "0123456789abcdef" else 0x20 for x in range(256))
_HEX_RUN = b"h" * 24

#: How much a part of a name, or two parts side by side, speaks for a secret.
_PARTS = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "passcode": 0.9, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "secrets": 0.9, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "bearer": 0.9, "auth": 0.6, "authorization": 0.7, "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0,
    "api key": 1.0, "access key": 1.0, "private key": 1.0, "secret key": 1.0, "signing key": 1.0, "encryption key": 1.0, "shared key": 0.9, "master key": 1.0, "connection string": 0.7,
}
_STEMS = tuple(sorted({k.split()[-1].encode() for k in _PARTS} | {b"pass", b"pwd"}, key=len))
_PLACEHOLDER = re.compile(r"(?i)(x{4,}|\*{3,}|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\)s|change_?me|example|placeholder|your[_-].*|none|null|true|false|undefined)")
_LONG = re.compile(r"(?i)your[_-]")
_X = re.compile(r"(?i)x{4,}|\*{3,}")
_TARGET = re.compile(
    r"""(?<![\w$.-])(?P<quote>["'`]?)(?P<name>[A-Za-z_$][\w$.-]*+)(?P=quote)(?:[ \t]*+[\]}])?[ \t]*+"""
    r"""(?::[ \t]*+(?P<type>[A-Za-z_][\w.<>\[\], \t]*+)(?==))?(?P<op>:=|=>|=(?!=)|:(?![:/]))[ \t]*+""",
    re.A,
)
_TERM = re.compile(
    r"""(?:[A-Za-z@$]{1,2}+(?=["'`]))?(?:\"{3}(?P<double3>(?:[^"\\]|\\.|"(?!""))*+)\"{3}|'{3}(?P<single3>(?:[^'\\]|\\.|'(?!''))*+)'{3}|`(?P<tick>[^`]*+)`"""
    r"""|"(?P<double>(?:[^"\\\n]|\\.)*+)"|'(?P<single>(?:[^'\\\n]|\\.)*+)'"""
    r"""|"(?P<key2>-----BEGIN [^"]*+)"|'(?P<key1>-----BEGIN [^']*+)')""",
    re.S,
)
_BARE = re.compile(r'''[^\s"'`,;(){}\[\]<>]++''')
_PROSE = re.compile(r"[\w>\]][ \t]++\w")
_PRIVATE = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY")
_PLUS = re.compile(r"[ \t]*\+[ \t]*")
#: Within brackets: what opens more of them, what parts and joins values, what closes.
_OPEN, _NEXT, _CLOSE = re.compile(r"(?:[(\[]\s*+)++"), re.compile(r"\s*+[,+]\s*+(?:[(\[]\s*+)*+|\s++(?=[\"'`])"), re.compile(r"(?:\s*+[)\]])++")
_CALL = re.compile(r"\(\s*+(?:[(\[]\s*+)*+")
_KEYWORD = re.compile(r"(?:new|await)[ \t]++(?=[\w$])")
#: Calls whose first argument is the name of what they give.
_KEYED = re.compile(r"(?:^|[._])(?:get|getenv|getproperty|getstring|environ|env|fetch|lookup|setdefault|pop|var|dig|require|config)$", re.I)
_ELEMENT = re.compile(r"<(?P<name>[A-Za-z_][\w.:-]{0,100}+)(?:\s[^<>]{0,200}+)?>(?P<value>[^<>\s]{6,}+)</(?P=name)>", re.A)
_ATTRIBUTES = re.compile(
    r"""(?<![\w.-])["']?(?:key|name|id|var|variable|setting|property)["']?\s{0,20}+[=:]\s{0,20}+(?P<q>["'])(?P<name>[\w.$-]{1,200}+)(?P=q)"""
    r"""\s{0,20}+,?\s{0,20}+["']?(?:value|val|content|default)["']?\s{0,20}+[=:]\s{0,20}+(?=["'])""",
    re.I | re.A,
)
_NAME = re.compile(r"[A-Za-z_$][\w$.-]*", re.A)
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


class Span(NamedTuple):
    """kind, the span, and within it the part that is secret."""

    kind: str
    start: int
    end: int
    first: int
    last: int


class Pair(NamedTuple):
    """A target name and its value: the places of literals, whether quoted, and names it refers to."""

    name: str
    literals: list[tuple[int, int, bool]]
    names: list[str]
    at: int


def base_spans(text: str, raw: bytes | None = None) -> list[Span]:
    """The spans of the three base patterns."""
    raw = text.encode() if raw is None else raw
    out = []
    if b"=" in raw or b":" in raw:
        low = raw.lower()
        if any(w in low for w in _WORDS_OF_ASSIGN):
            out += [Span("assign", *m.span(), *m.span(2)) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        out += [Span("access", *m.span(), *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    if _HEX_RUN in raw.translate(_HEX_MAP):
        out += [Span("hex", *m.span(), *m.span()) for m in _HEX.finditer(text) if len(m[0]) >= 24]
    return ordered(out)


def ordered(spans: Iterable[Span]) -> list[Span]:
    return sorted(set(spans), key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def lex(text: str) -> list[Pair]:
    """The assignments of a text in order."""
    out, words, at = [], [], 0
    run = (0, 0)
    while m := _TARGET.search(text, at):
        literals, names, end = [], [], m.end()
        inside, depth, keyed = None, 0, False
        if opened := _OPEN.match(text, end):
            depth, end = _brackets(opened[0]), opened.end()
        if keyword := _KEYWORD.match(text, end):
            end = keyword.end()
        while True:
            if term := _TERM.match(text, end):
                first, last = term.span(term.lastgroup)
                if not keyed:
                    literals.append((first, last, True))
                if inside is None and text.find("\n", first, last) >= 0:
                    inside = first
                end = term.end()
            else:
                if not run[0] <= end < run[1]:
                    bare = _BARE.match(text, end)
                    if not bare:
                        break
                    run = bare.span()
                word = _NAME.fullmatch(text, end, run[1])
                if word and (call := _CALL.match(text, run[1])):
                    depth, keyed, end = depth + _brackets(call[0]), bool(_KEYED.search(word[0])), call.end()
                    continue
                if keyed:
                    pass
                elif not word:
                    literals.append((end, run[1], False))
                elif any(c.isdigit() for c in word[0]):
                    words.append((word[0], end, literals, names))
                else:
                    names.append(word[0])
                end = run[1]
            keyed = False
            if depth and (closed := _CLOSE.match(text, end)):
                depth, end = depth - _brackets(closed[0]), closed.end()
            plus = _PLUS.match(text, end) if depth <= 0 else _NEXT.match(text, end)
            if not plus:
                break
            depth, end = max(depth, 0) + _brackets(plus[0]), plus.end()
            if opened := _OPEN.match(text, end):
                depth, end = depth + _brackets(opened[0]), opened.end()
        out.append(Pair(m["name"], literals, names, m.start()))
        # A bare value may itself be a target ("a=b=c"), and so may what looks like a type but is prose, and lines of a string.
        if m["type"] and _PROSE.search(m["type"].rstrip()):
            at = m.start("type")
        elif inside is not None:
            at = inside
        else:
            at = max(m.end(), end if literals and literals[-1][2] else m.end())
    if "</" in text:
        # An element's text is known by its tag.
        out += [Pair(m["name"], [(*m.span("value"), False)], [], m.start("value")) for m in _ELEMENT.finditer(text)]
    for m in _ATTRIBUTES.finditer(text):
        if term := _TERM.match(text, m.end()):
            out.append(Pair(m["name"], [(*term.span(term.lastgroup), True)], [], m.start("name")))
    out.sort(key=lambda p: p.at)
    # A bare word with digits is a name when the text assigns it, else a literal.
    assigned = {p.name for p in out}
    for word, start, literals, names in words:
        if word in assigned:
            names.append(word)
        else:
            literals.append((start, start + len(word), False))
    return out


def _brackets(text: str) -> int:
    return sum(c in "()[]" for c in text)


def name_score(name: str) -> float:
    """How much the name speaks for a secret, 0 to 1."""
    parts = [p.lower() for p in _PART.findall(name)]
    return max((_PARTS.get(p, 0.0) for p in [*parts, *map(" ".join, zip(parts, parts[1:], strict=False))]), default=0.0)


def literal_score(value: str, quoted: bool) -> float:
    """How much the literal looks like a secret, 0 to 1: long, mixed, not a placeholder; unquoted prose is none."""
    if quoted:
        if _PRIVATE.match(value.lstrip()):
            return 1.0
        lines = value.split("\n") if "\n" in value else []
        if lines:
            # Over several lines only what is wrapped at one width is a single word.
            lines = [x for x in (x.strip().removesuffix("\\") for x in lines) if x]
            if not lines or any(len(x) != len(lines[0]) or len(x) < 16 for x in lines[:-1]):
                return 0.0
            value = "".join(lines)
    if len(value) < 6 or any(c.isspace() for c in value) or _PLACEHOLDER.fullmatch(value):
        return 0.0
    return _look(Counter(value), len(value), quoted)


def _look(count: Counter, n: int, quoted: bool) -> float:
    letters, digits = any(c.isalpha() for c in count), any(c.isdigit() for c in count)
    if not quoted and not (letters and digits):
        return 0.0
    bits = -sum(k / n * math.log2(k / n) for k in count.values())
    return min(1.0, 0.3 + 0.2 * (n >= 8) + 0.5 * min(1.0, bits / 3))


def _scores(text: str, literals: set[tuple[int, int, bool]]) -> dict[tuple[int, int, bool], float]:
    """The scores of literals; unquoted ones that end together are counted in one go, from the last."""
    out, end, at = {}, None, 0
    count: Counter = Counter()
    for place in sorted(literals, key=lambda x: (x[1], x[0]), reverse=True):
        first, last, quoted = place
        if quoted:
            out[place] = literal_score(text[first:last], True)
            continue
        if last != end:
            end = at = last
            count = Counter()
        count.update(text[first:at])
        at = first
        # A bare run has no blanks, and of placeholders those that are long begin alike.
        empty = last - first < 6 or _LONG.match(text, first, last) or (last - first < 64 and _PLACEHOLDER.fullmatch(text, first, last)) or _X.fullmatch(text, first, last)
        out[place] = 0.0 if empty else _look(count, last - first, False)
    return out


def literal_spans(text: str, threshold: float = SCORE) -> list[Span]:
    """The literals that reach a sensitive target, directly or through constants."""
    pairs = lex(text)
    before: dict[str, list[Pair]] = {}
    for p in pairs:
        before.setdefault(p.name, []).append(p)
    places = {name: [p.at for p in known] for name, known in before.items()}
    reached: list[tuple[float, tuple[int, int, bool]]] = []
    seen: set[int] = set()
    # The most telling targets come first, so that what they reach need not be reached again.
    weighed = sorted(((name_score(p.name), p) for p in pairs), key=lambda x: -x[0])
    for weight, pair in weighed:
        if weight < threshold:
            break
        todo = [pair]
        while todo:
            p = todo.pop()
            if p.at in seen:
                continue
            seen.add(p.at)
            reached += [(weight, place) for place in p.literals]
            for name in p.names:
                if known := before.get(name):
                    todo.append(known[max(0, bisect.bisect_left(places[name], p.at) - 1)])
    scores = _scores(text, {place for _, place in reached})
    return [Span("literal", start, end, start, end) for weight, (start, end, quoted) in reached if weight * scores[start, end, quoted] >= threshold]


def secrets_in(text: str | None, threshold: float = SCORE) -> list[Span]:
    """All spans of a text, base and lexed."""
    if not text:
        return []
    raw = text.encode()
    found = base_spans(text, raw)
    if b"=" in raw or b":" in raw or b"</" in raw:
        low = raw.lower()
        if any(s in low for s in _STEMS):
            found += literal_spans(text, threshold)
    return ordered(found)


def redact(text: str, spans: list[Span], mask: str = MASK) -> str:
    """The text with the secret part of each span masked."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s.first, -s.last)):
        if s.last <= at:
            continue
        if s.first >= at:
            out += [text[at : s.first], mask]
        at = s.last
    return "".join([*out, text[at:]])


def joined(spans: Iterable[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


_ROW = pa.list_(pa.struct([("kind", pa.string()), *((k, pa.int32()) for k in ("start", "end", "first", "last"))]))


def _find(texts: pa.Array) -> pa.Array:
    return pa.array(([s._asdict() for s in secrets_in(x)] for x in strings(texts)), _ROW)


def _digest(texts: pa.Array) -> pa.Array:
    rows = []
    for text in strings(texts):
        spans = secrets_in(text)
        base = [s for s in spans if s.kind != "literal"]
        count = Counter(s.kind for s in base)
        rows.append((count["assign"], count["access"], count["hex"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
    columns = list(zip(*rows, strict=True)) or [()] * 5
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def _redact(texts: pa.Array) -> pa.Array:
    return pa.array((redact(x, secrets_in(x)) if x else x for x in strings(texts)), pa.string())


def find_secrets(text: Column | str) -> Column:
    """Array of spans: kind, start, end, and first-last of the secret part."""
    return F.arrow_udf(_find, SPANS)(text)


def redacted(text: Column | str) -> Column:
    """The text with every secret masked; null stays null."""
    return F.arrow_udf(_redact, "string")(text)


def secret_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every document."""
    return ids_and_text(docs, id_col, text_col).select("doc_id", F.arrow_udf(_digest, DIGESTS)("text").alias("r")).select("doc_id", "r.*")
