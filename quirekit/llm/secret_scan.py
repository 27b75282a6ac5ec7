"""Secrets found by what they are assigned to: name-literal pairs, constants propagated, scored by the name and the literal."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirekit.llm.common import column, id_type, rebatched

#: How telling a component of a name is.
SENSITIVE = {
    "password": 0.95, "passwd": 0.95, "passphrase": 0.95, "passcode": 0.9, "pwd": 0.9, "pass": 0.8, "pw": 0.6, "secret": 0.95, "secrets": 0.95, "token": 0.9, "tokens": 0.8,
    "apikey": 0.95, "accesskey": 0.95, "secretkey": 1.0, "privatekey": 1.0, "authtoken": 0.95, "accesstoken": 0.95, "credential": 0.9, "credentials": 0.9, "cred": 0.8, "creds": 0.8,
    "auth": 0.7, "authorization": 0.8, "bearer": 0.8, "signature": 0.6, "webhook": 0.6, "dsn": 0.6, "key": 0.6, "keys": 0.5,
}
#: Pairs of neighbouring components that tell more than either.
TOGETHER = {("api", "key"): 0.95, ("access", "key"): 0.95, ("private", "key"): 1.0, ("secret", "key"): 1.0, ("signing", "key"): 0.95, ("encryption", "key"): 0.95, ("account", "key"): 0.9, ("client", "secret"): 1.0, ("connection", "string"): 0.8}
#: Components after which a name is about a secret and isn't one.
ABOUT = {"path", "file", "filename", "dir", "url", "uri", "endpoint", "name", "id", "type", "kind", "length", "len", "size", "count", "max", "min", "limit", "policy", "field", "label", "hint", "prompt", "reset", "expiry", "expires", "expiration", "ttl", "public", "enabled", "required", "regex", "pattern", "column", "index", "map", "sort", "primary", "foreign", "tokenizer"}
#: A text without any of these holds no sensitive name and no address with a password, so it has no finding.
_HINT = r"(?i)pass|pwd|pw|secret|token|key|cred|auth|bearer|signature|webhook|dsn|connection|://"
_PLACEHOLDER = re.compile(r"(?i)^(?:x{3,}|\*{2,}|\.{2,}|-+|_+|<.*>|\[.*\]|\{.*\}|%.*%|your[-_ ].*|my[-_ ]?(?:password|secret|token|key)|change[-_ ]?me|example.*|placeholder|redacted|none|null|nil|true|false|undefined|todo|tbd|test|dummy|sample|default|string|password|secret|token|n/?a)$")

# Repeats without a bound are possessive, so a literal is read to its end in one go. The last way of the lexer passes a long name that nothing is assigned to, which else were read again from each dot in it.
_STRING = r"\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*+\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*+'''|[fFrRbBuU]{0,2}\"(?:[^\"\\\n]|\\.)*+\"|[fFrRbBuU]{0,2}'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\]|\\.)*+`"
_NAME = r"[A-Za-z_$][A-Za-z0-9_.\-]*+"
_BARE = r"[^\s\"'`,;()\[\]{}<>#|&]++"
_TERM = rf"(?:{_STRING}|\$\{{[A-Za-z_]\w*+\}}|{_BARE})"
_LEXER = re.compile(
    r"-----BEGIN (?P<pem>[A-Z0-9 ]*PRIVATE KEY[A-Z0-9 ]*)-----(?P<pembody>(?:[A-Za-z0-9+/=\s:,.]|-(?!----))++)"
    rf"|(?m:^(?P<indent>[ \t]*+)(?:-[ \t]++)?(?P<key>\"[\w.\- ]++\"|'[\w.\- ]++'|{_NAME})[ \t]*+:[ \t]*+[|>][-+0-9]*+[ \t]*+\n(?P<block>(?:(?P=indent)[ \t]++[^\n]*+(?:\n|\Z)|[ \t]*+\n)++))"
    rf"|(?P<url>\b[A-Za-z][A-Za-z0-9+.\-]{{1,30}}://(?P<user>[^\s:/@\"'<>]*+):(?P<word>[^\s@/\"'<>]++)@)"
    rf"|<(?P<tag>[A-Za-z_][\w.\-]*+)(?:\s[^<>]*+)?>(?P<body>[^<>\n]++)</(?P=tag)\s*>"
    rf"|--(?P<flag>[A-Za-z][\w\-]*+)[= ]\s?(?P<given>{_STRING}|{_BARE})"
    rf"|\(\s*(?P<arg>\"[\w.\-]++\"|'[\w.\-]++')\s*,\s*(?P<argval>{_STRING})"
    rf"|(?<![\w$])(?P<call>{_NAME})\(\s*(?P<callval>{_STRING})\s*\)"
    rf"|(?<![\w$])(?P<name>\"[\w.\- ]++\"|'[\w.\- ]++'|{_NAME})(?:\[(?P<sub>\"[^\"\n]++\"|'[^'\n]++')\])?"
    rf"(?:[ \t]*:[ \t]*[A-Za-z][\w\[\]., ]*+(?==))?[ \t]*(?:=>|:=|\+=|=(?![=~])|:(?![:/=]))[ \t]*"
    rf"(?:<<[~-]?[\"']?(?P<here>[A-Za-z_]\w*+)[\"']?[^\n]*+\n|(?P<value>{_TERM}(?:[ \t]*[+.][ \t]*{_TERM}|(?:[ \t]+|(?<=\+))(?:{_STRING}))*))"
    r"|(?<![\w$])[A-Za-z_$][A-Za-z0-9_.\-]{120,}+(?!://)"
)
_PARTS = re.compile(rf"(?P<text>{_STRING})|(?P<ref>\$\{{?[A-Za-z_]\w*+\}}?)|(?P<bare>{_BARE})")
_INSIDE = re.compile(r"\$\{?([A-Za-z_]\w*+)\}?|\{([A-Za-z_]\w*+)\}")
#: Characters of a literal's beginning that are kept with it.
HEAD = 64
_SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


class Literal:
    """A literal, or several joined: its parts are texts with where they are (start, end), texts alone, and other literals, by reference.

    So a constant that doubles from line to line takes room in proportion to the lines, whatever its length. Lengths, first and
    last characters and counts of characters are of the whole value."""

    __slots__ = ("_counts", "head", "last", "length", "parts")

    def __init__(self, parts: list) -> None:
        self.parts = parts
        self.length, self._counts, self.head, self.last = 0, None, "", ""
        for p in parts:
            text = p if isinstance(p, str) else p[0] if isinstance(p, tuple) else None
            length, head, last = (len(text), text[:HEAD], text[-1:]) if text is not None else (p.length, p.head, p.last)
            self.length += length
            self.head = (self.head + head)[:HEAD] if len(self.head) < HEAD else self.head
            self.last = last or self.last

    @property
    def counts(self) -> dict[str, int]:
        """How often each character is in it; counted once for each literal that it refers to."""
        stack = [self]
        while stack:
            v = stack[-1]
            left = [p for p in v.parts if isinstance(p, Literal) and p._counts is None] if v._counts is None else []
            if not left:
                stack.pop()
                if v._counts is None:
                    v._counts = Counter()
                    for p in v.parts:
                        v._counts.update(p._counts if isinstance(p, Literal) else p if isinstance(p, str) else p[0])
            stack += left
        return self._counts

    def leaves(self, seen: set[int]) -> Iterator[tuple[str, int, int]]:
        """The literals in the text that it is made of, in order, but for those of literals already seen."""
        stack: list = [self]
        while stack:
            p = stack.pop()
            if isinstance(p, tuple):
                yield p
            elif isinstance(p, Literal) and id(p) not in seen:
                seen.add(id(p))
                stack += p.parts[::-1]

    def joined(self) -> str:
        out, stack = [], [self]
        while stack:
            p = stack.pop()
            if isinstance(p, Literal):
                stack += p.parts[::-1]
            else:
                out.append(p if isinstance(p, str) else p[0])
        return "".join(out)


class Pair(NamedTuple):
    """A name, the literal it stands for after constants are propagated, whether all of it is quoted, and a number that pairs of the same parts share."""

    name: str
    literal: Literal
    quoted: bool
    same: int

    @property
    def value(self) -> str:
        return self.literal.joined()

    @property
    def spans(self) -> tuple[tuple[int, int], ...]:
        return tuple(dict.fromkeys((a, b) for _, a, b in self.literal.leaves(set())))

    @property
    def first(self) -> tuple[int, int]:
        return next((a, b) for _, a, b in self.literal.leaves(set()))


def name_score(name: str) -> float:
    parts = [p.lower() for p in _SPLIT.findall(name)]
    if not parts:
        return 0.0
    best = max((SENSITIVE.get(p, 0.0) for p in parts), default=0.0)
    best = max([best, *(TOGETHER.get(p, 0.0) for p in zip(parts, parts[1:]))])
    return best - 0.6 if parts[-1] in ABOUT or parts[0] == "public" else best


def value_score(v: Literal, quoted: bool) -> float:
    """From 0 to 1: how much like a secret a literal looks by its length, its variety and its kinds of characters."""
    blank = sum(k for c, k in v.counts.items() if c.isspace())
    head = v.head.lstrip()
    whole = v.joined().strip() if v.length <= HEAD else head + (v.last.strip() and v.last)  # what a placeholder is known by: all of a short one, both ends of a long one
    if v.length - blank < 6 or len(v.counts) < 4 or not head or _PLACEHOLDER.match(whole) or head[0] in "$%<{(":
        return 0.0
    seen = v.counts
    n = v.length
    bits = -sum(k / n * math.log2(k / n) for k in seen.values())
    kinds = any(c.islower() for c in seen) + any(c.isupper() for c in seen) + any(c.isdigit() for c in seen) + any(not c.isalnum() and not c.isspace() for c in seen)
    score = min(1.0, max(0.0, (bits - 1.8) / 1.7)) * min(1.0, 0.4 + n / 20)
    if kinds == 1 and not any(c.isdigit() for c in seen):
        score *= 0.75 if quoted else 0.2
    if " " in seen:
        score *= 0.5 if quoted else 0.2
    return score


def score_of(pair: Pair) -> float:
    name = name_score(pair.name)
    value = value_score(pair.literal, pair.quoted) if name > 0 else 0.0
    return 0.0 if value <= 0 else round(0.6 * name + 0.4 * value, 6)


def _quoted(s: str) -> tuple[str, int, int]:
    """The inside of a string literal, and how much of the literal is before and after it."""
    head = len(s) - len(s.lstrip("fFrRbBuU"))
    for mark in ('"""', "'''", '"', "'", "`"):
        if s.startswith(mark, head) and len(s) - head >= 2 * len(mark):
            return s[head + len(mark) : len(s) - len(mark)], head + len(mark), len(mark)
    return s, 0, 0


def pairs(text: str) -> list[Pair]:
    """The name-literal pairs of a text in their order, of assignments in source and settings, block scalars, here-documents, keyed and called arguments, flags, elements, addresses and armoured keys.

    A value that names a constant assigned above it, joins literals and constants or quotes constants in a literal is resolved, by reference."""
    known: dict[str, Pair] = {}
    out: list[Pair] = []
    numbers: dict[tuple, int] = {}
    ends: dict[str, list[int]] = {}

    def put(name: str, parts: list, quoted: bool) -> Pair:
        # parts of known constants carry the constant's own number
        keys = tuple(dict.fromkeys(k for k, _ in parts))
        same = numbers.setdefault(keys, len(numbers)) if len(keys) != 1 or isinstance(keys[0], tuple) else keys[0]
        pair = Pair(name, Literal([p for _, p in parts]) if len(parts) != 1 or not isinstance(parts[0][1], Literal) else parts[0][1], quoted, same)
        out.append(pair)
        return pair

    def plain(a: int, b: int) -> tuple:
        return (a, b), (text[a:b], a, b)

    def literal(m, group: str) -> tuple[list, bool]:
        s, at = m.group(group), m.start(group)
        _, before, after = _quoted(s)
        return [plain(at + before, at + len(s) - after)], before > 0

    def of(name: str) -> tuple:
        return known[name].same, known[name].literal

    def inside(a: int, b: int) -> list:
        """The parts of a quoted literal: itself, and the constants it quotes in place of their names."""
        found = [r for r in _INSIDE.finditer(text, a, b) if (r.group(1) or r.group(2)) in known]
        if not found:
            return [plain(a, b)]
        parts, at = [((a, b), ("", a, b))], a  # the whole of it is where the secret is
        for r in found:
            parts += [((a, b), text[at : r.start()]), of(r.group(1) or r.group(2))]
            at = r.end()
        return [*parts, ((a, b), text[at:b])]

    def stripped(a: int, b: int) -> tuple[int, int]:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        return a, b

    def end_of(tag: str, at: int) -> int:
        """Where the line that is only this tag begins, from `at` on; -1 if there is none."""
        if not ends:
            ends[""] = []
            a = 0
            for line in text.split("\n"):
                ends.setdefault(line.strip(), []).append(a)
                a += len(line) + 1
        lines = ends.get(tag, [])
        i = bisect_left(lines, at)
        return lines[i] if i < len(lines) else -1

    pos = 0
    while m := _LEXER.search(text, pos):
        pos = m.end()
        if m.group("pem"):
            put(m.group("pem"), [plain(*stripped(*m.span("pembody")))], True)
        elif m.group("key"):
            a, b = stripped(*m.span("block"))
            if a < b:
                name = m.group("key").strip("\"'")
                known[name] = known[name.rpartition(".")[2]] = put(name, [plain(a, b)], True)
        elif m.group("url"):
            put("url_password", [plain(*m.span("word"))], True)
        elif m.group("tag"):
            put(m.group("tag"), [plain(*m.span("body"))], True)
        elif m.group("flag"):
            put(m.group("flag"), *literal(m, "given"))
        elif m.group("arg"):
            put(m.group("arg")[1:-1], *literal(m, "argval"))
        elif m.group("call"):
            put(m.group("call"), *literal(m, "callval"))
        elif m.group("here"):
            b = end_of(m.group("here"), pos)
            if b >= 0:
                a, b = stripped(pos, b)
                if a < b:
                    name = (m.group("sub") or m.group("name")).strip("\"'")
                    known[name] = known[name.rpartition(".")[2]] = put(name, [plain(a, b)], True)
                    pos = b
        elif m.group("name"):
            name = (m.group("sub") or m.group("name")).strip("\"'")
            parts, quoted, opaque = [], True, False
            for p in _PARTS.finditer(text, m.start("value"), m.end("value")):
                if p.group("text"):
                    _, before, after = _quoted(p.group("text"))
                    parts += inside(p.start() + before, p.end() - after)
                    continue
                word = (p.group("ref") or p.group("bare")).strip("${}")
                if word in ("+", "."):
                    continue
                pieces = [w for w in word.split("+") if w]
                if pieces and all(w in known for w in pieces):
                    parts += map(of, pieces)
                    quoted &= all(known[w].quoted for w in pieces)
                else:
                    parts.append(plain(*p.span()))
                    quoted = False
                    opaque |= text[p.end() : p.end() + 1] in ("(", "[")  # a call or a look-up, not a literal
            if opaque:
                known.pop(name, None)
                continue
            known[name] = known[name.rpartition(".")[2]] = put(name, parts, quoted)
    return out


def findings(text: str, least: float = 0.68) -> list[tuple[Pair, float]]:
    """The pairs that score `least` or more; where two are made of the same parts, the one with the higher score, then the earlier."""
    best: dict[int, tuple[Pair, float]] = {}
    for p in pairs(text):
        if (s := score_of(p)) >= least and (p.same not in best or best[p.same][1] < s):
            best[p.same] = p, s
    return sorted(best.values(), key=lambda x: x[0].first)


def cleaned(text: str, least: float = 0.68, mask: str = "[SECRET]") -> str | None:
    """text with the literals of its secrets replaced by `mask`, again until it has none; None if it has none now."""
    found = findings(text, least)
    if not found:
        return None
    while found:
        seen: set[int] = set()
        out, at = [], 0
        for a, b in sorted({(a, b) for p, _ in found for _, a, b in p.literal.leaves(seen)}):
            if a >= at:
                out += [text[at:a], mask]
            at = max(at, b)
        new = "".join([*out, text[at:]])
        found = findings(new, least) if new != text else []
        text = new
    return text


def masked(value: Literal) -> str:
    return value.head[:3] + "*" * min(8, value.length - 3)


def secrets(docs: DataFrame, least: float = 0.68) -> DataFrame:
    """A row for each secret: (doc_id, name, start, end, length, masked, score).

    start and end are the characters of the first literal that the secret is made of, length is that of the whole value after
    constants are propagated. The score weighs how telling the name is (0.6) with how random the literal looks (0.4); names
    about secrets (password_file) and placeholders score little. Texts are lexed whole, and names and literals to their ends, however long. Constants may double
    from line to line, to a length of more than 2^63 - 1, which then stands for it.

    A null or empty text has no finding; rows with a null doc_id are scanned too and keep the null. doc_id may be of any type and keeps it. Rows of one doc_id, and
    equal rows, give their findings each; other columns are not read. An empty table gives none.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(it, 1024):
            rows = []
            for i, t in zip(column(batch, "doc_id").to_pylist(), column(batch, "text").to_pylist()):
                rows += [(i, p.name, *p.first, min(p.literal.length, (1 << 63) - 1), masked(p.literal), s) for p, s in findings(t, least)]
            types = (column(batch, "doc_id").type, pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.float64())
            cols = zip(*rows) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "name", "start", "end", "length", "masked", "score"])

    rows = docs.select(F.col("doc_id").cast(id_type(docs)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = id_type(docs)
    return rows.where(F.col("text").rlike(_HINT)).mapInArrow(run, f"doc_id {kind}, name string, start int, end int, length bigint, masked string, score double")


def without_secrets(docs: DataFrame, least: float = 0.68, mask: str = "[SECRET]") -> DataFrame:
    """docs with every literal that a secret is made of replaced by `mask`, and n_chars, where there is one, counted again. All rows stay, repeated ones too.

    Null and empty texts stay as they are; so do all other columns, whatever their names. Only texts with a hint of a secret go to Python, and only changed ones come back."""

    @F.arrow_udf("string")
    def redact(v: pa.Array) -> pa.Array:
        return pa.array([cleaned(t.as_py(), least, mask) if t.is_valid else None for t in v], pa.string())

    text = F.col("text").cast("string")
    out = docs.withColumn("text", F.coalesce(redact(F.when(text.rlike(_HINT), text)), text))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
