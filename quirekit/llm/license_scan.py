"""Licence texts found by token automata compiled from marked-up templates."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirekit.llm.common import column, id_type, rebatched
from quirekit.llm.license_templates import TEMPLATES

_TOKEN = re.compile(r"[^\W_]+")
_MARK = re.compile(r"<<(opt|/opt|var (\d+))>>")
#: Spellings that count as the same word.
SAME = {"licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "organisation": "organization", "authorised": "authorized", "favour": "favor", "acknowledgement": "acknowledgment"}
#: Every template has a mandatory word that contains one of these, so a text without any has no match.
HINTS = ("licens", "licenc", "permission", "redistribut", "reserved", "unencumbered")


class Automaton(NamedTuple):
    """States 0..n: steps[s] maps a word to the next states, any_word[s] are the next states by any word; both are closed under empty moves. It accepts in `final`."""

    name: str
    starts: frozenset[int]
    steps: list[dict[str, frozenset[int]]]
    any_word: list[frozenset[int]]
    final: int
    first: frozenset[str] | None  # words that can begin a match; None: any


def tokens(text: str) -> list[tuple[str, int, int]]:
    """(word, start, end) of each run of letters and digits, in lower case, with one spelling."""
    out = []
    for m in _TOKEN.finditer(text):
        w = m.group().lower()
        out.append((SAME.get(w, w), m.start(), m.end()))
    return out


def compiled(name: str, template: str) -> Automaton:
    """The automaton of a template: words follow each other, optional regions can be skipped, a region of up to n words is n skippable steps by any word."""
    words: list[list[tuple[str | None, int]]] = [[]]
    empty: list[set[int]] = [set()]

    def state() -> int:
        words.append([])
        empty.append(set())
        return len(words) - 1

    here, opened, at = 0, [], 0

    def literal(text: str) -> None:
        nonlocal here
        for w, _, _ in tokens(text):
            new = state()
            words[here].append((w, new))
            here = new

    for m in _MARK.finditer(template):
        literal(template[at : m.start()])
        at = m.end()
        if m.group(1) == "opt":
            opened.append(here)
        elif m.group(1) == "/opt":
            new = state()
            empty[here].add(new)
            empty[opened.pop()].add(new)
            here = new
        else:
            end = []
            for _ in range(int(m.group(2))):
                end.append(here)
                new = state()
                words[here].append((None, new))
                here = new
            for s in end:
                empty[s].add(here)
    literal(template[at:])
    if opened:
        raise ValueError(f"{name}: an optional region has no end")

    def closure(s: int) -> frozenset[int]:
        seen, todo = {s}, [s]
        while todo:
            for t in empty[todo.pop()] - seen:
                seen.add(t)
                todo.append(t)
        return frozenset(seen)

    near = [closure(s) for s in range(len(words))]
    steps: list[dict[str, frozenset[int]]] = []
    wild: list[frozenset[int]] = []
    for moves in words:
        by: dict[str, frozenset[int]] = {}
        free: frozenset[int] = frozenset()
        for w, t in moves:
            if w is None:
                free |= near[t]
            else:
                by[w] = by.get(w, frozenset()) | near[t]
        steps.append(by)
        wild.append(free)
    starts = near[0]
    first = None if any(wild[s] for s in starts) else frozenset(w for s in starts for w in steps[s])
    return Automaton(name, starts, steps, wild, here, first)


@functools.lru_cache(4)
def automata(templates: tuple[tuple[str, str], ...]) -> list[Automaton]:
    return [compiled(n, t) for n, t in templates]


def longest(a: Automaton, ws: list[str], at: int) -> int:
    """The end of the longest match of the automaton from a word on, or -1. Words are accepted one by one; a state that no word leads on from is dropped."""
    now, end = a.starts, -1
    for i in range(at, len(ws) + 1):
        if a.final in now and i > at:
            end = i
        if i == len(ws):
            break
        w = ws[i]
        nxt: frozenset[int] = frozenset()
        for s in now:
            if (t := a.steps[s].get(w)) is not None:
                nxt |= t
            if a.any_word[s]:
                nxt |= a.any_word[s]
        if not nxt:
            break
        now = nxt
    return end


def anchors(a: Automaton) -> tuple[str, int, int]:
    """(word, least, most): a mandatory word, the rarest by its length, and how many words of a match can come before it."""
    best = ("", 0, 0)
    todo = [(s, 0) for s in a.starts]
    span: dict[int, list[int]] = {}
    while todo:  # how many words lead to each state, at least and at most; templates have no loops
        s, d = todo.pop()
        if d in span.setdefault(s, []):
            continue
        span[s].append(d)
        for t in set().union(*a.steps[s].values(), a.any_word[s]) if a.steps[s] or a.any_word[s] else ():
            todo.append((t, d + 1))
    for s, moves in enumerate(a.steps):
        for w, nxt in moves.items():
            if s in span and len(w) > len(best[0]) and not reaches(a, w):
                where = [d for q in span for d in span[q] if w in a.steps[q]]
                best = (w, min(where), max(where))
    return best


def reaches(a: Automaton, without: str) -> bool:
    """Whether some match has no such word."""
    seen, todo = set(a.starts), list(a.starts)
    while todo:
        s = todo.pop()
        for w, nxt in [*a.steps[s].items(), (None, a.any_word[s])]:
            if w != without:
                todo += nxt - seen
                seen |= nxt
    return a.final in seen


@functools.lru_cache(4)
def anchored(templates: tuple[tuple[str, str], ...]) -> list[tuple[Automaton, str, int, int]]:
    return [(a, *anchors(a)) for a in automata(templates)]


def scan(text: str, templates: tuple[tuple[str, str], ...]) -> list[tuple[str, int, int, int]]:
    """(licence, start, end, words) of the matches in a text; of one template, from the left, each the longest of those that start where it does, without overlaps."""
    toks = tokens(text)
    ws = [t[0] for t in toks]
    where: dict[str, list[int]] = {}
    for i, w in enumerate(ws):
        where.setdefault(w, []).append(i)
    out = []
    for a, anchor, least, most in anchored(templates):
        begins = sorted({b for p in where.get(anchor, ()) for b in range(max(0, p - most), p - least + 1) if a.first is None or ws[b] in a.first})
        after = 0
        for b in begins:
            if b >= after and (e := longest(a, ws, b)) >= 0:
                out.append((a.name, toks[b][1], toks[e - 1][2], e - b))
                after = e
    return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """A row for each match of a template: (doc_id, license, start, end, n_words).

    Templates mark optional regions and regions that stand for up to some words of any kind; all other wording is mandatory and must match word for word, in
    lower case, without punctuation, with some spellings alike. Each is compiled to an automaton over words. start and end are
    characters of the text. Different templates can match the same passage (a notice holds a grant); the matches of one template do not overlap.

    A null or empty text has no match; rows with a null doc_id are scanned and keep the null; rows of one doc_id give their matches each. Texts are scanned whole.
    With templates of one's own, all texts are scanned; otherwise those that hold a word which every template needs.
    """
    chosen = tuple((TEMPLATES if templates is None else templates).items())
    rows = docs.select(F.col("doc_id").cast(id_type(docs)).alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    if templates is None:
        rows = rows.where(F.col("text").rlike("(?i)" + "|".join(HINTS)))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(it, 1024):
            found = [(i, *m) for i, t in zip(column(batch, "doc_id").to_pylist(), column(batch, "text").to_pylist()) for m in scan(t, chosen)]
            types = (column(batch, "doc_id").type, pa.string(), pa.int32(), pa.int32(), pa.int32())
            cols = zip(*found) if found else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "license", "start", "end", "n_words"])

    return rows.mapInArrow(run, f"doc_id {id_type(docs)}, license string, start int, end int, n_words int")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
