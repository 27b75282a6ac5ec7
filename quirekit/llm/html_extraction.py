"""Main text of web pages by paths on which a host's pages agree."""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirekit.llm.common import column, narrow_join, rebatched, saved

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<name>[A-Za-z][A-Za-z0-9:\-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_CLASS = re.compile(r"(?:^|\s)class\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_DIGITS, _BLANK = re.compile(r"\d+"), re.compile(r"[ \t\r\f\v\xa0]*\n\s*|[ \t\r\f\v\xa0]+")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements whose content is no markup, and goes on to the page's end where they aren't closed, as in browsers; elements whose subtree is hidden.
_RAW, _HIDDEN = {"script", "style", "textarea", "iframe"}, {"noscript", "template", "svg"}
#: Elements that can hold the main text, and those that never do.
CONTAINERS = {"body", "main", "article", "section", "div", "td", "blockquote", "center", "form", "dd"}
BOILERPLATE = {"nav", "footer", "aside", "header", "menu", "button", "select", "head"}
_BLOCKS = CONTAINERS | BOILERPLATE | {"p", "ul", "ol", "li", "table", "tr", "th", "dl", "dt", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "figure", "figcaption", "address", "html", "title"}
#: What an opening tag ends: the first set is closed, up to the second.
_ENDS = {"p": ({"p"}, CONTAINERS), "li": ({"li"}, {"ul", "ol", "menu"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"})}
for _b in (CONTAINERS | {"ul", "ol", "table", "dl", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "nav", "footer", "aside", "header"}) - {"td", "dd"}:
    _ENDS[_b] = ({"p"}, CONTAINERS | {"table"})


class Piece(NamedTuple):
    """A run of text: the index of its nearest container, the containers around that, whether it is in a link or in boilerplate, and the block it is in."""

    container: int
    text: str
    link: bool
    plate: bool
    block: int


class Page(NamedTuple):
    title: str
    paths: list[str]  # the generalised path of each container; the head of one of over 1000 characters is hashed
    parents: list[int]
    pieces: list[Piece]


def step_of(name: str, attrs: str) -> str:
    """A tag with its classes, sorted, digits generalised to #."""
    m = _CLASS.search(attrs) if attrs else None
    classes = sorted({_DIGITS.sub("#", c) for c in (m.group(1) or m.group(2) or m.group(3) or "").lower().split()}) if m else []
    return ".".join([name, *classes])


def parsed(source: str) -> Page:
    """The containers of a page and its runs of text. Broken markup is read as browsers do in the common cases: missing ends are implied, stray ends ignored."""
    stack: list[tuple[str, str, int, bool, bool]] = []  # name, step, container, in a link, in boilerplate
    paths, parents, pieces, title = ["html"], [-1], [], []
    at = block = 0
    n = len(source)

    def text(a: int, b: int) -> None:
        if a < b and not source[a:b].isspace():
            t = entities.unescape(source[a:b])
            if stack and stack[-1][0] == "title" and not any(e[0] in _HIDDEN for e in stack):
                title.append(t)
            else:
                top = stack[-1] if stack else ("", "", 0, False, False)
                pieces.append(Piece(top[2], t, top[3], top[4], block))

    while at < n:
        m = _TAG.search(source, at)
        if m is None:
            break
        text(at, m.start())
        at = m.end()
        name = m.group("name")
        if name is None:
            continue
        name = name.lower()
        if name in _BLOCKS or name == "br":
            block += 1
        if m.group("end"):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
                if stack[i][0] in CONTAINERS and name not in CONTAINERS and name not in BOILERPLATE and name not in ("html", "table", "ul", "ol"):
                    break
            continue
        if name in _VOID or m.group("attrs").endswith("/"):
            continue
        if name in _RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(source, at)
            at = end.end() if end else n
            continue
        if name in _BLOCKS:  # no block is part of a drawing: an unclosed one ends
            for i, e in enumerate(stack):
                if e[0] == "svg":
                    del stack[i:]
                    break
        closes, until = _ENDS.get(name, ((), ()))
        for i in range(len(stack) - 1, -1, -1) if closes else ():
            if stack[i][0] in closes:
                del stack[i:]
                break
            if stack[i][0] in until:
                break
        top = stack[-1] if stack else ("", "", 0, False, False)
        step, holder = step_of(name, m.group("attrs")), top[2]
        plate = top[4] or name in BOILERPLATE or name in _HIDDEN
        if name in CONTAINERS and not plate:
            above = paths[top[2]]
            paths.append((above if len(above) < 1000 else "~" + hashlib.md5(above.encode()).hexdigest()) + ">" + step)
            parents.append(top[2])
            holder = len(paths) - 1
        stack.append((name, step, holder, top[3] or name == "a", plate))
    text(at, n)
    return Page(_BLANK.sub(" ", " ".join(title)).strip(), paths, parents, pieces)


def scores(page: Page) -> list[float]:
    """A score for each container: the characters of the text it holds itself, those in links counted against it, and half of its children's score."""
    own = [0.0] * len(page.paths)
    for p in page.pieces:
        if not p.plate:
            size = len(p.text.strip())
            own[p.container] += -2.0 * size if p.link else size if size >= 25 else 0.25 * size
    out = [max(0.0, s) for s in own]
    for i in range(len(out) - 1, 0, -1):
        out[page.parents[i]] += 0.5 * max(0.0, own[i])
    return out


def text_of(page: Page, chosen: set[int] | None) -> str:
    """The text within the chosen containers, or of the whole page, without boilerplate; a line for each block."""
    inside = [chosen is None or i in chosen for i in range(len(page.paths))]
    for i in range(1, len(inside)):
        inside[i] = inside[i] or inside[page.parents[i]]
    lines: list[str] = []
    last = -1
    for p in page.pieces:
        if inside[p.container] and not p.plate:
            if p.block == last:
                lines[-1] += p.text
            else:
                lines.append(p.text)
            last = p.block
    return "\n".join(x for t in lines if (x := _BLANK.sub(" ", t).strip()))


def best_path(page: Page) -> str | None:
    s = scores(page)
    i = max(range(len(s)), key=lambda i: (s[i], -i))
    return page.paths[i] if s[i] > 0 else None


def extracted(source: str, path: str | None) -> tuple[str | None, str, str, str]:
    """(path used, how: host, page or whole, title, text) of a page, by its host's path or, where it has no text there, by its own best."""
    page = parsed(source)
    for how, want in (("host", path), ("page", best_path(page))):
        chosen = {i for i, p in enumerate(page.paths) if p == want}
        if chosen and (found := text_of(page, chosen)):
            return want, how, page.title, found
    return None, "whole", page.title, text_of(page, None)


def host_of(url: str = "url"):
    """The host of an address, in lower case without its port; '' where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def main_text(pages: DataFrame) -> DataFrame:
    """The main text of each page: (page_id, url, host, path, how, title, text).

    Each container of a page is scored by the text it holds outside of links. In shares of its page's scores, containers vote
    for their path of tags and classes (digits generalised), and the path with the most votes of a host wins; ties go to the
    path on more pages, then to the last in order. All pages are then extracted again: `how` is 'host' where the winning path
    has text, 'page' where the page's own best container is used instead, 'whole' where it has none and all text outside of boilerplate is taken.

    A null or empty html gives an empty text ('whole'). Null addresses, and those without a host, are the host ''. Each row gives one row,
    so repeated page_ids stay; null page_ids stay null. Other columns are left out.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), host_of().alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))

    def vote(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(it, 1024):
            out: list[tuple[str, str, int]] = []
            for host, source in zip(column(batch, "host").to_pylist(), column(batch, "html").to_pylist()):
                page = parsed(source)
                by: dict[str, float] = {}
                for path, s in zip(page.paths, scores(page)):
                    by[path] = by.get(path, 0.0) + s
                total = sum(by.values())
                out += [(host, path, round(1e6 * s / total)) for path, s in by.items() if s > 0]
            cols = list(zip(*out)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], ["host", "path", "share"])

    def extract(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(it, 1024):
            found = [extracted(s, p) for s, p in zip(column(batch, "html").to_pylist(), column(batch, "winner").to_pylist())]
            cols = list(zip(*found)) if found else [[]] * 4
            yield pa.RecordBatch.from_arrays([column(batch, c) for c in ("page_id", "url", "host")] + [pa.array(c, pa.string()) for c in cols], ["page_id", "url", "host", "path", "how", "title", "text"])

    votes = rows.select("host", "html").mapInArrow(vote, "host string, path string, share bigint").groupBy("host", "path").agg(F.sum("share").alias("votes"), F.count("*").alias("pages"))
    winners = saved(votes.groupBy("host").agg(F.max_by("path", F.struct("votes", "pages", "path")).alias("winner")))
    both = narrow_join(rows, winners, "host", "left", 100_000).select("page_id", "url", "host", "html", "winner")
    return both.mapInArrow(extract, "page_id bigint, url string, host string, path string, how string, title string, text string")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
