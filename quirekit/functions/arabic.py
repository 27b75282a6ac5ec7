"""Reordering and shaping of Arabic text between reading order, label order and presentation forms."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCKS = r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}"
_RANGES = ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))
NEUTRAL = set(' ,-.":')


def is_arabic(c: str) -> bool:
    return any(a <= ord(c) <= b for a, b in _RANGES)


def is_arabic_word(word: Column) -> Column:
    return word.rlike(f"^[{_BLOCKS}]+$")


def is_arabic_line(text: Column) -> Column:
    """Whether any word is Arabic."""
    return F.exists(F.split(text, r"\s+"), is_arabic_word)


def reordered(text: str) -> str:
    """Text between reading order and label order: runs of Arabic reversed, and the order of all runs reversed. Neutral signs belong to the run they are in; at its end, before Arabic, they go with that."""
    runs: list[tuple[bool, str]] = []
    for c in text:
        if c in NEUTRAL:
            if runs:
                runs[-1] = runs[-1][0], runs[-1][1] + c
            else:
                runs.append((True, c))
        elif runs and runs[-1][0] == is_arabic(c):
            runs[-1] = runs[-1][0], runs[-1][1] + c
        elif is_arabic(c):
            head = ""
            if runs:
                body = runs[-1][1].rstrip("".join(NEUTRAL))
                head = runs[-1][1][len(body) :]
                runs[-1] = False, body
            runs.append((True, head + c))
        else:
            runs.append((False, c))
    if runs and not runs[-1][0]:
        body = runs[-1][1].rstrip("".join(NEUTRAL))
        if tail := runs[-1][1][len(body) :]:
            runs[-1:] = [(False, body), (True, tail)]
    if not any(arabic and any(is_arabic(c) for c in run) for arabic, run in runs):
        return text
    return "".join(run[::-1] if arabic else run for arabic, run in reversed(runs))


def plain_letters(text: Column) -> Column:
    """Presentation forms as the letters they stand for; ligatures become their letters."""

    @F.pandas_udf("string")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda t: None if t is None else "".join(unicodedata.normalize("NFKC", c) if 0xFB50 <= ord(c) <= 0xFEFF else c for c in t))

    return run(text)


def reordered_udf():
    @F.pandas_udf("string")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda t: None if t is None else reordered(t))

    return run


def _forms() -> dict[str, dict[str, str]]:
    out: dict[str, dict[str, str]] = {}
    for code in (*range(0xFB50, 0xFE00), *range(0xFE70, 0xFEFD)):
        parts = unicodedata.decomposition(chr(code)).split()
        if len(parts) == 2:
            out.setdefault(chr(int(parts[1], 16)), {}).setdefault(parts[0].strip("<>"), chr(code))
    return out


FORMS = _forms()


def shaped(text: str) -> str:
    """Letters as the presentation forms that their neighbours give them; marks don't part letters, and lam with alef becomes one glyph."""
    lam = {"آ": ("ﻵ", "ﻶ"), "أ": ("ﻷ", "ﻸ"), "إ": ("ﻹ", "ﻺ"), "ا": ("ﻻ", "ﻼ")}
    joins = lambda c: "initial" in FORMS.get(c, {}) or c == "ـ"
    takes = lambda c: "final" in FORMS.get(c, {}) or c == "ـ"
    out, i, linked = [], 0, False
    while i < len(text):
        c = text[i]
        if unicodedata.combining(c):
            out.append(c)
            i += 1
            continue
        if c == "ل" and i + 1 < len(text) and text[i + 1] in lam:
            out.append(lam[text[i + 1]][linked])
            linked, i = False, i + 2
            continue
        j = i + 1
        while j < len(text) and unicodedata.combining(text[j]):
            j += 1
        ahead = joins(c) and j < len(text) and takes(text[j])
        form = "medial" if linked and ahead else "final" if linked else "initial" if ahead else "isolated"
        out.append(FORMS.get(c, {}).get(form, c))
        linked, i = ahead, i + 1
    return "".join(out)


def ligature_map(glyphs: str) -> list[list[int]]:
    """For each glyph, the places of the letters that it stands for."""
    out, at = [], 0
    for g in glyphs:
        n = len(unicodedata.normalize("NFKC", g)) if 0xFB50 <= ord(g) <= 0xFEFF else 1
        out.append(list(range(at, at + n)))
        at += n
    return out


def ligature_map_udf():
    """ligature_map() of a text column, NULL where it is; the lists are made of whole batches."""

    @F.arrow_udf("array<array<int>>")
    def run(v: pa.Array) -> pa.Array:
        texts = [t or "" for t in v.to_pylist()]
        size = np.array([len(t) for t in texts], np.int64)
        code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = np.ones(len(code), np.int64)
        for g in np.unique(code[(code >= 0xFB50) & (code <= 0xFEFF)]).tolist():
            n[code == g] = len(unicodedata.normalize("NFKC", chr(g)))
        edge, outer = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(size)])
        place = np.arange(edge[-1]) - np.repeat(edge[outer[:-1]], edge[outer[1:]] - edge[outer[:-1]])
        glyphs = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(place.astype(np.int32)))
        return pa.ListArray.from_arrays(pa.array(outer.astype(np.int32)), glyphs, mask=v.is_null())

    return run


def shaped_udf():
    @F.pandas_udf("string")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda t: None if t is None else shaped(t))

    return run
