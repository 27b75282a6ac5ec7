"""Decoding and alignment of whole lines: Arrow UDFs over arrays of frames, errors as data."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirekit.functions import ctc

BAG = "array<struct<text:string,vis:double,lm:double>>"


def _matrix(frames) -> np.ndarray:
    return np.array([np.asarray(f, float) for f in frames]) if len(frames) else np.zeros((0, 1))


def bags(lines: DataFrame, letters: Sequence[str], k: int = 8, lm: ctc.NgramModel | None = None, lm_scale: float = 1.0, bonus: float = 0.0) -> DataFrame:
    """(line, bag, error) of lines (line, logp): each line's hypotheses, the best visual score first, or the reason why it can't be decoded."""
    ctc.check_alphabet(letters, letters[-1])

    def one(frames) -> tuple:
        try:
            return [{"text": t, "vis": v, "lm": m} for t, v, m in ctc.prefix_beam(_matrix(frames), letters, k, lm, lm_scale, bonus)[0]], None
        except ValueError as e:
            return None, str(e)

    if not isinstance(k, int) or isinstance(k, bool) or k < 1:
        ctc.prefix_beam(np.zeros((0, 1)), letters, k)

    def run(it):
        for pdf in it:
            out = [one(f) for f in pdf.logp]
            yield pd.DataFrame({"line": pdf.line, "bag": [b for b, _ in out], "error": [e for _, e in out]})

    return lines.select("line", "logp").mapInPandas(run, f"line {lines.schema['line'].dataType.simpleString()}, bag {BAG}, error string")


def decoder(kind: str, letters: Sequence[str], **config):
    """A function from lines (line, logp) to (line, text) by its configured kind: GREEDY or FAST-LOG-RAW (a beam; with a model it needs lm_scale)."""
    from quirekit.operators.scoring import greedy

    if kind == "GREEDY":
        return lambda lines: lines.select("line", greedy(F.col("logp"), letters)["text"].alias("text"))
    if kind == "FAST-LOG-RAW":
        if config.get("lm") is not None and "lm_scale" not in config:
            raise ValueError("a model needs lm_scale")
        return lambda lines: bags(lines, letters, **config).select("line", F.get("bag", F.lit(0))["text"].alias("text"))
    raise ValueError(f"unknown kind of decoder: {kind}")


def alignments(lines: DataFrame, blank: int, positions: bool = False) -> DataFrame:
    """(line, path, error) of lines (line, logp, symbols): the symbol of each frame, or the reason why there is no alignment."""

    def one(frames, symbols) -> tuple:
        try:
            return ctc.forced_alignment(-_matrix(frames), [int(x) for x in symbols], blank, positions), None
        except ValueError as e:
            return None, str(e)

    def run(it):
        for pdf in it:
            out = [one(f, s) for f, s in zip(pdf.logp, pdf.symbols)]
            yield pd.DataFrame({"line": pdf.line, "path": [p for p, _ in out], "error": [e for _, e in out]})

    return lines.select("line", "logp", "symbols").mapInPandas(run, f"line {lines.schema['line'].dataType.simpleString()}, path array<int>, error string")


def letters_udf(blank: int):
    """(log-probabilities, symbols) to (frame, confidence) of each letter; empty where there is no alignment."""

    @F.pandas_udf("array<struct<frame:int,confidence:double>>")
    def run(frames: pd.Series, symbols: pd.Series) -> pd.Series:
        out = []
        for f, s in zip(frames, symbols):
            logp, s = _matrix(f), [int(x) for x in s]
            try:
                at = ctc.letter_frames(-logp, s, blank)
                out.append([{"frame": a, "confidence": c} for a, c in zip(at, ctc.letter_confidences(np.exp(logp), s, at))])
            except ValueError:
                out.append([])
        return pd.Series(out)

    return run


def decode_pages(lines: DataFrame, letters: Sequence[str], k: int = 8, lm: ctc.NgramModel | None = None, lm_scale: float = 1.0, bonus: float = 0.0, carry: bool = True, sure: float = float("inf")) -> DataFrame:
    """(page, line, text, confidence, error) of lines (page, line, logp, text): decoded in their order, page by page.

    With carry, each line's decoding begins in the model's state at the end of the line before it on the page. A line that is sure
    already (the probability of its least sure frame is above `sure`) keeps its text, and the state begins anew from it. A line that can't be decoded has its error, and the next begins anew."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        out, before = [], ""
        for r in pdf.sort_values("line").itertuples():
            logp = _matrix(r.logp)
            least = float(np.exp(logp.max(axis=1).min())) if len(logp) else 0.0
            if least > sure:
                out.append((r.line, r.text, least, None))
                before = r.text or ""
                continue
            try:
                bag, state = ctc.prefix_beam(logp, letters, k, lm, lm_scale, bonus, before if carry else "")
                total = np.array([v + lm_scale * m for _, v, m in bag])
                at = int(total.argmax())
                out.append((r.line, bag[at][0], float(np.exp(total[at] - np.logaddexp.reduce(total))), None))
                before = state
            except (ValueError, TypeError) as e:
                out.append((r.line, None, None, str(e)))
                before = ""
        return pd.DataFrame(out, columns=["line", "text", "confidence", "error"]).assign(page=key[0])[["page", "line", "text", "confidence", "error"]]

    page, line = (lines.schema[c].dataType.simpleString() for c in ("page", "line"))
    return lines.groupBy("page").applyInPandas(run, f"page {page}, line {line}, text string, confidence double, error string")


def ngram_counts(texts: DataFrame, order: int) -> DataFrame:
    """(context, letter, n): how often each letter follows each context of up to order-1 letters, line ends included. Counted in Spark, with partial sums before the shuffle."""
    t = F.concat("text", F.lit("\n"))
    at = texts.select(t.alias("t"), F.explode(F.sequence(F.lit(1), F.length("text") + 1)).alias("i"), )
    grams = at.select("t", "i", F.explode(F.sequence(F.lit(0), F.lit(order - 1))).alias("n")).where("n < i")
    return grams.select(F.substr("t", F.col("i") - F.col("n"), F.col("n")).alias("context"), F.substr("t", F.col("i"), F.lit(1)).alias("letter")).groupBy("context", "letter").agg(F.count("*").alias("n"))


def trained(texts: DataFrame, order: int, letters: Sequence[str], k: float = 0.1) -> ctc.NgramModel:
    """A letter model of all texts; it is held by every task, and its size is bounded by the letters and the order."""
    counts: dict[str, dict[str, float]] = {}
    known = [*letters[:-1], "\n"]
    rows = ngram_counts(texts, order).where(F.col("letter").isin(known))
    for r in rows.toLocalIterator():
        counts.setdefault(r.context, {})[r.letter] = float(r.n)
    return ctc.NgramModel(counts, order, letters[:-1], k)
