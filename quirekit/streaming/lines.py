"""Streams of lines: running error rates over arriving files, and decoding that carries its state from line to line."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirekit.functions import ctc


def error_rates(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Running sums and rates of arriving pairs (ref, hyp); output mode complete or update."""
    sums = pairs.withColumns({"errors": F.levenshtein("ref", "hyp"), "ref_len": F.length("ref")}).groupBy(*by).agg(F.sum("errors").alias("errors"), F.sum("ref_len").alias("ref_len"))
    return sums.withColumn("rate", F.when(F.col("ref_len") > 0, F.col("errors") / F.col("ref_len")))


def windowed_rates(pairs: DataFrame, time: str, window: str, late: str) -> DataFrame:
    """Sums by window of event time; rows that come later than `late` are dropped."""
    return error_rates(pairs.withWatermark(time, late).withColumn("window", F.window(time, window)), ["window"])


def carried(lines: DataFrame, width: int = 20, hold_ms: int = 3_600_000) -> DataFrame:
    """(page, line, text, before): each arriving line with the end of the line before it on its page, which is kept as state; lines of a batch are taken in their order.

    A line that comes after a later one of its page, in a batch of its own, has before '' and leaves the state as it is. A page that nothing comes for in hold_ms is forgotten."""

    def one(line, text: str | None, before: str) -> tuple[tuple, str]:
        return (text, before), (text or "")[-width:]

    return _stateful(lines, one, "text string, before string", ["text", "before"], ["text"], hold_ms)


def decoded(lines: DataFrame, letters: Sequence[str], k: int = 8, lm: ctc.NgramModel | None = None, lm_scale: float = 1.0, sure: float = float("inf"), hold_ms: int = 3_600_000) -> DataFrame:
    """(page, line, text, confidence, error) of arriving lines (page, line, logp, text): decoded as by decode_pages() with carry, the model's state being kept from batch to batch."""

    def one(line, logp, text: str | None, before: str) -> tuple[tuple, str]:
        m = np.array([np.asarray(f, float) for f in logp]) if len(logp) else np.zeros((0, 1))
        least = float(np.exp(m.max(axis=1).min())) if len(m) else 0.0
        if least > sure:
            return (text, least, None), text or ""
        try:
            bag, state = ctc.prefix_beam(m, letters, k, lm, lm_scale, 0.0, before)
            total = np.array([v + lm_scale * x for _, v, x in bag])
            at = int(total.argmax())
            return (bag[at][0], float(np.exp(total[at] - np.logaddexp.reduce(total))), None), state
        except (ValueError, TypeError) as e:
            return (None, None, str(e)), ""

    return _stateful(lines, one, "text string, confidence double, error string", ["text", "confidence", "error"], ["logp", "text"], hold_ms)


def _stateful(lines: DataFrame, one: Callable, schema: str, names: list[str], inputs: list[str], hold_ms: int) -> DataFrame:
    page, line = (lines.schema[c].dataType.simpleString() for c in ("page", "line"))

    def run(key: Any, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before, last = state.get if state.exists else ("", None)
        pdf = pd.concat(list(batches)).sort_values("line")
        out = []
        for r in pdf[["line", *inputs]].itertuples(index=False):
            late = last is not None and r[0] <= last
            row, after = one(r[0], *r[1:], "" if late else before)
            out.append((key[0], r[0], *row))
            if not late:
                before, last = after, r[0]
        state.update((before, last))
        state.setTimeoutDuration(hold_ms)
        yield pd.DataFrame(out, columns=["page", "line", *names])

    return lines.groupBy("page").applyInPandasWithState(run, f"page {page}, line {line}, {schema}", f"before string, last {line}", "append", "ProcessingTimeTimeout")
