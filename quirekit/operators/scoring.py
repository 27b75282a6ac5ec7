"""Frames of symbol scores as columns: normalisation, runs, greedy decoding and confidences, all in built-in expressions.

A line's frames are an array of arrays of doubles; the last symbol is the blank. A null array stays null; an array without frames decodes to ''.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirekit.functions.columns import let


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def softmax(frame: Column, theta: float = 1.0) -> Column:
    shifted = lambda m: let(F.transform(frame, lambda x: F.exp((x - m) * theta)), lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))
    return let(F.array_max(frame), shifted)


def log_softmax(frame: Column) -> Column:
    return let(F.array_max(frame), lambda m: let(m + F.log(F.aggregate(frame, F.lit(0.0), lambda a, x: a + F.exp(x - m))), lambda z: F.transform(frame, lambda x: x - z)))


def log_probabilities(frames: Column) -> Column:
    return F.transform(frames, log_softmax)


def logsumexp(xs: Column) -> Column:
    return let(F.array_max(xs), lambda m: m + F.log(F.aggregate(xs, F.lit(0.0), lambda a, x: a + F.exp(x - m))))


def sparse(frame: Column, least: float = 1e-4) -> Column:
    """The symbols of a frame with a probability of `least` or more, as a map from symbol to score."""
    kept = let(softmax(frame), lambda p: F.filter(F.transform(frame, lambda x, i: F.struct(i.alias("k"), x.alias("v"), F.get(p, i).alias("p"))), lambda e: e["p"] >= least))
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["k"], e["v"])))


def dense(symbols: Column, width: int, empty: float = -80.0) -> Column:
    """A sparse frame as an array of `width` scores, `empty` where it has none."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.coalesce(symbols[k], F.lit(empty)))


def deviation(logp: Column) -> Column:
    """How far the probabilities of a line's frames are from summing to 1, at most."""
    return F.array_max(F.transform(logp, lambda f: F.abs(F.aggregate(f, F.lit(0.0), lambda a, x: a + F.exp(x)) - 1)))


def guarded(logp: Column, most: float = 1e-5) -> Column:
    """logp; raises where a line's frames aren't normalised."""
    return F.when(F.coalesce(deviation(logp), F.lit(0.0)) <= most, logp).otherwise(F.raise_error(F.lit("the frames aren't normalised")))


def relevant(frame: Column, floor: float = -10.0) -> Column:
    """The symbols of more than `floor`."""
    return F.filter(F.transform(frame, lambda x, i: F.when(x > floor, i)), lambda i: i.isNotNull())


def best(frames: Column) -> Column:
    """(k, v) of each frame's best symbol, the first at a tie."""
    return F.transform(frames, lambda f: let(F.array_max(f), lambda m: F.struct((F.array_position(f, m) - 1).cast("int").alias("k"), m.alias("v"))))


def collapsed(xs: Column) -> Column:
    """An array without the elements that equal the one before."""
    return let(xs, lambda a: F.filter(a, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(a, i - 1))))


def runs(ids: Column, values: Column) -> Column:
    """(k, at, vs) of each run of equal ids: the id, where the run begins and the values along it."""
    starts = lambda a: F.filter(F.transform(a, lambda x, i: F.when((i == 0) | ~x.eqNullSafe(F.get(a, i - 1)), i)), lambda i: i.isNotNull())
    cut = lambda a, st: F.transform(st, lambda s, j: F.struct(F.get(a, s).alias("k"), s.alias("at"), F.slice(values, s + 1, F.coalesce(F.get(st, j + 1), F.size(a)) - s).alias("vs")))
    return let(ids, lambda a: let(starts(a), lambda st: cut(a, st)))


def letters_of(ks: Column, letters: Sequence[str], separator: str = "") -> Column:
    """Symbols as text, blanks dropped."""
    names = F.array(*(F.lit(c) for c in letters))
    return F.array_join(F.transform(F.filter(ks, lambda k: k < len(letters) - 1), lambda k: F.get(names, k)), separator)


def greedy(logp: Column, letters: Sequence[str], separator: str = "") -> Column:
    """(text, score): runs of each frame's best symbol collapsed, blanks dropped; the score is the logsumexp of the frames' best log-probabilities."""
    return let(best(logp), lambda b: F.struct(letters_of(collapsed(F.transform(b, lambda e: e["k"])), letters, separator).alias("text"), logsumexp(F.transform(b, lambda e: e["v"])).alias("score")))


def best_runs(logp: Column) -> Column:
    """runs() of the frames' best symbols and their probabilities."""
    return let(best(logp), lambda b: runs(F.transform(b, lambda e: e["k"]), F.transform(b, lambda e: F.exp(e["v"]))))


def line_confidence(logp: Column) -> Column:
    """The least, over runs of best symbols, of a run's best probability; 1 without frames."""
    return F.least(F.lit(1.0), F.coalesce(F.array_min(F.transform(best_runs(logp), lambda r: F.array_max(r["vs"]))), F.lit(1.0)))


def letter_confidences(logp: Column, aligned: Column, blank: int) -> Column:
    """(k, c) of each letter of an alignment: the best probability along its run; blanks are left out."""
    picked = F.zip_with(logp, aligned, lambda f, k: F.exp(F.get(f, k)))
    return F.transform(F.filter(runs(aligned, picked), lambda r: r["k"] != blank), lambda r: F.struct(r["k"].alias("k"), F.array_max(r["vs"]).alias("c")))


def mean_confidences(logp: Column, letters: Sequence[str]) -> Column:
    """(letter, c) of each letter that greedy decoding gives: the mean of its run's probabilities."""
    names = F.array(*(F.lit(c) for c in letters))
    found = F.filter(best_runs(logp), lambda r: r["k"] < len(letters) - 1)
    return F.transform(found, lambda r: F.struct(F.get(names, r["k"]).alias("letter"), (total(r["vs"]) / F.size(r["vs"])).alias("c")))


def picked(logp: Column, ks: Column) -> Column:
    """Each row's entry at an index: the confidences of a decoder that gives one frame for each symbol."""
    return F.zip_with(logp, ks, lambda f, k: F.get(f, k))


def least_confidence(logp: Column) -> Column:
    """The probability of the frame whose best symbol is the least probable."""
    return F.exp(F.array_min(F.transform(logp, F.array_max)))


def narrowed(frames: Column, ks: Column, blank: int) -> Column:
    """Labels with only the frame of the highest score kept of each run of one label, the first at a tie; the others are blank."""
    scores = F.zip_with(frames, ks, lambda f, k: F.get(f, k))
    keep = F.transform(F.filter(runs(ks, scores), lambda r: r["k"] != blank), lambda r: r["at"] + (F.array_position(r["vs"], F.array_max(r["vs"])) - 1).cast("int"))
    return let(keep, lambda at: F.transform(ks, lambda k, i: F.when(F.array_contains(at, i), k).otherwise(F.lit(blank))))


def cut_at(ks: Column, boundary: int, ignore: int) -> Column:
    """The symbols before the first boundary, without the ignored ones."""
    at = F.array_position(ks, F.lit(boundary))
    return F.filter(F.when(at > 0, F.slice(ks, F.lit(1), (at - 1).cast("int"))).otherwise(ks), lambda k: k != ignore)


def repeated(xs: Column) -> Column:
    """The second and later occurrences of an array's elements, in their order."""
    return F.filter(xs, lambda x, i: F.array_position(xs, x) < i + 1)


def without_positions(xs: Column, at: Column) -> Column:
    """The elements but for those at the given places, negative ones counted from the end; raises for a place beyond the ends."""
    n = F.size(xs)
    places = F.transform(at, lambda i: F.when((i >= n) | (i < -n), F.raise_error(F.lit("no such place")).cast("int")).when(i < 0, i + n).otherwise(i))
    return let(places, lambda p: F.filter(xs, lambda x, i: ~F.array_contains(p, i)))


def windows(at: Column, n_frames: Column) -> Column:
    """(low, high) of the frames around each place: up to halfway to its neighbours, all frames in all."""
    half = lambda a, i: F.floor((F.get(a, i) + 1 + F.get(a, i + 1)) / 2).cast("int")
    return let(at, lambda a: F.transform(a, lambda x, i: F.struct(F.when(i == 0, 0).otherwise(half(a, i - 1)).alias("low"), F.when(i == F.size(a) - 1, n_frames).otherwise(half(a, i)).alias("high"))))


def word_confidences(letters: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, word, confidence): the median of the confidences of each word's letters (pos, letter, confidence); words are parted by spaces, counted from 0."""
    from pyspark.sql import Window as W

    over = W.partitionBy(*keys).orderBy("pos")
    numbered = letters.withColumn("word", F.sum(F.when(F.col("letter") == " ", 1).otherwise(0)).over(over))
    return numbered.where("letter <> ' '").groupBy(*keys, "word").agg(F.percentile("confidence", 0.5).alias("confidence"))


def line_medians(letters: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, confidence): the median of the confidences of each line's letters."""
    return letters.groupBy(*keys).agg(F.percentile("confidence", 0.5).alias("confidence"))
