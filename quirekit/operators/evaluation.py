"""Character and word error rates, error summaries and their aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirekit.functions.sequence import alignment_udf, stitched_udf, text_distance_udf, word_distance_udf

INF = float("inf")


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def single_spaced(c: Column) -> Column:
    """Runs of any Unicode blanks as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys, the last in an order."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in df.columns if c not in keys)), order).alias("_s")).select(*keys, "_s.*")


def paired(reference: DataFrame, hypothesis: DataFrame, keys: list[str]) -> DataFrame:
    """Reference and hypothesis lines side by side, by their keys: ref and hyp are stripped, a null text is '', and side says which of them there is."""
    r = reference.select(*keys, stripped(F.coalesce("text", F.lit(""))).alias("ref"))
    h = hypothesis.select(*keys, stripped(F.coalesce("text", F.lit(""))).alias("hyp"))
    side = F.when(F.col("ref").isNull(), "hypothesis only").when(F.col("hyp").isNull(), "reference only").otherwise("both")
    return r.join(h, keys, "full_outer").withColumn("side", side)


def scored(pairs: DataFrame) -> DataFrame:
    """The pairs that have both sides, with the edit distance and the reference's length in characters."""
    return pairs.where("side = 'both'").withColumns({"errors": F.levenshtein("ref", "hyp"), "ref_len": F.length("ref")})


def rate(errors: Column, length: Column, empty: float | None = INF) -> Column:
    """errors / length; `empty` where the length is 0."""
    return F.when(length > 0, errors / length).otherwise(F.lit(empty).cast("double"))


def micro(lines: DataFrame, by: list[str]) -> DataFrame:
    """Sums and rates of each group and, with nulls for the keys, of all: partial sums before the one shuffle."""
    found = lines.rollup(*by).agg(F.count("*").alias("lines"), F.sum("errors").alias("errors"), F.sum("ref_len").alias("ref_len"))
    return found.withColumn("rate", rate(F.col("errors"), F.col("ref_len")))


def word_errors(ref: Column, hyp: Column) -> Column:
    """The edit distance of two texts in words."""
    return word_distance_udf()(single_spaced(ref), single_spaced(hyp))


def n_words(c: Column) -> Column:
    return F.when(F.length(single_spaced(c)) == 0, 0).otherwise(F.size(F.split(single_spaced(c), " ")))


def report(files: DataFrame) -> DataFrame:
    """(file_name, cer, wer, number_of_gt_characters, number_of_gt_words) of each pair of whole texts; rates of 6 decimals, 0 where the reference is empty."""
    ref, hyp = single_spaced(F.col("ref")), single_spaced(F.col("hyp"))
    chars, words = F.length(ref), n_words(F.col("ref"))
    return files.select(
        F.col("file").cast("string").alias("file_name"),
        F.round(F.when(chars > 0, text_distance_udf()(ref, hyp) / chars).otherwise(0.0), 6).alias("cer"),
        F.round(F.when(words > 0, word_errors(F.col("ref"), F.col("hyp")) / words).otherwise(0.0), 6).alias("wer"),
        chars.alias("number_of_gt_characters"),
        words.alias("number_of_gt_words"),
    )


def weighted(rates: DataFrame, value: str, weight: str) -> Column:
    """The mean of the rounded rates by their weights; null where all weights are 0."""
    total = F.sum(weight)
    return F.when(total > 0, F.sum(F.round(F.col(value), 6) * F.col(weight)) / total)


def best_group(lines: DataFrame, by: str) -> DataFrame:
    """The group with the least error rate in percent, 1e12 where it has no characters; the first at a tie."""
    sums = lines.groupBy(by).agg(F.sum("errors").alias("errors"), F.sum("ref_len").alias("ref_len"))
    cer = rate(100.0 * F.col("errors"), F.col("ref_len"), 1e12)
    return sums.withColumn("cer", cer).agg(F.min_by(F.struct(by, "cer"), F.struct("cer", by)).alias("s")).select("s.*")


def match_type(ref: Column, hyp: Column) -> Column:
    """C equal, I nothing in the reference, D nothing in the hypothesis, S different."""
    both = ref.isNull() & hyp.isNull()
    return F.when(both, F.raise_error(F.lit("neither side has a symbol"))).when(ref.isNull(), "I").when(hyp.isNull(), "D").when(ref == hyp, "C").otherwise("S")


def match_types(alignment: Column) -> Column:
    """Match types of an alignment of a hypothesis (src) with a reference (tgt)."""
    return F.transform(alignment, lambda p: match_type(p["tgt"], p["src"]))


def edit_stats(types: Column) -> dict[str, Column]:
    count = lambda t: F.size(F.filter(types, lambda x: x == t))
    return {"n_ref": F.size(types) - count("I"), "n_correct": count("C"), "n_ins": count("I"), "n_del": count("D"), "n_sub": count("S")}


def unmatched_end(types: Column) -> Column:
    """The types after the last C."""
    text = F.array_join(types, "")
    return F.regexp_extract(text, "[^C]*$", 0)


def unmatched_start(types: Column) -> Column:
    return F.regexp_extract(F.array_join(types, ""), "^[^C]*", 0)


def ending(suffix: Column) -> Column:
    """How a line ends, by the types of its unmatched end."""
    s, i, d = (suffix.contains(c) for c in "SID")
    return (
        F.when(suffix == "", "correct")
        .when(i & d, F.raise_error(F.lit("insertions and deletions in one ending")))
        .when(s & d, "mixed_deletion").when(s & i, "mixed_insertion").when(d, "pure_deletion").when(i, "pure_insertion").otherwise("pure_substitution")
    )


ENDINGS = ("correct", "pure_deletion", "pure_insertion", "pure_substitution", "mixed_deletion", "mixed_insertion")


def summaries(pairs: DataFrame) -> DataFrame:
    """Each pair's errors by type, its alignment of characters and its ending."""
    chars = lambda c: F.filter(F.split(F.col(c), ""), lambda x: x != "")
    out = pairs.withColumn("alignment", alignment_udf()(chars("hyp"), chars("ref"))).withColumn("types", match_types(F.col("alignment")))
    stats = edit_stats(F.col("types"))
    out = out.withColumns(stats | {"ending": ending(unmatched_end(F.col("types")))})
    return out.withColumn("n_errors", F.col("n_ins") + F.col("n_del") + F.col("n_sub"))


def total(lines: DataFrame) -> DataFrame:
    """One row: the sums of the summaries, their rate and the number of lines with each ending."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(a) for c, a in (("n_ref", "ref_len"), ("n_errors", "errors"), ("n_sub", "subs"), ("n_ins", "ins"), ("n_del", "dels"))]
    ends = [F.count_if(F.col("ending") == e).alias(e) for e in ENDINGS]
    return lines.agg(F.count("*").alias("lines"), *sums, *ends).withColumn("rate", rate(F.col("errors"), F.col("ref_len")))


def confusions(lines: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(ref, hyp, n): how often each reference symbol was read as each; a null reference is an insertion, a null hypothesis a deletion."""
    return lines.select(*by, F.explode("alignment").alias("p")).groupBy(*by, F.col("p.tgt").alias("ref"), F.col("p.src").alias("hyp")).agg(F.count("*").alias("n"))


def printed(errors: Column, length: Column, sub: Column, ins: Column, dele: Column) -> Column:
    return F.format_string("%.2f %% ( %d / %d ; sub: %d ins: %d del: %d )", rate(100.0 * errors, length), errors, length, sub, ins, dele)


def stitched(parts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Texts of overlapping parts joined in their order: the longest overlap's better halves of each side; texts without one are just joined.

    The overlap of a left and a right part is the n that makes the last n of the left most like the first n of the right, by the least error rate, below 1; the first such n."""
    texts = parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t")))), lambda p: p["t"]).alias("texts"))
    return texts.select(*keys, stitched_udf()("texts").alias("text"))


def quality(letters: DataFrame, keys: list[str], confidence: str = "confidence", power: float = 6.0, box: tuple | None = None) -> DataFrame:
    """The power mean of letters' confidences by page, -1 for a page without letters; box (x, y, w, h) keeps letters whose x and y lie in it."""
    value = F.col(confidence)
    if box is not None:
        x, y, w, h = box
        value = F.when(F.col("x").between(x, x + w) & F.col("y").between(y, y + h), value)
    return letters.groupBy(*keys).agg(F.coalesce(F.pow(F.avg(F.pow(value, F.lit(power))), F.lit(1 / power)), F.lit(-1.0)).alias("quality"))


def last_by(df: DataFrame, by: list[str], order: list) -> DataFrame:
    over = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(over)).where("_n = 1").drop("_n")
