"""Bags of hypotheses and confusion networks as rows: totals, posteriors, the best, top-k, networks and their paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F



def totals(bags: DataFrame, keys: list[str], lm_weight: float = 1.0) -> DataFrame:
    """bags with `total`: visual plus weighted model score; the visual one alone for all of a bag in which a model score is missing."""
    whole = F.count(F.when(F.col("lm").isNull(), 1)).over(W.partitionBy(*keys)) == 0
    return bags.withColumn("total", F.when(whole, F.col("vis") + lm_weight * F.col("lm")).otherwise(F.col("vis")))


def posteriors(bags: DataFrame, keys: list[str], lm_weight: float = 1.0) -> DataFrame:
    """bags with `posterior`, the logarithm of each hypothesis' share of its bag."""
    over = W.partitionBy(*keys)
    top = F.max("total").over(over)
    shifted = totals(bags, keys, lm_weight).withColumn("_top", top).withColumn("_e", F.exp(F.col("total") - F.col("_top")))
    return shifted.withColumn("posterior", F.col("total") - F.col("_top") - F.log(F.sum("_e").over(over))).drop("_top", "_e")


def confidence(bags: DataFrame, keys: list[str], lm_weight: float = 1.0) -> DataFrame:
    """(keys, confidence): the probability of each bag's most probable hypothesis."""
    return posteriors(bags, keys, lm_weight).groupBy(*keys).agg(F.exp(F.max("posterior")).alias("confidence"))


def transcript_confidence(bags: DataFrame, keys: list[str], transcript: str, lm_weight: float = 1.0) -> DataFrame:
    """(keys, confidence): the probability of a bag's first hypothesis of that text, 0 where there is none."""
    first = F.min_by("posterior", F.when(F.col("transcript") == transcript, F.col("rank")))
    return posteriors(bags, keys, lm_weight).groupBy(*keys).agg(F.coalesce(F.exp(first), F.lit(0.0)).alias("confidence"))


def ranked(bags: DataFrame, keys: list[str]) -> DataFrame:
    """bags with `place`: by visual score, the best first, in their order at a tie."""
    return bags.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("vis"), "rank")))


def best(bags: DataFrame, keys: list[str], lm_weight: float = 1.0) -> DataFrame:
    """(keys, transcript): the hypothesis of the highest visual plus model score, a missing one counting 0; the first at a tie. By default the model's score has no weight of its own here."""
    score = F.col("vis") + lm_weight * F.coalesce("lm", F.lit(0.0))
    return bags.groupBy(*keys).agg(F.max_by("transcript", F.struct(score, -F.col("rank"))).alias("transcript"))


def top_k(xs: DataFrame, keys: list[str], value: str, k: int, largest: bool = False, tie: str = "pos") -> DataFrame:
    """The k rows of each group with the smallest (or largest) values; with no keys, of all, without a shuffle of more than k rows a task."""
    order = [F.desc(value) if largest else F.asc(value), F.asc(tie)]
    if not keys:
        return xs.orderBy(*order).limit(k)
    return xs.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def normalised(cn: DataFrame, keys: list[str]) -> DataFrame:
    """A network's rows (keys, pos, symbol, weight) with the weights of each position summing to 1."""
    return cn.withColumn("weight", F.col("weight") / F.sum("weight").over(W.partitionBy(*keys, "pos")))


def pivots(cn: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, symbol): the heaviest symbol of each position; at a tie the first by `symbol`, null first."""
    over = W.partitionBy(*keys, "pos").orderBy(F.desc("weight"), F.asc_nulls_first("symbol"))
    return cn.withColumn("_n", F.row_number().over(over)).where("_n = 1").select(*keys, "pos", "symbol")


def best_path(cn: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text): the pivots in their order, nulls dropped."""
    parts = F.array_sort(F.collect_list(F.struct("pos", "symbol")))
    return pivots(cn, keys).groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: F.coalesce(p["symbol"], F.lit(""))), "").alias("text"))


def paths(cn: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text, weight): all paths through each network with their products of weights; equal texts stay apart. Their number is the product of the positions' sizes."""
    slots = cn.groupBy(*keys, "pos").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("symbol", F.lit("")).alias("t"), F.col("weight").alias("w")))).alias("slot"))
    lists = slots.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "slot"))), lambda s: s["slot"]).alias("slots"))
    start = F.array(F.struct(F.lit("").alias("t"), F.lit(1.0).alias("w")))
    grow = lambda acc, slot: F.flatten(F.transform(acc, lambda a: F.transform(slot, lambda s: F.struct(F.concat(a["t"], s["t"]).alias("t"), (a["w"] * s["w"]).alias("w")))))
    return lists.select(*keys, F.explode(F.aggregate("slots", start, grow)).alias("p")).select(*keys, F.col("p.t").alias("text"), F.col("p.w").alias("weight"))


def networks(bags: DataFrame, keys: list[str], visual_weight: float = 1.0, lm_weight: float = 1.0, normalise: bool = True) -> DataFrame:
    """(keys, pos, symbol, weight): the confusion network of each bag, folded hypothesis by hypothesis in the order of rank."""
    import pandas as pd

    from quirekit.functions.confusion import produced

    def fold(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        bag = zip(pdf.transcript, pdf.vis, (None if pd.isna(v) else v for v in pdf.lm))
        rows = [(*key, pos, s, w) for pos, p in enumerate(produced(bag, visual_weight, lm_weight, normalise)) for s, w in p.items()]
        return pd.DataFrame(rows, columns=[*keys, "pos", "symbol", "weight"])

    kinds = ", ".join(f"{k} {bags.schema[k].dataType.simpleString()}" for k in keys)
    return bags.groupBy(*keys).applyInPandas(fold, f"{kinds}, pos int, symbol string, weight double")


def merged(engines: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """base (keys, text, confidence) with each line's text and confidence from the engine that is surest of it.

    engines has (keys, engine, text, confidence), engine counting from 0. The highest confidence above 0 wins, the earlier engine at a tie; a line of which none is sure keeps its base."""
    won = engines.where("confidence > 0").groupBy(*keys).agg(F.max_by(F.struct("engine", "text", "confidence"), F.struct("confidence", -F.col("engine"))).alias("won"))
    return base.join(won, keys, "left").select(*keys, F.coalesce("won.text", "text").alias("text"), F.coalesce("won.confidence", "confidence").alias("confidence"), F.col("won.engine").alias("engine"))


def mean_confidence(confidences: Column, empty: float = -10.0) -> Column:
    """The mean of an array of confidences; `empty` where there is none."""
    return F.when(F.size(confidences) > 0, F.aggregate(confidences, F.lit(0.0), lambda a, x: a + x) / F.size(confidences)).otherwise(F.lit(empty))


