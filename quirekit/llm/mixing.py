"""Mixing of sources to target weights by iterative proportional fitting."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirekit.llm.common import BROADCAST_ROWS, fresh, id_type, narrow_join, saved

DIMS = ("source", "lang", "topic")
#: A marginal's targets: shares by category, or the power of the observed shares that they follow (0: all equal, 1: as observed).
TARGETS: dict[str, dict[str, float] | float] = {"source": 0.5, "lang": {"en": 0.5, "fr": 0.2, "de": 0.15, "es": 0.15}, "topic": 0.7}


def topic_of(text: Column) -> Column:
    """A coarse topic by marks in the text: legal, technical, tabular or prose."""
    legal = text.contains("icense") | text.contains("opyright") | text.contains("rights reserved")
    technical = text.contains("://") | text.contains(' = "') | text.contains("@")
    return F.when(legal, "legal").when(technical, "technical").when(text.contains(" | "), "tabular").otherwise("prose")


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, topic, tokens) of each row: tokens are runs of characters between blanks, as in the SQL (packing counts signs, too); null categories and topics of null texts are ''."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast(id_type(docs)).alias("doc_id"),
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("source", "lang")),
        topic_of(text).alias("topic"),
        F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f]+")).cast("bigint").alias("tokens"),
    )


def shares(observed: pd.Series, target: dict[str, float] | float) -> pd.Series:
    """Target shares of the categories observed: listed ones as listed, in proportion where some are absent; unlisted ones keep their observed share."""
    observed = observed / observed.sum()
    if not isinstance(target, dict):
        out = observed**target
        return out / out.sum()
    listed = pd.Series({k: float(v) for k, v in target.items() if k in observed.index and v > 0}, dtype=float)
    zero = [k for k, v in target.items() if v <= 0]
    free = observed.drop([*listed.index, *(k for k in zero if k in observed.index)])
    if not len(listed):
        return free.reindex(observed.index).fillna(0) / free.sum() if free.sum() > 0 else observed
    left = max(0.0, 1 - free.sum())
    return pd.concat([listed / listed.sum() * left, free]).reindex(observed.index).fillna(0)


def raked(cells: pd.DataFrame, targets: dict, rounds: int = 200, tol: float = 1e-10) -> pd.DataFrame:
    """cells (DIMS, tokens) with `weight`: the factor of each cell's tokens so that the marginals are the target shares of all tokens.

    Each round scales the cells to one marginal after another, until no factor is off by more than tol. Cells without tokens have weight 0."""
    out = cells.sort_values(list(DIMS)).reset_index(drop=True)
    mass = out.tokens.to_numpy(float)
    total = mass.sum()
    if total <= 0:
        return out.assign(weight=0.0)
    fitted = mass / total
    goals = []
    for dim in DIMS:
        codes, names = pd.factorize(out[dim], sort=True)
        observed = pd.Series(np.bincount(codes, mass, len(names)), index=names)
        some = observed[observed > 0]
        goals.append((codes, shares(some, targets[dim]).reindex(names).fillna(0).to_numpy()))
    for _ in range(rounds):
        worst = 0.0
        for codes, goal in goals:
            now = np.bincount(codes, fitted, len(goal))
            factor = np.divide(goal, now, out=np.zeros_like(goal), where=now > 0)
            worst = max(worst, float(np.abs(now - goal).max()))
            fitted = fitted * factor[codes]
        if worst < tol:
            break
    return out.assign(weight=np.divide(fitted * total, mass, out=np.zeros_like(mass), where=mass > 0))


def probabilities(cells: pd.DataFrame, keep: float) -> pd.DataFrame:
    """cells with `probability` = min(1, weight * scale), the scale chosen so that `keep` of all tokens are expected, or as many as can be."""
    w, t = cells.weight.to_numpy(float), cells.tokens.to_numpy(float)
    budget = keep * t.sum()
    order = np.argsort(-w, kind="stable")
    w, t = w[order], t[order]
    full = np.concatenate([[0.0], np.cumsum(t)[:-1]])  # tokens of the cells of larger weight, all kept
    rest = np.cumsum((w * t)[::-1])[::-1]
    scale = np.divide(budget - full, rest, out=np.full_like(w, np.inf), where=rest > 0)
    with np.errstate(invalid="ignore"):  # no tokens are left at an infinite scale
        fits = np.flatnonzero((scale * w <= 1 + 1e-12) & (scale >= 0))
    p = np.where(w > 0, 1.0, 0.0)
    if len(fits):
        p[fits[0] :] = np.minimum(1.0, scale[fits[0]] * w[fits[0] :])
    out = np.empty_like(p)
    out[order] = p
    return cells.assign(probability=out)


def uniform(seed: int) -> Column:
    """A number in [0, 1) that depends on doc_id and seed only: 52 bits of an MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mixed(docs: DataFrame, targets: dict | None = None, keep: float = 0.6, seed: int = 17) -> DataFrame:
    """Each row's weight and whether it is sampled: (doc_id, source, lang, topic, tokens, weight, probability, sampled).

    Tokens are summed by cell of source, language and topic; the cells' weights are raked until the marginals of all three
    are at their targets; and every document is sampled with its cell's probability, which is in proportion to the weight, at most 1,
    and such that `keep` of all tokens are expected. The cells, not the documents, are fitted, in one task: their number is
    bounded by the categories. Sampling depends on doc_id and seed only.

    Null categories are the category ''. Null and empty texts have no tokens and belong to their cells all the same; a cell without
    tokens has weight 0. Rows of one doc_id are all sampled or all not, within a cell; so are all rows with a null doc_id. An empty table gives an empty one.
    """
    rows = saved(measured(docs))
    targets = TARGETS | (targets or {})

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        return probabilities(raked(pdf[[*DIMS, "tokens"]], targets), keep)

    cells = rows.groupBy(*DIMS).agg(F.sum("tokens").alias("tokens")).withColumn("_all", F.lit(1))
    fitted = saved(cells.groupBy("_all").applyInPandas(fit, "source string, lang string, topic string, tokens bigint, weight double, probability double").drop("tokens"))
    both = narrow_join(rows, fitted, list(DIMS), "inner", BROADCAST_ROWS // 4)
    return both.select("doc_id", *DIMS, "tokens", "weight", "probability", (uniform(seed) < F.col("probability")).alias("sampled"))


def mixed_documents(docs: DataFrame, **params) -> DataFrame:
    """The rows of docs that mixed() samples, by (doc_id, source, lang, topic); a document without tokens goes.

    Rows with a null doc_id or category and repeated rows are treated as mixed() says. Other columns stay as they are, whatever their names. An empty table gives an empty one."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    names = {c: fresh(docs, f"{c}_of_cell") for c in DIMS} | {"probability": fresh(docs, "probability_of_cell")}
    weighed = saved(mixed(docs, **params).select(*DIMS, "probability").distinct().select(*(F.col(c).alias(n) for c, n in names.items())))
    keyed = docs.withColumns({names[c]: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source", "lang")} | {names["topic"]: topic_of(text)})
    both = narrow_join(keyed, weighed, [names[c] for c in DIMS], "inner", BROADCAST_ROWS // 4)
    return both.where(uniform(params.get("seed", 17)) < F.col(names["probability"])).select(docs.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.withColumns({c: F.round(c, 6) for c in ("weight", "probability")})


_GOAL = "SELECT {0}, pow(o, {1}) / sum(pow(o, {1})) OVER () AS g{0} FROM (SELECT {0}, sum(mass) / any_value(total) AS o FROM cells, total GROUP BY {0}) WHERE o > 0"
#: op8_mixing in SQL: 200 rounds of raking, and the scale of the probabilities.
ORACLE_SQL = rf"""WITH RECURSIVE m AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
 CASE WHEN contains(t, 'icense') OR contains(t, 'opyright') OR contains(t, 'rights reserved') THEN 'legal' WHEN contains(t, '://') OR contains(t, ' = "') OR contains(t, '@') THEN 'technical' WHEN contains(t, ' | ') THEN 'tabular' ELSE 'prose' END AS topic,
 len(regexp_extract_all(t, '[^ 	

]+'))::BIGINT AS tokens FROM (SELECT *, coalesce(text, '') AS t FROM documents)),
cells AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS mass FROM m GROUP BY source, lang, topic), total AS (SELECT sum(mass) AS total FROM cells),
gs AS ({_GOAL.format("source", 0.5)}), gt AS ({_GOAL.format("topic", 0.7)}),
ol AS (SELECT lang, sum(mass) / any_value(total) AS o, max(CASE lang WHEN 'en' THEN 0.5 WHEN 'fr' THEN 0.2 WHEN 'de' THEN 0.15 WHEN 'es' THEN 0.15 END)::DOUBLE AS listed FROM cells, total GROUP BY lang HAVING sum(mass) > 0),
gl AS (SELECT lang, CASE WHEN listed IS NULL THEN o ELSE listed / sum(listed) OVER () * (1 - coalesce(sum(o) FILTER (WHERE listed IS NULL) OVER (), 0)) END AS glang FROM ol),
fit AS (SELECT 0 AS n, source, lang, topic, mass / total AS f FROM cells, total WHERE mass > 0
 UNION ALL SELECT n + 1, source, lang, topic, f2 * gtopic / sum(f2) OVER (PARTITION BY topic) FROM (
  SELECT n, source, lang, topic, gtopic, f1 * glang / sum(f1) OVER (PARTITION BY lang) AS f2 FROM (
   SELECT n, source, lang, topic, glang, gtopic, f * gsource / sum(f) OVER (PARTITION BY source) AS f1 FROM fit JOIN gs USING (source) JOIN gl USING (lang) JOIN gt USING (topic) WHERE n < 200))),
w AS (SELECT source, lang, topic, mass, coalesce(f * total / mass, 0) AS weight FROM cells CROSS JOIN total LEFT JOIN (SELECT source, lang, topic, f FROM fit WHERE n = 200) USING (source, lang, topic)),
s AS (SELECT weight, (0.6 * (SELECT total FROM total) - coalesce(sum(mass) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / nullif(sum(weight * mass) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS scale, row_number() OVER o AS pos FROM w WINDOW o AS (ORDER BY weight DESC, source, lang, topic)),
c AS (SELECT arg_min(scale, pos) FILTER (WHERE scale * weight <= 1 + 1e-12 AND scale >= 0) AS scale FROM s),
p AS (SELECT source, lang, topic, weight, CASE WHEN weight <= 0 THEN 0 WHEN scale IS NULL THEN 1 ELSE least(1, scale * weight) END::DOUBLE AS probability FROM w, c)
SELECT doc_id, source, lang, topic, tokens, round(weight, 6) AS weight, round(probability, 6) AS probability,
 ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / (1::BIGINT << 52)::DOUBLE < probability AS sampled FROM m JOIN p USING (source, lang, topic)"""
