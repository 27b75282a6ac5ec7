"""The logical inputs of the queries, as projections of whole tables: in Spark, and as common table expressions for the SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def noisy(text: str = "text"):
    """The text as a poor reader might give it: two letters taken for others, one lost."""
    return F.replace(F.translate(F.col(text), "eo", "ca"), F.lit("th"), F.lit("t"))


NOISY = "replace(translate(text, 'eo', 'ca'), 'th', 't')"


def references(spark: SparkSession, d: str) -> DataFrame:
    """(file, line, text): all turns of conversations."""
    return table(spark, d, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").cast("bigint").alias("line"), "text")


def hypotheses(spark: SparkSession, d: str) -> DataFrame:
    """(file, line, text): all turns, read poorly; some under a line number that no reference has, so both sides have lines of their own."""
    line = F.expr("cast(CASE WHEN (conv_id + turn) % 9 = 4 THEN turn + 1000000 ELSE turn END as bigint)")
    return table(spark, d, "conversations").select(F.col("conv_id").alias("file"), line.alias("line"), noisy().alias("text"))


SIDES = f"""reference AS (SELECT conv_id AS file, turn::BIGINT AS line, text FROM conversations),
hypothesis AS (SELECT conv_id AS file, (CASE WHEN (conv_id + turn) % 9 = 4 THEN turn + 1000000 ELSE turn END)::BIGINT AS line, {NOISY} AS text FROM conversations)"""


def lines(spark: SparkSession, d: str) -> DataFrame:
    """(page, line, x, y, w, h): a line of text for each order, on its customer's page."""
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("line"), F.expr("(o_orderkey * 7919) % 1000").alias("x"), F.expr("(o_orderkey * 104729) % 1500").alias("y"), F.expr("20 + o_orderkey % 180").alias("w"), F.expr("10 + o_orderkey % 15").alias("h")
    )


LINES = """lines AS (SELECT o_custkey AS page, o_orderkey AS line, (o_orderkey * 7919) % 1000 AS x, (o_orderkey * 104729) % 1500 AS y, 20 + o_orderkey % 180 AS w, 10 + o_orderkey % 15 AS h FROM orders)"""


def regions(spark: SparkSession, d: str) -> DataFrame:
    """(page, region, x0, y0, x1, y1): two columns of each page, which overlap."""
    pages = table(spark, d, "orders").select(F.col("o_custkey").alias("page")).distinct()
    return pages.select("page", F.explode(F.expr("array(named_struct('region', 'a', 'x0', 0L, 'y0', 0L, 'x1', 550L, 'y1', 1500L), named_struct('region', 'b', 'x0', 450L, 'y0', 0L, 'x1', 1000L, 'y1', 1500L))")).alias("r")).select("page", "r.*")


REGIONS = """regions AS (SELECT DISTINCT o_custkey AS page, r.region, r.x0, 0 AS y0, r.x1, 1500 AS y1 FROM orders, (VALUES ('a', 0, 550), ('b', 450, 1000)) r(region, x0, x1))"""


def frames(spark: SparkSession, d: str) -> DataFrame:
    """(line, scores): 8 frames of 8 symbols for each embedding, the last symbol being the blank."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("line"), "label", F.expr("transform(sequence(0, 7), t -> transform(slice(embedding, 8 * t + 1, 8), v -> double(v) * 10))").alias("scores"))


FRAMES = """frames AS (SELECT vec_id AS line, label, list_transform(range(8), lambda t: list_transform(embedding[8 * t + 1 : 8 * t + 8], lambda v: CAST(v AS DOUBLE) * 10)) AS scores FROM embeddings)"""
CELLS = (
    FRAMES
    + """,
cells AS (SELECT line, label, t, k, CAST(embedding[8 * t + k + 1] AS DOUBLE) * 10 AS v FROM (SELECT vec_id AS line, label, embedding FROM embeddings), range(8) a(t), range(8) b(k)),
tops AS (SELECT line, label, t, max(v) AS m, ln(sum(exp(v))) AS lse, arg_max(k, v) AS k FROM cells GROUP BY ALL)"""
)


def bags(spark: SparkSession, d: str) -> DataFrame:
    """(line, rank, transcript, vis, lm): the hypotheses of each user's line, one for each event, in their order; some lines' model scores are missing."""
    return table(spark, d, "events").select(
        F.col("user_id").alias("line"), F.col("event_id").alias("rank"), F.col("event_type").alias("transcript"), (-F.col("value") / 10).alias("vis"), F.when(F.col("user_id") > 5, -F.length("props").cast("double")).alias("lm")
    )


BAGS = """bags AS (SELECT user_id AS line, event_id AS rank, event_type AS transcript, -value / 10 AS vis, CASE WHEN user_id > 5 THEN -CAST(length(props) AS DOUBLE) END AS lm FROM events)"""
