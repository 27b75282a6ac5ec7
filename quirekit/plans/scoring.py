"""Queries of the scoring operators over frames of symbols, and of the hypotheses."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirekit.operators import hypotheses as hy
from quirekit.operators import scoring as sc
from quirekit.plans.inputs import BAGS, CELLS, bags, frames, table
from quirekit.plans.registry import query

LETTERS = [*"abcdefg", ""]
BLANK = 7
_RUNS = CELLS + """,
tagged AS (SELECT *, m - lse AS lp, CASE WHEN k = lag(k) OVER (PARTITION BY line ORDER BY t) THEN 0 ELSE 1 END AS new FROM tops),
placed AS (SELECT *, sum(new) OVER (PARTITION BY line ORDER BY t) AS run FROM tagged),
runs AS (SELECT line, run, any_value(k) AS k, min(t) AS begun, max(exp(lp)) AS top, avg(exp(lp)) AS mean FROM placed GROUP BY line, run)"""
_LETTER = "substr('abcdefg', k::INT + 1, 1)"


def logp(s, d):
    return frames(s, d).withColumn("logp", sc.log_probabilities(F.col("scores")))


def _cells(df, column: str, name: str):
    """An array of frames as rows (line, t, k, name), rounded."""
    return df.select("line", F.posexplode(column).alias("t", "f")).select("line", "t", F.posexplode("f").alias("k", "v")).select("line", "t", "k", F.round("v", 6).alias(name))


@query("d01_softmax", f"WITH {CELLS} SELECT line, t::INT AS t, cells.k::INT AS k, round(exp(v - m) / sum(exp(v - m)) OVER (PARTITION BY line, t), 6) AS p FROM cells JOIN tops USING (line, t)")
def d01(s, d):
    return _cells(frames(s, d).select("line", F.transform("scores", lambda f: sc.softmax(f)).alias("p")), "p", "p")


@query("d02_log_softmax", f"WITH {CELLS} SELECT line, t::INT AS t, cells.k::INT AS k, round(v - lse, 6) AS logp FROM cells JOIN tops USING (line, t)")
def d02(s, d):
    return _cells(logp(s, d), "logp", "logp")


@query("d03_dense", f"WITH {CELLS} SELECT line, t::INT AS t, cells.k::INT AS k, round(CASE WHEN exp(v - lse) >= 0.001 THEN v ELSE -80 END, 6) AS v FROM cells JOIN tops USING (line, t)")
def d03(s, d):
    return _cells(frames(s, d).select("line", F.transform("scores", lambda f: sc.dense(sc.sparse(f, 1e-3), 8)).alias("v")), "v", "v")


@query("f15_pruned", f"WITH {CELLS} SELECT line, t::INT AS t, count(*)::INT AS kept FROM cells JOIN tops USING (line, t) WHERE exp(v - lse) >= 0.001 GROUP BY line, t")
def f15(s, d):
    sizes = frames(s, d).select("line", F.posexplode(F.transform("scores", lambda f: F.size(sc.sparse(f, 1e-3)))).alias("t", "kept"))
    return sizes


_GREEDY = _RUNS + f""",
texts AS (SELECT line, string_agg({_LETTER}, '' ORDER BY run) FILTER (WHERE k < 7) AS text FROM runs GROUP BY line),
sums AS (SELECT line, ln(sum(exp(lp))) AS score FROM tagged GROUP BY line)"""


@query("d04_greedy", f"WITH {_GREEDY} SELECT line, coalesce(text, '') AS text, round(score, 6) AS score FROM texts JOIN sums USING (line)")
def d04(s, d):
    g = logp(s, d).select("line", sc.greedy(F.col("logp"), LETTERS).alias("g"))
    return g.select("line", "g.text", F.round("g.score", 6).alias("score"))


@query("d05_greedy_scores", f"WITH {_GREEDY} SELECT line, coalesce(text, '') AS text FROM texts")
def d05(s, d):
    return frames(s, d).select("line", sc.greedy(F.col("scores"), LETTERS).text.alias("text"))


@query("w01_collapsed", f"WITH {_RUNS} SELECT line, list(k::INT ORDER BY run) AS ks FROM runs GROUP BY line")
def w01(s, d):
    return frames(s, d).select("line", sc.collapsed(F.transform(sc.best(F.col("scores")), lambda b: b["k"])).alias("ks"))


@query("w02_runs", f"""WITH {_RUNS} SELECT line, k::INT AS k, begun::INT AS "at", n::INT AS n FROM (SELECT line, run, any_value(k) AS k, min(t) AS begun, count(*) AS n FROM placed GROUP BY line, run)""")
def w02(s, d):
    rows = logp(s, d).select("line", F.explode(sc.best_runs(F.col("logp"))).alias("r"))
    return rows.select("line", "r.k", F.col("r.at").cast("int").alias("at"), F.size("r.vs").alias("n"))


@query("w03_picked", f"WITH {CELLS} SELECT c.line, c.t::INT AS t, round(v - lse, 6) AS v FROM cells c JOIN tops p USING (line, t) WHERE c.k = c.label % 8")
def w03(s, d):
    ks = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.col("label") % 8)
    return logp(s, d).select("line", F.posexplode(sc.picked(F.col("logp"), ks)).alias("t", "v")).select("line", "t", F.round("v", 6).alias("v"))


@query("a17_transformer_confidence", f"WITH {CELLS} SELECT c.line, c.t::INT AS t, round(exp(v - lse), 6) AS confidence FROM cells c JOIN tops p USING (line, t) WHERE c.k = (c.label + c.t) % 8")
def a17(s, d):
    ks = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: (F.col("label") + t) % 8)
    return logp(s, d).select("line", F.posexplode(sc.picked(F.col("logp"), ks)).alias("t", "v")).select("line", "t", F.round(F.exp("v"), 6).alias("confidence"))


@query("w04_windows", f"""WITH {_RUNS}, n AS (SELECT line, run, begun, lag(begun) OVER w AS p, lead(begun) OVER w AS q FROM runs WHERE k < 7 WINDOW w AS (PARTITION BY line ORDER BY run))
SELECT line, begun::INT AS "at", CASE WHEN p IS NULL THEN 0 ELSE (p + 1 + begun) // 2 END::INT AS low, CASE WHEN q IS NULL THEN 8 ELSE (begun + 1 + q) // 2 END::INT AS high FROM n""")
def w04(s, d):
    at = F.transform(F.filter(sc.best_runs(F.col("logp")), lambda r: r["k"] < BLANK), lambda r: r["at"].cast("int"))
    rows = logp(s, d).select("line", at.alias("at")).where("size(at) > 0")
    return rows.select("line", F.explode(F.arrays_zip("at", sc.windows(F.col("at"), F.lit(8)).alias("w"))).alias("r")).select("line", "r.at", "r.w.low", "r.w.high")


@query("a12_line_confidence", f"WITH {_RUNS} SELECT line, round(least(1, min(top)), 6) AS confidence FROM runs GROUP BY line")
def a12(s, d):
    return logp(s, d).select("line", F.round(sc.line_confidence(F.col("logp")), 6).alias("confidence"))


@query("a13_update_confidences", f"WITH {_RUNS} SELECT vec_id AS line, coalesce(c, -1) AS confidence FROM embeddings LEFT JOIN (SELECT line, round(least(1, min(top)), 6) AS c FROM runs WHERE line % 3 <> 0 GROUP BY line) ON line = vec_id")
def a13(s, d):
    lines = frames(s, d).select("line")
    known = logp(s, d).where("line % 3 <> 0").select("line", F.round(sc.line_confidence(F.col("logp")), 6).alias("c"))
    return lines.join(known, "line", "left").select("line", F.coalesce("c", F.lit(-1.0)).alias("confidence"))


@query("a14_letter_confidence", f"WITH {_RUNS} SELECT line, k::INT AS k, round(top, 6) AS confidence FROM runs WHERE k < 7")
def a14(s, d):
    ks = F.transform(sc.best(F.col("logp")), lambda b: b["k"])
    rows = logp(s, d).select("line", F.explode(sc.letter_confidences(F.col("logp"), ks, BLANK)).alias("r"))
    return rows.select("line", "r.k", F.round("r.c", 6).alias("confidence"))


@query("a19_greedy_filtration", f"WITH {_RUNS} SELECT line, {_LETTER} AS letter, round(mean, 6) AS confidence FROM runs WHERE k < 7")
def a19(s, d):
    rows = logp(s, d).select("line", F.explode(sc.mean_confidences(F.col("logp"), LETTERS)).alias("r"))
    return rows.select("line", "r.letter", F.round("r.c", 6).alias("confidence"))


@query("a16_word_confidence", f"WITH {_RUNS}, w AS (SELECT line, k, top, sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY line ORDER BY run) AS word FROM runs WHERE k < 7) SELECT line, word::BIGINT AS word, round(quantile_cont(top, 0.5), 6) AS confidence FROM w WHERE k > 0 GROUP BY line, word")
def a16(s, d):
    ks = F.transform(sc.best(F.col("logp")), lambda b: b["k"])
    rows = logp(s, d).select("line", F.posexplode(sc.letter_confidences(F.col("logp"), ks, BLANK)).alias("pos", "r"))
    letters = rows.select("line", "pos", F.when(F.col("r.k") == 0, " ").otherwise("x").alias("letter"), F.col("r.c").alias("confidence"))
    return sc.word_confidences(letters, ["line"]).withColumn("confidence", F.round("confidence", 6))


@query("f04_confident_enough", f"WITH {CELLS} SELECT line, exp(min(m - lse)) > 0.3 AS enough FROM tops GROUP BY line")
def f04(s, d):
    return logp(s, d).select("line", (sc.least_confidence(F.col("logp")) > 0.3).alias("enough"))


@query("f14_relevant", f"WITH {CELLS} SELECT line, t::INT AS t, list(cells.k::INT ORDER BY cells.k) AS ks FROM cells JOIN tops USING (line, t) WHERE v - lse > -4 GROUP BY line, t")
def f14(s, d):
    return logp(s, d).select("line", F.posexplode(F.transform("logp", lambda f: sc.relevant(f, -4.0))).alias("t", "ks"))


@query("f17_deviation", f"WITH {CELLS} SELECT line, round(max(abs(e - 1)), 6) AS deviation FROM (SELECT line, t, sum(exp(v / 10)) AS e FROM cells GROUP BY line, t) GROUP BY line")
def f17(s, d):
    return frames(s, d).select("line", F.round(sc.deviation(F.transform("scores", lambda f: F.transform(f, lambda x: x / 10))), 6).alias("deviation"))


@query("d14_narrowed", f"""WITH {_RUNS}, kept AS (SELECT line, run, arg_max(t, m) AS at FROM placed WHERE k < 7 GROUP BY line, run)
SELECT p.line, list(CASE WHEN k.at = p.t THEN p.k ELSE 7 END::INT ORDER BY p.t) AS ks FROM placed p LEFT JOIN kept k USING (line, run) GROUP BY p.line""")
def d14(s, d):
    ks = F.transform(sc.best(F.col("scores")), lambda b: b["k"])
    return frames(s, d).select("line", sc.narrowed(F.col("scores"), ks, BLANK).alias("ks"))


@query("d16_cut", f"WITH {CELLS}, b AS (SELECT line, min(t) FILTER (WHERE k = 7) AS e FROM tops GROUP BY line) SELECT line, coalesce(list(k::INT ORDER BY t) FILTER (WHERE k <> 0 AND t < coalesce(e, 99)), []) AS ks FROM tops JOIN b USING (line) GROUP BY line")
def d16(s, d):
    ks = F.transform(sc.best(F.col("scores")), lambda b: b["k"])
    return frames(s, d).select("line", sc.cut_at(ks, 7, 0).alias("ks"))


@query("f16_repeated", """WITH w AS (SELECT conv_id, turn, u.w, u.i FROM (SELECT conv_id, turn, string_split(text, ' ') AS ws FROM conversations), (SELECT unnest(ws) AS w, generate_subscripts(ws, 1) AS i) u),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, w ORDER BY i) AS n FROM w) SELECT conv_id, turn, list(w ORDER BY i) AS again FROM n WHERE n > 1 GROUP BY conv_id, turn""")
def f16(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", sc.repeated(F.split("text", " ")).alias("again")).where("size(again) > 0")


@query("f10_positions", f"WITH {CELLS} SELECT line, list(k::INT ORDER BY t) FILTER (WHERE t NOT IN (1, 7)) AS ks FROM tops GROUP BY line")
def f10(s, d):
    ks = F.transform(sc.best(F.col("scores")), lambda b: b["k"])
    return frames(s, d).select("line", sc.without_positions(ks, F.array(F.lit(1), F.lit(-1), F.lit(1))).alias("ks"))


# bags: events of one user have one rank each


@query("d08_totals", f"WITH {BAGS}, o AS (SELECT line, count(*) FILTER (WHERE lm IS NULL) AS miss FROM bags GROUP BY line) SELECT line, rank, round(CASE WHEN miss = 0 THEN vis + 0.5 * lm ELSE vis END, 6) AS total FROM bags JOIN o USING (line)")
def d08(s, d):
    return hy.totals(bags(s, d), ["line"], 0.5).select("line", "rank", F.round("total", 6).alias("total"))


_POST = f"""{BAGS}, o AS (SELECT line, count(*) FILTER (WHERE lm IS NULL) AS miss FROM bags GROUP BY line), tot AS (SELECT bags.*, CASE WHEN miss = 0 THEN vis + lm ELSE vis END AS total FROM bags JOIN o USING (line)),
tp AS (SELECT *, max(total) OVER (PARTITION BY line) AS m FROM tot), post AS (SELECT *, total - m - ln(sum(exp(total - m)) OVER (PARTITION BY line)) AS posterior FROM tp)"""


@query("d08_posteriors", f"WITH {_POST} SELECT line, rank, round(posterior, 5) AS posterior FROM post")
def d08_posteriors(s, d):
    return hy.posteriors(bags(s, d), ["line"]).select("line", "rank", F.round("posterior", 5).alias("posterior"))


@query("d08_confidence", f"WITH {_POST} SELECT line, round(exp(max(posterior)), 6) AS confidence FROM post GROUP BY line")
def d08_confidence(s, d):
    return hy.confidence(bags(s, d), ["line"]).withColumn("confidence", F.round("confidence", 6))


@query("d08_transcript_confidence", f"WITH {_POST} SELECT line, round(coalesce(exp(arg_min(posterior, rank) FILTER (WHERE transcript = 'click')), 0), 6) AS confidence FROM post GROUP BY line")
def d08_transcript(s, d):
    return hy.transcript_confidence(bags(s, d), ["line"], "click").withColumn("confidence", F.round("confidence", 6))


@query("o02_ranked", f"WITH {BAGS} SELECT line, rank, row_number() OVER (PARTITION BY line ORDER BY vis DESC, rank)::INT AS place FROM bags")
def o02(s, d):
    return hy.ranked(bags(s, d), ["line"]).select("line", "rank", "place")


@query("o03_best", f"WITH {BAGS} SELECT line, transcript FROM bags QUALIFY row_number() OVER (PARTITION BY line ORDER BY vis + coalesce(lm, 0) DESC, rank) = 1")
def o03(s, d):
    return hy.best(bags(s, d), ["line"])


@query("o01_top_k", "SELECT event_id AS pos, value FROM events ORDER BY value, event_id LIMIT 10")
def o01(s, d):
    return hy.top_k(table(s, d, "events").select(F.col("event_id").alias("pos"), "value"), [], "value", 10)


@query("o01_top_k_by_line", "SELECT user_id AS line, event_id AS pos, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 3")
def o01_by_line(s, d):
    return hy.top_k(table(s, d, "events").select(F.col("user_id").alias("line"), F.col("event_id").alias("pos"), "value"), ["line"], "value", 3, True)


_CN = CELLS + """, raw AS (SELECT line, (t // 3)::INT AS pos, CASE WHEN k = 7 THEN NULL ELSE chr(97 + k::INT) END AS symbol, sum(exp(v)) AS weight FROM cells GROUP BY ALL),
cn AS (SELECT line, pos, symbol, weight / sum(weight) OVER (PARTITION BY line, pos) AS weight FROM raw)"""


def network(s, d):
    rows = frames(s, d).select("line", F.posexplode("scores").alias("t", "f")).select("line", "t", F.posexplode("f").alias("k", "v"))
    named = rows.select("line", F.floor(F.col("t") / 3).cast("int").alias("pos"), F.when(F.col("k") < 7, F.chr(97 + F.col("k"))).alias("symbol"), F.exp("v").alias("w"))
    return hy.normalised(named.groupBy("line", "pos", "symbol").agg(F.sum("w").alias("weight")), ["line"])


@query("a25_normalised_network", f"WITH {_CN} SELECT line, pos, symbol, round(weight, 6) AS weight FROM cn")
def a25(s, d):
    return network(s, d).withColumn("weight", F.round("weight", 6))


@query("o04_best_path", f"WITH {_CN}, p AS (SELECT line, pos, symbol FROM cn QUALIFY row_number() OVER (PARTITION BY line, pos ORDER BY weight DESC, symbol NULLS FIRST) = 1) SELECT line, coalesce(string_agg(symbol, '' ORDER BY pos), '') AS text FROM p GROUP BY line")
def o04(s, d):
    return hy.best_path(network(s, d), ["line"])


@query("o04_pivots", f"WITH {_CN} SELECT line, pos, symbol FROM cn QUALIFY row_number() OVER (PARTITION BY line, pos ORDER BY weight DESC, symbol NULLS FIRST) = 1")
def o04_pivots(s, d):
    return hy.pivots(network(s, d), ["line"])


@query("o05_paths", f"WITH {_CN} SELECT a.line, concat(a.symbol, b.symbol, c.symbol) AS text, round(a.weight * b.weight * c.weight, 6) AS weight FROM cn a JOIN cn b ON b.line = a.line AND b.pos = 1 JOIN cn c ON c.line = a.line AND c.pos = 2 WHERE a.pos = 0")
def o05(s, d):
    return hy.paths(network(s, d), ["line"]).withColumn("weight", F.round("weight", 6))


@query("a26_networks")
def a26(s, d):
    """The networks of each user's bag; their folds are tested against the literal facts."""
    b = bags(s, d).withColumn("lm", F.col("lm") / 10)
    return hy.networks(b.select("line", "rank", "transcript", "vis", "lm"), ["line"]).withColumn("weight", F.round("weight", 6))


@query("a24_hypothesis_added")
def a24(s, d):
    """The same without normalisation: the weights that hypotheses add."""
    b = bags(s, d).withColumn("lm", F.lit(0.0))
    return hy.networks(b, ["line"], normalise=False).withColumn("weight", F.round("weight", 6))


_ENGINES = """engines AS (SELECT vec_id // 10 AS line, label % 3 AS engine, max(embedding[1])::DOUBLE AS confidence FROM embeddings GROUP BY ALL)"""


@query("j04_merged", f"""WITH {_ENGINES}, won AS (SELECT * FROM engines WHERE confidence > 0 QUALIFY row_number() OVER (PARTITION BY line ORDER BY confidence DESC, engine) = 1)
SELECT b.line, CASE WHEN w.line IS NULL THEN 'base' ELSE concat('e', w.engine) END AS text, round(coalesce(w.confidence, -10), 6) AS confidence FROM (SELECT DISTINCT line FROM engines) b LEFT JOIN won w ON w.line = b.line""")
def j04(s, d):
    e = table(s, d, "embeddings").groupBy(F.floor(F.col("vec_id") / 10).alias("line"), (F.col("label") % 3).alias("engine")).agg(F.max(F.col("embedding")[0].cast("double")).alias("confidence"))
    e = e.withColumn("text", F.concat(F.lit("e"), F.col("engine")))
    base = e.select("line").distinct().select("line", F.lit("base").alias("text"), F.lit(-10.0).alias("confidence"))
    return hy.merged(e, base, ["line"]).select("line", "text", F.round("confidence", 6).alias("confidence"))


@query("a18_mean_confidence", f"WITH {_RUNS} SELECT line, round(coalesce(avg(top) FILTER (WHERE k < 7), -10), 6) AS confidence FROM runs GROUP BY line")
def a18(s, d):
    ks = F.transform(sc.best(F.col("logp")), lambda b: b["k"])
    found = F.transform(sc.letter_confidences(F.col("logp"), ks, BLANK), lambda r: r["c"])
    return logp(s, d).select("line", F.round(hy.mean_confidence(found), 6).alias("confidence"))


@query("f03_min_confidence", "SELECT event_id FROM events WHERE value <> 0 AND value > 5")
def f03(s, d):
    return table(s, d, "events").where("value <> 0 and value > 5").select("event_id")


@query("j06_logits_onto_lines", f"WITH {CELLS} SELECT o_orderkey AS line, o_custkey AS page, n::INT AS n_frames FROM orders LEFT JOIN (SELECT line, count(*) AS n FROM tops GROUP BY line) f ON f.line = o_orderkey")
def j06(s, d):
    lines = table(s, d, "orders").select(F.col("o_orderkey").alias("line"), F.col("o_custkey").alias("page"))
    return lines.join(frames(s, d).select("line", F.size("scores").alias("n_frames")), "line", "left")


@query("j12_letter_index", "SELECT conv_id, turn, list_transform(list_filter(string_split(text, ''), lambda c: c <> ''), lambda c: greatest(instr('abcdefghijklmnopqrstuvwxyz ', c) - 1, 0)::INT) AS ks FROM conversations")
def j12(s, d):
    letters = F.split(F.lit("abcdefghijklmnopqrstuvwxyz "), "")
    ks = F.transform(F.filter(F.split(F.col("text"), ""), lambda c: c != ""), lambda c: F.greatest(F.array_position(letters, c) - 1, F.lit(0)).cast("int"))
    return table(s, d, "conversations").select("conv_id", "turn", ks.alias("ks"))
