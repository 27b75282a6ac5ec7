"""Queries of the decoders, alignments and language models."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirekit.functions import arabic as ar
from quirekit.operators import decoding as de
from quirekit.operators import scoring as sc
from quirekit.plans.inputs import CELLS, table
from quirekit.plans.registry import query
from quirekit.plans.scoring import BLANK, LETTERS, logp

def _text():
    return F.array(F.lit(0), F.lit(3), F.lit(3))


@query("d06_prefix_beam")
def d06(s, d):
    return de.bags(logp(s, d), LETTERS, 8).select("line", F.posexplode("bag").alias("rank", "h")).select("line", "rank", "h.text", F.round("h.vis", 6).alias("vis"))


@query("d09_decoder")
def d09(s, d):
    return de.decoder("FAST-LOG-RAW", LETTERS, k=4)(logp(s, d))


@query("d15_ngram_counts", """WITH c AS (SELECT text || chr(10) AS t FROM conversations), g AS (SELECT substr(t, i::BIGINT, 1) AS letter, CASE WHEN n > 0 THEN substr(t, (i - n)::BIGINT, n::BIGINT) ELSE '' END AS context FROM c, (SELECT unnest(range(1, (SELECT max(length(text)) + 2 FROM conversations))) AS i), (VALUES (0), (1), (2)) v(n) WHERE i <= length(t) AND n < i)
SELECT context, letter, count(*) AS n FROM g GROUP BY context, letter""")
def d15(s, d):
    return de.ngram_counts(table(s, d, "conversations").select("text"), 3)


def _model(s, d):
    texts = table(s, d, "conversations").select(F.regexp_replace(F.lower("text"), "[^a-g]", "").alias("text"))
    return de.trained(texts, 3, LETTERS)


@query("d10_decoded_pages")
def d10(s, d):
    pages = logp(s, d).select(F.floor(F.col("line") / 10).alias("page"), "line", "logp", F.lit(None).cast("string").alias("text"))
    return de.decode_pages(pages, LETTERS, 6, _model(s, d), 0.5, carry=False).select("page", "line", "text", F.round("confidence", 6).alias("confidence"), "error")


@query("st01_carried_state")
def st01(s, d):
    pages = logp(s, d).select(F.floor(F.col("line") / 10).alias("page"), "line", "logp", sc.greedy(F.col("logp"), LETTERS)["text"].alias("text"))
    return de.decode_pages(pages, LETTERS, 6, _model(s, d), 0.5, sure=0.5).select("page", "line", "text", F.round("confidence", 6).alias("confidence"), "error")


@query("d11_forced_alignment")
def d11(s, d):
    return de.alignments(logp(s, d).withColumn("symbols", _text()), BLANK)


@query("d12_alignment_cost", f"""WITH {CELLS}, p AS (SELECT c.line, c.t, c.k, c.v - t.lse AS lp FROM cells c JOIN tops t USING (line, t)),
s AS (SELECT * FROM (VALUES (0, 7), (1, 0), (2, 7), (3, 3), (4, 7), (5, 3), (6, 7)) v(st, sym)), m AS (SELECT a.st AS f, b.st AS g FROM s a JOIN s b ON b.st - a.st IN (0, 1) OR (b.st - a.st = 2 AND a.sym <> 7 AND a.sym <> b.sym)),
w0 AS (SELECT line, st, -lp AS c FROM p JOIN s ON sym = k WHERE t = 0 AND st < 2),
{', '.join(f"w{t} AS (SELECT w.line, g AS st, min(c) - any_value(lp) AS c FROM w{t - 1} w JOIN m ON f = w.st JOIN s ON s.st = g JOIN p ON p.line = w.line AND p.k = sym AND p.t = {t} GROUP BY w.line, g)" for t in range(1, 8))}
SELECT line, round(min(c), 5) AS cost FROM w7 WHERE st >= 5 GROUP BY line""")
def d12(s, d):
    """The cost of the cheapest path, which doesn't depend on ties."""
    paths = de.alignments(logp(s, d).withColumn("symbols", _text()), BLANK)
    rows = logp(s, d).join(paths, "line")
    return rows.select("line", F.round(-sc.total(sc.picked(F.col("logp"), F.col("path"))), 5).alias("cost"))


@query("d13_letter_frames")
def d13(s, d):
    rows = logp(s, d).select("line", F.posexplode(de.letters_udf(BLANK)(F.col("logp"), _text())).alias("pos", "r"))
    return rows.select("line", "pos", "r.frame")


@query("a15_letter_confidences")
def a15(s, d):
    rows = logp(s, d).select("line", F.posexplode(de.letters_udf(BLANK)(F.col("logp"), _text())).alias("pos", "r"))
    return rows.select("line", "pos", F.round("r.confidence", 6).alias("confidence"))


@query("a27_decoding_summary", f"WITH {CELLS}, l AS (SELECT line, exp(min(m - lse)) > 0.3 AS sure FROM tops GROUP BY line) SELECT count(*) AS lines, count(*) FILTER (WHERE NOT sure) AS decoded, round(100.0 * count(*) FILTER (WHERE NOT sure) / count(*), 4) AS percent FROM l")
def a27(s, d):
    sure = logp(s, d).select((sc.least_confidence(F.col("logp")) > 0.3).alias("sure"))
    n = F.count_if(~F.col("sure"))
    return sure.agg(F.count("*").alias("lines"), n.alias("decoded"), F.round(100 * n / F.count("*"), 4).alias("percent"))




def _arabic(s, d):
    """Turns of talk with Arabic letters in place of eight others."""
    words = F.transform(F.split("text", " "), lambda w: F.translate(w, "aeinorst", "ابتثجحخد"))
    return table(s, d, "conversations").select("conv_id", "turn", F.array_join(words, " ").alias("text"))


@query("c15_arabic_lines", "SELECT conv_id, turn, len(list_filter(string_split(text, ' '), lambda w: regexp_full_match(w, '[aeinorst]+'))) > 0 AS arabic FROM conversations")
def c15(s, d):
    return _arabic(s, d).select("conv_id", "turn", ar.is_arabic_line(F.col("text")).alias("arabic"))


@query("c16_reordered")
def c16(s, d):
    return _arabic(s, d).select("conv_id", "turn", ar.reordered_udf()(F.col("text")).alias("text"))


@query("c17_shaped")
def c17(s, d):
    return _arabic(s, d).select("conv_id", "turn", ar.shaped_udf()(F.col("text")).alias("text"))


@query("c17_plain_letters", "SELECT conv_id, turn, translate(text, 'aeinorst', 'ابتثجحخد') AS text FROM conversations")
def c17_plain(s, d):
    """Shaped and back again."""
    return _arabic(s, d).select("conv_id", "turn", ar.plain_letters(ar.shaped_udf()(F.col("text"))).alias("text"))


@query("c18_ligatures")
def c18(s, d):
    return _arabic(s, d).select("conv_id", "turn", ar.ligature_map_udf()(ar.shaped_udf()(F.col("text"))).alias("places"))


@query("a29_representatives")
def a29(s, d):
    """Ten clusters of the vectors, and the vector nearest to each one's centre."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = table(s, d, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=10, seed=0, maxIter=10).fit(v)
    centres = s.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "prediction int, centre array<double>")
    near = model.transform(v).join(F.broadcast(centres), "prediction")
    gap = F.aggregate(F.zip_with(vector_to_array("features"), "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
    return near.groupBy(F.col("prediction").alias("cluster")).agg(F.count("*").alias("n"), F.min_by("vec_id", F.struct(gap, "vec_id")).alias("vec_id"))


