"""Queries of the evaluation operators: pairing, error rates, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirekit.functions import sequence
from quirekit.operators import evaluation as ev
from quirekit.plans.inputs import NOISY, SIDES, hypotheses, noisy, references, table
from quirekit.plans.registry import query

KEYS = ["file", "line"]
_PAIRED = f"""{SIDES},
paired AS (SELECT coalesce(r.file, h.file) AS file, coalesce(r.line, h.line) AS line, trim(r.text) AS ref, trim(h.text) AS hyp,
  CASE WHEN r.file IS NULL THEN 'hypothesis only' WHEN h.file IS NULL THEN 'reference only' ELSE 'both' END AS side
  FROM reference r FULL OUTER JOIN hypothesis h ON r.file = h.file AND r.line = h.line),
scored AS (SELECT *, levenshtein(ref, hyp) AS errors, length(ref) AS ref_len FROM paired WHERE side = 'both')"""


def paired(s, d):
    return ev.paired(references(s, d), hypotheses(s, d), KEYS)


def scored(s, d):
    return ev.scored(paired(s, d))


@query("j01_line_cer", f"""WITH {_PAIRED} SELECT file, count(*) AS lines, sum(errors)::BIGINT AS errors, sum(ref_len)::BIGINT AS ref_len,
 round(sum(errors) / sum(ref_len), 6) AS rate FROM scored GROUP BY ROLLUP (file)""")
def j01(s, d):
    return ev.micro(scored(s, d), ["file"]).withColumn("rate", F.round("rate", 6))


@query("j01_line_join", f"WITH {_PAIRED} SELECT file, line, ref, hyp, side FROM paired")
def j01_join(s, d):
    return paired(s, d).select("file", "line", "ref", "hyp", "side")


@query("j03_unmatched_lines", f"WITH {_PAIRED} SELECT side, count(*) AS n FROM paired WHERE side <> 'both' GROUP BY side")
def j03(s, d):
    return paired(s, d).where("side <> 'both'").groupBy("side").agg(F.count("*").alias("n"))


_FILES = f"""{SIDES}, r AS (SELECT file, string_agg(text, ' ' ORDER BY line) AS ref FROM reference GROUP BY file), h AS (SELECT file, string_agg(text, ' ' ORDER BY line) AS hyp FROM hypothesis GROUP BY file)"""


def files(s, d):
    """Whole files of both sides; those of one side are left out."""
    whole = lambda df, c: df.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("t")).select("file", F.array_join("t.text", " ").alias(c))
    return whole(references(s, d), "ref").join(whole(hypotheses(s, d), "hyp"), "file")


@query("j02_file_join", f"WITH {_FILES} SELECT file, coalesce(ref, '') AS ref, coalesce(hyp, '') AS hyp, (ref IS NOT NULL) AS has_ref, (hyp IS NOT NULL) AS has_hyp FROM r FULL OUTER JOIN h USING (file)")
def j02(s, d):
    whole = lambda df, c: df.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("t")).select("file", F.array_join("t.text", " ").alias(c))
    both = whole(references(s, d), "ref").join(whole(hypotheses(s, d), "hyp"), "file", "full_outer")
    return both.select("file", F.coalesce("ref", F.lit("")).alias("ref"), F.coalesce("hyp", F.lit("")).alias("hyp"), F.col("ref").isNotNull().alias("has_ref"), F.col("hyp").isNotNull().alias("has_hyp"))


@query("c06_cer", f"""WITH {_PAIRED}, n AS (SELECT file, line, trim(regexp_replace(ref, '\\s+', ' ', 'g')) AS r, trim(regexp_replace(hyp, '\\s+', ' ', 'g')) AS h FROM scored)
SELECT file, line, levenshtein(r, h) AS distance, length(r) AS ref_len, round(CASE WHEN length(r) > 0 THEN levenshtein(r, h) / length(r) ELSE 0 END, 6) AS cer FROM n""")
def c06(s, d):
    r, h = ev.single_spaced(F.col("ref")), ev.single_spaced(F.col("hyp"))
    rows = scored(s, d).select("file", "line", F.levenshtein(r, h).alias("distance"), F.length(r).alias("ref_len"))
    return rows.withColumn("cer", F.round(ev.rate(F.col("distance"), F.col("ref_len"), 0.0), 6))


@query("c07_word_errors")
def c07(s, d):
    return scored(s, d).select("file", "line", ev.word_errors(F.col("ref"), F.col("hyp")).alias("word_errors"), ev.n_words(F.col("ref")).alias("words"))


@query("c08_single_spaces", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents")
def c08(s, d):
    return table(s, d, "documents").select("doc_id", ev.single_spaced(F.col("text")).alias("text"))


@query("k13_report")
def k13(s, d):
    return ev.report(files(s, d))


_RATES = f"""{_PAIRED}, f AS (SELECT file, round(sum(errors) / sum(ref_len), 6) AS cer, sum(ref_len) AS n FROM scored GROUP BY file)"""


@query("a09_weighted_cer", f"WITH {_RATES} SELECT round(sum(cer * n) / sum(n), 6) AS cer, sum(n)::BIGINT AS n FROM f")
def a09(s, d):
    rates = ev.micro(scored(s, d), ["file"]).where("file is not null")
    return rates.agg(F.round(ev.weighted(rates, "rate", "ref_len"), 6).alias("cer"), F.sum("ref_len").alias("n"))


@query("a08_micro_cer", f"WITH {_PAIRED} SELECT c.role, sum(errors)::BIGINT AS errors, sum(ref_len)::BIGINT AS ref_len, round(100.0 * sum(errors) / sum(ref_len), 6) AS cer FROM scored s JOIN conversations c ON c.conv_id = s.file AND c.turn = s.line GROUP BY ROLLUP (c.role)")
def a08(s, d):
    roles = table(s, d, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("line"), "role")
    return ev.micro(scored(s, d).join(roles, KEYS), ["role"]).select("role", "errors", "ref_len", F.round(100 * F.col("rate"), 6).alias("cer"))


@query("a02_rate", f"""WITH {_PAIRED} SELECT file, line, CASE WHEN length(trim(hyp)) > 0 THEN round(levenshtein(hyp, ref) / length(hyp), 6) ELSE 'Infinity'::DOUBLE END AS rate FROM scored""")
def a02(s, d):
    return scored(s, d).select("file", "line", F.round(ev.rate(F.levenshtein("hyp", "ref"), F.length("hyp")), 6).alias("rate"))


@query("a10_best_group", f"""WITH {_PAIRED}, g AS (SELECT c.role, 100.0 * sum(errors) / sum(ref_len) AS cer FROM scored s JOIN conversations c ON c.conv_id = s.file AND c.turn = s.line GROUP BY c.role)
SELECT role, round(cer, 6) AS cer FROM g ORDER BY cer, role LIMIT 1""")
def a10(s, d):
    roles = table(s, d, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("line"), "role")
    return ev.best_group(scored(s, d).join(roles, KEYS), "role").withColumn("cer", F.round("cer", 6))



@query("a07_match_type", """WITH p AS (SELECT a.l_orderkey, a.l_linenumber, a.l_partkey, a.l_returnflag AS ref, CASE WHEN a.l_quantity > 10 THEN a.l_linestatus END AS hyp FROM lineitem a)
SELECT ref, hyp, CASE WHEN hyp IS NULL THEN 'D' WHEN ref = hyp THEN 'C' ELSE 'S' END AS type, count(*) AS n FROM p GROUP BY ALL""")
def a07(s, d):
    p = table(s, d, "lineitem").select(F.col("l_returnflag").alias("ref"), F.when(F.col("l_quantity") > 10, F.col("l_linestatus")).alias("hyp"))
    return p.withColumn("type", ev.match_type(F.col("ref"), F.col("hyp"))).groupBy("ref", "hyp", "type").agg(F.count("*").alias("n"))


def summaries(s, d):
    return ev.summaries(scored(s, d))


@query("c02_alignment")
def c02(s, d):
    return summaries(s, d).select("file", "line", "alignment")


@query("c03_alignment_path")
def c03(s, d):
    chars = lambda c: F.split(F.col(c), "")
    return scored(s, d).select("file", "line", sequence.path_udf()(chars("hyp"), chars("ref")).alias("path"))


_WORDS = f"""WITH {_PAIRED} SELECT file, line, levenshtein(ref, hyp)::DOUBLE AS distance FROM scored"""


@query("c01_list_distance", _WORDS)
def c01(s, d):
    chars = lambda c: F.filter(F.split(F.col(c), ""), lambda x: x != "")
    return scored(s, d).select("file", "line", sequence.distance_udf()(chars("ref"), chars("hyp")).alias("distance"))


@query("c01_weighted_distance")
def c01_weighted(s, d):
    return scored(s, d).select("file", "line", sequence.distance_udf(1.5, 0.5, 1.0)(F.split("ref", " "), F.split("hyp", " ")).alias("distance"))


@query("c04_substring_distance")
def c04(s, d):
    return scored(s, d).select("file", "line", sequence.substring_distance_udf()(F.split("ref", " "), F.split("hyp", " ")).alias("distance"))


@query("c05_substring_alignment")
def c05(s, d):
    return scored(s, d).select("file", "line", sequence.substring_alignment_udf()(F.split("ref", " "), F.split("hyp", " ")).alias("alignment"))


# an alignment's lengths and costs don't depend on which of the cheapest it is
@query("a03_edit_stats", f"WITH {_PAIRED} SELECT file, line, levenshtein(ref, hyp)::INT AS n_errors, length(ref)::INT AS n_ref, (length(hyp) - length(ref))::INT AS ins_less_del FROM scored")
def a03(s, d):
    return summaries(s, d).select("file", "line", F.col("n_errors").cast("int").alias("n_errors"), F.col("n_ref").cast("int").alias("n_ref"), (F.col("n_ins") - F.col("n_del")).cast("int").alias("ins_less_del"))


@query("a04_confusions")
def a04(s, d):
    return ev.confusions(summaries(s, d))


@query("a05_endings")
def a05(s, d):
    return summaries(s, d).select("file", "line", "ending")


@query("a06_unmatched_ends")
def a06(s, d):
    return summaries(s, d).select("file", "line", ev.unmatched_start(F.col("types")).alias("prefix"), ev.unmatched_end(F.col("types")).alias("suffix"))


@query("a01_total", f"WITH {_PAIRED} SELECT count(*) AS lines, sum(ref_len)::BIGINT AS ref_len, sum(errors)::BIGINT AS errors, round(sum(errors) / sum(ref_len), 6) AS rate FROM scored")
def a01(s, d):
    return ev.total(summaries(s, d)).select("lines", F.col("ref_len").cast("bigint"), F.col("errors").cast("bigint"), F.round("rate", 6).alias("rate"))


@query("c10_summary")
def c10(s, d):
    return summaries(s, d).select("file", "line", "n_ref", "n_errors", "n_sub", "n_ins", "n_del", "ending")


@query("c11_printed")
def c11(s, d):
    t = summaries(s, d).groupBy("file").agg(*(F.sum(c).alias(c) for c in ("n_errors", "n_ref", "n_sub", "n_ins", "n_del")))
    return t.select("file", ev.printed(F.col("n_errors"), F.col("n_ref"), F.col("n_sub"), F.col("n_ins"), F.col("n_del")).alias("text"))


@query("c09_stitched")
def c09(s, d):
    t = table(s, d, "conversations").select("conv_id", "turn", "text")
    cut = F.least(F.length("text"), F.lit(40))
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / 30).cast("int"))
    parts = t.select("conv_id", "turn", F.explode(F.sequence(F.lit(0), n - 1)).alias("part"), "text").select("conv_id", "turn", "part", F.substr("text", F.col("part") * 30 + 1, cut).alias("text"))
    return ev.stitched(parts, ["conv_id", "turn"], "part")


@query("a11_quality", """WITH l AS (SELECT event_type AS page, value / 500 AS c FROM events) SELECT page, round(pow(avg(pow(c, 6)), 1.0 / 6), 6) AS quality FROM l GROUP BY page""")
def a11(s, d):
    letters = table(s, d, "events").select(F.col("event_type").alias("page"), (F.col("value") / 500).alias("confidence"))
    return ev.quality(letters, ["page"]).withColumn("quality", F.round("quality", 6))


_IDS = f"{SIDES}"


@query("u01_id_union", f"WITH {_IDS} SELECT file, line FROM reference UNION SELECT file, line FROM hypothesis")
def u01(s, d):
    return references(s, d).select(*KEYS).union(hypotheses(s, d).select(*KEYS)).distinct()


@query("u02_id_intersection", f"WITH {_IDS} SELECT file, line FROM reference INTERSECT SELECT file, line FROM hypothesis")
def u02(s, d):
    return references(s, d).select(*KEYS).intersect(hypotheses(s, d).select(*KEYS))


@query("u03_id_difference", f"WITH {_IDS} SELECT file, line FROM reference EXCEPT SELECT file, line FROM hypothesis")
def u03(s, d):
    return references(s, d).select(*KEYS).subtract(hypotheses(s, d).select(*KEYS))


@query("u04_key_intersection", f"WITH {_IDS} SELECT r.file, r.line, (h.file IS NOT NULL) AS matched FROM reference r LEFT JOIN hypothesis h ON r.file = h.file AND r.line = h.line")
def u04(s, d):
    there = hypotheses(s, d).select(*KEYS).withColumn("matched", F.lit(True))
    return references(s, d).select(*KEYS).join(there, KEYS, "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


@query("f11_not_processed", f"WITH {_IDS} SELECT file, line FROM reference r WHERE NOT EXISTS (SELECT 1 FROM hypothesis h WHERE h.file = r.file AND h.line = r.line)")
def f11(s, d):
    return references(s, d).select(*KEYS).join(hypotheses(s, d), KEYS, "left_anti")


@query("f12_having_xml", f"WITH {_IDS} SELECT file, line FROM reference r WHERE EXISTS (SELECT 1 FROM hypothesis h WHERE h.file = r.file AND h.line = r.line)")
def f12(s, d):
    return references(s, d).select(*KEYS).join(hypotheses(s, d), KEYS, "left_semi")


@query("f13_listed", "SELECT o_custkey AS page, count(*) AS lines FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY o_custkey")
def f13(s, d):
    listed = table(s, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("page"))
    return table(s, d, "orders").select(F.col("o_custkey").alias("page")).join(listed, "page", "left_semi").groupBy("page").agg(F.count("*").alias("lines"))


@query("f18_non_blank", f"SELECT conv_id, turn, {NOISY} AS text FROM conversations WHERE trim({NOISY}) <> ''")
def f18(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", noisy().alias("text")).where(ev.stripped(F.col("text")) != "")
