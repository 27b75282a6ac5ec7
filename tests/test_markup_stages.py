"""Hand-written documents, settings, scores, configured runs over a folder in batch and as a stream, and jobs."""

import json
from configparser import ConfigParser

import numpy as np
import pytest
from pyspark.sql import functions as F
from quirekit import jobs
from quirekit.operators import decoding as de
from quirekit.sources import logits as lo
from quirekit.sources import markup as mu
from quirekit.sources import markup_trees as mt
from quirekit.sources import settings as se
from quirekit.stages import Pages, layout_stage, parser, recognised
from quirekit.streaming import folders
from quirekit.streaming import lines as sl

NESTED = """<?xml version="1.0" encoding="UTF-8"?><pc:PcGts xmlns:pc="http://schema.primaresearch.org/PAGE/gts/pagecontent/2013-07-15"><pc:Page imageFilename="a.jpg" imageWidth="300" imageHeight="400">
<pc:ReadingOrder><pc:OrderedGroup id="o"><pc:RegionRefIndexed index="1" regionRef="r1"/><pc:RegionRefIndexed index="0" regionRef="r3"/></pc:OrderedGroup></pc:ReadingOrder>
<pc:TextRegion id="r1" type="paragraph"><pc:Coords><pc:Point x="1" y="2"/><pc:Point x="50" y="2"/><pc:Point x="50" y="60"/></pc:Coords>
<pc:TextRegion id="r2"><pc:Coords points="1,1 9,9 2,2"/><pc:TextLine id="l1"><pc:Coords points="0,0 40,0 40,20 0,20"/><pc:Baseline points="0,15 20,15 40,15"/><pc:TextEquiv conf="0.5"><pc:Unicode>Hi &amp; you</pc:Unicode></pc:TextEquiv></pc:TextLine>
<pc:TextLine id="none"><pc:Coords points="0,0 1,1"/></pc:TextLine></pc:TextRegion><pc:TextEquiv><pc:Unicode/></pc:TextEquiv></pc:TextRegion>
<pc:TextRegion id="r3"><pc:Coords points="0,100 200,100 200,200 0,200"/><pc:TextLine id="l2" index="7" custom="heights_v2:[8.5,2.0]"><pc:Coords points="10,110 90,110 90,130 10,130"/><pc:Baseline><pc:Point x="10" y="125"/><pc:Point x="90" y="125"/></pc:Baseline></pc:TextLine></pc:TextRegion>
</pc:Page></pc:PcGts>"""


def test_nested_documents_with_prefixes(spark):
    docs = spark.createDataFrame([("a", NESTED), ("bad", "<PcGts><Page"), ("none", None)], "page_id string, xml string")
    parsed = mt.trees(docs)
    rows = {r.page_id: r for r in parsed.collect()}
    assert rows["bad"].error and rows["none"].error and rows["a"].error is None and (rows["a"].width, rows["a"].height) == (300, 400) and rows["a"].namespace == mu.NAMESPACES["2013"]
    assert [(r.region_id, r.type, r.transcription, len(r.polygon)) for r in rows["a"].regions] == [("r1", "paragraph", "", 3), ("r2", None, None, 3), ("r3", None, None, 4)]
    assert {(r.region_id, r["index"]) for r in mt.order_of(parsed).collect()} == {("r1", 1), ("r3", 0)}
    lines = {(r.region_id, r.line_id): r for r in mu.parse_page_xml(docs).collect()}
    assert set(lines) == {("r1", "l1"), ("r2", "l1"), ("r3", "l2")}
    one, two = lines["r2", "l1"], lines["r3", "l2"]
    assert (one.ascender, one.descender, one.transcription, one.confidence, one.line_pos) == (15.0, 5.0, "Hi & you", 0.5, 0)
    assert (two.ascender, two.descender, two.transcription, two.line_pos) == (8.5, 2.0, None, 7) and [(p.x, p.y) for p in two.baseline] == [(10, 125), (90, 125)]


def test_heights_from_edges():
    # a slanted line in a slanted box: 12 above and 4 below it, along its normals
    way, up = np.array([0.8, 0.6]), np.array([0.6, -0.8])
    base = [np.array([100.0, 100.0]) + t * way for t in (0, 50, 100)]
    edge = [base[0] - way + 12 * up, base[-1] + way + 12 * up, base[-1] + way - 4 * up, base[0] - way - 4 * up]
    assert np.allclose(mt.guessed_heights(base, edge), [12, 4])
    assert mt.guessed_heights([(0, 5)], [(0, 0), (10, 0), (10, 10), (0, 10)]) == [8.0, 2.0] and mt.guessed_heights([(0, 0)], None) == [0.0, 0.0]
    assert mt.heights_of("heights:[8,1,5,1]") == [8, 5] and mt.heights_of("heights:[1,4,7]") == [4, 6] and mt.heights_of("x") is None


def test_alto_in_composed_blocks(spark):
    xml = '<a:alto xmlns:a="http://www.loc.gov/standards/alto/ns-v4#"><a:Layout><a:Page ID="p" WIDTH="10" HEIGHT="20"><a:PrintSpace><a:ComposedBlock><a:TextBlock ID="b" HPOS="1" VPOS="2" WIDTH="8" HEIGHT="9"><a:TextLine BASELINE="9" HPOS="1" VPOS="3" WIDTH="6" HEIGHT="8"><a:String CONTENT="one" WC="0.5"/><a:SP/><a:String CONTENT="two" WC="0.7"/></a:TextLine></a:TextBlock></a:ComposedBlock></a:PrintSpace></a:Page></a:Layout></a:alto>'
    (r,) = mt.lines_of(mt.trees(spark.createDataFrame([(1, xml)], "page_id int, xml string"), "alto")).collect()
    assert (r.region_id, r.transcription, r.ascender, r.descender) == ("b", "one two", 6.0, 2.0) and abs(r.confidence - 0.6) < 1e-9


def test_written_documents_read_back(spark):
    parsed = mt.trees(spark.createDataFrame([("a", NESTED)], "page_id string, xml string"))
    pages, regions, lines = parsed.select("page_id", "width", "height"), mt.regions_of(parsed), mt.lines_of(parsed).select(*mu._COLUMNS)
    xml = mu.to_page_xml(lines, pages, mt.order_of(parsed), version="2019", creator="x & y", created="2020-01-01T00:00:00Z", regions_of_pages=regions)
    text = xml.first().xml
    assert "<Creator>x &amp; y</Creator><Created>2020-01-01T00:00:00Z</Created>" in text and text.index('id="r3"') < text.index('id="r1"') < text.index('id="r2"')
    back = mt.trees(xml)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(mt.order_of(back)) == key(mt.order_of(parsed)) and key(mt.lines_of(back).select(*mu._COLUMNS)) == key(lines)
    assert key(mt.regions_of(back).drop("region_pos")) == key(regions.drop("region_pos"))
    assert mu.NAMESPACES["2013"] in mu.to_page_xml(lines, pages, version="2013").first().xml
    with pytest.raises(ValueError):
        mu.to_page_xml(lines, pages, version="1999")
    sure = lines.where("line_id = 'l1' and region_id = 'r2'").withColumn("word_confidences", F.array(F.lit(0.25), F.lit(0.5), F.lit(1.0)))
    alto = mu.to_alto_xml(sure, pages, processing=mu.processing_element("IdOcr", when="2020")).first().xml
    assert 'WC="0.25"' in alto and 'WC="1.00"' in alto and "<processingDateTime>2020</processingDateTime>" in alto
    assert "<String" not in mu.to_alto_xml(sure, pages, 0.6).first().xml


def test_settings(tmp_path):
    path = tmp_path / "ocr.json"
    path.write_text(json.dumps({"line_px_height": 40, "line_vertical_scale": 1.5, "checkpoint": "w.pt", "characters": ["a", "ž"], "embed_num": 3, "other": 1}), encoding="utf-8")
    got = se.recogniser(str(path))
    assert got.checkpoint == str(tmp_path / "w.pt") and got.characters == ("a", "ž") == tuple(se.characters(str(path))) and got.rest == {"other": 1} and got.embed_id is None
    se.choose_embedding(str(path), 2)
    assert se.recogniser(str(path)).embed_id == 2 and se.compose_path("/x", "y") == "/x" and se.compose_path("x", "") == "x" and se.compose_path("x", "y") == "y/x"


FRAMES = [[[2.0, 0.0, -1.0], [0.0, 0.0, 3.0], [0.0, 2.0, -1.0]], [[0.0, 1.0, 0.5]]]


def scores(spark):
    return spark.createDataFrame([("a", "l1", FRAMES[0], ["x", "y", ""], 0, 3), ("a", "l2", FRAMES[1], ["x", "y", ""], 0, 1)], lo.SCHEMA)


def test_scores(spark, tmp_path):
    lo.write_logits(scores(spark), str(tmp_path / "s"))
    back = lo.read_logits(spark, str(tmp_path / "s"))
    assert sorted(map(str, back.collect())) == sorted(map(str, scores(spark).collect()))
    lines = spark.createDataFrame([("a", "l1"), ("a", "l9")], "page_id string, line_id string")
    assert {r.line_id: r.frames is None for r in lo.onto_lines(lines, back).collect()} == {"l1": False, "l9": True}
    part = scores(spark).withColumn("characters", F.when(F.col("line_id") == "l1", F.col("characters")))
    with pytest.raises(Exception, match="l2 are incomplete"):
        lo.write_logits(part, str(tmp_path / "t"))
    lo.write_logits(part, str(tmp_path / "u"), missing_ok=True)
    assert lo.read_logits(spark, str(tmp_path / "u")).count() == 1


def config(**sections):
    c = ConfigParser()
    c.read_dict(sections)
    return c


LAYOUT = {"PAGE_PARSER": {"RUN_LAYOUT_PARSER": "yes"}, "LAYOUT_PARSER_1": {"METHOD": "REGION_SORTER_NAIVE"}, "LAYOUT_PARSER_2": {"METHOD": "LINE_POSTPROCESSING", "STRETCH_LINES": "5"}, "LAYOUT_PARSER_3": {"METHOD": "LINE_FILTER", "FILTER_PAGES_WITH_SHORT_LINES": "yes", "LENGTH_THRESHOLD": "50"}}


def test_configured_runs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xml").write_text(NESTED, encoding="utf-8")
    (tmp_path / "in" / "b.xml").write_text(NESTED.replace("10,110 90,110", "10,110 20,110").replace("90,130 10,130", "20,130 10,130").replace('<pc:Point x="90" y="125"/>', '<pc:Point x="20" y="125"/>'), encoding="utf-8")
    c = config(**LAYOUT, PARSE_FOLDER={"INPUT_XML_PATH": str(tmp_path / "in"), "OUTPUT_XML_PATH": str(tmp_path / "out")})
    done = jobs.parse_folder(spark, c)
    lines = {(r.page_id, r.region_id): r for r in done.lines.collect()}
    assert {k for k in lines} >= {("a", "r3")} and [(p.x, p.y) for p in lines["a", "r3"].baseline][0] == (5, 125)
    assert {r.region_id for r in done.regions.where("page_id = 'a'").collect()} == {k[1] for k in lines if k[0] == "a"}
    before = spark.read.parquet(str(tmp_path / "out")).count()
    jobs.parse_folder(spark, c, skip_processed=True)
    assert spark.read.parquet(str(tmp_path / "out")).count() == before == len({k[0] for k in lines} | {"a", "b"})
    for _ in range(2):  # the second run finds nothing new
        folders.follow(spark, str(tmp_path / "in"), str(tmp_path / "stream"), str(tmp_path / "checkpoint"), parser(c)).awaitTermination(120)
    key = lambda p: sorted((r.page_id, r.xml) for r in spark.read.parquet(str(tmp_path / p)).select("page_id", "xml").collect())
    assert key("stream") == key("out")
    with pytest.raises(ValueError, match="unknown layout method"):
        layout_stage({"METHOD": "NOPE"})
    with pytest.raises(ValueError, match="plug it in"):
        layout_stage({"METHOD": "LAYOUT_CNN"})
    assert layout_stage({"METHOD": "LAYOUT_CNN"}, {"LAYOUT_CNN": lambda c: lambda p: p})("same") == "same"


def test_whole_pages_and_confidences(spark):
    p = jobs.loaded(spark.createDataFrame([("a", NESTED)], "page_id string, xml string"), scores(spark))
    whole = layout_stage({"METHOD": "REGION_WHOLE_PAGE"})(p)
    assert whole.lines.count() == 0 and [(r.region_id, [(q.x, q.y) for q in r.polygon]) for r in whole.regions.collect()] == [("r1", [(0, 0), (300, 0), (300, 400), (0, 400)])]
    done = parser(config(PAGE_PARSER={"FILTER_CONFIDENT_LINES_THRESHOLD": "0.6"}))(p)
    assert {r.line_id for r in done.lines.collect()} == {"l1"}


def test_recogniser_plug_in(spark):
    lines = spark.createDataFrame([("a", f"l{i}", w, bytes([i])) for i, w in enumerate((10, 20, 33, 64, 64))], "page_id string, line_id string, w int, crop binary")
    rows = recognised(lines, lambda crops, width: [[[float(c[0]), float(width)]] * len(crops) for c in crops], 128, ["x", ""]).collect()
    got = {r.line_id: (r.frames[0], len(r.frames)) for r in rows}
    assert got == {"l0": ([0.0, 32.0], 2), "l1": ([1.0, 32.0], 2), "l2": ([2.0, 64.0], 2), "l3": ([3.0, 64.0], 2), "l4": ([4.0, 64.0], 1)}


def test_jobs(spark, tmp_path):
    for name, text in (("one", NESTED), ("two", NESTED.replace("Hi &amp; you", "Hi &amp; me").replace('conf="0.5"', 'conf="0.9"'))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.xml").write_text(text, encoding="utf-8")
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    got = {r.line_id: (r.text, r.engine) for r in jobs.merge(spark, [one, two]).where("text is not null").collect()}
    assert got["l1"] == ("Hi & me", 1)
    rates = {r.page_id: r.errors for r in jobs.compare(spark, one, two).collect()}
    assert rates["a"] == rates[None] > 0
    (tmp_path / "one" / "t.txt").write_text("ab cd")
    (tmp_path / "two" / "t.txt").write_text("ab ce")
    assert jobs.compare_texts(spark, one, two).first().cer == 0.2
    lines = spark.createDataFrame([("p", "r", i, f"l{i}", "" if i % 3 == 0 else "t") for i in range(30)], "page_id string, region_id string, line_pos int, line_id string, transcription string")
    (r,) = jobs.sampled_lines(lines, 10, 4, 1).collect()
    assert len(r.lines) == 4 and all(int(x.line_id[1:]) < 15 and x.transcription for x in r.lines)
    store = spark.createDataFrame([(f"k{i}", bytes([i])) for i in range(5)], "id string, value binary")
    data = spark.createDataFrame([(f"k{i}", "t", i) for i in range(9)], "id string, text string, pos int")
    assert {r.id for r in jobs.stored_lines(store, data, 3, 2, 1).collect()} <= {"k0", "k1", "k2"}
    (tmp_path / "s.json").write_text('{"characters": []}')
    pairs = spark.createDataFrame([(0, "abc", "abd"), (1, "abc", "abc")], "embed_id int, ref string, hyp string")
    assert jobs.select_embedding(pairs, str(tmp_path / "s.json")) == 1 and json.loads((tmp_path / "s.json").read_text())["embed_id"] == 1


def test_stream_decodes_with_carried_state(spark, tmp_path):
    rng = np.random.default_rng(3)
    letters = ["a", "b", ""]
    rows = [(p, i, np.log(rng.dirichlet([1, 1, 1], 5)).tolist(), "t") for p in range(3) for i in range(4)]
    df = spark.createDataFrame(rows, "page int, line int, logp array<array<double>>, text string")
    df.write.parquet(str(tmp_path / "in"))
    lm = de.trained(spark.createDataFrame([("abab",), ("aab",)], "text string"), 3, letters)
    q = sl.decoded(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), letters, 4, lm).writeStream.format("memory").queryName("decoded").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {(r.page, r.line): (r.text, round(r.confidence, 9)) for r in de.decode_pages(df, letters, 4, lm).collect()}
    assert {(r.page, r.line): (r.text, round(r.confidence, 9)) for r in spark.table("decoded").collect()} == want


def test_windows_of_event_time(spark, tmp_path):
    df = spark.createDataFrame([("2020-01-01 00:00:01", "ab", "ab"), ("2020-01-01 00:00:02", "ab", "ac"), ("2020-01-01 01:00:00", "x", "y")], "t string, ref string, hyp string").withColumn("t", F.col("t").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    q = sl.windowed_rates(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "t", "10 minutes", "1 minute").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.errors, r.ref_len) for r in spark.table("windows").collect()) == [(1, 1), (1, 4)]
