"""Files and streams: transcriptions and markup read back from disk, streams against their batch forms."""

import pytest
from pyspark.sql import functions as F
from quirekit.plans import documents
from quirekit.sources import markup as mu
from quirekit.sources import transcriptions as tr
from quirekit.streaming import lines as st

from .conftest import SMALL


def test_transcription_files(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a one two\nb x\na last one\nc \n", encoding="utf-8")
    rows = {r.id: r.text for r in tr.read(spark, str(tmp_path / "t.txt")).collect()}
    assert rows == {"a": "last one", "b": "x", "c": ""}
    tr.write(tr.read(spark, str(tmp_path / "t.txt")), str(tmp_path / "out"))
    assert {r.id: r.text for r in tr.read(spark, str(tmp_path / "out")).collect()} == {"a": "last one", "b": "x"}
    assert {(r.name, r.text.count("\n")) for r in tr.read_texts(spark, str(tmp_path)).collect()} == {("t", 4)}
    (tmp_path / "bad.txt").write_text("alone\n")
    with pytest.raises(Exception, match="too few fields"):
        tr.read(spark, str(tmp_path / "bad.txt")).collect()


def test_page_files(spark, tmp_path):
    docs = documents.page_xml(spark, SMALL).limit(5).collect()
    for r in docs:
        (tmp_path / f"{r.page_id}.xml").write_text(r.xml)
    back = mu.read_page_xml(spark, str(tmp_path))
    want = mu.parse_page_xml(spark.createDataFrame(docs)).withColumn("page_id", F.col("page_id").cast("string"))
    assert sorted(map(str, back.collect())) == sorted(map(str, want.select(back.columns).collect())) != []


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "ab", "ab"), (1, 2, "cd", "ce"), (2, 1, "x", "")], "page int, line int, ref string, hyp string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = st.error_rates(stream, ["page"]).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.page, r.errors, r.ref_len) for r in spark.table("rates").collect()} == {(1, 1, 4), (2, 1, 1)}
    carried = st.carried(stream.select("page", "line", F.col("ref").alias("text")))
    q = carried.writeStream.format("memory").queryName("carried").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.page, r.line, r.before) for r in spark.table("carried").collect()} == {(1, 1, ""), (1, 2, "ab"), (2, 1, "")}
