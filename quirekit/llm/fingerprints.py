"""MinHash fingerprints of documents, and all links among them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirekit.llm.common import id_type, narrow_join, prepared, saved
from quirekit.llm.set_join import similar_sets
from quirekit.llm.signatures import known, one_each, signed

N_HASHES = 64


def fingerprints(docs: DataFrame, jaccard: float = 0.8, shingle: int = 4, seed: int = 29) -> DataFrame:
    """A row for each document: (doc_id, fingerprint, n_shingles, signature, match_id, jaccard, class_id, n_links).

    fingerprint is a 128-bit hash of the document's set of word shingles, in hexadecimal, and signature has the minima of 64
    universal hash functions over it. Documents of one set are a class, class_id the smallest doc_id of it; n_links is the number of other classes
    whose set has a Jaccard similarity of at least `jaccard` with it. match_id is for all but the first of a class that first one, with similarity 1; for the first it is the most similar
    document of smaller doc_id among the firsts of the linked classes, of equally similar ones the smallest, or null if there is none.

    All links are found, see similar_pairs(). A group of m classes that are all similar has m(m-1)/2 links, which are all checked.

    Rows with a null doc_id are left out. A null text or one without words has no shingles: its fingerprint, signature,
    match and class are null, and it has no links. Rows of one doc_id are one document, of its text with the largest set. doc_id may be a number or a string. An empty table gives none.
    """
    signs, table, twice, good = _linked(docs, jaccard, shingle, seed)
    best = good.groupBy("doc_id").agg(F.min(F.struct(-F.col("score"), "other")).alias("m")).select("doc_id", F.col("m.other").alias("other"), (-F.col("m.col1")).alias("score"))
    degrees = good.select(F.col("doc_id").alias("first")).union(good.select(F.col("other").alias("first"))).groupBy("first").agg(F.count("*").alias("n_links"))
    found = saved(table.select("doc_id", "first").join(saved(best), "doc_id", "left").join(saved(degrees), "first", "left"))
    copy = F.col("first") < F.col("doc_id")
    out = narrow_join(one_each(signs, twice, ["doc_id"]), found, "doc_id", "inner").select(
        "doc_id",
        F.lower(F.hex("print")).alias("fingerprint"),
        F.col("size").alias("n_shingles"),
        F.col("sig").alias("signature"),
        F.when(copy, F.col("first")).otherwise(F.col("other")).alias("match_id"),
        F.when(copy, F.lit(1.0)).otherwise(F.col("score")).alias("jaccard"),
        F.col("first").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
    )
    without = docs.select(F.col("doc_id").cast(id_type(docs)).alias("doc_id")).where("doc_id is not null").distinct()
    without = narrow_join(without, found.select("doc_id"), "doc_id", "left_anti")
    zero = {"n_shingles": "int", "n_links": "bigint"}
    none = {"fingerprint": "string", "signature": "binary", "match_id": id_type(docs), "jaccard": "double", "class_id": id_type(docs)}
    rest = without.select("doc_id", *(F.lit(0).cast(zero[c]).alias(c) if c in zero else F.lit(None).cast(none[c]).alias(c) for c in out.columns[1:]))
    return out.union(rest)


def _linked(docs: DataFrame, jaccard: float, shingle: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(signs, table, twice, links) of docs: see signed(), known() and similar_sets()."""
    rows = prepared(docs)
    signs = saved(signed(rows, shingle, N_HASHES, seed))
    table, twice = known(signs)
    copies = saved(table.where("doc_id <> first").select("doc_id"))
    return signs, table, twice, similar_sets(narrow_join(rows, copies, "doc_id", "left_anti"), table, twice, shingle, jaccard)


def similar_pairs(docs: DataFrame, jaccard: float = 0.8, shingle: int = 4) -> DataFrame:
    """(doc_id, other, score): all pairs of classes whose sets have a Jaccard similarity of at least `jaccard`, by the first documents of the classes, other the smaller.

    fingerprints() has the class of each document. Sets are joined by prefixes in one order of all shingles, rare ones first, so no pair is missed, and each pair's shingles are counted."""
    return _linked(docs, jaccard, shingle, 29)[3]


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
