"""Near-duplicate documents by a containment ensemble of MinHash bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirekit.llm.common import fresh, id_type, narrow_join, prepared, saved
from quirekit.llm.signatures import agreeing, buckets, checked, known, linked, one_each, signed, sought

N_HASHES = 64
#: A scheme finds a pair at its threshold with this probability, or as nearly as n_hashes functions allow with LEAST_ROWS in a band.
FIND, LEAST_ROWS = 0.95, 2
#: Containers of the own partition of sizes and of so many above are first looked for by bands.
GAPS = 1


def jaccard_at(containment: float, ratio: float) -> float:
    """The least Jaccard similarity of a set that is so far contained in another of `ratio` times its size."""
    return containment / (1 + ratio - containment)


def tuned(threshold: float, n_hashes: int = N_HASHES, find: float = FIND) -> tuple[int, int]:
    """(bands, rows): the most rows, then the fewest bands, that find pairs of this Jaccard similarity with probability `find`; no band has fewer than LEAST_ROWS rows."""
    for rows in range(8, LEAST_ROWS - 1, -1):
        for bands in range(1, n_hashes // rows + 1):
            if 1 - (1 - threshold**rows) ** bands >= find:
                return bands, rows
    return n_hashes // LEAST_ROWS, LEAST_ROWS


def near_duplicates(docs: DataFrame, containment: float = 0.7, shingle: int = 3, n_hashes: int = N_HASHES, seed: int = 11) -> DataFrame:
    """Each document that is nearly contained in a larger one: (doc_id, duplicate_of, containment, size, other_size).

    A document is a duplicate if at least `containment` of its set of word shingles is in that of another document that
    comes before it, by size of the set, largest first, then by doc_id; however large that is. A set equal to another's counts as contained in
    that of the smallest doc_id. duplicate_of is the best candidate that passes the exact check; it may itself be a duplicate.
    The first of all documents that are linked is never a duplicate, so one of each group stays.

    Documents are partitioned by the power of 2 of their set's size. For the containers of their own partition and of the next GAPS
    the containment becomes a Jaccard threshold, and bands are tuned for each. In each bucket a document is linked with the first of
    it; links are weighed by their signatures and then checked exactly, so most members of large groups of copies are settled in links in proportion to their
    number. Documents that are not ask with their rarest shingles for all that hold one of them (see sought), in partitions of any size, where a Jaccard threshold
    would need too many bands; those candidates are checked exactly, too.

    Rows with a null doc_id or text, and texts without a word, are no duplicates. Rows of one doc_id are one document, of
    its text with the largest set. Texts of fewer words than a shingle are one shingle. doc_id may be a number or a string. An empty table gives none.
    """
    rows = prepared(docs)
    signs = saved(signed(rows, shingle, n_hashes, seed))
    table, twice = known(signs)
    same = table.where("doc_id <> first").select("doc_id", F.col("first").alias("duplicate_of"), F.lit(1.0).alias("containment"), "size", F.col("size").alias("other_size"))
    copies = saved(same.select("doc_id"))
    one = one_each(narrow_join(signs, copies, "doc_id", "left_anti"), twice, ["doc_id"])
    found = buckets(one, {gap: tuned(jaccard_at(containment, 2.0 ** (gap + 1)), n_hashes) for gap in range(GAPS + 1)})
    jac = f"({containment} * size / (other_size + size * (1 - {containment})))"
    floor = f"greatest(1, floor({n_hashes} * {jac} - 2.6 * sqrt({n_hashes} * {jac} * (1 - {jac}))))"
    likely = agreeing(linked(found, largest=True), one, floor, n_hashes)
    good = checked(rows, likely, twice, shingle, "both / size", containment, [F.desc(F.expr("agree * (size + other_size) / size")), F.asc("other")])
    more = sought(narrow_join(rows, copies, "doc_id", "left_anti"), one, saved(good.select("doc_id")), twice, shingle, containment, "(other_size > size or other_size = size and other < doc_id)")
    good = good.union(checked(rows, more, twice, shingle, "both / size", containment, [F.desc("agree"), F.asc("other_size"), F.asc("other")]).select(good.columns))
    return same.union(good.select("doc_id", F.col("other").alias("duplicate_of"), F.col("score").alias("containment"), "size", "other_size"))


def without_near_duplicates(docs: DataFrame, **params) -> DataFrame:
    """docs without the duplicates that near_duplicates() finds; of rows with one doc_id, one stays: that of the longest text, then the largest, then any.

    Rows with a null doc_id stay, and so do those with a null, empty or wordless text. Other columns may have any names. An empty table gives an empty one."""
    gone = saved(near_duplicates(docs, **params).select("doc_id"))
    left = docs.withColumn("doc_id", F.col("doc_id").cast(id_type(docs)))
    twice = saved(left.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"))
    left = narrow_join(left, gone, "doc_id", "left_anti")
    if not twice.isEmpty():
        again = narrow_join(left, twice, "doc_id", "left_semi")
        place = fresh(docs, "place")
        order = W.partitionBy("doc_id").orderBy(F.desc_nulls_last(F.length(F.col("text").cast("string"))), F.desc_nulls_last(F.col("text").cast("string")))
        again = again.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).drop(place)
        left = narrow_join(left, twice, "doc_id", "left_anti").union(again.select(left.columns))
    return left.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType)).select(docs.columns)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
