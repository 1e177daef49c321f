"""Benchmark decontamination: size-partitioned MinHash containment search, in SQL functions only.

An item with n shingles is contained in a document at t or more exactly if at most n - ceil(t n) of
its shingles are missing.  So of any n - ceil(t n) + 1 of them the document holds at least one; the
sketch of an item is that many of its least shingle hashes (a bottom-k MinHash).  Items are parted
by size (powers of two), and the largest size of a part gives k for all of it.  Documents, which may
be any number of times longer than an item, are probed with every one of their shingles, and what a
sketch hits is verified by exact containment of the shingles themselves, as words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pipetally.llm.shared import small_enough, written

#: Largest tables of hashes or shingles of the benchmark, and of candidate ids, that are broadcast; above, joins shuffle.
BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _shingle_rows(rows: DataFrame, size: int, keep: list[str]) -> DataFrame:
    """One row for each run of ``size`` words of the array ``w``, with columns w0, w1, ..."""
    parts = [F.slice("w", i + 1, F.greatest(F.size("w") - (size - 1), F.lit(0))).alias(f"w{i}") for i in range(size)]
    return rows.select(*keep, F.inline(F.arrays_zip(*parts))).toDF(*keep, *[f"w{i}" for i in range(size)])


def _hashed(rows: DataFrame, sizes: list[int], keep: list[str]) -> DataFrame:
    """(keep, h): the hash of each shingle, over all ``sizes``."""
    out = None
    for n in sizes:
        part = _shingle_rows(rows, n, keep).select(*keep, F.xxhash64(*[f"w{i}" for i in range(n)]).alias("h"))
        out = part if out is None else out.unionByName(part)
    return out


def _spelled(rows: DataFrame, sizes: list[int], keep: list[str]) -> DataFrame:
    """(keep, s): the words of each shingle, over all ``sizes``."""
    out = None
    for n in sizes:
        part = _shingle_rows(rows, n, keep).select(*keep, F.concat_ws(" ", *[f"w{i}" for i in range(n)]).alias("s"))
        out = part if out is None else out.unionByName(part)
    return out


def _maybe_broadcast(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if small_enough(df, BROADCAST_ROWS) else df


def contained_items(docs: DataFrame, items: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_id, shared, size, containment) for each document that holds ``threshold`` or more
    of the distinct ``words``-word shingles of an item.

    An item of fewer words is one shingle, all its words.  Items without words, null texts and rows
    without an id match nothing; rows that repeat an id count as one document (or item) with the
    shingles of all; other columns are not looked at; empty tables give an empty result.
    """
    it = items.filter("item_id is not null").select("item_id", words_of(F.col("text")).alias("w")).filter("size(w) > 0")
    it = written(it.withColumn("k", F.least(F.size("w"), F.lit(words))), "items")
    sizes = sorted(r.k for r in it.select("k").distinct().collect())  # at most ``words`` values
    if not sizes:
        return docs.select("doc_id").limit(0).crossJoin(items.select("item_id").limit(0)).select(
            "doc_id", "item_id", F.lit(0).cast("long").alias("shared"), F.lit(0).cast("long").alias("size"), F.lit(0.0).alias("containment"))

    def by_size(make, keep):
        parts = [make(it.filter(F.col("k") == n), [n], keep) for n in sizes]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    spelled = written(by_size(_spelled, ["item_id"]).distinct(), "item-shingles")
    n_of = spelled.groupBy("item_id").agg(F.count("*").alias("size"))
    # bottom-k sketches, k from the largest size of the part
    hashed = by_size(_hashed, ["item_id"]).distinct()
    part = n_of.withColumn("part", F.floor(F.log2("size")))
    top = part.groupBy("part").agg(F.max("size").alias("top"))
    k = part.join(top, "part").select("item_id", (F.col("top") - F.ceil(F.col("top") * F.lit(threshold) - 1e-9) + 1).alias("k"))
    rank = F.row_number().over(W.partitionBy("item_id").orderBy("h"))
    sketch = written(hashed.withColumn("rank", rank).join(k, "item_id").filter("rank <= k").select("h", "item_id"), "sketch")

    texts = docs.filter("doc_id is not null").select("doc_id", words_of(F.col("text")).alias("w"))
    # one row a hash keeps the probe from growing where many items share a shingle
    probes = _maybe_broadcast(sketch.select("h").distinct())
    hits = _hashed(texts, sizes, ["doc_id"]).join(probes, "h", "left_semi").distinct()
    found = written(hits.join(_maybe_broadcast(sketch), "h").select("doc_id", "item_id").distinct(), "candidates")

    ids = _maybe_broadcast(found.select("doc_id").distinct())
    again = _spelled(texts.join(ids, "doc_id", "left_semi"), sizes, ["doc_id"])
    held = again.join(_maybe_broadcast(spelled.select("s").distinct()), "s", "left_semi").distinct()
    pairs = held.join(_maybe_broadcast(spelled), "s").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))
    share = F.col("shared") / F.col("size")
    return (
        pairs.join(found, ["doc_id", "item_id"], "left_semi").join(_maybe_broadcast(n_of), "item_id")
        .select("doc_id", "item_id", "shared", "size", share.alias("containment"))
        .filter(F.col("shared") >= F.col("size") * F.lit(threshold) - 1e-9)
    )


def decontaminated(docs: DataFrame, items: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` without the rows whose own text contains an item, whatever their ids are.

    Rows without an id are judged too, and rows that share an id each by themselves; null and empty
    texts contain nothing; other columns pass through, whatever their names.
    """
    same = F.unhex(F.md5(F.col("text").cast("string").cast("binary")))  # equal texts are judged once
    bad = written(contained_items(docs.select(same.alias("doc_id"), F.col("text").cast("string").alias("text")), items, words, threshold).select(F.col("doc_id").alias("same")).distinct(), "contaminated")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), same.alias("same"))
    return rows.join(_maybe_broadcast(bad), "same", "left_anti").select("row.*")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contained_items(docs, items)


QUERIES = {"op7_benchmark_decontamination": op7_benchmark_decontamination}

ORACLES = {
    "op7_benchmark_decontamination": r"""
with d as (select doc_id, [x for x in regexp_split_to_array(lower(text), '[^\pL\pN]+') if x <> ''] w
           from documents where doc_id is not null),
i as (select item_id, [x for x in regexp_split_to_array(lower(text), '[^\pL\pN]+') if x <> ''] w
      from benchmark where item_id is not null),
s as (select distinct item_id, least(len(w), 5) k, array_to_string(w[p : p + least(len(w), 5) - 1], ' ') s
      from i, unnest(range(1, len(w) - least(len(w), 5) + 2)) u(p) where len(w) > 0),
n as (select item_id, count(*) size from (select distinct item_id, s from s) group by 1),
t as (select distinct doc_id, k, array_to_string(w[p : p + k - 1], ' ') s
      from (select d.*, k from d, (select distinct k from s)), unnest(range(1, len(w) - k + 2)) u(p)),
c as (select doc_id, item_id, count(*) shared from t join (select distinct item_id, k, s from s) using (k, s) group by 1, 2)
select doc_id, item_id, cast(shared as bigint) shared, cast(size as bigint) size, shared / size containment
from c join n using (item_id) where shared >= size * 0.8 - 1e-9
"""
}
