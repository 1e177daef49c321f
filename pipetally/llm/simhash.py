"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position i gets a vector m(i) of radius + 1 bits, and every non-zero vector v of that
size gives a mask that keeps the positions with odd <m(i), v>.  For radius or fewer positions
there is a v orthogonal to all of them, so two fingerprints that differ only there agree under
that mask: a pair within the radius always meets in one of 2^(radius+1) - 1 tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pipetally.llm.components import connected_components
from pipetally.llm.shared import pieces, reach_workers, small_enough, written

BITS = 64
#: A node table of at most this many rows (16 bytes each) may be broadcast.
BROADCAST_ROWS = 200_000


def covering_masks(radius: int) -> list[int]:
    """The masks as signed 64-bit integers."""
    n = (1 << (radius + 1)) - 1
    masks = []
    for v in range(1, n + 1):
        mask = sum(1 << i for i in range(BITS) if bin((i % n + 1) & v).count("1") % 2)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BYTE_AT = (np.arange(8) * 256)[None, :]


def fingerprint(text: str | None, words: int) -> int:
    """The 64-bit SimHash (as a signed integer) of the ``words``-word shingles of a whole text."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not w:
        return 0
    line, k = b" ".join(w), min(words, len(w))
    ends = np.cumsum([len(x) + 1 for x in w])
    starts = np.concatenate(([0], ends[: len(w) - k])).tolist()
    f = xxhash.xxh64_intdigest
    h = np.array([f(line[a:b], 42) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist())], dtype=np.uint64)
    at = h.view(np.uint8).reshape(-1, 8) + _BYTE_AT
    seen = np.bincount(at.ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
    return int(np.packbits((seen.ravel() * 2 > len(h)).astype(np.uint8), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 3, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and ``fp`` (bigint) of every row; a text without words, or null, has 0."""
    reach_workers(docs.sparkSession)
    wanted = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = wanted.drop("__text").withColumn("fp", F.lit(0).cast("bigint")).schema
    names = schema.names

    def work(batches):
        for b in pieces(batches):
            fp = pa.array([fingerprint(t, words) for t in b.column(b.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], fp], names=names)

    return wanted.mapInArrow(work, schema)


def tables(rows: DataFrame, radius: int, fp: str = "fp") -> DataFrame:
    """``rows`` once for each mask, with ``t`` (the table) and ``key`` (the fingerprint under its mask)."""
    keys = [F.struct(F.lit(t).alias("t"), F.col(fp).bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(covering_masks(radius))]
    return rows.withColumn("__k", F.explode(F.array(*keys))).select("*", "__k.t", "__k.key").drop("__k")


def _ball() -> Column:
    """The 65 fingerprints at distance 1 or less."""
    return F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << i) - ((1 << 64) if i == 63 else 0))) for i in range(BITS)])


def linked_fingerprints(fps: DataFrame) -> DataFrame:
    """(fp, component) of distinct fingerprints ``fp`` under links of 2 or fewer differing bits.

    Covering tables of radius 2 leave only fingerprints that share a bucket with another.  Those are
    not paired, as a bucket may hold thousands: fingerprints x and y differ in 2 bits or fewer
    exactly if some z is within 1 bit of both, so each candidate is sent to its 65 neighbours z, where
    at most 65 meet and are linked in a chain to the least.  This is exact for every bucket size.
    """
    spread = tables(fps, 2)
    shared = spread.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("fp"), F.max("fp").alias("top")).filter("n > 1")
    shared = written(shared, "buckets")
    # a bucket of two is its least and its greatest member; the others are joined back
    two = shared.filter("n = 2").select(F.explode(F.array("fp", "top")).alias("fp"))
    more = shared.filter("n > 2").select("t", "key")
    many = spread.join(F.broadcast(more) if small_enough(more, BROADCAST_ROWS) else more, ["t", "key"], "left_semi").select("fp")
    near = two.unionByName(many).distinct().withColumn("z", F.explode(_ball()))
    met = near.groupBy("z").agg(F.collect_list("fp").alias("all"), F.min("fp").alias("a")).filter(F.size("all") > 1)
    edges = met.select("a", F.explode("all").alias("b")).filter("a <> b").distinct()
    found = connected_components(edges)
    return fps.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))


def near_duplicate_classes(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): every row's fingerprint and the least doc_id reachable by links of
    2 or fewer differing bits.

    Null and empty texts have fingerprint 0 and are linked like any other; equal fingerprints (ties,
    repeated rows) always share a component; a null doc_id takes part but never names a component
    unless all of it is null; other columns are not looked at; an empty table gives an empty result.
    """
    fp = written(fingerprints(docs, words), "fingerprints")
    nodes = fp.groupBy("fp").agg(F.min("doc_id").alias("least"))
    linked = written(linked_fingerprints(nodes.select("fp")).join(nodes, "fp"), "linked")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    named = linked.join(least, "component").select("fp", "component_id")
    return fp.join(named, "fp").select("doc_id", "fp", "component_id")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicate_classes(docs, words=3).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op8_simhash_near_dedup": op8_simhash_near_dedup}
