"""Exact top-k by inner product with norm-bucketed retrieval.

Vectors are dealt into buckets by length, in geometric ranges.  A query with a k-th best score so far
(from a first look at the longest vectors) needs, in a bucket whose longest vector has length L, a cosine of at least
that score / (|query| L).  Where no cosine reaches it the bucket is skipped; where the threshold is
high, vectors are left out by the query's strongest coordinate; elsewhere by length alone.  What is
left is verified by products.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pipetally.llm.shared import few, reach_workers, written

#: Vectors in a bucket, queries in a block (each of these is one row of arrays), and the cosine from which coordinates prune.
BUCKET, BLOCK, BY_COORDINATE = 2048, 512, 0.8
#: Ranges of length to a doubling of it; vectors of one range are dealt into its buckets by a hash of the row.
STEPS = 64
#: Tables of buckets and of query blocks (their numbers and lengths only) up to this many rows are broadcast.
BROADCAST_ROWS = 100_000
#: The first buckets are broadcast up to so many bytes; beyond, each goes to so many tasks.
BROADCAST_BYTES, SALTS = 64 << 20, 16
#: Products up to here are exact in doubles.
_EXACT = 2.0**52


def integer_vectors(rows: DataFrame, vec: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v, norm): floor(scale * x) of each component; rows without an id, a vector or with an odd component are left out."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    d = F.col(vec).cast("array<double>")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), d.alias("d")).filter("vec_id is not null and d is not null and size(d) > 0")
    rows = rows.filter(~F.exists("d", odd)).select("vec_id", F.transform("d", lambda x: F.floor(x * scale)).alias("v"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))


def _blocked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row a block: row numbers, ids and norms, and the components one after another; longest vectors first."""
    held = F.reverse(F.sort_array(F.collect_list(F.struct("norm", "row", "vec_id", "v"))))
    return rows.groupBy(*keys, F.size("v").alias("dim")).agg(held.alias("h")).select(*keys, "dim", "h.row", "h.vec_id", "h.norm", F.flatten("h.v").alias("v"))


def _best(own, scores, rows, ids, k):
    """The k best (score, then smaller id, then row) of one query's candidates, its own row left out: their places' rows, ids and scores."""
    keep = rows != own
    scores, rows, ids = scores[keep], rows[keep], ids[keep]
    if len(ids) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = scores >= least
        scores, rows, ids = scores[keep], rows[keep], ids[keep]
    order = np.lexsort((rows, ids, -scores))[:k]
    return rows[order], ids[order], scores[order]


def search_block(q_rows, q_norms, q, least, rows, ids, norms, x, k):
    """(query row, row, id, score) of the k best of a bucket for each query that they can matter to.

    ``least``: each query's k-th best score so far, or -inf.  ``norms`` fall.
    """
    out = ([], [], [], [])
    top = norms[0]
    if max(q_norms.max(initial=0) * top, 0) < _EXACT:
        q, x = q.astype(np.float64), x.astype(np.float64)
    unit = None
    slack = 1 + 1e-9
    bound = q_norms * top * slack
    full = []
    for i in np.flatnonzero(bound >= least):
        t = least[i] / (q_norms[i] * top) if q_norms[i] > 0 and top > 0 else -1.0
        if t >= BY_COORDINATE:
            if unit is None:
                unit = x / np.maximum(norms, 1e-300)[:, None]
            qi = q[i] / q_norms[i]
            f = int(np.argmax(np.abs(qi)))
            a, t = qi[f], min(t, 1.0) - 1e-9
            wide = np.sqrt(max(0.0, (1 - a * a) * (1 - t * t))) + 1e-9
            lo, hi = (-1.0 if a <= -t else a * t - wide), (1.0 if a >= t else a * t + wide)
            near = np.flatnonzero((unit[:, f] >= lo - 1e-9) & (unit[:, f] <= hi + 1e-9))
            found = _best(q_rows[i], x[near] @ q[i], rows[near], ids[near], k)
            for o, v in zip(out, (np.full(len(found[0]), q_rows[i]), *found)):
                o.append(v)
        else:
            full.append(i)
    if full:
        # by length: the longest prefix that any of these queries needs, in one product
        need = [len(norms) if least[i] <= 0 or q_norms[i] == 0 else int(np.searchsorted(-norms, -least[i] / (q_norms[i] * slack), side="right")) for i in full]
        scores = q[full] @ x[: max(need)].T
        for s, i, n in zip(scores, full, need):
            found = _best(q_rows[i], s[:n], rows[:n], ids[:n], k)
            for o, v in zip(out, (np.full(len(found[0]), q_rows[i]), *found)):
                o.append(v)
    return [np.concatenate(o) if o else np.zeros(0) for o in out]


def _search(pairs: DataFrame, k: int) -> DataFrame:
    """(query, row, vec_id, score) of each pair of a query block and a bucket."""

    def work(frames):
        for frame in frames:
            for r in frame.itertuples(index=False):
                q, x = (np.asarray(v, dtype=np.int64).reshape(-1, int(r.dim)) for v in (r.qv, r.v))
                least = np.array([-np.inf if s is None or s != s else s for s in r.least], dtype=float)
                found = search_block(np.asarray(r.query), np.asarray(r.q_norm, dtype=float), q, least, np.asarray(r.row), np.asarray(r.vec_id), np.asarray(r.norm, dtype=float), x, k)
                yield pd.DataFrame({c: v.astype(np.int64) for c, v in zip(("query", "row", "vec_id", "score"), found)})

    return pairs.mapInPandas(work, "query long, row long, vec_id long, score long")


def _with_first(q: DataFrame, first: DataFrame) -> DataFrame:
    """Query blocks beside the bucket of the longest vectors of their size (a row a size): sent to all tasks if it is small in bytes, else ``SALTS`` times."""
    size = first.agg(F.sum(F.size("v").cast("long") * 8)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return q.join(F.broadcast(first), "dim")
    salted = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return q.withColumn("salt", F.pmod("part", F.lit(SALTS))).join(salted, ["dim", "salt"]).drop("salt")


def top_k(vectors: DataFrame, is_query: Column | str, k: int = 5, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of ``vectors`` (vec_id, v, norm) for each row that ``is_query``.

    A row is not its own result; rows that repeat a vec_id are rows of their own, as queries and as
    results.  Vectors of other sizes than the query's take no part; fewer than k candidates are all
    returned; equal scores rank by the smaller id, then by row; an empty table gives an empty result.
    Which buckets a query block needs is decided on lengths alone; vectors are joined to what is left.
    """
    spark = vectors.sparkSession
    reach_workers(spark)
    is_query = F.expr(is_query) if isinstance(is_query, str) else is_query
    vectors = written(vectors.select("vec_id", "v", "norm", F.coalesce(is_query, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("row")), "vectors")
    dealt = vectors.withColumn("g", F.coalesce(F.floor(F.log2("norm") * STEPS), F.lit(-1_000_000)).cast("int"))
    sizes, before, dealing = dealt.groupBy("g").count().collect(), 0, []  # one row a range of lengths
    for r in sorted(sizes, reverse=True):
        dealing.append((r["g"], max(1, -(-r["count"] // bucket)), before))
        before += dealing[-1][1]
    ranges = F.from_json(F.lit(json.dumps([dict(zip(("g", "n", "at"), r)) for r in dealing])), "array<struct<g: int, n: int, at: int>>")  # a few hundred at most
    dealing = F.broadcast(spark.createDataFrame(dealing, "g int, parts int, first int"))
    dealt = dealt.join(dealing, "g").withColumn("b", (F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts"))).cast("int"))
    blocks = written(_blocked(dealt, ["b"]), "buckets")
    asked = vectors.filter("asks")
    parts = max(1, -(-asked.count() // block))
    # a block's queries are of about one length, so that they need about the same buckets
    buckets = max(1, before)
    part = (F.col("b") * parts / F.lit(buckets)).cast("int") * 1024 + F.pmod(F.xxhash64("row", F.lit(1)), F.lit(max(1, parts // buckets))).cast("int")
    q = _blocked(dealt.filter("asks").withColumn("part", part), ["part"])
    q = written(q.select("part", "dim", F.col("row").alias("query"), F.col("norm").alias("q_norm"), F.col("v").alias("qv")), "queries")

    def best(found: DataFrame) -> DataFrame:
        order = W.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    lengths = written(blocks.select("b", "dim", F.col("norm")[0].alias("top")), "bucket-lengths")
    longest = lengths.groupBy("dim").agg(F.max_by("b", F.struct("top", -F.col("b"))).alias("b"))
    first = written(blocks.join(F.broadcast(longest), ["dim", "b"]).select("dim", "row", "vec_id", "norm", "v"), "first-buckets")
    none = F.transform("query", lambda _: F.lit(None).cast("double"))
    seeds = written(best(_search(_with_first(q, first).withColumn("least", none), k)), "seeds")
    kth = seeds.filter(F.col("rank") == k).select("query", F.col("score").cast("double").alias("s"))
    least = q.select("part", "dim", F.posexplode(F.arrays_zip("query", "q_norm")).alias("p", "z")).select("part", "dim", "p", "z.query", "z.q_norm").join(kth, "query", "left")
    # the shortest length of a bucket's longest vector that any query of the block can need
    reach = F.min(F.when(F.col("s").isNull() | (F.col("s") <= 0) | (F.col("q_norm") == 0), F.lit(0.0)).otherwise(F.col("s") / F.col("q_norm"))).alias("reach")
    least = written(least.groupBy("part", "dim").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "s"))), lambda z: z.s).alias("least"), reach), "query-bounds")
    # ranges of length that reach far enough, their buckets, and of these the ones that do
    from_g = F.floor(F.log2(F.col("reach") * (1 - 1e-9)) * STEPS) - 1
    near = F.filter(ranges, lambda r: (F.col("reach") <= 0) | (r["g"] >= from_g))
    needed = least.select("part", "dim", "reach", F.explode(near).alias("r")).select("part", "dim", "reach", F.explode(F.sequence(F.col("r.at"), F.col("r.at") + F.col("r.n") - 1)).alias("b"))
    needed = needed.join(few(lengths, BROADCAST_ROWS), ["b", "dim"]).filter(F.col("top") * (1 + 1e-9) >= F.col("reach")).select("part", "dim", "b")
    pairs = needed.join(q.join(least.drop("reach"), ["part", "dim"]), ["part", "dim"]).join(blocks, ["b", "dim"])
    pairs = pairs.select("part", "b", "dim", "query", "q_norm", "qv", "least", "row", "vec_id", "norm", "v").repartition(spark.sparkContext.defaultParallelism * 2, "part", "b")
    ids = asked.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    return best(_search(pairs, k)).join(few(ids, BROADCAST_ROWS), "query").select("query_id", "rank", "vec_id", "score")


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


QUERIES = {"op6_exact_top_k": op6_exact_top_k}

ORACLES = {
    "op6_exact_top_k": """
with v as (select row_number() over () "row", vec_id, [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] v from embeddings
  where vec_id is not null and len(embedding) > 0
    and len([1 for x in embedding if x is null or isnan(x) or isinf(x)]) = 0),
s as (select q."row" q, q.vec_id query_id, c."row", c.vec_id, cast(list_sum([z[1] * z[2] for z in list_zip(q.v, c.v)]) as bigint) score
      from v q join v c on q.vec_id % 50 = 0 and q."row" <> c."row" and len(q.v) = len(c.v)),
r as (select *, row_number() over (partition by q order by score desc, vec_id) rank from s)
select query_id, cast(rank as int) rank, vec_id, score from r where rank <= 5
"""
}
