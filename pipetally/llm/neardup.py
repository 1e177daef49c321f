"""Near-duplicate removal: SimHash classes first, then what no fingerprint shows, on word shingles.

The pipeline's stage.  Texts whose SimHash fingerprints link (those of ``simhash``: 3-word shingles, 2 or
fewer differing bits, by covering masks) are near copies, and so are those with a Jaccard similarity of 0.8
or more of their sets of five-word shingles.  No SimHash radius follows from the latter, so an exact filter
comes after the fingerprints, for pairs of texts that these leave apart: under one order of all shingles, two
sets of n and m shingles that are similar enough share one among the first n - ceil(0.8 n) + 1 of the one and
m - ceil(0.8 m) + 1 of the other.  Any order gives every pair; shingles that are common in a sample come
last, so that few buckets are large.

A text is a class of equal rows and has a number, its ``node``; rows are found again by a digest of
their text, so that ids, which may repeat or be missing, decide only which row of a class stays.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipetally.llm.components import connected_components
from pipetally.llm.shared import few, freed, pieces, reach_workers, scratch, small_enough, written
from pipetally.llm.simhash import fingerprint, linked_fingerprints

WORDS, SIMILARITY = 5, 0.8
#: Words of a shingle of the SimHash fingerprints.
HASHED_WORDS = 3
#: Guard against rounding: a prefix may be longer than needed, never shorter.
ROUND = 1e-9
#: Bits of the parity sketch of a set of up to so many shingles; a larger set has a power of two that is no less than its size.
SKETCH = 1024
#: The order only: shingles of so many sampled texts are common; texts sampled at least, and their least share; most common shingles.
COMMON, SAMPLE, SHARE, MOST = 3, 8000, 1 / 32, 30_000
#: Buckets of up to so many texts are paired in SQL; larger ones are compared in blocks of about so many, or of so many shingles.
FULL, BLOCK, BLOCK_SHINGLES = 16, 1024, 1 << 20
#: Buckets of more texts than this are dealt into blocks, so many times, before what is left is compared in full.
DENSE, ROUNDS = 256, 2
#: Texts that a worker remembers to skip their repeats; tables of so many nodes are broadcast, and of so many with their sketches.
SEEN, BROADCAST_ROWS, BROADCAST_SKETCHES = 200_000, 200_000, 20_000
_WORD = re.compile(r"\w+")
_ODD = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)]


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct hashes, sorted, of the shingles of a whole text; all its words are one, if it has fewer."""
    found = _WORD.findall((text or "").lower())
    if not found:
        return np.zeros(0, dtype=np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=np.uint64, count=len(found))
    k = min(words, len(h))
    m = len(h) - k + 1
    z = np.full(m, k, dtype=np.uint64)
    for i in range(k):  # a word's factor depends on its place
        z *= _ODD[i % 5]
        z += h[i : i + m]
    for shift, odd in ((32, _ODD[1]), (29, _ODD[2]), (32, _ODD[0])):
        z ^= z >> np.uint64(shift)
        z *= odd
    z = np.sort(z.view(np.int64))
    return z[np.concatenate(([True], z[1:] != z[:-1]))]


def prefix_of(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a sorted set: those not in ``common`` (sorted) by hash, then the others by their ``counts``."""
    n = len(hashes)
    if not n:
        return hashes
    most = n - math.ceil(n * SIMILARITY - ROUND) + 1
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        rank = np.where(common[at] == hashes, counts[at], 0)
        if rank.any():
            return hashes[np.lexsort((hashes, rank))][:most]
    return hashes[:most]


def sketch_of(hashes: np.ndarray) -> bytes:
    """The parity of the number of shingles at each place: sets differ in no fewer shingles than sketches in bits."""
    bits = max(SKETCH, 1 << (len(hashes) - 1).bit_length()) if len(hashes) else SKETCH
    at = (hashes.view(np.uint64) >> np.uint64(20)) & np.uint64(bits - 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """A sketch (of 64-bit words) as one of fewer places: halves are put on one another."""
    while len(sketch) > words:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def may_be_similar(n: int, a: bytes, m: int, b: bytes) -> bool:
    """Whether sizes and sketches of two sets allow the similarity.

    Sets of n and m shingles with the similarity s differ in at most (n + m) (1 - s) / (1 + s) of them,
    and so their sketches do.
    """
    x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
    least = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, least) ^ folded(y, least)).sum(dtype=np.int64)) <= (n + m) * ((1 - SIMILARITY) / (1 + SIMILARITY)) + ROUND


def _digest(text: str = "text") -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, same, text) of every row: ``same`` is equal for equal texts, and null is an empty text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("same"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _arrays(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else np.zeros(0, dtype=np.int64), pa.int64()))


def _hashed(rows: DataFrame) -> DataFrame:
    """``rows`` (one column and ``text``) with the array ``s`` of the shingle hashes in place of the text."""
    name, kind = rows.dtypes[0]

    def work(batches):
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), _arrays([shingle_hashes(t) for t in b.column(1).to_pylist()])], names=[name, "s"])

    return rows.mapInArrow(work, f"{name} {kind}, s array<bigint>")


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that are common in a sample of the distinct texts, sorted, and their counts; they only set the order."""
    rows = _keyed(docs)
    share = max(SHARE, SAMPLE / max(docs.count(), 1))
    some = rows.filter(F.pmod(F.xxhash64(F.lit(3), "same"), F.lit(1_000_000)) < int(1_000_000 * share) + 1).dropDuplicates(["same"])
    seen = _hashed(some.select("same", "text")).select(F.explode("s").alias("h")).groupBy("h").count()
    got = sorted((r["h"], r["count"]) for r in seen.filter(F.col("count") >= COMMON).orderBy(F.desc("count"), "h").limit(MOST).collect())
    return np.array([h for h, _ in got], dtype=np.int64), np.array([c for _, c in got], dtype=np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    """(same, id, fp, size, first, sketch, node) of every different text: its least doc_id, its SimHash fingerprint, the
    number of its shingles, the first of them, and their sketch."""
    held = docs.sparkSession.sparkContext.broadcast(common_shingles(docs))  # at most MOST of them

    def work(batches):
        common, counts = held.value
        seen: set[bytes] = set()
        for b in pieces(batches):
            # a text that this task has met already is passed on without its shingles
            new = []
            for s in b.column(1).to_pylist():
                new.append(s not in seen)
                seen.add(s)
            if len(seen) > SEEN:
                seen.clear()
            whole = [t.as_py() if n else None for t, n in zip(b.column(2), new)]
            sets = [shingle_hashes(t) if t is not None else None for t in whole]
            first = [prefix_of(s, common, counts).tolist() if s is not None else None for s in sets]
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(1), pa.array([None if t is None else fingerprint(t, HASHED_WORDS) for t in whole], pa.int64()),
                pa.array([None if s is None else len(s) for s in sets], pa.int64()), pa.array(first, pa.list_(pa.int64())),
                pa.array([None if s is None else sketch_of(s) for s in sets], pa.binary()),
            ], names=["doc_id", "same", "fp", "size", "first", "sketch"])

    rows = _keyed(docs).mapInArrow(work, "doc_id long, same binary, fp long, size long, first array<bigint>, sketch binary")
    one = lambda c: F.first(c, ignorenulls=True).alias(c)
    texts = rows.groupBy("same").agg(F.min("doc_id").alias("id"), one("fp"), one("size"), one("first"), one("sketch"))
    return written(texts.withColumn("node", F.monotonically_increasing_id()), "dup-texts")


def simhash_links(texts: DataFrame) -> DataFrame:
    """(a, b): each of the ``texts`` (node, fp) with the least text of its SimHash class, all that fingerprints of 2 or fewer differing bits reach."""
    nodes = written(texts.groupBy("fp").agg(F.min("node").alias("a"), F.count("*").alias("n")), "dup-fingerprints")
    found = written(linked_fingerprints(nodes.select("fp")), "dup-linked")
    classes = found.join(nodes, "fp").groupBy("component").agg(F.min("a").alias("a"), F.sum("n").alias("n")).filter("n > 1").select("component", "a")
    near = written(found.join(few(written(classes, "dup-simhash"), BROADCAST_ROWS), "component").select("fp", "a"), "dup-named")
    return written(texts.select("fp", F.col("node").alias("b")).join(few(near, BROADCAST_ROWS), "fp").filter("a <> b").select("a", "b"), "dup-links")


def _apart(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """The pairs (a, b) that the stars ``links`` (least text, text) do not hold together already."""
    links = few(links, BROADCAST_ROWS)
    for x in "ab":
        pairs = pairs.join(links.select(F.col("b").alias(x), F.col("a").alias(f"c{x}")), x, "left")
    return pairs.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _close(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow the similarity."""
    for x in "ab":
        side = texts.select(F.col("node").alias(x), F.col("size").alias(f"n{x}"))
        pairs = pairs.join(F.broadcast(side) if small_enough(texts, BROADCAST_ROWS) else side, x)
    pairs = written(pairs.filter(F.least("na", "nb") >= SIMILARITY * F.greatest("na", "nb") - ROUND), "dup-sized")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    held = written(texts.select("node", "sketch").join(few(ids, BROADCAST_ROWS), "node", "left_semi"), "dup-sketches")
    for x in "ab":
        pairs = pairs.join(few(held.select(F.col("node").alias(x), F.col("sketch").alias(f"s{x}")), BROADCAST_SKETCHES), x)

    def work(batches):
        for b in pieces(batches):
            rows = zip(*(b.column(c).to_pylist() for c in ("a", "b", "na", "sa", "nb", "sb")))
            got = [(x, y) for x, y, n, p, m, q in rows if may_be_similar(n, p, m, q)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.int64()), pa.array([y for _, y in got], pa.int64())], names=["a", "b"])

    return pairs.select("a", "b", "na", "sa", "nb", "sb").mapInArrow(work, "a long, b long")


def _sets(docs: DataFrame, ids: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, s) of the texts ``ids``: their shingle hashes."""
    ids = written(texts.select("node", "same").join(few(ids, BROADCAST_ROWS), "node", "left_semi"), "dup-near")
    rows = _keyed(docs).join(few(ids, BROADCAST_ROWS), "same").dropDuplicates(["node"]).select("node", "text")
    return freed(written(_hashed(rows), "dup-shingles"))


def _similar(docs: DataFrame, pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts' shingles are similar enough."""
    with scratch(docs.sparkSession):  # the sets are large, and no one else's
        sets = _sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), texts)
        a, b = (sets.select(F.col("node").alias(x), F.col("s").alias(f"s{x}")) for x in "ab")
        # the small list of pairs goes to the sets; of the other side only what is in a pair is moved
        a = a.join(few(pairs.select("a").distinct(), BROADCAST_ROWS), "a", "left_semi")
        both = F.size(F.array_intersect("sa", "sb"))
        like = both / (F.size("sa") + F.size("sb") - both)
        found = b.join(few(pairs, BROADCAST_ROWS), "b").join(a, "a").filter(like >= SIMILARITY - ROUND).select("a", "b")
        return freed(written(found, "dup-links", keep=True))


def text_classes(docs: DataFrame) -> DataFrame:
    """(same, id, class): every different text that is not alone, its least doc_id, and its class of near copies.

    SimHash classes are whole from the start.  In every bucket then the least text is compared with those of other
    classes.  Where a large bucket is then left
    with several classes, each of its texts goes with its shingles to one block of one such bucket, and
    blocks join what is similar there; dealt twice, they leave few classes of a large group.  Where a bucket still
    has several, texts of different ones are compared: as pairs in small buckets, inside tasks and in
    blocks of bounded size in larger ones, so that only candidates leave a block.  No similar pair of
    different classes is missed.  Texts without words are copies only if
    their fingerprints link.
    """
    reach_workers(docs.sparkSession)
    texts = _texts(docs)
    links = simhash_links(texts)
    spread = texts.select("node", F.explode("first").alias("key"))
    met = written(spread.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("a"), F.max("node").alias("b")).filter("n > 1"), "dup-buckets")
    # a bucket of two is its two ends; the others are joined back to their texts
    more = met.filter("n > 2").select("key", "n")
    held = written(spread.join(few(more, BROADCAST_ROWS), "key"), "dup-held")
    # buckets of the same texts (every shingle of a shared passage) are one
    marks = [F.expr(f"bit_xor(xxhash64({i}, node))").alias(f"m{i}") for i in range(2)]
    one = held.groupBy("key", "n").agg(F.min("node").alias("a"), *marks).groupBy("n", "a", "m0", "m1").agg(F.min("key").alias("key")).select("key", "a")
    held = freed(written(held.join(few(one, BROADCAST_ROWS), "key"), "dup-distinct"))
    pairs = met.filter("n = 2").select("a", "b").unionByName(held.filter("node <> a").select("a", F.col("node").alias("b"))).distinct()
    links = links.unionByName(_similar(docs, written(_close(_apart(pairs, links), texts), "dup-pairs"), texts))
    links = _inside_one_bucket(docs, texts, held, links)
    links = links.unionByName(_between_classes(docs, texts, held, links))
    classes = connected_components(links)
    ends = classes.select(F.explode(F.array("node", "component")).alias("node")).distinct().join(classes, "node", "left")
    return texts.select("same", "id", "node").join(few(ends.select("node", F.coalesce("component", "node").alias("class")), BROADCAST_ROWS), "node").select("same", "id", "class")


def _open(held: DataFrame, links: DataFrame) -> DataFrame:
    """(key, n, node, c) of the buckets ``held`` whose texts ``links`` leave in several classes c."""
    now = held.select("key", "n", "node").join(few(connected_components(links), BROADCAST_ROWS), "node", "left")
    now = written(now.select("key", "n", "node", F.coalesce("component", "node").alias("c")), "dup-now")
    mixed = now.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("key")
    return written(now.join(few(mixed, BROADCAST_ROWS), "key", "left_semi"), "dup-open")


def _met_in_blocks(rows: DataFrame, blocks: Column) -> DataFrame:
    """``rows`` (key, node, ...) once for each pair of blocks (``lo``, ``hi``) of their bucket in which they are; ``own`` is their block."""
    rows = rows.withColumn("blocks", blocks.cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})


def block_links(ids: np.ndarray, classes: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of similar texts of one block that join their classes: fewer than there are classes."""
    sizes = np.array([len(s) for s in sets])
    short = np.stack([folded(np.frombuffer(sketch_of(s), dtype=np.uint64), SKETCH // 64) for s in sets])
    label = np.unique(classes, return_inverse=True)[1]
    out = []
    for i in range(len(ids)):
        j = np.arange(i + 1, len(ids))
        j = j[(label[j] != label[i]) & (np.minimum(sizes[i], sizes[j]) >= SIMILARITY * np.maximum(sizes[i], sizes[j]) - ROUND)]
        differ = np.bitwise_count(short[j] ^ short[i]).sum(axis=1, dtype=np.int64)
        for k in j[differ <= (sizes[i] + sizes[j]) * ((1 - SIMILARITY) / (1 + SIMILARITY)) + ROUND].tolist():
            if label[k] != label[i]:
                both = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
                if both >= SIMILARITY * (sizes[i] + sizes[k] - both) - ROUND:
                    out.append((min(int(ids[i]), int(ids[k])), max(int(ids[i]), int(ids[k]))))
                    label[label == label[k]] = label[i]
    return out


def _inside_one_bucket(docs: DataFrame, texts: DataFrame, held: DataFrame, links: DataFrame) -> DataFrame:
    """``links`` and such that join the classes of similar texts in one large bucket of each text, the least that is left open.

    A bucket is dealt into blocks by a hash, so each text, with its shingles, goes to one task once; what
    a block joins, other blocks join with it when all are dealt again.  What is left is for the exact comparison.
    """
    for seed in range(ROUNDS):
        with scratch(docs.sparkSession):
            found = _dealt_once(docs, texts, held, links, seed)
        if found is None:
            break
        links = links.unionByName(freed(found))
    return links


def _dealt_once(docs: DataFrame, texts: DataFrame, held: DataFrame, links: DataFrame, seed: int) -> DataFrame | None:
    """The links (a, b) of one round of ``_inside_one_bucket``; None if no bucket is left."""
    now = _open(held.filter(F.col("n") > DENSE), links)
    one = written(now.groupBy("node", "c").agg(F.min("key").alias("key")), "dup-one")
    some = one.groupBy("key").agg(F.countDistinct("c").alias("k")).filter("k > 1").select("key")
    one = written(one.join(few(some, BROADCAST_ROWS), "key", "left_semi"), "dup-chosen")
    if small_enough(one, 0):
        return None
    sized = one.join(texts.select("node", "size"), "node").groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("all"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("all") / BLOCK_SHINGLES)).cast("int")
    chosen = one.join(few(written(sized, "dup-sums"), BROADCAST_ROWS), "key").select("key", "node", "c", F.pmod(F.xxhash64(F.lit(seed), "node"), blocks).alias("own"))
    rows = _sets(docs, one.select("node"), texts).join(few(chosen, BROADCAST_ROWS), "node")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        got = block_links(group["node"].to_numpy(), group["c"].to_numpy(), [np.asarray(s) for s in group["s"]])
        return pd.DataFrame(got, columns=["a", "b"], dtype="int64")

    return written(rows.groupBy("key", "own").applyInPandas(compare, "a long, b long"), "dup-links", keep=True)


def block_pairs(ids: np.ndarray, classes: np.ndarray, sides: np.ndarray, sizes: np.ndarray, sketches: list[bytes], keys: list, key: int) -> list[tuple[int, int]]:
    """Pairs of texts of different classes, of one block (sides all 0) or of two (0 and 1), whose sizes and sketches allow the similarity.

    ``keys``: the sorted buckets of each text; a pair is of the first bucket that both are in, and left out in the others.
    """
    held: dict[int, frozenset] = {}
    two = sides.any()
    left, right = (np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)) if two else (np.arange(len(ids)),) * 2
    short = np.stack([folded(np.frombuffer(s, dtype=np.uint64), SKETCH // 64) for s in sketches])
    out = []
    for i in left.tolist():
        j = right if two else right[i + 1 :]
        n, m = sizes[i], sizes[j]
        j = j[(classes[j] != classes[i]) & (np.minimum(n, m) >= SIMILARITY * np.maximum(n, m) - ROUND)]
        if len(j):
            differ = np.bitwise_count(short[j] ^ short[i]).sum(axis=1, dtype=np.int64)
            j = j[differ <= (n + sizes[j]) * ((1 - SIMILARITY) / (1 + SIMILARITY)) + ROUND].tolist()
            for k in j:
                if k not in held:
                    held[k] = frozenset(keys[k])
            j = [k for k in j if next(h for h in keys[i] if h in held[k]) == key and may_be_similar(int(n), sketches[i], int(sizes[k]), sketches[k])]
            out += [(min(int(ids[i]), int(ids[k])), max(int(ids[i]), int(ids[k]))) for k in j]
    return out


def _between_classes(docs: DataFrame, texts: DataFrame, held: DataFrame, links: DataFrame) -> DataFrame:
    """Links (a, b) between texts of one bucket (``held``: key, n, node) that ``links`` leave in two classes."""
    now = _open(held, links)
    x, y = (now.filter(F.col("n") <= FULL).select("key", F.col("node").alias(v), F.col("c").alias(f"c{v}")) for v in "ab")
    pairs = _close(x.join(y, "key").filter("a < b and ca <> cb").select("a", "b").distinct(), texts)
    large = now.filter(F.col("n") > FULL)
    if not small_enough(large, 0):
        pairs = pairs.unionByName(_block_pairs(large, texts)).distinct()
    return _similar(docs, written(pairs, "dup-pairs"), texts)


def _block_pairs(large: DataFrame, texts: DataFrame) -> DataFrame:
    """Candidates (a, b) of different classes in the buckets ``large`` (key, n, node, c), compared in blocks."""
    nodes = written(large.groupBy("node").agg(F.sort_array(F.collect_list("key")).alias("keys")), "dup-keys")
    held = written(texts.select("node", "size", "sketch").join(few(nodes, BROADCAST_SKETCHES), "node"), "dup-compared")
    rows = _met_in_blocks(large.join(few(held, BROADCAST_SKETCHES), "node"), F.ceil(F.col("n") / BLOCK))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        sides = (group["own"] != group["lo"]).to_numpy().astype(int)
        got = block_pairs(group["node"].to_numpy(), group["c"].to_numpy(), sides, group["size"].to_numpy(), group["sketch"].tolist(), [k.tolist() for k in group["keys"]], int(group["key"].iloc[0]))
        return pd.DataFrame(got, columns=["a", "b"], dtype="int64")

    return rows.groupBy("key", "lo", "hi").applyInPandas(compare, "a long, b long")


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each class of equal or near texts: that of the least doc_id, and of the least text where ids repeat.

    Classes are of texts, so rows that share an id with a copy stay if their own text is no copy.  Null
    and empty texts are one class; a row without an id stays only where its whole class has none (then
    one of them does); rows that repeat both stay once; other columns pass through; an empty table
    gives an empty result.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("same"))
    with scratch(docs.sparkSession):
        near = written(text_classes(docs), "dup-classes", keep=True)
    best = F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("same")))
    stays = near.groupBy("class").agg(best.alias("b")).select(F.col("b.same").alias("same"), F.lit(True).alias("stays"))
    near = near.select("same", F.lit(True).alias("near")).join(stays, "same", "left")
    # texts of one row that are near nothing need no decision
    rows = keyed.groupBy("same").agg(F.count("*").alias("n"), F.min("doc_id").alias("id")).join(near, "same", "left").filter("n > 1 or near")
    rows = written(rows.select("same", "n", "id", (F.col("near").isNotNull() & F.col("stays").isNull()).alias("goes")), "dup-verdicts")
    # a row travels as one value, so that no name of its columns can clash
    rowed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("same"))
    marked = rowed.join(few(rows.select("same", "id", "goes"), BROADCAST_ROWS), "same", "left")
    left = marked.filter(F.col("goes").isNull() | (~F.col("goes") & F.col("doc_id").eqNullSafe(F.col("id"))))
    # of rows that repeat a text and its least id, one stays
    again = keyed.join(few(rows.filter("n > 1 and not goes").select("same", "id"), BROADCAST_ROWS), "same").filter(F.col("doc_id").eqNullSafe(F.col("id")))
    again = written(again.groupBy("same").agg(F.count("*").alias("k")).filter("k > 1").select("same"), "dup-repeats")
    if small_enough(again, 0):
        return left.select("row.*")
    again = few(again, BROADCAST_ROWS)
    once = left.join(again, "same", "left_semi").dropDuplicates(["same"])
    return left.join(again, "same", "left_anti").select("row.*").unionByName(once.select("row.*"))
