"""Phrase collocation mining: exact counts of frequent word n-grams, found by PCY/DHP passes, and their scores.

Pass L reads all texts, counts the L-grams that can still be frequent, and at the same time counts the
(L + 1)-grams by the bucket that their hash falls into (DHP).  A bucket below the threshold holds no frequent
phrase.  Before the next pass counts anything exactly, two bitmaps of a fixed size are sent to the tasks:
the full enough buckets, and the frequent L-grams by hash, which both ends of an (L + 1)-gram must be among
(Apriori).  Bitmaps only ever let too much through, so they change the work and never a count.

Bucket counts stop at the threshold, so they fit a byte; a task sends those that are not 0, in chunks of
``CHUNK`` buckets, and each chunk is added up by one task.  Exact counts are combined in the tasks and
then by Spark.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pipetally.llm.shared import pieces, reach_workers, written

#: The threshold, the longest phrase in words, the share of a phrase that a longer one must reach to stand for it (percent), and how many a language gives.
LEAST, LONGEST, COVERED, TOP = 10, 3, 50, 2000
#: Buckets are 2 ** this many: one to about 8 bytes of text, between these bounds (a bitmap of 16 MB at most).
FEWEST_BITS, MOST_BITS = 16, 27
CHUNK = 1 << 15
#: A task gives out its counts when it has met so many words, or holds so many different ones.
WORDS, VOCABULARY = 4_000_000, 1_000_000

#: Breaks become newlines, tabs blanks, and A-Z lower case, byte by byte: no byte of a longer UTF-8 letter is touched.
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\x0d\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
_BREAK = b"."  # as a word: no word holds a full stop

_U = np.uint64
KINDS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64()), ("chunk", pa.int32()), ("at", pa.binary()), ("counts", pa.binary())])
SQL_KINDS = "lang string, phrase string, n long, chunk int, at binary, counts binary"


def words_and_breaks(text: str) -> list[bytes]:
    """The words of a text in order, with a break between the last word of a piece and the first of the next.

    Vertical tabs, form feeds, carriage returns and newlines part pieces; words are parted by blanks and tabs alone.
    """
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).replace(b"\n", b" . ").split()


class _Vocabulary(dict):
    """Numbers for the words of one language in one task, and their hashes; 0 is the break."""

    def __init__(self, lang: str):
        super().__init__({_BREAK: 0})
        self.seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))
        self.words, self.hashes = [_BREAK], array("Q", [0])

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        self.hashes.append(xxhash.xxh3_64_intdigest(word, self.seed))
        return n


def _mixed(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The hash of a phrase from that of its first words and that of its last word."""
    with np.errstate(over="ignore"):
        x = (h ^ (h >> _U(29))) * _U(0x9E3779B97F4A7C15) + g
        x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
        return x ^ (x >> _U(32))


def _slots(h: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((h * _U(0xFF51AFD7ED558CCD)) >> _U(64 - bits)).astype(np.uint32)


def _in(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bitmap[slots >> np.uint32(3)] >> (slots & np.uint32(7)).astype(np.uint8)) & np.uint8(1) != 0


def _hashed(h: np.ndarray, length: int) -> list[np.ndarray]:
    """Hashes of the phrases of 1 to ``length`` words that start at each place."""
    out = [h]
    for k in range(1, length):
        out.append(_mixed(out[-1][: len(h) - k], h[k:]))
    return out


def bucket_rows(slots: np.ndarray, least: int) -> Iterator[dict]:
    """Counts of ``slots``, up to ``least``: a row a chunk of buckets with any."""
    slots = np.sort(slots)
    starts = np.flatnonzero(np.r_[True, slots[1:] != slots[:-1]]) if len(slots) else np.zeros(0, dtype=np.int64)
    counts = np.minimum(np.diff(np.r_[starts, len(slots)]), least).astype(np.uint8)
    slots = slots[starts]
    chunk = slots // CHUNK
    edges = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1], True]) if len(slots) else []
    for a, b in zip(edges[:-1], edges[1:]):
        yield {"chunk": int(chunk[a]), "at": (slots[a:b] % CHUNK).astype("<u2").tobytes(), "counts": counts[a:b].tobytes()}


def _distinct(ids: np.ndarray, size: int, step: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The different rows of ``ids`` (numbers below ``size``) and their counts, some at a time."""
    width = ids.shape[1]
    if size**width < 1 << 62:
        key = ids[:, 0].copy()
        for k in range(1, width):
            key = key * size + ids[:, k]
        key, counts = np.unique(key, return_counts=True)
        for at in range(0, len(key), step):
            rest, cols = key[at : at + step], []
            for _ in range(width):
                cols.append(rest % size)
                rest = rest // size
            yield np.stack(cols[::-1], axis=1), counts[at : at + step]
    else:
        some, counts = np.unique(ids, axis=0, return_counts=True)
        for at in range(0, len(some), step):
            yield some[at : at + step], counts[at : at + step]


class _Pass:
    """What one task counts in pass ``length``."""

    def __init__(self, length: int, longest: int, least: int, bits: int, known: np.ndarray | None, full: np.ndarray | None):
        self.length, self.next, self.least, self.bits = length, length < longest, least, bits
        self.known, self.full = known, full
        self.clear()

    def clear(self) -> None:
        self.langs: dict[str, _Vocabulary] = {}
        self.met: dict[str, list[np.ndarray]] = {}
        self.buckets: list[np.ndarray] = []
        self.words = 0

    def add(self, lang: str, words: list[bytes]) -> None:
        vocabulary = self.langs.get(lang)
        if vocabulary is None:
            vocabulary = self.langs[lang] = _Vocabulary(lang)
        ids = np.fromiter(map(vocabulary.__getitem__, words), dtype=np.int64, count=len(words))
        self.words += len(ids)
        if self.length == 1 and not self.next:
            self.met.setdefault(lang, []).append(ids[ids > 0].reshape(-1, 1))
            return
        hashes = np.frombuffer(vocabulary.hashes, dtype=np.uint64)[ids]
        grams = _hashed(hashes, self.length + 1 if self.next else self.length)
        real, length = ids > 0, self.length
        whole = real
        for k in range(1, length):
            whole = whole[:-1] & real[k:]
        if length > 1:
            part = _in(self.known, _slots(grams[length - 2], self.bits))  # the first and the last length - 1 words
            own = np.flatnonzero(whole & part[:-1])
            own = own[self._ends(hashes, own)]
            own = own[_in(self.full, _slots(grams[length - 1][own], self.bits))]
            keep = np.zeros(len(whole), dtype=bool)
            keep[own] = True
        else:
            keep, own = whole, np.flatnonzero(whole)
        self.met.setdefault(lang, []).append(ids[own[:, None] + np.arange(length)])
        if self.next:
            both = np.flatnonzero(keep[:-1] & keep[1:])
            self.buckets.append(_slots(grams[length][both], self.bits))

    def _ends(self, hashes: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Which of the phrases at ``own`` end in a known one."""
        g = hashes[own + 1]
        for k in range(2, self.length):
            g = _mixed(g, hashes[own + k])
        return _in(self.known, _slots(g, self.bits))

    def rows(self) -> Iterator[dict]:
        for lang in list(self.met):
            ids, words = np.concatenate(self.met.pop(lang)), self.langs[lang].words
            for some, counts in _distinct(ids, len(words)):
                for g, n in zip(some.tolist(), counts.tolist()):
                    yield {"lang": lang, "phrase": b" ".join([words[i] for i in g]).decode("utf-8", "surrogatepass"), "n": n}
        if self.buckets:
            slots = np.concatenate(self.buckets)
            self.buckets.clear()
            yield from bucket_rows(slots, self.least)
        self.clear()

    def crowded(self) -> bool:
        return self.words >= WORDS or sum(map(len, self.langs.values())) >= VOCABULARY


def _batched(rows: Iterable[dict]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 64 + len(r.get("at") or b"")
        if len(held) >= 20_000 or size > 4 << 20:
            yield pa.RecordBatch.from_pylist(held, schema=KINDS)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=KINDS)


def _counted(texts: DataFrame, length: int, longest: int, least: int, bits: int, known, full) -> DataFrame:
    """One pass over ``texts`` (lang, text): rows of exact counts (lang, phrase, n), not yet added up, and of buckets (chunk, at, counts)."""

    def work(batches):
        task = _Pass(length, longest, least, bits, *(None if b is None else np.frombuffer(b.value, dtype=np.uint8) for b in (known, full)))
        for b in pieces(batches):
            held: dict[str, list[bytes]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                words = words_and_breaks(text.as_py())
                if words:
                    held.setdefault(lang, []).extend(words)
                    held[lang].append(_BREAK)
            for lang, words in held.items():
                task.add(lang, words)
            if task.crowded():
                yield from _batched(task.rows())
        yield from _batched(task.rows())

    return written(texts.mapInArrow(work, SQL_KINDS), f"phrases-{length}")


def _bitmap(spark: SparkSession, buckets: DataFrame, bits: int, least: int):
    """The buckets (chunk, at, counts) that hold ``least`` or more, as a broadcast bitmap of 2 ** ``bits`` bits: at most 16 MB by MOST_BITS."""

    def work(batches):
        chunk, held = None, None

        def out():
            return pa.RecordBatch.from_pydict({"chunk": [chunk], "bits": [np.packbits(held >= least, bitorder="little").tobytes()]}, schema=kinds)

        for b in pieces(batches):
            for c, at, counts in zip(*(x.to_pylist() for x in b.columns)):
                if c != chunk:
                    if chunk is not None:
                        yield out()
                    chunk, held = c, np.zeros(CHUNK, dtype=np.uint32)
                held[np.frombuffer(at, dtype="<u2")] += np.frombuffer(counts, dtype=np.uint8)  # a row has a bucket once
        if chunk is not None:
            yield out()

    kinds = pa.schema([("chunk", pa.int32()), ("bits", pa.binary())])
    dealt = buckets.select("chunk", "at", "counts").repartition("chunk").sortWithinPartitions("chunk")
    bitmap = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for r in dealt.mapInArrow(work, "chunk int, bits binary").collect():  # a row a chunk: 2 ** bits / 8 bytes in all
        part = np.frombuffer(r["bits"], dtype=np.uint8)
        bitmap[r["chunk"] * CHUNK // 8 : (r["chunk"] + 1) * CHUNK // 8] = part
    return spark.sparkContext.broadcast(bitmap.tobytes())


def _marked(frequent: DataFrame, bits: int, least: int) -> DataFrame:
    """The buckets of the frequent phrases (lang, phrase), each as full as need be."""

    def work(batches):
        for b in pieces(batches):
            vocabularies, hashes = {}, []
            for lang, phrase in zip(*(x.to_pylist() for x in b.columns)):
                v = vocabularies.get(lang)
                if v is None:
                    v = vocabularies[lang] = _Vocabulary(lang)
                h = np.array([v.hashes[v[w]] for w in phrase.encode("utf-8", "surrogatepass").split(b" ")], dtype=np.uint64)
                hashes.append(_hashed(h, len(h))[-1][0])
            slots = _slots(np.array(hashes, dtype=np.uint64), bits)
            yield from _batched({**r, "counts": bytes([least]) * len(r["counts"])} for r in bucket_rows(slots, least))

    return frequent.select("lang", "phrase").mapInArrow(work, SQL_KINDS)


def _bits_for(texts: DataFrame) -> int:
    size = texts.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    return min(MOST_BITS, max(FEWEST_BITS, int(size // 8).bit_length()))


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, f) of every phrase of up to ``longest`` words that occurs ``least`` times (255 at most) in a language, (lang, n)).

    ``n`` counts all words.  A null text is empty, a null language ``und``; phrases never cross a mark or a
    line; other columns are not looked at; an empty table gives empty results.
    """
    if not 1 <= least <= 255:
        raise ValueError(f"least: {least}")
    spark = docs.sparkSession
    reach_workers(spark)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bits = bits or _bits_for(texts)
    out, total, known, full = None, None, None, None
    for length in range(1, longest + 1):
        rows = _counted(texts, length, longest, least, bits, known, full)
        counts = rows.filter("phrase is not null").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        if length == 1:
            total = rows.filter("phrase is not null").groupBy("lang").agg(F.sum("n").alias("n"))
        frequent = written(counts.filter(F.col("f") >= least).withColumn("words", F.lit(length)), f"phrases-frequent-{length}")
        out = frequent if out is None else out.unionByName(frequent)
        for b in (known, full):
            if b is not None:
                b.unpersist()
        if length < longest:
            known = _bitmap(spark, _marked(frequent, bits, least), bits, least)
            full = _bitmap(spark, rows.filter("chunk is not null"), bits, least)
    return out, total


def _wide(c: Column) -> Column:
    return c.cast("decimal(15,0)")


def score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1,000,000 a a / (l r)), exact for counts below 10 ** 15."""
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (_wide(a) * _wide(a)), _wide(l) * _wide(r))


def scored_phrases(frequent: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of each phrase of 2 words or more, by its lowest cut, equal ones by the earliest."""
    w = F.split("phrase", " ")
    cut = lambda k, n: F.array_join(F.slice(w, k + 1, n), " ")
    cuts = frequent.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": cut(F.lit(0), F.col("k")), "rest": cut(F.col("k"), F.col("words") - F.col("k"))})
    parts = frequent.select("lang", F.col("phrase").alias("part"), F.col("f"))
    side = lambda name, f: parts.select("lang", F.col("part").alias(name), F.col("f").alias(f))
    cuts = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"])
    cuts = cuts.withColumn("score", score(F.col("a"), F.col("l"), F.col("r")))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "words")).alias("b"))
    return best.select("lang", "phrase", "b.words", "b.a", "b.l", "b.r", "b.score")


def without_covered(scored: DataFrame, covered: int = COVERED) -> DataFrame:
    """``scored`` without the phrases that lie in a longer one with ``covered`` percent of their count or more."""
    w, n = F.split("phrase", " "), F.col("words")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), n - 1), lambda k: F.transform(F.sequence(F.lit(0), n - k), lambda at: F.array_join(F.slice(w, at + 1, k), " "))))
    inside = scored.filter("words > 2").select("lang", F.explode(spans).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = scored.join(inside, ["lang", "phrase"], "left")
    return left.filter(F.col("longer").isNull() | (_wide(F.col("longer")) * 100 < _wide(F.col("a")) * covered)).drop("longer")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, covered: int = COVERED, top: int = TOP, bits: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language by score, count and phrase.

    Handling of odd rows as in ``frequent_phrases``.  A language without a phrase has no row.
    """
    frequent, total = frequent_phrases(docs, longest, least, bits)
    left = written(without_covered(written(scored_phrases(frequent, longest), "phrases-scored"), covered), "phrases-left")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # each task ranks its own rows first, so a language brings ``top`` rows a task to the last ranking
    some = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op13_phrase_collocations": op13_phrase_collocations}

ORACLES = {
    "op13_phrase_collocations": r"""
with t as (select coalesce(lang, 'und') lang, row_number() over () d, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') x from documents),
p as (select lang, d, unnest(x) x, generate_subscripts(x, 1) j from (select lang, d, regexp_split_to_array(x, '[.,;:!?\n\x0B\f\r]') x from t)),
w as (select lang, d, j, unnest(x) w, generate_subscripts(x, 1) i from (select lang, d, j, regexp_split_to_array(x, '[ \t]+') x from p)),
v as (select lang, w, lead(w, 1) over q w2, lead(w, 2) over q w3 from w where w <> '' window q as (partition by d, j order by i)),
g as (select lang, 1 k, w phrase from v union all select lang, 2, w || ' ' || w2 from v where w2 is not null union all select lang, 3, w || ' ' || w2 || ' ' || w3 from v where w3 is not null),
f as materialized (select lang, k, phrase, count(*) f from g group by all),
n as (select lang, sum(f) n from f where k = 1 group by 1),
c as (select lang, k words, phrase, f a, string_split(phrase, ' ') w from f where k > 1 and f >= 10),
e as materialized (select lang, words, phrase, a, w, u.k, array_to_string(w[1 : u.k], ' ') first, array_to_string(w[u.k + 1 :], ' ') rest from c, unnest([1, 2]) u(k) where u.k < words),
o as materialized (select lang || ' ' || phrase whole, f from f where f >= 10),
cut as (select e.*, x.f l, y.f r, cast(1000000 as hugeint) * a * a // (cast(x.f as hugeint) * y.f) score from e
  join o x on x.whole = e.lang || ' ' || first join o y on y.whole = e.lang || ' ' || rest),
s as (select * from cut qualify row_number() over (partition by lang, phrase order by score, k) = 1),
d as (select lang, unnest([array_to_string(w[1 : 2], ' '), array_to_string(w[2 : 3], ' ')]) phrase, a longer from c where words = 3),
m as (select lang, phrase, max(longer) longer from d group by all),
r as (select s.*, row_number() over (partition by s.lang order by score desc, a desc, s.phrase) rank from s left join m using (lang, phrase) where longer is null or 100 * longer < 50 * a)
select r.lang, rank, phrase, a, l, r, cast(n as bigint) n, cast(score as bigint) score from r join n on n.lang = r.lang where rank <= 2000
"""
}
