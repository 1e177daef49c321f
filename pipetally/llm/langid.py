"""Language identification by words first, backing off to shorter and shorter character n-grams.

Known words score by their log frequency in each language; an unseen word scores by the longest of
its character n-grams (with word ends marked, from five characters down to one) that training saw.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pipetally.llm.shared import pieces, reach_workers, text_sample, written

UNDETERMINED = "und"
#: Labelled documents to learn from, of each language at most, and the bytes of their texts (the bounds of the sample, and so of the model).
SAMPLE_DOCS, SAMPLE_BYTES = 2000, 64 << 20
#: The longest n-gram.
LONGEST = 5
#: Words that a worker remembers, and the longest of them; letters that are looked up at a time.
REMEMBERED, SHORT, STRETCH = 400_000, 64, 1 << 16
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return [w for w in _WORD.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))] if text else []


def grams_of(word: str, n: int) -> list[str]:
    """The n-grams of a word with its ends marked; an end alone says nothing."""
    marked = f"^{word}$"
    return [marked[i : i + n] for i in range(n == 1, len(marked) - n + 1 - (n == 1))]


def hash_of(key: str) -> int:
    """XXH64 of a word or n-gram, as Spark's ``xxhash64`` has it."""
    return xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"), 42)


Counts = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def counts_of(counts: dict[tuple[str, str], int], langs: list[str], size: int | None = None) -> Counts:
    """(hashes, places of languages, sizes, counts) of a dict by (language, key); sizes are those of the keys unless given."""
    return (np.array([hash_of(k) for _, k in counts], dtype=np.uint64), np.array([langs.index(g) for g, _ in counts], dtype=np.int64),
            np.array([len(k) if size is None else size for _, k in counts], dtype=np.int64), np.array(list(counts.values()), dtype=np.int64))


class _Table:
    """All keys of one kind by hash, in order, and for each the languages that have it: what a count adds to the log frequency of a key never met."""

    def __init__(self, counts: Counts):
        h, lang, size, n = counts
        order = np.lexsort((lang, h))
        h = h[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, dtype=np.int64)
        self.keys, self.ends = h[first], np.r_[first, len(h)]
        self.lang, self.more = lang[order].astype(np.int32), np.log(2.0 * n[order] + 1).astype(np.float32)
        self.distinct = Counter(size[order][first].tolist())

    def find(self, keys: list[str]) -> np.ndarray:
        """The row of each key, -1 where it was never met."""
        h = np.array([hash_of(k) for k in keys], dtype=np.uint64)
        if not len(self.keys):
            return np.full(len(h), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, at, -1)

    def add(self, rows: np.ndarray, owners: np.ndarray, weights: np.ndarray, total: np.ndarray) -> None:
        """Add ``weights`` times what the keys at ``rows`` have to the lines ``owners`` of ``total`` (by language)."""
        lengths = self.ends[rows + 1] - self.ends[rows]
        flat = np.repeat(self.ends[rows] - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
        cell = np.repeat(owners, lengths) * total.shape[1] + self.lang[flat]
        total += np.bincount(cell, weights=self.more[flat] * np.repeat(weights, lengths), minlength=total.size).reshape(total.shape)


class LanguageModel:
    """Log frequencies of words and n-grams by language: all that were counted, as sorted hashes (two of 64 bits are one key in less than one model of a million)."""

    def __init__(self, words: Counts, grams: Counts, totals: dict[tuple[str, int], int], docs: dict[str, int]):
        """Counts of words and of n-grams, languages in order of name; of all of a language's words (size 0) and
        of all its n-grams of a size; and of its training documents."""
        self.langs = sorted(docs)
        total = sum(docs.values())
        self.prior = np.log(np.array([docs[lang] / total for lang in self.langs])) if docs else np.zeros(0)
        self.words, self.grams = _Table(words), _Table(grams)
        kinds = self.grams.distinct | Counter({0: len(self.words.keys)})
        # of a key that a language never had: frequencies are among keys of one size
        self.never = np.array([[-np.log(2 * totals.get((lang, n), 0) + kinds[n] + 1) for lang in self.langs] for n in range(LONGEST + 1)]).reshape(LONGEST + 1, len(self.langs))

    def backed_off(self, words: list[str]) -> np.ndarray:
        """For each unseen word the mean log frequencies of its longest known n-grams, over all of it; zeros if none is known."""
        out, left = np.zeros((len(words), len(self.langs))), list(range(len(words)))
        for n in range(LONGEST, 0, -1):
            total, known = np.zeros_like(out), np.zeros(len(words))

            def look(owners: list[int], keys: list[str]) -> None:
                rows, own = self.grams.find(keys), np.array(owners, dtype=np.int64)
                rows, own = rows[rows >= 0], own[rows >= 0]
                np.add.at(known, own, 1)  # noqa: B023
                self.grams.add(rows, own, np.ones(len(rows)), total)  # noqa: B023

            owners, keys = [], []
            for i in left:
                marked = f"^{words[i]}$"
                first, end = int(n == 1), len(marked) - n + 1 - (n == 1)
                for k in range(first, end, STRETCH):  # of a run without end too
                    keys += [marked[j : j + n] for j in range(k, min(end, k + STRETCH))]
                    owners += [i] * (len(keys) - len(owners))
                    if len(keys) >= STRETCH:
                        look(owners, keys)
                        owners, keys = [], []
            if keys:
                look(owners, keys)
            done = known > 0
            out[done] = self.never[n] + total[done] / known[done, None]
            left = [i for i in left if not done[i]]
            if not left:
                break
        return out

    def predict(self, text: str | None, seen: dict[str, int | np.ndarray]) -> tuple[str, float]:
        """The likeliest language of a whole text and its share of the evidence; ``seen`` remembers words: the row of a known one, the scores of another."""
        counts = Counter(words_of(text))
        if not counts or not self.langs:
            return UNDETERMINED, 0.0
        if len(seen) >= REMEMBERED:
            seen.clear()
        new = [w for w in counts if w not in seen]
        now: dict[str, int | np.ndarray] = {}
        if new:
            rows = self.words.find(new).tolist()
            unseen = [w for w, r in zip(new, rows) if r < 0]
            now = {w: r for w, r in zip(new, rows) if r >= 0}
            now |= zip(unseen, self.backed_off(unseen))
            seen |= {w: v for w, v in now.items() if len(w) <= SHORT}
        at, n, total, size = [], [], self.prior.copy(), 0
        for w, c in counts.items():
            size += c
            v = seen[w] if w in seen else now[w]
            if type(v) is int:
                at.append(v)
                n.append(c)
            else:
                total += c * v
        if at:
            found, n = np.zeros((1, len(self.langs))), np.array(n)
            self.words.add(np.array(at), np.zeros(len(at), dtype=np.int64), n, found)
            total += found[0] + n.sum() * self.never[0]
        best = int(np.argmax(total))
        share = np.exp(np.clip((total - total[best]) / np.sqrt(size), -700, 0))
        return self.langs[best], float(1 / share.sum())


def _counts_in(counted: DataFrame, langs: list[str]) -> Counts:
    got = counted.select("lang", F.xxhash64("key").alias("h"), "size", "n").toArrow()
    lang = got["lang"].combine_chunks().dictionary_encode()
    if isinstance(lang, pa.ChunkedArray):
        lang = lang.combine_chunks()
    place = np.array([langs.index(x) for x in lang.dictionary.to_pylist()], dtype=np.int64)
    return got["h"].to_numpy().view(np.uint64), place[lang.indices.to_numpy()] if len(got) else np.zeros(0, dtype=np.int64), got["size"].to_numpy().astype(np.int64), got["n"].to_numpy()


def fit(labelled: DataFrame, sample: int = SAMPLE_DOCS, most: int = SAMPLE_BYTES, seed: int = 4) -> LanguageModel:
    """Learn from at most ``sample`` different texts of each language of ``labelled`` (text, lang), ``most`` bytes of them (or one text).

    Words and n-grams of all of them are counted in Spark, and the model keeps every one: its size follows
    from the sample, and a language with many documents takes no room from one with few.
    """
    reach_workers(labelled.sparkSession)
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("text is not null and lang is not null")
    upto = W.partitionBy("lang").orderBy(F.xxhash64("text"), "text")  # at most ``sample`` rows a language
    rows = text_sample(rows, "text", sample, seed, by="lang").withColumns({"__sum": F.sum(F.octet_length("text")).over(upto), "__k": F.row_number().over(upto)})
    rows = rows.filter((F.col("__sum") <= most) | (F.col("__k") == 1)).select("text", "lang")

    def count(batches):
        for b in pieces(batches):
            seen, docs = {}, Counter()
            for text, lang in zip(*(c.to_pylist() for c in b.columns)):
                docs[lang] += 1
                seen.setdefault(lang, Counter()).update(words_of(text))
            out = [(lang, -1, "", n) for lang, n in docs.items()]
            for lang, of in seen.items():
                out += [(lang, 0, w, n) for w, n in of.items()]
            lang, size, key, n = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(size, pa.int32()), pa.array(key, pa.string()), pa.array(n, pa.int64())], names=["lang", "size", "key", "n"])

    counted = rows.mapInArrow(count, "lang string, size int, key string, n long").groupBy("lang", "size", "key").agg(F.sum("n").alias("n"))
    counted = written(counted, "language-words")
    # all sizes of n-grams in one pass over the words; a mark of a word's end alone is none
    marked = F.concat(F.lit("^"), "key", F.lit("$"))
    sizes = counted.filter("size = 0").select("lang", "n", marked.alias("m"), F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("key") + 2))).alias("size"))
    first, last = F.when(F.col("size") == 1, 2).otherwise(1), F.when(F.col("size") == 1, F.length("m") - 1).otherwise(F.length("m") + 1 - F.col("size"))
    of_size = sizes.select("lang", "size", "n", "m", F.explode(F.sequence(first, last)).alias("i")).select("lang", "size", F.substr("m", F.col("i"), F.col("size")).alias("key"), "n")
    of_size = written(of_size.groupBy("lang", "size", "key").agg(F.sum("n").alias("n")), "language-grams")
    docs = {r.lang: r.n for r in counted.filter("size < 0").collect()}  # one row a language
    known = counted.filter("size = 0")
    totals = {(r.lang, r.size): r.n for t in (known, of_size) for r in t.groupBy("lang", "size").agg(F.sum("n").alias("n")).collect()}
    return LanguageModel(_counts_in(known, sorted(docs)), _counts_in(of_size, sorted(docs)), totals, docs)


def with_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) of every row, by its whole text alone.

    Null texts and texts without a letter are ``und`` with score 0; ids are carried along, null or
    repeated; equal evidence goes to the first language by name; other columns are not looked at;
    an empty table gives an empty result.
    """
    spark = docs.sparkSession
    reach_workers(spark)
    shared = spark.sparkContext.broadcast(model)  # at most what SAMPLE_BYTES bytes a language hold

    def work(batches):
        m, seen = shared.value, {}
        for b in pieces(batches):
            found = [m.predict(t, seen) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    out = with_language(docs, fit(docs.filter(remainder != 2)))
    return out.select("doc_id", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = {"op4_language_id": op4_language_id}
