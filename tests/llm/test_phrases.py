"""Collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pipetally.llm import phrases as P

LOWER = {c: c + 32 for c in range(65, 91)}


def plain(rows, longest=3, least=10, covered=50, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    cands = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in cands.items():
        if any(l2 == lang and len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (l2, q), b in cands.items()):
            continue
        s, k = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-s, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, v in out.items() for i, (s, a, p, l, r) in enumerate(sorted(v)[:top]))


def rows_of(seed, docs=120):
    rnd = random.Random(seed)
    words = ["the", "The", "of", "é", "É", "日本", "x-y", "a b", "\x1c", "new", "york", "city", "'tis", "🙂"]
    out = []
    for i in range(docs):
        text = "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "\r\n", "? "]) for _ in range(rnd.randrange(60)))
        out.append((text + " New York City" * rnd.randrange(3), rnd.choice(["en", "en", "en", "de", None, "und"])))
    return out + [(None, "en"), ("", None), ("   ", "de"), ("lone", "xx"), ("aa " * 30_000, "long")] + [("same same words here", "cp")] * 12


def test_query_equals_plain_counting(spark, tmp_path):
    rows = rows_of(1)
    df = spark.createDataFrame(rows, "text string, lang string").withColumns({"doc_id": F.monotonically_increasing_id(), "phrase": F.lit("x"), "n": F.lit(1), "chunk": F.lit(2)})
    df.repartition(7).write.parquet(str(tmp_path / "documents.parquet"))
    got = P.op13_phrase_collocations(spark, str(tmp_path))
    assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == plain(rows)


@pytest.mark.parametrize("longest,least,bits", [(2, 3, 16), (4, 4, 16), (5, 3, 18)])
def test_other_lengths_and_few_buckets(spark, longest, least, bits, monkeypatch):
    monkeypatch.setattr(P, "WORDS", 300)  # counts leave the task often
    rows = rows_of(longest, 60)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    got = P.collocations(df, longest, least, 60, 15, bits)
    assert sorted(map(tuple, got.collect())) == plain(rows, longest, least, 60, 15)


def test_scores_beyond_64_bits(spark):
    big = [(10**12 + 7, 10**12 + 9, 3 * 10**12 + 1), (10**14, 10**14, 10**14), (10, 10**14, 10**14), (999_999, 1_000_000, 1_000_001)]
    df = spark.createDataFrame(big, "a long, l long, r long").withColumn("s", P.score(F.col("a"), F.col("l"), F.col("r")))
    assert [r.s for r in df.collect()] == [1_000_000 * a * a // (b * c) for a, b, c in big]


def test_equal_scores_are_cut_first(spark):
    f = spark.createDataFrame([("x", "a b c", 3, 10), ("x", "a", 1, 100), ("x", "b c", 2, 20), ("x", "a b", 2, 40), ("x", "c", 1, 50), ("x", "b", 1, 50)], "lang string, phrase string, words int, f long")
    r = P.scored_phrases(f).filter("phrase = 'a b c'").first()
    assert (r.l, r.r, r.score) == (100, 20, 50_000)


def test_bucket_rows_and_bitmap(spark):
    slots = np.array([5, 5, 5, 70_000, 70_000, 131_071, 5] + [9] * 300, dtype=np.uint32)
    rows = list(P.bucket_rows(slots, 3))
    assert [r["chunk"] for r in rows] == [0, 70_000 // P.CHUNK, 131_071 // P.CHUNK]
    df = spark.createDataFrame([(r["chunk"], bytearray(r["at"]), bytearray(r["counts"])) for r in rows + list(P.bucket_rows(np.array([70_000], dtype=np.uint32), 3))], "chunk int, at binary, counts binary")
    bits = np.frombuffer(P._bitmap(spark, df, 17, 3).value, dtype=np.uint8)
    assert np.flatnonzero(np.unpackbits(bits, bitorder="little")).tolist() == [5, 9, 70_000]
    assert list(P.bucket_rows(np.zeros(0, dtype=np.uint32), 3)) == []


def test_empty_tables(spark):
    assert P.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert P.collocations(spark.createDataFrame([(None, None), ("...", "en")], "text string, lang string")).count() == 0
