"""Packing against every possible cut, and round trips of its pieces."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pipetally.llm import packing as P


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(P.TOKENIZER))


def cost_of(at, penalty, cuts, window, each):
    total = 0
    for a, b in zip(cuts, cuts[1:]):
        n = at[b] - at[a]
        assert n <= window
        total += each + penalty[b] + (0 if n & (n - 1) == 0 else window - n)
    return total


def plain_cost(at, penalty, window, each):
    best = [0] + [None] * (len(at) - 1)
    for j in range(1, len(at)):
        for i in range(j):
            n = at[j] - at[i]
            if n <= window:
                c = best[i] + each + penalty[j] + (0 if n & (n - 1) == 0 else window - n)
                best[j] = c if best[j] is None else min(best[j], c)
    return best[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 16), st.sampled_from([0, 2, 16])), min_size=1, max_size=60), st.sampled_from([16, 32, 64]), st.integers(0, 5))
def test_cuts_are_the_best_there_are(gaps, window, each):
    at, penalty = np.cumsum([0] + [g for g, _ in gaps]), np.array([0] + [p for _, p in gaps])
    cuts = P.best_cuts(at, penalty, window, each)
    assert cuts[0] == 0 and cuts[-1] == len(at) - 1
    assert cost_of(at, penalty, cuts, window, each) == plain_cost(at, penalty, window, each)


def test_cut_points(tokenizer):
    ends = P.sentence_ends(tokenizer)
    ids = lambda t: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1])
    x = ids("One two three. Four five?! Six seven, eight.")
    at, penalty = P.cut_points(x, ends)
    shown = [tokenizer.decode(x[a:b].tolist()) for a, b in zip([0, *at[:-1]], at)]
    assert [s.split()[0] for s in shown] == ["one</w>", "four</w>", "six</w>"] and penalty.tolist() == [2, 2, 0] and at[-1] == len(x)
    at, penalty = P.cut_points(np.array([5] * 200 + [1]), np.zeros(10, dtype=bool))
    assert at.tolist() == [64, 128, 192, 201] and penalty.tolist() == [16, 16, 16, 0]
    assert P.cut_points(np.array([1]), ends)[0].tolist() == [1]


TEXTS = [None, "", ".", "a.", "Short one. And two! " * 40, "word " * 9000, "x" * 50_000, "Über. 日本語。テスト？ " * 300, "...", "one. two. three. " * 2000]


def test_query_gives_every_id_once(spark, tmp_path, tokenizer):
    rows = [(i, TEXTS[i % len(TEXTS)], "x") for i in range(100)] + [(None, "no id", "x"), (5, "again", "x"), (5, "again", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, part string").withColumn("window", F.lit("y")).withColumn("ids", F.lit(1))
    df.repartition(6).write.parquet(str(tmp_path / "documents.parquet"))
    got = P.op12_packing(spark, str(tmp_path)).collect()
    ids = lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
    want = sorted(((d, ids(t)) for d, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    crc = lambda x: zlib.crc32(np.array(x, dtype="<u4").tobytes())
    # sequences are gapless and numbered from 0
    by_seq = {}
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert sorted(by_seq) == list(range(len(by_seq)))
    padding = 0
    stream = []
    for s in sorted(by_seq):
        at = 0
        for r in sorted(by_seq[s], key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
            stream.append(r)
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    total = sum(len(x) for _, x in want)
    assert sum(r.length for r in got) == total and padding < 0.02 * total
    # the stream is the documents in order
    k = 0
    by_id = {}
    for d, x in want:
        by_id.setdefault(d, []).append(x)
    while k < len(stream):
        d, n = stream[k].doc_id, stream[k].doc_tokens
        run, done = [], 0
        while done < n:
            r = stream[k]
            assert (r.doc_id, r.start, r.doc_tokens) == (d, done, n)
            run.append(r)
            done += r.length
            k += 1
        x = next(x for x in by_id[d] if len(x) == n and all(crc(x[r.start : r.start + r.length]) == r.ids_crc32 for r in run))
        by_id[d].remove(x)
    assert not any(by_id.values())
    docs = [r.doc_id for r in stream if r.start == 0]
    assert docs == sorted(docs, key=lambda d: (d is not None, d or 0))


def test_segments_change_no_ids_and_little_padding(tokenizer, monkeypatch):
    ends = P.sentence_ends(tokenizer)
    docs = [(i, np.array([*tokenizer.encode("Some words here. " * (i % 90), add_special_tokens=False).ids, 1], dtype="<u4")) for i in range(400)]

    def run(segment):
        task, out = P._Packer(3, ends, 256), []
        for d, x in docs:
            task.add(d, x)
            if task.size >= segment:
                out += list(task.flush(False))
        out += list(task.flush(True))
        rows = [r for b in out for r in b.to_pylist()]
        back = {}
        for r in rows:
            assert r["start"] == len(back.get(r["doc_id"], b"")) // 4
            back[r["doc_id"]] = back.get(r["doc_id"], b"") + r["ids"]
        assert back == {d: x.tobytes() for d, x in docs}
        sizes = {}
        for r in rows:
            sizes[r["window"]] = sizes.get(r["window"], 0) + r["length"]
        return sum(0 if n & (n - 1) == 0 else 256 - n for n in sizes.values())

    total = sum(len(x) for _, x in docs)
    whole, parts = run(1 << 40), run(1000)
    assert whole <= parts <= whole + 0.02 * total


def test_an_empty_table(spark):
    assert P.packed(spark.createDataFrame([], "doc_id long, text string")).count() == 0
