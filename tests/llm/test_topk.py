import random

import numpy as np
import pytest

from pipetally.llm import simhash, topk


def plain(rows, k):
    """(query_id, rank, vec_id, score) for rows whose id is divisible by 50, each row against all others."""
    ok = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (q, own) in enumerate(ok):
        if q % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(own, v)), i) for n, (i, v) in enumerate(ok) if n != at and len(v) == len(own))[:k]
            out += [(q, n, i, -x) for n, (x, i) in enumerate(s, 1)]
    return sorted(out)


ASKS = "vec_id % 50 = 0"


@pytest.mark.parametrize("kind", ["unit", "lengths", "clustered", "same"])
def test_matches_brute_force(spark, kind):
    rnd = np.random.default_rng(4)
    n, dim = 600, 8
    v = rnd.normal(size=(n, dim))
    if kind == "unit":
        v /= np.linalg.norm(v, axis=1)[:, None]
    elif kind == "lengths":
        v *= np.exp(rnd.normal(size=(n, 1)) * 2)
    elif kind == "clustered":
        v = rnd.normal(size=(5, dim))[rnd.integers(0, 5, n)] + 0.01 * v
    else:
        v[: n // 2] = v[0]  # ties: half of all vectors are one
    rows = [(int(i), [float(np.float32(x)) for x in r]) for i, r in enumerate(v)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, norm string")
    ints = topk.integer_vectors(df)
    got = topk.top_k(ints, ASKS, k=5, bucket=64, block=4)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, 5)


def test_first_buckets_too_large_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(topk, "BROADCAST_BYTES", 0)
    rnd = np.random.default_rng(9)
    rows = [(int(i), [float(x) for x in rnd.normal(size=4) * np.exp(rnd.normal())]) for i in range(400)]
    got = topk.top_k(topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), ASKS, bucket=32, block=2)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, 5)


def test_repeated_ids_are_rows_of_their_own(spark):
    rnd = np.random.default_rng(8)
    rows = [(int(i), [float(x) for x in rnd.normal(size=3)]) for i in [0, 0, 0, 1, 1, 50, 50, *range(60, 90)]]
    got = topk.top_k(topk.integer_vectors(spark.createDataFrame([*rows, (0, [1.0, 0.0])], "vec_id long, embedding array<double>")), ASKS)
    assert sorted(tuple(r) for r in got.collect()) == plain([*rows, (0, [1.0, 0.0])], 5)
    two = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 1.0]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r.rank, r.vec_id) for r in topk.top_k(topk.integer_vectors(two), ASKS).collect()) == [(0, 1, 1)] * 2 + [(0, 2, 2)] * 2 + [(0, 3, 0)] * 2


def test_its_batches_do_not_depend_on_the_session(spark):
    df = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(120)], "vec_id long, embedding array<double>")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    lazy = topk.top_k(topk.integer_vectors(df), ASKS)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    simhash.fingerprints(spark.createDataFrame([(1, "a b c")], "doc_id long, text string")).collect()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before and lazy.count() == 15


def test_only_needed_buckets_are_joined(spark):
    """Short vectors are left out on their lengths: few pairs of blocks are searched."""
    rnd = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rnd.normal(size=4) * (100 if i % 50 == 0 else 1)]) for i in range(2000)]
    seen, search = [], topk._search
    topk._search = lambda pairs, k: seen.append(pairs.count()) or search(pairs, k)
    try:
        got = topk.top_k(topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), ASKS, bucket=16, block=8)
        assert sorted(tuple(r) for r in got.collect()) == plain(rows, 5)
    finally:
        topk._search = search
    assert seen[1] < 0.5 * (2000 / 16) * (40 / 8)


def test_coordinates_and_lengths_prune():
    """The pruned search of a block is the full one whatever the threshold."""
    rnd = np.random.default_rng(9)
    for _ in range(60):
        dim = int(rnd.integers(1, 6))
        x = rnd.integers(-50, 50, size=(40, dim)) + (rnd.integers(0, 2) * 200)
        x = x[np.argsort(-np.linalg.norm(x, axis=1), kind="stable")]
        q = rnd.integers(-50, 50, size=(6, dim)) + (rnd.integers(0, 2) * 200)
        norms, qn = np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1)
        scores = q @ x.T
        least = np.array([np.sort(s)[-5] if i % 2 else np.sort(s)[-1] for i, s in enumerate(scores)], dtype=float)
        a, b, _, c = topk.search_block(np.arange(1000, 1006), qn, q, least, np.arange(40), np.arange(40), norms, x, 5)
        got = {(int(i), int(j)): int(s) for i, j, s in zip(a, b, c)}
        for i in range(6):
            for j in np.flatnonzero(scores[i] > least[i]):
                assert got[1000 + i, int(j)] == scores[i, j]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [nan, 1.0]), (3, [None, 1.0]), (4, [inf, 1.0]), (5, []), (None, [1.0, 1.0]), (6, [0.5, -0.001]), (7, [1.0, 2.0, 3.0]), (50, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ints = topk.integer_vectors(df)
    got = topk.top_k(ints, ASKS)
    assert sorted(tuple(r) for r in got.collect()) == [(0, 1, 6, 32768), (0, 2, 50, 0), (50, 1, 0, 0), (50, 2, 6, 0)]
    assert topk.top_k(ints.limit(0), ASKS).count() == 0
