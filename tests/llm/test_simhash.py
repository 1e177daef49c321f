import random

import xxhash
from pyspark.sql import functions as F

from pipetally.llm import simhash
from pipetally.llm.components import connected_components


def plain_fingerprint(text, k=3):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", w) if x]
    grams = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << i for i in range(64) if sum(h >> i & 1 for h in hs) * 2 > len(hs))


def plain_components(fps):
    ids = sorted(fps)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_masks_cover_every_pair_within_the_radius():
    rnd = random.Random(1)
    for radius in (1, 2, 3):
        masks = simhash.covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(300):
            diff = sum(1 << i for i in rnd.sample(range(64), radius))
            assert any((m & (2**64 - 1)) & diff == 0 for m in masks)


def test_classes_match_brute_force(spark):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(40)] + ["Ärger", "ÉTÉ", "x y"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.choice((1, 2, 3, 8, 60)))) for _ in range(150)]
    for t in texts[:60]:
        w = t.split(" ")
        w[rnd.randrange(len(w))] = "changed"
        texts.append(rnd.choice("\t\n \r").join(w).upper())
    texts += ["", None, "  \n\t", texts[5], texts[5], "a b " * 30_000]
    rows = [(i * 3, t, "clash", "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string, fp string")
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicate_classes(docs).collect()}
    fps = {i: plain_fingerprint(t) for i, t, _, _ in rows}
    assert {i: g[0] for i, g in got.items()} == fps
    assert {i: g[1] for i, g in got.items()} == plain_components(fps)


def test_links_match_brute_force_on_chains_and_large_buckets(spark):
    rnd = random.Random(3)
    fps = {rnd.getrandbits(64) for _ in range(100)} | {0}
    x = rnd.getrandbits(64)
    for _ in range(60):  # a chain
        x ^= 1 << rnd.randrange(64)
        x ^= 1 << rnd.randrange(64)
        fps.add(x)
    base = rnd.getrandbits(64)
    fps |= {base ^ (1 << i) for i in range(64)}  # a ball of pairs at distance 2
    fps = {i: f for i, f in enumerate(sorted(fps))}
    signed = [(f - 2**64 if f >> 63 else f,) for f in fps.values()]
    got = {r.fp & (2**64 - 1): r.component & (2**64 - 1) for r in simhash.linked_fingerprints(spark.createDataFrame(signed, "fp long")).collect()}
    want = plain_components(fps)
    groups = lambda d: sorted(sorted(k for k in d if d[k] == c) for c in set(d.values()))
    assert groups({fps[i]: fps[c] for i, c in want.items()}) == groups(got)


def test_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicate_classes(empty).count() == 0
    docs = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (None, "z y x")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicate_classes(docs).collect())
    assert got == [("4", "4"), ("None", "4"), ("None", "None")]


def test_components_of_a_long_path(spark):
    edges = spark.range(1, 300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {i: 1 for i in range(2, 301)}
    assert connected_components(edges.limit(0)).count() == 0
