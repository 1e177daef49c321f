import random
import re
from itertools import combinations

import numpy as np
import pytest

from pipetally.llm import neardup, simhash


def plain_kept(rows):
    """The least id of each class of equal or similar texts."""
    texts = {}
    for i, t in rows:
        if i is not None:
            texts.setdefault(i, t or "")
    up = {i: i for i in texts}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    def shingles(t):
        w = re.findall(r"\w+", t.lower())
        k = min(5, len(w))
        return {tuple(w[p : p + k]) for p in range(len(w) - k + 1)} if w else set()

    s = {i: shingles(t) for i, t in texts.items()}
    for a, b in combinations(sorted(texts), 2):
        same = texts[a] == texts[b] or s[a] and len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b])
        if same:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i for i in texts if root(i) == i}


def make(rnd, n, copies):
    words = [f"w{i}" for i in range(800)]
    base = [[rnd.choice(words) for _ in range(rnd.choice((30, 120, 400)))] for _ in range(n)]
    rows = [" ".join(b) for b in base]
    for b in base[: n // 2]:
        for _ in range(rnd.randrange(copies)):
            c = list(b)
            for _ in range(rnd.randrange(max(1, len(c) // 60))):
                c[rnd.randrange(len(c))] = rnd.choice(words)
            rows.append(" ".join(c))
    return rows


def test_matches_brute_force(spark):
    rnd = random.Random(11)
    texts = make(rnd, 60, 4) + ["", "", None, "a", "a", "A", "one two", "same text twice here and there"] * 2 + ["w1 w2 " * 20_000]
    rows = [(i * 2, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, kept string")
    got = neardup.without_near_duplicates(docs)
    assert got.columns == docs.columns
    assert {r.doc_id for r in got.collect()} == plain_kept(rows)


@pytest.mark.parametrize("dense", [16, 256])
def test_large_buckets(spark, monkeypatch, dense):
    monkeypatch.setattr(neardup, "DENSE", dense)
    monkeypatch.setattr(neardup, "BLOCK", 64)
    rnd = random.Random(12)
    b = [f"w{rnd.randrange(500)}" for _ in range(300)]
    rows = [(0, " ".join(b))]
    for i in range(1, 200):
        c = list(b)
        for _ in range(2):
            c[rnd.randrange(300)] = f"x{rnd.randrange(500)}"
        rows.append((i, " ".join(c)))
    rows += [(1000 + i, t) for i, t in enumerate(make(rnd, 40, 1))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in neardup.without_near_duplicates(docs).collect()} == plain_kept(rows)


def test_repeated_and_missing_ids(spark):
    kept = lambda rows: sorted((str(r.doc_id), r.text) for r in neardup.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "a b c d e f"), (2, "other words of a text"), (None, "without an id"), (None, "without an id"), (None, None), (7, "")]
    assert kept(rows) == [("1", "a b c d e f"), ("2", "other words of a text"), ("7", ""), ("None", "without an id")]
    # a text of its own stays, whatever else has its id
    assert kept([(1, "x"), (2, "x"), (2, "own text")]) == [("1", "x"), ("2", "own text")]
    long = " ".join(f"w{i}" for i in range(100))
    assert kept([(3, long), (3, long + " end"), (3, "short"), (4, long)]) in ([("3", "short"), ("3", t)] for t in (long, long + " end"))
    assert neardup.without_near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_large_group_of_one_text(spark):
    docs = spark.range(40_000).selectExpr("id doc_id", "case when id % 3 = 0 then 'the same words in every one of these texts' else 'own ' || id || ' words ' || id * 7 || ' here ' || id end text", "1 __same", "2 node")
    got = neardup.without_near_duplicates(docs)
    assert got.columns == docs.columns and got.count() == 40_000 - 40_000 // 3 and got.filter("doc_id % 3 = 0").first().doc_id == 0


def test_every_kind_of_edit(spark):
    rnd = random.Random(13)
    word = lambda: f"v{rnd.randrange(20_000)}"
    rows = []
    for n in (13, 20, 30, 60, 1000, 3000):
        for _ in range(12):
            b = [word() for _ in range(n)]
            k = n // 2
            appended = b + [word() for _ in range(n * 15 // 100)]
            cut = b[: n * 85 // 100]
            replaced = b[:k] + [word() for _ in range(n * 6 // 100)] + b[k + n * 6 // 100 :]
            for t in (b, rnd.choice((appended, cut, replaced, b[:-1] + [word()]))):
                rows.append((len(rows), " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in neardup.without_near_duplicates(docs).collect()} == plain_kept(rows)


def test_common_lines_and_blocks(spark):
    rnd = random.Random(14)
    line = "a very common line that stands in all of these texts and says nothing at all"
    rows = []
    for i in range(300):
        b = [f"v{rnd.randrange(20_000)}" for _ in range(rnd.choice((4, 40)))]
        rows.append((len(rows), f"{line} {' '.join(b)}"))
        if i % 3 == 0:
            rows.append((len(rows), f"{line} {' '.join(b)} v{rnd.randrange(20_000)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in neardup.without_near_duplicates(docs).collect()} == plain_kept(rows)


def test_block_links_join_what_is_similar():
    rnd = random.Random(15)
    base = [f"w{rnd.randrange(500)}" for _ in range(150)]
    sets = []
    for _ in range(120):
        c = list(base)
        for _ in range(rnd.choice((1, 3, 6))):
            c[rnd.randrange(150)] = f"x{rnd.randrange(500)}"
        sets.append(neardup.shingle_hashes(" ".join(c)))
    near = lambda a, b: len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b))

    def classes(links):
        up = np.arange(120)
        for a, b in links:
            up[up == up[b]] = up[a]
        return {frozenset(np.flatnonzero(up == c).tolist()) for c in set(up.tolist())}

    ids, own = np.arange(120), np.arange(120)
    want = classes([(a, b) for a, b in combinations(range(120), 2) if near(sets[a], sets[b])])
    got = neardup.block_links(ids, own, sets)
    assert classes(got) == want and len(got) == 120 - len(want) and all(near(sets[a], sets[b]) for a, b in got)
    # classes that are joined already give no pair
    assert neardup.block_links(ids, np.zeros(120, dtype=int), sets) == []


def test_simhash_classes_are_whole(spark):
    """Every class of the SimHash operator keeps one text, also where the sets of shingles differ; the exact filter adds to it."""
    rnd = random.Random(16)
    word = lambda: f"v{rnd.randrange(20_000)}"
    line = " ".join(word() for _ in range(21))
    rows = [(i, f"{line} " * 50 + " ".join(word() for _ in range(60))) for i in range(4)]  # one fingerprint; Jaccard similarity about 0.2
    rows += [(10 + i, " ".join(word() for _ in range(40))) for i in range(20)]
    rows += [(30 + i, rows[4 + i][1] + " end") for i in range(3)] + [(40, ""), (41, " \t"), (42, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in neardup.without_near_duplicates(docs).collect()}
    classes = {r.doc_id: r.component_id for r in simhash.near_duplicate_classes(docs).collect()}
    assert {classes[i] for i in range(4)} == {0} and len(plain_kept(rows[:4])) == 4
    assert kept == {0, 40, *range(10, 30)} == {i for i in plain_kept(rows) if classes[i] == i}


def test_names_of_other_columns_pass_through(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (2, text), (3, text + " more"), (4, "something else"), (4, "something else"), (None, "lone")]
    df = spark.createDataFrame([(i, t, "a", "b", "c", "d", 5) for i, t in rows], "doc_id long, text string, __goes string, __same string, __id string, `row.x` string, same int")
    left = neardup.without_near_duplicates(df)
    assert left.columns == df.columns
    got = sorted(map(str, left.collect()))
    assert got == sorted(str(r) for r in df.dropDuplicates(["doc_id", "text"]).filter("doc_id is null or doc_id in (1, 4)").collect())
