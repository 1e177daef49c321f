import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from pipetally.llm import quality


def test_estimates_labellers_without_labels():
    rnd = random.Random(3)
    counts, truth = {}, {}
    for _ in range(4000):
        good = rnd.random() < 0.8
        v = [(2 if good else 0) if rnd.random() < (0.9 if i < 5 else 0.6) and rnd.random() < 0.7 else 1 for i in range(quality.LABELLERS)]
        v = [2 - x if rnd.random() < 0.05 else x for x in v]
        k = sum(x * 3**i for i, x in enumerate(v))
        counts[k] = counts.get(k, 0) + 1
        truth.setdefault(k, []).append(good)
    p = quality.estimate(counts)
    right = sum(sum(g == (p[k] >= 0.5) for g in gs) for k, gs in truth.items())
    assert right / 4000 > 0.95
    assert quality.estimate({}) == {} and quality.estimate({-1: 3}) == {}


def test_scorer_separates():
    rows = [([0, 1 + i % 2], [1.0, 1.0]) for i in range(100)]
    w = quality.train(rows, np.array([i % 2 for i in range(100)], dtype=float))
    assert w[2] > 1 > -1 > w[1]
    assert not quality.train([], np.zeros(0)).any()


def test_agrees_with_held_labels(spark, small):
    sf = small.replace("sf0.001", "sf0.01")
    rows = quality.featured(spark.read.parquet(f"{sf}/documents.parquet"))
    got = quality.scored(rows, quality.QualityModel(rows)).select("doc.doc_id", "score").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    n = {(r.quality, r.keep): r["count"] for r in got.groupBy("quality", (F.col("score") >= quality.KEEP).alias("keep")).count().collect()}
    assert n.get((1, False), 0) <= 0.005 * n[1, True] and n[0, False] >= 0.95 * (n[0, False] + n.get((0, True), 0))


def plain_figures(text):
    """The labellers' figures of a text, by a slower path of its own."""
    w = text.split()
    shape = lambda x: re.sub(r"\d+", "0", re.sub(r"[A-ZÀ-ÖØ-Þ]+", "A", re.sub(r"[^\W\d_A-ZÀ-ÖØ-Þ]+", "a", x)))
    s = [shape(x) for x in w]
    share = lambda n, of: n / of if of > 0 else 0.0
    bare = [re.sub(r"(?<=[aA0])[.,;:!?]$", "", x) for x in s]
    sentences = [x for x in re.split(r"(?<=[.!?])\s+|\n", text) if x.strip()]
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    return {
        "runs": share(sum(len(x) > 1 and x[-1] == x[-2] and x[-1] != "." and not re.match(r"\w", x[-1]) for x in s), len(w)),
        "marks": share(sum(0 if "0" in x else sum(c not in "aA_" for c in x) for x in bare), sum(map(len, w))),
        "capitals": share(sum("A" in x and "a" not in x for x in s) - sum(len(x) == 1 and x.isupper() for x in w), len(w)),
        "lone": share(sum(not set(x) & set("aA0") for x in s), len(w)),
        "twice": share(sum(a == b for a, b in zip(w, w[1:])), len(w) - 1),
        "trigrams": 1 - share(len(set(grams)), len(grams)) if grams else 0.0,
        "sentences": 1 - share(len(set(sentences)), len(sentences)),
        "n_sentences": len(sentences),
        "ends": share(sum(bool(re.search(r"\w[\"')\]]?[.?!]$", x)) for x in lines), len(lines)),
    }, s


def plain_judged(text):
    """Votes and features by the definition, from ``plain_figures``."""
    text = text or ""
    if not text.split():
        return -1, {}
    f, shapes = plain_figures(text)
    n = len(shapes)
    down = lambda x, good, bad: 0 if x >= bad else 2 if x <= good else 1
    v = [
        down(f["runs"], -1, 0.1), down(f["marks"], 0.03, 0.08), down(f["capitals"], 0.1, 0.4), down(f["lone"], -1, 0.1), down(f["twice"], 0.05 if n > 4 else -1, 0.2),
        down(f["trigrams"], 0.1 if n > 4 else -1, 0.35 if n > 29 else 2), down(f["sentences"], -1, 0.4 if f["n_sentences"] > 5 else 2),
        2 if f["ends"] >= 0.6 else 0 if f["ends"] <= 0.15 and n > 19 else 1,
    ]
    at = lambda name: zlib.crc32(name.encode()) % (quality.FEATURES - 1) + 1
    x = {0: 1.0}
    for s in shapes:
        k = at(re.sub(r"(?<=[aA0])[.,;:!?]$", "", re.sub("^Aa", "a", s)))
        x[k] = x.get(k, 0.0) + 1 / n
    for k in ("runs", "marks", "capitals", "lone", "twice", "trigrams", "sentences"):
        x[at(f"={k}")] = x.get(at(f"={k}"), 0.0) + 2 * f[k]
    return sum(a * 3**i for i, a in enumerate(v)), x


def plain_scores(texts):
    """Score of every text by the method done plainly: EM over all patterns, a scorer on the different texts."""
    judged = [plain_judged(t) for t in texts]
    keys = sorted({p for p, _ in judged if p >= 0})
    votes = {k: [k // 3**i % 3 for i in range(quality.LABELLERS)] for k in keys}
    n = {k: sum(p == k for p, _ in judged) for k in keys}
    good = {k: 1 / (1 + np.exp(-(votes[k].count(2) - 3.0 * votes[k].count(0)))) for k in keys}
    for _ in range(100):
        g, b = sum(n[k] * good[k] for k in keys), sum(n[k] * (1 - good[k]) for k in keys)
        like = {}
        for side, of in (("g", lambda k: good[k]), ("b", lambda k: 1 - good[k])):
            for i in range(quality.LABELLERS):
                seen = [sum(n[k] * of(k) for k in keys if votes[k][i] == x) + 0.5 for x in range(3)]
                for x in range(3):
                    like[side, i, x] = np.log(seen[x] / sum(seen))
        total = {k: [np.log((m + 1) / (g + b + 2)) + sum(like[s, i, votes[k][i]] for i in range(quality.LABELLERS)) for s, m in (("g", g), ("b", b))] for k in keys}
        good = {k: 1 / (1 + np.exp(np.clip(total[k][1] - total[k][0], -50, 50))) for k in keys}
    different = sorted({(p, tuple(x.items())) for p, x in judged if p >= 0})
    w = quality.train([([k for k, _ in x], [np.float32(v) for _, v in x]) for _, x in different], np.array([good[p] for p, _ in different]))
    return [1 / (1 + np.exp(-sum(w[k] * v for k, v in x.items()))) if x else 0.0 for _, x in judged]


def test_matches_a_plain_version(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.score for r in quality.op10_quality_classifier(spark, small).select("doc_id", "score").collect()}
    want = dict(zip(texts, plain_scores(list(texts.values()))))
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in got) < 1e-2  # float32 features, another order of sums
    assert all((got[k] >= quality.KEEP) == (want[k] >= quality.KEEP) for k in got)


def test_whole_shapes_and_repeats_count(spark):
    assert quality.judged("a-" * 40 + "b")[1] != quality.judged("a-" * 40 + "1")[1]  # shapes that differ after 80 characters
    rows = quality.featured(spark.createDataFrame([(i, "the same text again and again." if i % 3 else f"Text number {i} is about {i} things.") for i in range(3000)], "doc_id long, text string"))
    model = quality.QualityModel(rows, sample=100)
    assert sum(model.counts.values()) == 3000


def test_odd_rows(spark, small):
    model = quality.QualityModel(quality.featured(spark.read.parquet(f"{small}/documents.parquet")))
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", "a"), (None, "A plain sentence of words. And another one.", "a"), (None, "A plain sentence of words. And another one.", "a"),
            (5, "One word. " + "Many plain words follow here, " * 3 + "of course.", "a"), (6, "$$$ ### " * 50, "a"), (7, "x" * 200_000, "a"), (8, "De.", "a"), (9, "12 34 56", "a")]
    odd = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, score string, pattern int, __score int")
    got = quality.scored(quality.featured(odd), model)
    assert got.select("doc.*").columns == odd.columns
    score = [(r.doc_id, r.score) for r in got.select("doc.doc_id", "score").collect()]
    assert len(score) == len(rows) and all(0 <= s <= 1 for _, s in score)
    by = dict(score)
    assert by[1] == by[2] == by[3] == 0 and by[None] > 0.5 and by[6] < 0.5 and by[8] > 0.5
    kept = quality.good_documents(odd)
    assert kept.columns == odd.columns and quality.good_documents(odd.limit(0)).count() == 0
