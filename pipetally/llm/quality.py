"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document.  Expectation-
maximisation over the counts of vote patterns (at most 3^8 of them, over all documents) estimates
how each labeller votes on good and on bad documents, without any given labels; the posterior of a
document's pattern is its soft label.  A linear scorer over hashed word shapes and repetition
figures is trained on those, and scores whole texts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipetally.llm.shared import PIECE_ROWS, let_go, reach_workers, text_sample, written

#: Hashed features, documents that the scorer is trained on (the bound of the sample), score from which a document stays.
FEATURES, SAMPLE_DOCS, KEEP = 1 << 12, 20_000, 0.5

_LOWER, _UPPER, _DIGIT = re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), re.compile(r"[A-ZÀ-ÖØ-Þ]+"), re.compile(r"\d+")
_RUN = re.compile(r"([^\w.])\1$")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n")
_CAPITAL, _STOP = re.compile(r"^Aa"), re.compile(r"(?<=[aA0])[.,;:!?]$")
_ENDS = re.compile(r"\w[\"')\]]?[.?!]$")


def figures(text: str) -> tuple[dict[str, float], Counter, int]:
    """Shares that the labellers judge by, the counts of word shapes, and the number of words."""
    w = text.split()
    n = len(w)
    shaped = Counter(_DIGIT.sub("0", _UPPER.sub("A", _LOWER.sub("a", text))).split())
    shape = {s: (("A" in s and "a" not in s), _RUN.search(s) is not None, not re.search("[aA0]", s), 0 if "0" in s else sum(c not in "aA_" for c in _STOP.sub("", s))) for s in shaped}
    marks = sum(c * shape[s][3] for s, c in shaped.items())
    # words of one capital letter are ordinary, so capitals count where there are more than a few
    capitals = sum(c for s, c in shaped.items() if shape[s][0]) - sum(len(x) == 1 and x.isupper() for x in w)
    trigrams = len(set(zip(w, w[1:], w[2:])))
    sentences = [s for s in _SENTENCE.split(text) if s.strip()]
    lines = [x for x in (y.strip() for y in text.split("\n")) if x]
    of = lambda a, b: a / b if b > 0 else 0.0
    return {
        "runs": of(sum(c for s, c in shaped.items() if shape[s][1]), n),
        "marks": of(marks, sum(map(len, w))),
        "capitals": of(capitals, n),
        "lone": of(sum(c for s, c in shaped.items() if shape[s][2]), n),
        "twice": of(sum(map(eq, w, w[1:])), n - 1),
        "trigrams": 1 - of(trigrams, n - 2) if n > 2 else 0.0,
        "sentences": 1 - of(len(set(sentences)), len(sentences)),
        "n_sentences": len(sentences),
        "ends": of(sum(_ENDS.search(x) is not None for x in lines), len(lines)),
    }, shaped, n


def _vote(x: float, good: float, bad: float) -> int:
    """2 (good) up to ``good``, 0 (bad) from ``bad``, else 1 (no vote)."""
    return 0 if x >= bad else 2 if x <= good else 1


def votes(f: dict[str, float], n: int) -> list[int]:
    """One of bad 0, none 1, good 2 from each labeller.

    A labeller that judges by a share abstains where a text has too few words or sentences for one: a
    repeated word in a text of three is no repetition, and half of two sentences is one.
    """
    return [
        _vote(f["runs"], -1, 0.1),
        _vote(f["marks"], 0.03, 0.08),
        _vote(f["capitals"], 0.1, 0.4),
        _vote(f["lone"], -1, 0.1),
        _vote(f["twice"], 0.05 if n >= 5 else -1, 0.2),
        _vote(f["trigrams"], 0.1 if n >= 5 else -1, 0.35 if n >= 30 else 2),
        _vote(f["sentences"], -1, 0.4 if f["n_sentences"] >= 6 else 2),
        2 if f["ends"] >= 0.6 else 0 if f["ends"] <= 0.15 and n >= 20 else 1,
    ]


LABELLERS = 8


def judged(text: str | None) -> tuple[int, list[int], list[float]]:
    """All votes as one number in base 3, and the sparse features: shares of word shapes and of the figures, hashed.

    A text without words has -1 and no features.
    """
    f, shaped, n = figures(text or "")
    if not n:
        return -1, [], []
    out: dict[int, float] = {0: 1.0}
    for s, c in shaped.items():
        s = _STOP.sub("", _CAPITAL.sub("a", s))  # a short text has as many capitals and stops as it has sentences
        at = zlib.crc32(s.encode("utf-8", "surrogatepass")) % (FEATURES - 1) + 1
        out[at] = out.get(at, 0.0) + c / n
    for k in ("runs", "marks", "capitals", "lone", "twice", "trigrams", "sentences"):
        at = zlib.crc32(f"={k}".encode()) % (FEATURES - 1) + 1
        out[at] = out.get(at, 0.0) + 2 * f[k]
    return sum(v * 3**i for i, v in enumerate(votes(f, n))), list(out), list(out.values())


def estimate(counts: dict[int, int], rounds: int = 100) -> dict[int, float]:
    """The posterior of being good for each vote pattern, by EM from the labellers' mean vote."""
    keys = [k for k in counts if k >= 0]
    if not keys:
        return {}
    v = np.array([[k // 3**i % 3 for i in range(LABELLERS)] for k in keys])
    c = np.array([counts[k] for k in keys], dtype=float)
    hot = np.stack([v == x for x in range(3)], axis=2).astype(float)  # pattern, labeller, vote
    # a bad vote is rare and specific, so at first one bad vote outweighs two good ones
    p = 1 / (1 + np.exp(-((v == 2).sum(1) - 3.0 * (v == 0).sum(1))))
    for _ in range(rounds):
        prior = (np.array([(c * p).sum(), (c * (1 - p)).sum()]) + 1) / (c.sum() + 2)
        logs = []
        for q in (p, 1 - p):
            seen = np.einsum("p,plv->lv", c * q, hot) + 0.5
            logs.append(np.einsum("plv,lv->p", hot, np.log(seen / seen.sum(1, keepdims=True))))
        good, bad = np.log(prior)[:, None] + np.array(logs)
        p = 1 / (1 + np.exp(np.clip(bad - good, -50, 50)))
    return dict(zip(keys, p.tolist()))


def train(rows: list[tuple[list[int], list[float]]], labels: np.ndarray, steps: int = 300) -> np.ndarray:
    """Weights of a logistic scorer on soft labels, both classes weighing the same, by full-batch Adam."""
    w = np.zeros(FEATURES)
    if not rows:
        return w
    at = np.concatenate([np.array(i, dtype=np.int64) for i, _ in rows])
    x = np.concatenate([np.array(v) for _, v in rows])
    r = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
    good = max(labels.sum(), 1.0)
    bad = max((1 - labels).sum(), 1.0)
    weight = labels / good + (1 - labels) / bad
    weight /= weight.sum()
    m, s = np.zeros(FEATURES), np.zeros(FEATURES)
    for k in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(r, w[at] * x, len(rows)), -50, 50)))
        g = np.bincount(at, ((p - labels) * weight)[r] * x, FEATURES) + 1e-5 * w
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.999**k)) + 1e-9)
    return w


def featured(docs: DataFrame, columns: tuple[str, ...] = ("*",)) -> DataFrame:
    """(doc, pattern, at, x): the votes and features of every whole text beside its row (a struct of ``columns``), written once.

    Fitting and scoring both read them.
    """
    reach_workers(docs.sparkSession)

    @F.arrow_udf("struct<pattern: int, at: array<int>, x: array<float>>")
    def found(texts: pa.Array) -> pa.Array:
        let_go()
        parts = []
        for k in range(0, len(texts), PIECE_ROWS):
            pattern, at, x = zip(*(judged(t.as_py()) for t in texts.slice(k, PIECE_ROWS)))
            parts.append(pa.StructArray.from_arrays(
                [pa.array(pattern, pa.int32()), pa.array(at, pa.list_(pa.int32())), pa.array(x, pa.list_(pa.float32()))], names=["pattern", "at", "x"]))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("pattern", pa.int32()), ("at", pa.list_(pa.int32())), ("x", pa.list_(pa.float32()))]))

    rows = docs.select(F.struct(*columns).alias("doc"), found(F.col("text").cast("string")).alias("f"))
    return written(rows.select("doc", "f.pattern", "f.at", "f.x"), "quality-features")


class QualityModel:
    """Posteriors by vote pattern and the weights of the linear scorer."""

    def __init__(self, rows: DataFrame, sample: int = SAMPLE_DOCS, seed: int = 10):
        """Estimate the labellers over all of ``rows`` (of ``featured``); train on at most ``sample`` different texts."""
        self.counts = {r["pattern"]: r["count"] for r in rows.groupBy("pattern").count().collect()}  # at most 3^8 + 1 rows
        self.posterior = estimate(self.counts)
        # texts with the same votes and features teach the same
        some = rows.filter("pattern >= 0").select("pattern", "at", "x", F.struct("at", "x").alias("k"))
        some = text_sample(some, "k", sample, seed).select("pattern", "at", "x")
        some = sorted((r["pattern"], r["at"], r["x"]) for r in some.collect())
        self.weights = train([(i, x) for _, i, x in some], np.array([self.posterior[p] for p, _, _ in some]))


def scored(rows: DataFrame, model: QualityModel) -> DataFrame:
    """(doc, score) of ``rows`` (of ``featured``); the score is from 0 to 1, and 0 for null and for texts without words.

    A null or repeated doc_id makes no difference, all columns are in ``doc`` whatever their names, an
    empty table gives an empty result.
    """
    w = model.weights.astype(np.float64)

    @F.arrow_udf("double")
    def score(at: pa.Array, x: pa.Array) -> pa.Array:
        sizes = np.diff(at.offsets.to_numpy())
        total = np.bincount(np.repeat(np.arange(len(at)), sizes), w[at.flatten().to_numpy()] * x.flatten().to_numpy(), len(at))
        return pa.array(np.where(sizes > 0, 1 / (1 + np.exp(-np.clip(total, -50, 50))), 0.0), pa.float64())

    return rows.select("doc", score("at", "x").alias("score"))


def good_documents(docs: DataFrame) -> DataFrame:
    """``docs`` whose score, by a classifier fitted on them, is at least KEEP."""
    rows = featured(docs)
    return scored(rows, QualityModel(rows)).filter(F.col("score") >= KEEP).select("doc.*")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = featured(spark.read.parquet(f"{sf_dir}/documents.parquet"), ("doc_id",))
    return scored(rows, QualityModel(rows)).select("doc.doc_id", "score", (F.col("score") >= KEEP).alias("keep"))


QUERIES = {"op10_quality_classifier": op10_quality_classifier}
