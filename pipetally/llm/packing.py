"""Packing: documents in order, cut into windows by dynamic programming with a monotone queue.

The tokens of all documents, in order, are one stream.  Windows may be cut at the end of a document, at the
end of a sentence, and, inside a sentence of more than ``STRIDE`` tokens, at every ``STRIDE``-th of them.
The best cuts minimise padding (a window is filled up to the full size, unless its length is a power of two)
plus a penalty for each cut that parts a sentence or a document, plus a constant a window, so that windows of
a few tokens are no way out.  For the padded windows the cost of a cut j after a cut i is a term of i plus a
term of j: the best i of the last ``window`` tokens stands at the front of a monotone queue, and each cut
enters and leaves it once.  The unpadded lengths are a dozen single cuts to look up.

The stream is dealt out by ranges of doc_id.  Within a range it is solved in segments of about ``SEGMENT``
tokens; the last window of a segment is not given out but begins the next one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pipetally.llm.shared import pieces, reach_workers, written
from pipetally.llm.token_files import END_ID, TOKENIZER, encoder

WINDOW, STRIDE, SEGMENT = 2048, 64, 1_000_000
#: Costs in tokens of padding: of a cut between sentences, of one inside a sentence, and of a window.
SENTENCE_CUT, INNER_CUT, PER_WINDOW = 2, 16, 4
MARKS = frozenset(".!?…。！？")

PIECES = pa.schema([(n, pa.int64()) for n in ("part", "window", "doc_id", "start", "length", "doc_tokens", "offset")] + [("ids", pa.binary())])
SQL_PIECES = "part long, window long, doc_id long, start long, length long, doc_tokens long, offset long, ids binary"


def sentence_ends(tokenizer: Tokenizer) -> np.ndarray:
    """For each id whether it ends a sentence: marks alone, a full stop or its like among them."""
    out = np.zeros(tokenizer.get_vocab_size(), dtype=bool)
    for token, i in tokenizer.get_vocab().items():
        text = tokenizer.decode([i]).replace("</w>", "").strip() if not token.startswith("<|") else ""  # the mark of a word's end
        out[i] = bool(MARKS.intersection(text)) and not any(c.isalnum() for c in text)
    return out


_ENDS: dict[str, np.ndarray] = {}


def _ends_of(path: str, tokenizer: Tokenizer) -> np.ndarray:
    """One table a worker process."""
    if path not in _ENDS:
        _ENDS[path] = sentence_ends(tokenizer)
    return _ENDS[path]


def cut_points(ids: np.ndarray, ends: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Where a document (its end id last) may be cut, in order, its end included, and the penalty of each cut."""
    n = len(ids)
    stop = ends[ids[: n - 1]]
    # after the last of several marks, and never before the end id alone
    at = np.flatnonzero(stop[:-1] & ~stop[1:]) + 1 if n > 2 else np.zeros(0, dtype=np.int64)
    bounds = np.concatenate([[0], at, [n]])
    penalty = np.full(len(bounds), SENTENCE_CUT, dtype=np.int64)
    penalty[-1] = 0
    wide = np.flatnonzero(np.diff(bounds) > stride)
    if len(wide):
        inner = np.concatenate([np.arange(bounds[k] + stride, bounds[k + 1], stride) for k in wide])
        bounds, penalty = np.concatenate([bounds, inner]), np.concatenate([penalty, np.full(len(inner), INNER_CUT, dtype=np.int64)])
        order = np.argsort(bounds, kind="stable")
        bounds, penalty = bounds[order], penalty[order]
    return bounds[1:], penalty[1:]


def best_cuts(at: np.ndarray, penalty: np.ndarray, window: int = WINDOW, each: int = PER_WINDOW) -> list[int]:
    """Places of the chosen cuts among ``at`` (ascending, from 0; no two neighbours further apart than ``window``); the first and the last are always chosen.

    The sum of padding, penalties and ``each`` a window is the least there is.
    """
    n = len(at)
    # pairs (j, i) of cuts that a power of two parts
    place = np.full(int(at[-1]) + 1, -1, dtype=np.int64)
    place[at] = np.arange(n)
    js, befores = [], []
    for k in range(window.bit_length()):
        if 1 << k <= window:
            j = np.flatnonzero(at >= 1 << k)
            i = place[at[j] - (1 << k)]
            js.append(j[i >= 0])
            befores.append(i[i >= 0])
    js, befores = np.concatenate(js), np.concatenate(befores)
    order = np.argsort(js, kind="stable")
    js, befores = [*js[order].tolist(), n], befores[order].tolist()

    at, penalty = at.tolist(), penalty.tolist()
    cost, key, back, queue = [0] * n, [0] * n, [0] * n, [0] * (n + 1)
    head, tail, e = 0, 1, 0
    for j in range(1, n):
        p = at[j]
        while at[queue[head]] < p - window:
            head += 1
        i = queue[head]
        best = key[i] + window - p
        while js[e] == j:
            k = befores[e]
            e += 1
            if cost[k] < best:
                best, i = cost[k], k
        cost[j] = best = best + penalty[j] + each
        back[j] = i
        key[j] = value = best + p
        while tail > head and key[queue[tail - 1]] > value:
            tail -= 1
        queue[tail] = j
        tail += 1
    chosen = [n - 1]
    while chosen[-1]:
        chosen.append(back[chosen[-1]])
    return chosen[::-1]


class _Packer:
    """The stream of one task: documents come in, pieces go out."""

    def __init__(self, part: int, ends: np.ndarray, window: int):
        self.part, self.ends, self.window, self.windows = part, ends, window, 0
        self.docs: list[tuple[int | None, np.ndarray, int]] = []  # id, ids, those given out
        self.size = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, ids, 0))
        self.size += len(ids)

    def flush(self, last: bool) -> Iterator[pa.RecordBatch]:
        if not self.docs:
            return
        at, penalty, base, doc_ends = [np.zeros(1, dtype=np.int64)], [np.zeros(1, dtype=np.int64)], 0, []
        for _, ids, done in self.docs:
            a, p = cut_points(ids[done:], self.ends, min(STRIDE, self.window))
            at.append(a + base)
            penalty.append(p)
            base += len(ids) - done
            doc_ends.append(base)
        at = np.concatenate(at)
        cuts = at[best_cuts(at, np.concatenate(penalty), self.window)]
        if not last:
            cuts = cuts[:-1]  # what follows the last of them waits
        doc_ends, upto = np.array(doc_ends), int(cuts[-1])
        edges = np.union1d(cuts, doc_ends[doc_ends < upto])
        left, right = edges[:-1], edges[1:]
        doc, win = np.searchsorted(doc_ends, left, side="right"), np.searchsorted(cuts, left, side="right") - 1
        cols: list[list] = [[] for _ in PIECES]
        size = 0
        for a, b, d, w in zip(left.tolist(), right.tolist(), doc.tolist(), win.tolist()):
            doc_id, ids, done = self.docs[d]
            start = done + a - (int(doc_ends[d - 1]) if d else 0)
            for c, v in zip(cols, (self.part, self.windows + w, doc_id, start, b - a, len(ids), a - int(cuts[w]), ids[start : start + b - a].tobytes())):
                c.append(v)
            size += 4 * (b - a)
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, PIECES)], schema=PIECES)
                cols, size = [[] for _ in PIECES], 0
        if cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, PIECES)], schema=PIECES)
        self.windows += len(cuts) - 1
        first = int(np.searchsorted(doc_ends, upto, side="right"))
        rest = self.docs[first:]
        if rest:
            doc_id, ids, done = rest[0]
            rest[0] = doc_id, ids, done + upto - (int(doc_ends[first - 1]) if first else 0)
        self.docs, self.size = rest, int(doc_ends[-1]) - upto


def packed_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """(part, window, doc_id, start, length, doc_tokens, offset, ids) of each piece: what ``window`` of its ``part`` holds of a document.

    ``ids`` are little-endian unsigned 32-bit; every id of a document (the end id last) is in one piece,
    ``start`` counts those before, ``offset`` those before it in its window.  Documents come by doc_id,
    null ones first, rows that repeat one by text; a null or empty text is the end id alone; other columns
    are not looked at; an empty table gives an empty result.
    """
    reach_workers(docs.sparkSession)
    model = public_tokenizers.path(tokenizer)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def work(batches):
        code = encoder(model)
        task = _Packer(TaskContext.get().partitionId(), _ends_of(model, code.tokenizer), window)
        for b in pieces(batches):
            for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                task.add(d, np.append(code.encode(t.as_py()), np.array([end_id], dtype="<u4")).astype("<u4"))
                if task.size >= SEGMENT:
                    yield from task.flush(False)
        yield from task.flush(True)

    return rows.mapInArrow(work, SQL_PIECES)


def numbered_sequences(found: DataFrame) -> DataFrame:
    """``found`` with ``sequence_id``, from 0 over all parts, instead of (part, window); written, so that a number stays what it is."""
    found = written(found, "packed")
    before, starts = 0, []
    for r in sorted(found.groupBy("part").agg((F.max("window") + 1).alias("n")).collect()):  # one number a partition comes to the driver
        starts.append((r["part"], before))
        before += r["n"]
    starts = found.sparkSession.createDataFrame(starts, "part long, base long")
    return found.join(F.broadcast(starts), "part").withColumn("sequence_id", F.col("base") + F.col("window")).drop("part", "window", "base")


def packed(docs: DataFrame, tokenizer: str = TOKENIZER, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """(sequence_id, offset, doc_id, start, length, doc_tokens, ids) of each piece."""
    return numbered_sequences(packed_pieces(docs, tokenizer, window, end_id))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packed_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return numbered_sequences(found).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


QUERIES = {"op12_packing": op12_packing}
