"""Token-ID / binary output: whole texts as Simple-8b files in ascending doc_id order.

A file (a shard of one range of doc_ids) is, little-endian: the magic ``PTS8B001``; the numbers of
documents, ids, blocks, words and escapes (u64 each); the doc_ids (i64), a byte for each that is 0 for
a null doc_id, and the documents' lengths (u64); for each block of 16,384 ids (the last may be shorter)
the offsets of its words and escapes, and one pair more (u64); the words; the escapes.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from array import array
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from tokenizers import Tokenizer

from pipetally.llm import simple8b
from pipetally.llm.shared import fresh_path, kept, pieces, reach_workers, written

MAGIC, BLOCK_IDS, SHARD_IDS = b"PTS8B001", 16_384, 4_000_000
TOKENIZER, END_ID = "word_bpe_49k.json", 1
#: Encoded words and pieces of words that a worker remembers in a stage (about 150 bytes each); then it starts afresh.
WORDS = 500_000

_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_LATIN = re.compile(r"[\x21-\x7e\xa1-\xff]+")
_MARKS = frozenset(".,;:!?")
_ODD_SPACE = re.compile(r"[\x1c-\x1f]")  # white space to str.split, not to the tokenizer


def _byte_letters() -> dict[int, str]:
    """Each Latin-1 character as the letters that byte-level BPE writes for its UTF-8 bytes."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # these bytes stand for themselves
    letter = {b: chr(b) for b in shown}
    letter |= {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in letter)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(256)}


_LETTERS = _byte_letters()


def _latin(text: str) -> bool:
    """Whether all of a text is Latin-1, which lower-cases character by character."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


#: How a tokenizer is built whose texts ``_PIECE`` cuts as it does.
EXPECTED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
    "post_processor": None, "truncation": None, "padding": None,
}


def encodes_by_words(config: dict) -> bool:
    """Whether the tokenizer of this configuration is a byte-level BPE that lower-cases, drops white space and splits by the pattern that ``_PIECE`` follows."""
    return EXPECTED == {k: config.get(k) for k in EXPECTED} and config.get("model", {}).get("type") == "BPE" and all(
        t["content"].startswith("<|") for t in config.get("added_tokens") or [])


class _Words(dict):
    """The ids of words, as bytes; one that is missing is encoded."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        self[word] = ids = self.encode(word)
        return ids


class WordEncoder:
    """Ids of whole texts, as the tokenizers library has them.

    Where the tokenizer lower-cases, drops white space and never joins across it, a text's ids are
    those of its words one after another, and a word's those of its pieces (by the tokenizer's own
    pattern); each distinct piece goes through the library once.  Any other tokenizer gets whole texts.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = encodes_by_words(json.loads(Path(path).read_text()))
        self.model = self.tokenizer.model
        self.words = _Words(self._word)  # and pieces of words: a word that is a piece has the same ids

    def _plain(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _alone(self, piece: str) -> bytes:
        # a piece is what the tokenizer's own pattern finds, so the model alone can encode it
        return array("I", [t.id for t in self.model.tokenize(piece if piece.isascii() else piece.translate(_LETTERS))]).tobytes()

    def _piece(self, piece: str) -> bytes:
        ids = self.words.get(piece)
        if ids is None:
            self.words[piece] = ids = self._alone(piece)
        return ids

    def _word(self, word: str) -> bytes:
        # Latin-1 is in normal form, and lower-casing keeps its letters letters; special tokens hold "<|"
        if not _LATIN.fullmatch(word) or "<|" in word:
            return self._plain(word)
        low = word.lower()
        if low.isalpha():  # what the pattern finds are runs of letters
            return self._alone(low) if low == word else self._piece(low)
        if low[:-1].isalpha() and low[-1] in _MARKS:
            return self._piece(low[:-1]) + self._piece(low[-1])
        return b"".join(map(self._piece, _PIECE.findall(low)))

    def encode(self, text: str) -> np.ndarray:
        if not self.by_words or _ODD_SPACE.search(text):
            return np.frombuffer(self._plain(text), dtype="<u4")
        if "<|" not in text and _latin(text):
            text = text.lower()  # as the tokenizer would; fewer distinct words
        ids = b"".join(map(self.words.__getitem__, text.split()))
        if len(self.words) > WORDS:
            self.words.clear()
        return np.frombuffer(ids, dtype="<u4")


def encoder(path: str) -> WordEncoder:
    """One encoder for the tasks of a stage in a worker process."""
    return kept(f"encoder {path}", lambda: WordEncoder(path))


def pack(doc_ids: list[int | None], texts: list[np.ndarray]) -> bytes:
    """The bytes of one file."""
    ids = np.concatenate(texts) if texts else np.zeros(0, dtype="<u4")
    words, escapes, w_at, e_at = [], [], [0], [0]
    for k in range(0, len(ids), BLOCK_IDS):
        w, e = simple8b.encode(ids[k : k + BLOCK_IDS])
        words.append(w)
        escapes.append(e)
        w_at.append(w_at[-1] + len(w))
        e_at.append(e_at[-1] + len(e))
    head = MAGIC + struct.pack("<5Q", len(doc_ids), len(ids), len(w_at) - 1, w_at[-1], e_at[-1])
    u8 = lambda x: np.asarray(x, dtype="<u8").tobytes()
    return b"".join([
        head, np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(), bytes(d is not None for d in doc_ids), u8([len(t) for t in texts]),
        u8(w_at), u8(e_at), *map(u8, words), *map(u8, escapes),
    ])


def unpack(data: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    """doc_ids and ids of each document of one file."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    docs, ids, blocks, n_words, n_escapes = struct.unpack_from("<5Q", data, 8)
    at = 48

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, dtype=kind, count=n, offset=at)
        at += out.nbytes
        return out

    doc_ids, valid, lengths = take("<i8", docs), take("u1", docs), take("<u8", docs).astype(np.int64)
    w_at, e_at = take("<u8", blocks + 1).astype(np.int64), take("<u8", blocks + 1).astype(np.int64)
    words, escapes = take("<u8", n_words), take("<u8", n_escapes)
    out = np.empty(ids, dtype=np.uint64)
    for k in range(blocks):
        a, b = k * BLOCK_IDS, min(ids, (k + 1) * BLOCK_IDS)
        out[a:b] = simple8b.decode(words[w_at[k] : w_at[k + 1]], escapes[e_at[k] : e_at[k + 1]], b - a)
    ends = np.cumsum(lengths)
    return [int(d) if v else None for d, v in zip(doc_ids, valid)], [out[e - n : e] for e, n in zip(ends, lengths)]


def publish(fs: pafs.FileSystem, own: str, name: str) -> None:
    """Give a finished file its name; where a repeated task finds the name taken, the file there must be the same."""
    try:
        fs.move(own, name)
    except (OSError, pa.ArrowException):
        if fs.get_file_info(name).type == pafs.FileType.NotFound:
            raise
    if fs.get_file_info(own).type != pafs.FileType.NotFound:  # the store did not replace it
        with fs.open_input_stream(own) as a, fs.open_input_stream(name) as b:
            same = a.read() == b.read()
        fs.delete_file(own)
        if not same:
            raise OSError(f"{name} is there with other contents")


def write_token_files(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` (doc_id, text) into files under ``path``; (part, shard, file, docs, ids, start) of each.

    ``path`` must be seen by all machines.  A task writes a file under a name of its own and renames
    it, so that a repeated task leaves the same files.  Null texts are empty (the end id alone); null
    doc_ids come first; rows that repeat a doc_id follow each other by text; other columns are not
    written; an empty table gives no files.
    """
    spark = docs.sparkSession
    reach_workers(spark)
    model = public_tokenizers.path(tokenizer)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def work(batches):
        part, code, shard = TaskContext.get().partitionId(), encoder(model), 0
        fs, root = pafs.FileSystem.from_uri(path)
        ids, texts, n = [], [], 0

        def close():
            nonlocal ids, texts, n, shard
            name = f"part-{part:06d}-{shard:05d}.s8b"
            fs.create_dir(root, recursive=True)
            own = f"{root}/.{name}.{uuid.uuid4().hex}"
            with fs.open_output_stream(own) as f:
                f.write(pack(ids, texts))
            publish(fs, own, f"{root}/{name}")
            row = pa.RecordBatch.from_pylist([{"part": part, "shard": shard, "file": name, "docs": len(ids), "ids": n}], schema=kinds)
            ids, texts, n, shard = [], [], 0, shard + 1
            return row

        for b in pieces(batches):
            for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                coded = np.append(code.encode(t.as_py()), np.array([end_id], dtype="<u4")).astype("<u4")
                ids.append(d)
                texts.append(coded)
                n += len(coded)
                if n >= SHARD_IDS:
                    yield close()
        if ids:
            yield close()

    kinds = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())])
    files = written(rows.mapInArrow(work, "part int, shard int, file string, docs long, ids long"), "token-files")
    # one number a partition comes to the driver
    before, starts = 0, []
    for r in sorted(files.groupBy("part").agg(F.sum("ids").alias("n")).collect()):
        starts.append((r.part, before))
        before += r.n
    within = F.sum("ids").over(W.partitionBy("part").orderBy("shard")) - F.col("ids")
    starts = spark.createDataFrame(starts, "part int, base long")
    return files.join(F.broadcast(starts), "part").withColumn("start", F.col("base") + within).drop("base")


def read_token_files(files: DataFrame, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the files listed."""

    def work(batches):
        fs, root = pafs.FileSystem.from_uri(path)
        for b in pieces(batches):
            for name, start in zip(*(c.to_pylist() for c in b.columns)):
                with fs.open_input_stream(f"{root}/{name}") as f:
                    doc_ids, texts = unpack(f.read())
                n = np.array([len(t) for t in texts], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(doc_ids, pa.int64()), pa.array(start + np.cumsum(n) - n, pa.int64()), pa.array(n, pa.int64()),
                    pa.array([zlib.crc32(t.astype("<u4").tobytes()) for t in texts], pa.int64()),
                ], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = files.count()  # AQE would gather a list of names into one task
    spread = files.select("file", "start").repartition(max(1, min(n, 10_000)), "file")
    return spread.mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Write ``docs`` to fresh files in the shared folder and return what they hold."""
    path = fresh_path(docs.sparkSession, "tokens")
    return read_token_files(written(write_token_files(docs, path, tokenizer), "token-starts"), path)


def op5_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_token_id_output": op5_token_id_output}
