import pyarrow as pa
import pyarrow.fs as pafs
from pathlib import Path
import gc
import json
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pipetally.llm import simple8b, token_files
from pipetally.llm.shared import pieces, reach_workers

WIDE = st.one_of(st.integers(0, 1), st.integers(0, 300), st.integers(0, 60_000), st.integers(0, 2**60 - 1), st.integers(2**60, 2**64 - 1))


@settings(max_examples=150, deadline=None)
@given(st.lists(WIDE, max_size=300))
def test_simple8b_round_trip(ids):
    ids = np.array(ids, dtype=np.uint64)
    words, escapes = simple8b.encode(ids)
    assert np.array_equal(simple8b.decode(words, escapes, len(ids)), ids)


def test_simple8b_packs():
    assert len(simple8b.encode(np.zeros(120, dtype=np.uint64))[0]) == 2
    assert len(simple8b.encode(np.full(40, 32_767, dtype=np.uint64))[0]) == 10
    words, escapes = simple8b.encode(np.array([5, 2**63, 7], dtype=np.uint64))
    assert len(escapes) == 1 and (words >> np.uint64(60)).tolist().count(15) == 1


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-(2**62), 2**62)), st.lists(st.integers(0, 2**32 - 1), max_size=60)), max_size=20))
def test_file_round_trip(docs):
    data = token_files.pack([d for d, _ in docs], [np.array(t, dtype="<u4") for _, t in docs])
    ids, texts = token_files.unpack(data)
    assert ids == [d for d, _ in docs] and [t.tolist() for t in texts] == [t for _, t in docs]


def test_blocks_are_coded_on_their_own():
    big = np.arange(3 * token_files.BLOCK_IDS + 5, dtype="<u4")
    _, (back,) = token_files.unpack(token_files.pack([1], [big]))
    assert np.array_equal(back, big)
    with pytest.raises(ValueError):
        token_files.unpack(b"something else")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(token_files.TOKENIZER))


ODD = ["", " ", "It's we'll X'RE", "a,b;c!!", "Ünïcode ÉTÉ ß", "x\x1cy z", "a\u00a0b\u2003c", "e\u0301te\u0301 İstanbul ΑΣ", "<|endoftext|> a<|ENDOFTEXT|>b", "12 345 ½ ²", "日本語 テスト 🙂", "''s 's' 'LL", "a\x00b", "\u200b w", "µ ª º", "ǅ Ǆ"]


@settings(max_examples=120, deadline=None)
@given(st.one_of(st.text(max_size=60), st.sampled_from(ODD), st.text(alphabet="abcIT'’sS.,!<|>é Ñ\t\n\x1c", max_size=60)))
def test_words_encode_as_the_whole_text(text):
    text = text.encode("utf-8", "ignore").decode()
    own = Tokenizer.from_file(public_tokenizers.path(token_files.TOKENIZER)) if not hasattr(test_words_encode_as_the_whole_text, "t") else test_words_encode_as_the_whole_text.t
    test_words_encode_as_the_whole_text.t = own
    code = token_files.encoder(public_tokenizers.path(token_files.TOKENIZER))
    assert code.encode(text).tolist() == own.encode(text, add_special_tokens=False).ids


def test_odd_texts(tokenizer):
    code = token_files.WordEncoder(public_tokenizers.path(token_files.TOKENIZER))
    for text in ODD + [" ".join(ODD), "long " * 50_000]:
        assert code.encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def expected(rows, tokenizer):
    out, start = [], 0
    for d, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_files_hold_every_text_in_order(spark, tokenizer, monkeypatch):
    rows = [(7 * i % 101, t) for i, t in enumerate(ODD * 3)] + [(None, "no id"), (500, None), (501, "w " * 30_000)]
    docs = spark.createDataFrame([(d, t, "x", 9) for d, t in rows], "doc_id long, text string, start string, ids int")
    got = sorted((tuple(r) for r in token_files.token_output(docs).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d))
    assert sorted((str(r[0]), *r[2:]) for r in got) == sorted((str(r[0]), *r[2:]) for r in expected(rows, tokenizer))
    at = 0
    for r in got:
        assert r[1] == at
        at += r[2]
    assert token_files.token_output(docs.limit(0)).count() == 0


def test_whole_table(spark, small, tokenizer):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    assert sorted(tuple(r) for r in token_files.token_output(docs).collect()) == expected(rows, tokenizer)


def test_any_tokenizer_gives_the_ids_of_its_library(spark):
    texts = ["Hello, World!  it's 12 o'clock", "", "ÉTÉ ß <|endoftext|> \x1c x", "日本語 text", "a\n\n b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        tok = Tokenizer.from_file(public_tokenizers.path(name))
        want = [tok.encode(t, add_special_tokens=False).ids + [1] for t in texts]
        got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_files.token_output(df, name).collect()}
        assert got == {i: (len(w), zlib.crc32(np.array(w, dtype="<u4").tobytes())) for i, w in enumerate(want)}
    config = json.loads(Path(public_tokenizers.path("word_bpe_49k.json")).read_text())
    assert token_files.encodes_by_words(config) and not token_files.encodes_by_words({**config, "normalizer": None})


def test_a_repeated_task_leaves_the_same_file(tmp_path):
    fs = pafs.LocalFileSystem()
    for name, data in (("a", b"1"), ("b", b"1"), ("c", b"2")):
        (tmp_path / name).write_bytes(data)
    token_files.publish(fs, str(tmp_path / "a"), str(tmp_path / "file"))
    token_files.publish(fs, str(tmp_path / "b"), str(tmp_path / "file"))
    assert (tmp_path / "file").read_bytes() == b"1" and not (tmp_path / "b").exists()

    class Keeps:  # a store that refuses to replace a file
        get_file_info, open_input_stream, delete_file = fs.get_file_info, fs.open_input_stream, fs.delete_file

        def move(self, own, name):
            raise OSError("exists")

    (tmp_path / "b").write_bytes(b"1")
    token_files.publish(Keeps(), str(tmp_path / "b"), str(tmp_path / "file"))
    assert not (tmp_path / "b").exists()
    with pytest.raises(OSError):
        token_files.publish(Keeps(), str(tmp_path / "c"), str(tmp_path / "file"))


def test_a_worker_forgets_the_words_of_an_earlier_stage(spark):
    """Else what the encoders remember counts against the memory of every later stage."""
    reach_workers(spark)
    path = public_tokenizers.path(token_files.TOKENIZER)

    def encode(batches):
        for b in pieces(batches):
            token_files.encoder(path).encode("some words")
            yield b

    def held(batches):
        for b in pieces(batches):
            n = sum(type(o).__name__ == "WordEncoder" for o in gc.get_objects())
            yield pa.RecordBatch.from_arrays([pa.array([n] * b.num_rows, pa.int64())], names=["id"])

    ids = spark.range(40)
    assert ids.mapInArrow(encode, "id long").count() == 40
    assert {r.id for r in ids.mapInArrow(held, "id long").collect()} == {0}
