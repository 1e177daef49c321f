import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from pipetally.llm import decontaminate, mixing, quality, registry, shared
from tests.llm.test_decontaminate import plain as plain_contained
from tests.llm.test_neardup import plain_kept
from tests.llm.test_quality import plain_scores


def test_stages_match_brute_force(spark, small):
    """Each stage on its predecessor's rows against plain Python, and run() against the last of them."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = [n for n, _ in cp.STAGES]
    assert len(names) == 5
    rows, frame, seen = {r.doc_id: r for r in docs.collect()}, docs, []
    for name, stage in cp.STAGES[:-1]:
        before = frame
        frame = shared.written(stage(spark, frame, small), "stage")
        assert frame.columns == docs.columns
        got = [r.doc_id for r in frame.collect()]
        seen.append(got)
        ids = {r.doc_id for r in before.collect()}
        if name == names[0]:
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
            gone = ids - set(got)
            assert gone and not [i for i in gone if labels.get(i) == 1]
            order = sorted(ids)
            assert set(got) == {i for i, s in zip(order, plain_scores([rows[i].text for i in order])) if s >= quality.KEEP}
        elif name == names[1]:
            assert set(got) == plain_kept([(i, rows[i].text) for i in ids])
        elif name == names[2]:
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
            bad = {d for d, _ in plain_contained([(i, rows[i].text) for i in ids], items)}
            assert bad and set(got) == ids - bad
        else:
            con = duckdb.connect()
            con.register("documents", before.toPandas())
            want = con.execute(mixing.mixing_sql("select doc_id from picked")).fetchall()
            assert sorted(got) == sorted(w[0] for w in want)
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, start = [], 0
    for i in sorted(seen[-1]):
        ids = tok.encode(rows[i].text, add_special_tokens=False).ids + [1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in cp.run(spark, small).collect()) == want


def test_run_on_an_empty_table_and_on_odd_rows(spark, small, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, __score double, __tokens int, doc string, domain string, same int"
    spark.read.parquet(f"{small}/benchmark.parquet").write.parquet(str(tmp_path / "none/benchmark.parquet"))
    spark.read.parquet(f"{small}/benchmark.parquet").write.parquet(str(tmp_path / "odd/benchmark.parquet"))
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert cp.run(spark, str(tmp_path / "none")).count() == 0
    plain = [f"This is a plain sentence about topic {i}. It is followed by another one on {i * i}, and ends here." for i in range(40)]
    rows = [(i, t, "en", "src1") for i, t in enumerate(plain)] + [(None, plain[0], None, None), (None, "A text without an id, which is all its own. It stays.", None, None), (3, None, "en", "src2"), (4, "", None, "src3"), (5, plain[5], "en", "src1")]
    frame = spark.createDataFrame([(*r, 1, 0.1, 2, "d", "x", 3) for r in rows], schema)
    frame.write.parquet(str(tmp_path / "odd/documents.parquet"))
    for _, stage in cp.STAGES[:-1]:
        frame = shared.written(stage(spark, frame, str(tmp_path / "odd")), "stage")
        assert frame.dtypes == spark.createDataFrame([], schema).dtypes
    kept = [r.doc_id for r in frame.collect()]
    out = cp.run(spark, str(tmp_path / "odd")).collect()
    assert sorted(map(str, kept)) == sorted(str(r.doc_id) for r in out) and 20 < len(out) <= 41 * mixing.MAX_EPOCHS


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_queries_match_sql(spark, small, name):
    from tests.test_queries import canon

    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "conversations", "pages", "labels"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    df = registry.QUERIES[name](spark, small)
    want = con.execute(registry.ORACLES[name])
    names = [c[0] for c in want.description]
    assert canon(df.columns, df.collect()) == canon(names, want.fetchall())


def test_words_are_cut_alike(spark):
    df = spark.createDataFrame([("A b-c, D1_e\nÉté ß 3½",)], "text string")
    assert df.select(decontaminate.words_of(df.text).alias("w")).first().w == ["a", "b", "c", "d1", "e", "été", "ß", "3½"]
