"""The manifest against trees built level by level in memory."""

import random
import zlib
from binascii import hexlify
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from pipetally.llm import merkle


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(tree, i):
    out = []
    for level in tree[:-1]:
        out.append((level[i ^ 1] if i ^ 1 < len(level) else None, i % 2 == 1))
        i //= 2
    return out


def leaf_of(row, more=0):
    doc_id, text, lang, source, n_chars = row
    values = [doc_id, source, lang, None if n_chars is None else n_chars + more, text]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain(rows):
    """{(doc_id, leaf): (subroot, root, proof, folded, verified)}"""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    trees, order = {}, sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[g] = levels([leaf_of(r) for r in groups[g]])
    top = levels([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            proof = siblings(trees[g], i) + siblings(top, k)
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            acc = leaf_of(r, 1 if changed else 0)
            for s, left in proof:
                acc = h(s or "", acc) if left else h(acc, s or "")
            out.append((r[0], leaf_of(r), trees[g][-1][0], top[-1][0], h(*(s or "" for s, _ in proof)), acc, acc == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 8, 9, 31, 33, 200, 255, 256])
def test_traversal_gives_every_path(n):
    leaves = [h(str(i)) for i in range(n)]
    height = (n - 1).bit_length()
    root, paths = merkle.block_paths([x.encode() for x in leaves], height)
    tree = levels(leaves)
    assert root.decode() == tree[-1][0]
    for i, path in enumerate(paths):
        assert [None if s is None else s.decode() for s in path] == [s for s, _ in siblings(tree, i)]


@pytest.mark.parametrize("n", [1, 5, 12])
def test_a_last_block_is_climbed_to_the_full_height(n):
    leaves = [h(str(i)) for i in range(16 + n)]  # the tree over two blocks of 16
    root, paths = merkle.block_paths([x.encode() for x in leaves[16:]], 4)
    tree = levels(leaves)
    assert root.decode() == tree[4][1]
    assert [[None if s is None else s.decode() for s in p] for p in paths] == [[s for s, _ in siblings(tree, 16 + i)][:4] for i in range(n)]


def test_stacks_stay_small(monkeypatch):
    most = []
    step = merkle._TreeHash.step

    def watched(self, leaves):
        step(self, leaves)
        most.append(len(self.nodes))

    monkeypatch.setattr(merkle._TreeHash, "step", watched)
    merkle.block_paths([hexlify(bytes([i])) for i in range(256)], 8)
    assert max(most) <= 8 and len(most) <= 256 * (2 * 8 - 1)


def run(spark, rows, tmp_path, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        df = df.withColumns({c: F.lit("x") for c in ("g", "o", "node", "pos", "n", "leaf", "root", "path", "top", "tampered", "block")})
    df.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = merkle.op11_merkle_dataset_manifest(spark, str(tmp_path))
    return sorted(map(tuple, got.collect()), key=repr)


def test_query_equals_the_plain_trees(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "HEIGHT", 3)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    rnd = random.Random(5)
    langs = ["en"] * 60 + ["de"] * 9 + ["é", "z", None, "", "EN", "one"]
    rows = [(rnd.choice([None, rnd.randrange(400)]) if i % 20 == 0 else i, rnd.choice([None, "", "text \n" * (i % 5), "ü" * 3]), rnd.choice(langs), rnd.choice(["web", None]), rnd.choice([None, i])) for i in range(300)]
    rows += rows[:7] + [(9999, "a" * 300_000, "one", "web", 300_000)]  # repeated rows, a long text, a lone leaf
    assert run(spark, rows, tmp_path, extra=True) == plain(rows)


def test_one_row_and_none(spark, tmp_path):
    row = [(7, "x", "en", None, None)]
    got = run(spark, row, tmp_path / "a")
    assert got == plain(row) and got[0][1] == got[0][2] == got[0][3] and got[0][6]
    assert run(spark, [], tmp_path / "b") == []
