import random
import re

from pipetally.llm.decontaminate import contained_items, decontaminated


def plain(docs, items, k=5, t=0.8):
    words = lambda s: re.findall(r"[^\W_]+", (s or "").lower())
    out = {}
    for i, text in items:
        w = words(text)
        n = min(k, len(w))
        if i is None or not w:
            continue
        mine = {tuple(w[p : p + n]) for p in range(len(w) - n + 1)}
        for d, body in docs:
            v = words(body)
            have = {tuple(v[p : p + n]) for p in range(len(v) - n + 1)}
            if d is not None and len(mine & have) >= t * len(mine) - 1e-9:
                out[d, i] = len(mine & have)
    return out


def test_matches_brute_force(spark):
    rnd = random.Random(7)
    word = lambda: f"w{rnd.randrange(60)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((1, 2, 3, 4, 5, 6, 12, 35, 90, 200))]
    items += [(20, None), (21, ""), (22, "..."), (None, "w1 w2"), (23, items[7][1]), (24, "w5, W5! w5 w5 w5 w5 w5")]
    docs = []
    for d in range(120):
        body = [word() for _ in range(rnd.choice((0, 1, 3, 6, 80, 400)))]
        if d % 3 == 0:
            copy = rnd.choice(items[4:10])[1].split()
            for _ in range(rnd.randrange(4)):
                copy[rnd.randrange(len(copy))] = "changed"
            body[len(body) // 2 : len(body) // 2] = copy
        docs.append((d, rnd.choice((" ", ", ", "\n")).join(body).upper()))
    docs += [(500, None), (501, ""), (None, items[8][1]), (502, "x " * 20_000 + items[9][1]), (502, "x " * 20_000 + items[9][1])]
    d = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, item_id string, size int")
    b = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id): r.shared for r in contained_items(d, b).collect()}
    assert got == plain(docs, items)
    # the stage judges each row by its own text
    bad = {k for k, _ in plain([(k, t) for k, (_, t) in enumerate(docs)], items)}
    left = decontaminated(d, b)
    assert left.columns == d.columns
    assert sorted(map(str, left.select("doc_id", "text").collect())) == sorted(f"Row(doc_id={i!r}, text={t!r})" for k, (i, t) in enumerate(docs) if k not in bad)
    assert any(docs[k][0] is None for k in bad)


def test_rows_not_ids_are_removed(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    half = item.split()
    docs = [(1, " ".join(half[:7])), (1, " ".join(half[5:])), (None, item), (None, "clean"), (2, item), (2, "clean too"), (3, None), (4, "")]
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in docs], "doc_id long, text string, same string, row string, `item.id` string")
    left = decontaminated(df, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert left.columns == df.columns
    assert sorted(map(str, left.select("doc_id", "text").collect())) == sorted(f"Row(doc_id={i!r}, text={t!r})" for i, t in docs if t != item)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert contained_items(none, items).count() == 0
    assert contained_items(docs, items.limit(0)).count() == 0
    assert contained_items(docs, items).first().containment == 1.0
    assert decontaminated(docs, items.limit(0)).count() == 1
