import hashlib
import random
from collections import defaultdict

from pipetally.llm import mixing


def share(amount, children):
    """Water-filling among (key, cap, weight), by whole division."""
    got, left, open_ = {}, amount, sorted(children, key=lambda c: (c[1] / c[2], c[0]))
    while open_:
        k, cap, w = open_[0]
        total = sum(c[2] for c in open_)
        if cap * total > left * w:
            return got | {k: left * w // total for k, _, w in open_}
        got[k] = cap
        left -= cap
        open_.pop(0)
    return got


def plain(rows, weights, domains, percent, epochs, seed):
    leaf, tokens = defaultdict(list), defaultdict(int)
    for doc_id, text, lang, source in rows:
        dom = next((k for k, v in domains.items() if source in v), "other")
        key = (dom, "none" if lang is None else lang, "none" if source is None else source)
        name = f"{'none' if doc_id is None else doc_id}|{hashlib.md5((text or '').encode()).hexdigest()}"
        leaf[key].append((doc_id, len((text or "").split()), name))
        tokens[key] += len((text or "").split())
    cap = {k: v * epochs for k, v in tokens.items()}
    given = {(): min(sum(tokens.values()) * percent // 100, sum(cap.values()))}
    for n, level in enumerate(("domain", "lang", "source")):
        nxt = {}
        for parent, amount in given.items():
            kids = sorted({k[n] for k in cap if k[:n] == parent})
            part = share(amount, [(c, sum(v for k, v in cap.items() if k[: n + 1] == (*parent, c)), weights.get(level, {}).get(c, 1)) for c in kids])
            nxt |= {(*parent, c): v for c, v in part.items()}
        given = nxt
    out = []
    for key, docs in leaf.items():
        full, rest = divmod(given[key], tokens[key]) if tokens[key] else (0, given[key])
        place = lambda name: hashlib.md5(f"{seed}|{full}|{name}".encode()).hexdigest()  # noqa: E731, B023
        order = sorted((place(name), str(d), n) for d, n, name in docs)
        run, picked = 0, set()
        for k in sorted({k for k, _, _ in order}):
            run += sum(n for h, _, n in order if h == k)
            if rest and run <= rest:
                picked.add(k)
        for d, n, name in docs:
            out += [(str(d), *key, e, n) for e in range(full + (place(name) in picked))]
    return sorted(out)


def test_matches_plain_budgeting(spark):
    rnd = random.Random(5)
    domains, weights = {"web": ["a", "b"], "news": ["c"]}, {"domain": {"web": 3, "other": 2}, "lang": {"en": 4}, "source": {"b": 5}}
    rows = [(i, "w " * rnd.choice((0, 1, 5, 40)), rnd.choice(("en", "de", None)), rnd.choice(("a", "a", "a", "b", "c", "d", None))) for i in range(400)]
    rows += [(None, f"x{i}", "en", "a") for i in range(30)] + [(None, "x y", "en", "a"), (None, "x y", "en", "a"), (3, "other", "en", "a"), (3, "w w", "en", "a"), (3, "w w", "en", "a"), (900, None, "en", "b"), (901, "long " * 30_000, "fr", "e")]
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, lang string, source string, domain string, name int")
    for percent, epochs in ((60, 1), (90, 2), (150, 3), (400, 2)):
        got = mixing.mixed(docs, weights=weights, domains=domains, percent=percent, epochs=epochs, seed="s")
        assert got.select("doc.*").columns == docs.columns
        got = sorted((str(r.doc.doc_id), r.domain, r.lang, r.source, r.epoch, r.tokens) for r in got.collect())
        assert got == plain(rows, weights, domains, percent, epochs, "s")


def test_shortage_goes_to_siblings_before_ancestors(spark):
    leaves = [("web", "en", "a", 10), ("web", "en", "b", 1000), ("news", "en", "c", 1000)]
    df = spark.createDataFrame([(*x, 1) for x in leaves], "domain string, lang string, source string, tokens long, docs long")
    got = {r.source: r.got for r in mixing.leaf_budgets(df, {}, percent=20, epochs=1).collect()}
    assert got == {"a": 10, "b": 191, "c": 201}  # 402 tokens: the domains share evenly, and b takes what a lacks


def test_empty_table(spark):
    assert mixing.mixed(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0
