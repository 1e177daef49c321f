import math
import random
import re

from pyspark.sql import functions as F

from pipetally.llm import langid


def test_held_out_accuracy(spark, small):
    docs = spark.read.parquet(f"{small.replace('sf0.001', 'sf0.01')}/documents.parquet")
    out = langid.op4_language_id(spark, small.replace("sf0.001", "sf0.01")).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    right, n = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 100 and right > 0.99


def model_of(counts, docs, kept=None):
    """A model of all the words of ``counts``, its n-grams counted here."""
    grams, totals = {}, {}
    for (lang, w), n in counts.items():
        totals[lang, 0] = totals.get((lang, 0), 0) + n
        for size in range(1, langid.LONGEST + 1):
            for g in langid.grams_of(w, size):
                grams[lang, g] = grams.get((lang, g), 0) + n
                totals[lang, size] = totals.get((lang, size), 0) + n
    langs = sorted(docs)
    return langid.LanguageModel(langid.counts_of(counts, langs, 0), langid.counts_of(grams, langs), totals, docs)


def shown(model, table):
    t = model.words if table == "words" else model.grams
    return {int(k): sorted(zip(t.lang[a:b].tolist(), t.more[a:b].tolist())) for k, a, b in zip(t.keys, t.ends, t.ends[1:])}


def plain_prediction(counts, docs, text):
    """Language and score by the definition: words first, else the longest known n-grams, down to one letter."""
    words = [w for w in re.findall(r"[^\W\d_]+", text.lower())]
    if not words:
        return "und", 0.0
    tables = {0: counts}
    for size in range(1, 6):
        tables[size] = {}
        for (lang, w), n in counts.items():
            m = f"^{w}$"
            for i in range(len(m) - size + 1):
                if m[i : i + size] not in "^$":
                    key = lang, m[i : i + size]
                    tables[size][key] = tables[size].get(key, 0) + n

    def log(size, lang, key):
        t = tables[size]
        return math.log(t.get((lang, key), 0) + 0.5) - math.log(sum(n for (g, _), n in t.items() if g == lang) + 0.5 * (len({k for _, k in t}) + 1))

    total = {lang: math.log(n / sum(docs.values())) for lang, n in docs.items()}
    for w in words:
        m = f"^{w}$"
        for size in (0, 5, 4, 3, 2, 1):
            keys = [w] if size == 0 else [m[i : i + size] for i in range(len(m) - size + 1)]
            known = [k for k in keys if any((lang, k) in tables[size] for lang in docs)]
            if known:
                for lang in total:
                    total[lang] += sum(log(size, lang, k) for k in known) / len(known)
                break
    best = max(sorted(total), key=total.get)
    return best, 1 / sum(math.exp((v - total[best]) / math.sqrt(len(words))) for v in total.values())


def test_words_first_then_shorter_ngrams():
    counts = {("en", "the"): 50, ("en", "thing"): 9, ("de", "der"): 50, ("de", "ding"): 9, ("de", "schule"): 5}
    m = model_of(counts, {"en": 10, "de": 10})
    best = lambda w: m.langs[int(m.backed_off([w])[0].argmax())]
    assert best("schulen") == "de" and best("things") == "en"
    assert m.predict("the der the", {})[0] == "en"
    assert not m.backed_off(["ωωω"]).any()


def test_matches_a_plain_version():
    rnd = random.Random(5)
    word = lambda letters: "".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 9)))
    alphabets = {"aa": "abcdef", "bb": "defghi", "cc": "éèfgh"}
    counts = {}
    for lang, letters in alphabets.items():
        for _ in range(60):
            counts[lang, word(letters)] = rnd.randrange(1, 9)
    docs = {"aa": 30, "bb": 5, "cc": 10}
    m = model_of(counts, docs)
    for _ in range(150):
        letters = rnd.choice([*alphabets.values(), "abcdefghié", "xyz"])
        text = " ".join(rnd.choice([w for _, w in counts]) if rnd.random() < 0.4 else word(letters) for _ in range(rnd.randrange(0, 12)))
        got, want = m.predict(text, {}), plain_prediction(counts, docs, text)
        assert got[0] == want[0] and abs(got[1] - want[1]) < 1e-4


def test_fit_counts_all_words_and_ngrams(spark):
    texts = [("aa", "one two two"), ("bb", "two drei drei ß"), ("aa", "ONE seen")]
    m = langid.fit(spark.createDataFrame([(t, g) for g, t in texts], "text string, lang string"))
    counts = {("aa", "one"): 2, ("aa", "two"): 2, ("aa", "seen"): 1, ("bb", "two"): 1, ("bb", "drei"): 2, ("bb", "ß"): 1}
    want = model_of(counts, {"aa": 2, "bb": 1})
    assert all(shown(m, t) == shown(want, t) for t in ("words", "grams")) and abs(m.never - want.never).max() < 1e-12
    assert set(shown(m, "words")) == {langid.hash_of(w) for _, w in counts}


def test_the_model_of_a_table_is_the_plain_one(spark, small):
    """Every word of the sample is kept, however rare."""
    docs = spark.read.parquet(f"{small.replace('sf0.001', 'sf0.01')}/documents.parquet").select("text", "lang")
    m = langid.fit(docs)
    counts, by_lang = {}, {}
    for r in docs.filter("text is not null and lang is not null").distinct().collect():
        by_lang[r.lang] = by_lang.get(r.lang, 0) + 1
        for w in langid.words_of(r.text):
            counts[r.lang, w] = counts.get((r.lang, w), 0) + 1
    want = model_of(counts, by_lang)
    assert len(m.words.keys) == len({w for _, w in counts}) > 40_000
    assert all(shown(m, t) == shown(want, t) for t in ("words", "grams")) and abs(m.never - want.never).max() < 1e-12
    for text in ("an entirely unseenword hier", "qqq", "la der the"):
        got, plain = m.predict(text, {}), plain_prediction(counts, by_lang, text)
        assert got[0] == plain[0] and abs(got[1] - plain[1]) < 1e-4


def test_the_sample_is_bounded_in_bytes(spark):
    words = [f"only{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10]}" for i in range(50)]
    rows = [(f"{w} " * 100, "en") for w in words] + [("sehr lang " * 1000, "de")]
    m = langid.fit(spark.createDataFrame(rows, "text string, lang string"), most=5000)
    assert int((m.words.find(words) >= 0).sum()) == 7 and m.words.find(["sehr"])[0] >= 0  # 7 texts of 700 bytes, and one larger one
    assert langid.fit(spark.createDataFrame(rows, "text string, lang string"), most=5000).langs == ["de", "en"]


def test_all_of_a_run_counts():
    m = model_of({("en", "thering"): 20, ("en", "withal"): 20, ("de", "schung"): 20, ("de", "keit"): 20}, {"en": 1, "de": 1})
    assert m.predict("thering" * 5 + "schung" * 500, {})[0] == "de" and m.predict("schung" * 5 + "thering" * 50_000, {})[0] == "en"


def test_a_rare_language_keeps_its_words(spark):
    """Neither a large language nor a repeated text takes the room of a language with one document."""
    large = [(f"common{i} words{i} of{i} this", "en") for i in range(400)] + [("the very same text", "en")] * 2000
    m = langid.fit(spark.createDataFrame([*large, ("seltene wörter einer sprache", "de")], "text string, lang string"), sample=50)
    assert (m.words.find(["seltene", "wörter", "einer", "sprache"]) >= 0).all() and m.langs == ["de", "en"]
    assert m.predict("seltene sprache", {})[0] == "de"


def test_odd_rows(spark):
    train = [(t, lang) for lang, t in (("en", "the cat and the dog"), ("de", "der hund und die katze")) for _ in range(5)] + [(None, "en"), ("the", None)]
    m = langid.fit(spark.createDataFrame(train, "text string, lang string"))
    rows = [(1, None), (2, ""), (3, "123 ... _ ²"), (4, "THE DOG"), (None, "und die"), (4, "THE DOG"), (5, "the " * 50_000), (6, "q" * 100_000)]
    docs = spark.createDataFrame([(*r, "zz", 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    got = [(r.doc_id, r.lang_pred, round(r.score, 3)) for r in langid.with_language(docs, m).collect()]
    by = {d: (x, s) for d, x, s in got}
    assert by[1] == by[2] == by[3] == ("und", 0.0) and by[4][0] == "en" and by[None][0] == "de" and by[5][0] == "en"
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, _, s in got)
    assert langid.with_language(docs.limit(0), m).count() == 0
    tie = model_of({("aa", "x"): 1, ("bb", "x"): 1}, {"aa": 1, "bb": 1})
    assert tie.predict("x", {}) == ("aa", 0.5)
    none = langid.fit(spark.createDataFrame([], "text string, lang string"))
    assert langid.with_language(docs, none).filter("lang_pred <> 'und'").count() == 0
