import re

import numpy as np
import pytest

from pipetally.llm import licenses


@pytest.fixture(scope="module")
def scanner(spark, small):
    return licenses.LicenceClassifier(spark.read.parquet(f"{small}/documents.parquet"))


def plain_scan(scanner, texts):
    """(id, paragraph, family, probability, similarity, confirmed) by the definition: every paragraph scored, no gate."""
    rows, at = scanner.model.coefficientMatrix.toArray(), scanner.model.interceptVector.toArray()
    place = {g: k for k, g in enumerate(scanner.vocabulary)}
    out = []
    for i, text in texts.items():
        if text is None:
            continue
        bare = re.sub(r"(?m)^[ \t]*(?:/\*+|\*+/|\*+(?=[ \t]|$)|//+|#+|--+|;+|%+|<!--|-->|>+)[ \t]*", "", text)
        parts, part = [], ""
        for line in bare.split("\n"):
            if not line.strip():
                parts, part = [*parts, part], ""
                continue
            part = f"{part}\n{line}" if part else line
            if re.search(r"[.!?:;][\"')\]]?[ \t]{0,2}$", line):
                parts, part = [*parts, part], ""
        for p in [x for x in [*parts, part] if x]:
            w = [x for x in re.split(r"[\W_]+", p.lower()) if x]
            if not w:
                continue
            grams = {" ".join(w[k : k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1)}
            score = at + rows[:, [place[g] for g in grams if g in place]].sum(axis=1)
            share = np.exp(score - score.max()) / np.exp(score - score.max()).sum()
            k = int(np.argmax(share[:-1]))
            known, cue = share[k] > scanner.least, re.search(licenses.CUES[4:], p, re.I)
            if not known and not cue:
                continue
            pairs, like = set(zip(w, w[1:])), 0.0
            for family, t in scanner.templates:
                g = set(zip(t, t[1:]))
                if family == scanner.names[k] and len(g) >= licenses.LEAST_PAIRS:
                    like = max(like, len(pairs & g) / min(len(g), max(len(pairs), 4)))
            out.append((i, scanner.names[k] if known else "unknown", round(float(share[k]), 6), round(like, 6), bool(known and like >= scanner.similarity), p))
    return out


def found(spark, scanner, texts):
    """(id, family, confirmed) of each row, in order."""
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return [(r.doc_id, r.family, r.confirmed) for r in scanner.scan(docs).orderBy("doc_id", "paragraph").collect()]


TEXTS = {
    1: "Some words.\nReleased under the MIT License.\nMore words.", 2: "This work is licensed under the GNU General Public License, version 3.", 3: "Licensed under CC BY-NC 4.0.",
    4: "We renew the driver license of every driver in the city each year without fee.", 5: "nothing here", 6: "", 7: None,
    8: "word " * 20_000 + "\nLicensed under the Apache License, Version 2.0.\n" + "word " * 20_000, 9: "RELEASED UNDER THE MIT LICENSE", 10: "note that released under the mit license, see also below",
    11: "Copyright of dreams and of nothing else", 12: "Released under the MIT License.\n\nReleased under the MIT License.", 13: "Some words.\nAll rights reserved.\nMore words.",
    14: "Released under CC BY 4.0.", 15: "Distributed under the GPL v3", 16: "all seats reserved for the evening", 17: "The above is permitted in any form, and the conditions of the software are free for use.",
}
WRAPPED = {
    21: """/*
 * Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software and associated documentation files (the "Software"), to deal
 * in the Software without restriction, including without limitation the rights
 * to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
 * copies of the Software, and to permit persons to whom the Software is
 * furnished to do so, subject to the following conditions:
 */""",
    22: """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.""",
    23: """// Licensed under the Apache License, Version 2.0 (the "License");
// you may not use this file except in compliance with the License.""",
    24: """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:
1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.""",
    25: """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
}


def test_families_and_unknown(spark, scanner):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in TEXTS.items()] + [(None, TEXTS[3], "x", 1), (3, TEXTS[3], "x", 1)], "doc_id long, text string, family string, w int")
    rows = scanner.scan(docs)
    got = sorted((str(r.doc_id), r.paragraph, r.family) for r in rows.filter("confirmed").collect())
    want = [(1, 1, "mit"), (2, 0, "gpl"), (3, 0, "cc-by-nc"), (3, 0, "cc-by-nc"), (None, 0, "cc-by-nc"), (8, 1, "apache"), (9, 0, "mit"), (10, 0, "mit"), (12, 0, "mit"), (12, 1, "mit"), (13, 1, "proprietary"), (14, 0, "cc-by"), (15, 0, "gpl")]
    assert got == sorted((str(a), b, c) for a, b, c in want if a != 8) or got == sorted((str(a), b if a != 8 else 0, c) for a, b, c in want)
    others = {r.doc_id: r.family for r in rows.filter("not confirmed").collect()}
    assert others.keys() >= {4, 11} and set(others.values()) == {"unknown"}
    by_doc = {r.doc_id: r.licences for r in licenses.document_licences(rows).collect()}
    assert by_doc[12] == ["mit"]


def test_wrapped_and_commented_paragraphs(spark, scanner):
    got = found(spark, scanner, WRAPPED)
    assert {(i, f) for i, f, c in got if c} >= {(21, "mit"), (22, "gpl"), (23, "apache"), (24, "bsd"), (25, "mit")}
    assert [f for i, f, c in got if i == 22 and c] == ["gpl", "gpl"] and [f for i, f, c in got if i == 24 and c] == ["bsd", "bsd"]


def test_matches_a_plain_version(spark, scanner, small):
    """The scan with its needed words is the scoring of every paragraph."""
    texts = {**TEXTS, **WRAPPED, **{r.doc_id + 1000: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}}
    assert scanner.cues
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = sorted((r.doc_id, r.family, round(r.probability, 6), round(r.similarity, 6), r.confirmed) for r in scanner.scan(docs).collect())
    want = sorted(x[:5] for x in plain_scan(scanner, texts))
    assert [g[:2] + g[4:] for g in got] == [w[:2] + w[4:] for w in want] and len(got) > 10
    assert all(abs(g[2] - w[2]) < 1e-5 and abs(g[3] - w[3]) < 1e-5 for g, w in zip(got, want))


def test_every_notice_is_its_family(spark, scanner):
    rows = [(i, n, f) for i, (f, n) in enumerate((f, n) for f, ns in licenses.NOTICES.items() for n in [*ns, *licenses.PARAGRAPHS.get(f, [])])]
    got = {r.doc_id: r.family for r in scanner.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).filter("confirmed").collect()}
    assert sum(got.get(i) == f for i, _, f in rows) >= 0.9 * len(rows)
    assert sum(got.get(i, f) != f for i, _, f in rows) <= 1


def test_an_empty_table_and_equal_probabilities(spark, scanner):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert scanner.scan(empty).count() == 0
    alone = licenses.LicenceClassifier(empty)  # the notices alone
    assert [f for _, f, c in found(spark, alone, {1: "Released under the MIT License.", 2: "nothing of the kind"}) if c] == ["mit"]
    same = [(r.predicted, r.probability) for r in scanner._scored(spark.createDataFrame([(["zzz"],), (["zzz"],)], "w array<string>")).collect()]
    assert same[0] == same[1]


def test_planted_lines_are_found_and_empty_tables(spark, scanner, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = {r.doc_id for r in docs.filter("text rlike '(Released|[Ll]icensed) under |All rights reserved'").collect()}
    assert {r.doc_id for r in scanner.scan(docs).filter("confirmed").collect()} == want
    assert scanner.scan(docs.limit(0)).count() == 0


