"""Licence scans: a trained paragraph classifier, in DataFrame and SQL functions only.

A paragraph runs to a blank line or to a line that ends a sentence; comment marks at line starts do
not count and wrapped lines are one.  Every one is scored by a sparse multinomial logistic regression
over word 1- to 3-grams, which is trained here on the notices below (whole, cut short, and inside
other words) against a bounded set of ordinary paragraphs.  The unknown class is calibrated on
ordinary paragraphs kept out of training: a family needs a probability above nearly all that those
get.  A prediction counts only if comparison with the family's own notices confirms it.

Most paragraphs need no arithmetic: from the fitted weights follows a set of words without any of
which no family can reach its probability, however the other words stand (``LicenceClassifier.cues``).
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pipetally.llm.shared import text_sample, written

# The usual short notices of each licence family.
NOTICES = {
    "agpl": ["This program is licensed under the GNU Affero General Public License, version 3.",
             "You can redistribute it under the terms of the GNU Affero General Public License as published by the Free Software Foundation."],
    "apache": ["Licensed under the Apache License, Version 2.0.",
               "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
               "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
               "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
            "Released under the BSD License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
            "SPDX-License-Identifier: BSD-3-Clause"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "Released under CC BY 4.0."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0": ["Released into the public domain under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 2.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
            "Distributed under the GPL v3.", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
            "Released under the ISC License."],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1.",
             "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."],
    "mit": ["Released under the MIT License.", "Licensed under the MIT license.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
            "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
            "SPDX-License-Identifier: MIT"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "proprietary": ["Copyright. All rights reserved. No part of this publication may be reproduced or distributed in any form without prior written permission of the publisher.",
                    "All rights reserved."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}
# Paragraphs of the licences' own texts and headers.
PARAGRAPHS = {
    "apache": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."],
    "agpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
             "You should have received a copy of the GNU Affero General Public License along with this program."],
    "bsd": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
            "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
            "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
            "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."],
    "gpl": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
            "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
            "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."],
    "isc": ["THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."],
    "lgpl": ["This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
             "You should have received a copy of the GNU Lesser General Public License along with this library."],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
            "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "mpl": ["If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "unlicense": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
}
#: Paragraphs that hold one of these are reported even if their licence is unknown.
CUES = r"(?i)licen[cs]|redistribut|copyright|public domain|permission (to|is)"
#: Words around a notice in training, so that no single one of them decides.
AROUND = ["", "note that", "see also", "this file is", "please read", "the text below applies", "unless stated otherwise"]
UNKNOWN = "unknown"
#: A notice of fewer word pairs trains, but is too short to confirm a prediction.
LEAST_PAIRS = 2
#: Ordinary texts, and paragraphs of them, for training and calibration (the bounds of the sample); least similarity.
SAMPLE_DOCS, SAMPLE_PARAGRAPHS, SIMILARITY = 1000, 4000, 0.6
#: Comment marks and quotes at the start of a line, and where a paragraph ends.
_MARKS = r"(?m)^[ \t]*(?:/\*+|\*+/|\*+(?=[ \t]|$)|//+|#+|--+|;+|%+|<!--|-->|>+)[ \t]*"
_ENDS = r"(?:\r\n?|[\n\x0B\f])(?:[ \t]*(?:\r\n?|[\n\x0B\f]))+|(?<=[.!?:;][\"')\]]{0,1}[ \t]{0,2})(?:\r\n?|[\n\x0B\f])"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _grams(w: Column, n: int) -> Column:
    """The runs of n words, joined; an array."""
    parts = [F.slice(w, i + 1, F.greatest(F.size(w) - (n - 1), F.lit(0))) for i in range(n)]
    return F.transform(F.arrays_zip(*parts), lambda z: F.concat_ws(" ", *[z[str(i)] for i in range(n)]))


def _all_grams(w: str = "w") -> Column:
    return F.concat(w, _grams(F.col(w), 2), _grams(F.col(w), 3))


def _constants(spark: SparkSession, rows: list[tuple[str, ...]], names: list[str]) -> DataFrame:
    """A table of constant texts, made in the plan."""
    structs = [F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def notices(spark: SparkSession) -> DataFrame:
    """(family, notice, tw): the short notices and the paragraphs of every family, and their words."""
    rows = [(f, n) for f, texts in sorted(NOTICES.items()) for n in [*texts, *PARAGRAPHS.get(f, [])]]
    return _constants(spark, rows, ["family", "notice"]).withColumn("tw", words_of(F.col("notice")))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph, text) of every paragraph of every text, from 0."""
    return docs.select("doc_id", F.posexplode(F.split(F.regexp_replace("text", _MARKS, ""), _ENDS)).alias("paragraph", "text"))


class LicenceClassifier:
    """The regression, its calibrated threshold, the words it needs, and the notices."""

    def __init__(self, docs: DataFrame, sample: int = SAMPLE_DOCS, most: int = SAMPLE_PARAGRAPHS, similarity: float = SIMILARITY, seed: int = 9):
        """Train against paragraphs without a cue, ``most`` at most, of ``sample`` different texts of ``docs``."""
        spark = docs.sparkSession
        self.similarity, self.names = similarity, [*sorted(NOTICES), UNKNOWN]
        tw = notices(spark)
        # the notices are constants: a few hundred short rows come to the driver
        self.templates = [(r.family, list(r.tw)) for r in tw.select("family", "tw").collect()]
        grams = [" ".join(w[i : i + n]) for _, w in self.templates for n in (1, 2, 3) for i in range(len(w) - n + 1)]
        self.vocabulary = list(dict.fromkeys(grams))
        around = _constants(spark, [(a, b) for a in AROUND for b in AROUND], ["a", "b"])
        whole = tw.join(F.broadcast(around), F.lit(True)).select("family", words_of(F.concat_ws(" ", "a", "notice", "b")).alias("w"))
        n = F.size("tw")
        cut = tw.filter(n > 9).select("family", F.explode(F.array(F.slice("tw", F.lit(1), F.ceil(n * 0.7).cast("int")), F.slice("tw", (n * 0.3).cast("int") + 1, n))).alias("w"))
        texts = text_sample(docs.select(F.lit(0).alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null"), "text", sample, seed)
        plain = paragraphs(texts).filter(~F.col("text").rlike(CUES)).select(words_of(F.col("text")).alias("w")).filter("size(w) > 0")
        held = F.concat(F.lit(" "), F.concat_ws(" ", "w"), F.lit(" "))
        plain = plain.filter(~held.rlike(f" (?:{'|'.join(sorted({' '.join(words) for _, words in self.templates}))}) "))
        plain = plain.distinct().orderBy(F.xxhash64(F.lit(seed), "w"), "w").limit(most)  # short rows, whose number the two bounds limit
        plain = written(plain.withColumns({"side": F.pmod(F.xxhash64("w"), F.lit(2)), "k": F.pmod(F.xxhash64(F.lit(1), "w"), F.lit(len(self.templates)))}), "licence-plain")
        # calibration paragraphs are like those that are hard: each holds a word that cues a licence, somewhere inside
        cues = F.array(*[F.lit(x) for x in ("license", "licensed", "copyright", "redistribute", "public domain", "permission to")])
        cue = F.element_at(cues, (F.pmod(F.xxhash64("w"), F.lit(6)) + 1).cast("int"))
        half = F.ceil(F.size("w") / 2).cast("int")
        cued = plain.withColumn("w", F.concat(F.slice("w", F.lit(1), half), F.split(cue, " "), F.slice("w", half + 1, F.size("w"))))
        none = plain.unionByName(cued).withColumn("family", F.lit(UNKNOWN))
        # and notices stand inside ordinary words too
        numbered = tw.select("family", "tw", F.row_number().over(_by_notice()).alias("k")).withColumn("k", (F.col("k") - 1).cast("long"))
        inside = plain.filter("side = 0").join(F.broadcast(numbered), "k").select("family", F.concat(F.slice("w", F.lit(1), half), "tw", F.slice("w", half + 1, F.size("w"))).alias("w"))
        rows = whole.unionByName(cut).unionByName(inside).unionByName(none.filter("side = 0").select("family", "w"))
        label = F.array_position(F.array(*[F.lit(x) for x in self.names]), F.col("family")).cast("double") - 1
        self.vectors = CountVectorizerModel.from_vocabulary(self.vocabulary, inputCol="grams", outputCol="features", minTF=1.0).setBinary(True)
        train = self._features(rows).select("family", "w", "features", label.alias("label"))
        train = written(train.coalesce(4), "licence-train")
        # both kinds of rows weigh the same in all
        by = {r[0]: r[1] for r in train.groupBy(F.col("family") == UNKNOWN).count().collect()}
        weight = F.when(F.col("family") == UNKNOWN, 1.0 / max(by.get(True, 0), 1)).otherwise(1.0 / max(by.get(False, 0), 1)) * sum(by.values()) / 2
        lr = LogisticRegression(family="multinomial", regParam=0.0005, elasticNetParam=0.5, maxIter=40, tol=1e-5, weightCol="weight")
        # a few thousand short rows: one partition spares each iteration a round of small tasks
        self.model = lr.fit(train.select("features", "label", weight.alias("weight")).coalesce(1))
        q = self._scored(none.filter("side = 1").select("w")).agg(F.percentile_approx("probability", 0.99, 10_000).alias("q")).first()["q"]
        self.least = max(0.5, q or 0.0)
        ordinary = none.select(F.explode("w").alias("x")).filter(F.col("x").isin([g for g in self.vocabulary if " " not in g])).groupBy("x").count().collect()
        self.cues = self._needed({r["x"]: r["count"] for r in ordinary})

    def _features(self, rows: DataFrame) -> DataFrame:
        return self.vectors.transform(rows.withColumn("grams", _all_grams()))

    def _scored(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with words ``w``) with the likeliest family, ``predicted``, and its ``probability``."""
        p = self.model.transform(self._features(rows)).withColumn("p", vector_to_array("probability"))
        fam = F.slice("p", 1, len(self.names) - 1)
        best = F.array_max(fam)
        named = F.element_at(F.array(*[F.lit(x) for x in self.names]), F.array_position(fam, best).cast("int"))
        return p.select(*rows.columns, best.alias("probability"), named.alias("predicted"))

    def _needed(self, ordinary: dict[str, int]) -> list[str] | None:
        """Words without which no paragraph gets a family; None if even one without any known gram does.

        A family's probability is above ``least`` only if its score exceeds that of the unknown class by
        logit(least).  A paragraph with none of the words has at most the intercepts and all positive
        differences of the grams without such a word; words are added, rare ones first, until that is too little.
        """
        need = math.log(self.least / (1 - self.least))
        rows, at = self.model.coefficientMatrix.toArray().tolist(), self.model.interceptVector.toArray().tolist()
        parts, words = [g.split(" ") for g in self.vocabulary], set()
        for f in range(len(self.names) - 1):
            base = at[f] - at[-1]
            if base > need:
                return None
            gain = {g: d for g, d in ((g, rows[f][g] - rows[-1][g]) for g in range(len(parts))) if d > 0 and words.isdisjoint(parts[g])}
            while base + sum(gain.values()) > need:
                share: dict[str, float] = {}
                for g, d in gain.items():
                    for w in set(parts[g]):
                        share[w] = share.get(w, 0.0) + d
                words.add(max(sorted(share), key=lambda w: share[w] / (1 + ordinary.get(w, 0))))
                gain = {g: d for g, d in gain.items() if words.isdisjoint(parts[g])}
        return sorted(words)

    def scan(self, docs: DataFrame) -> DataFrame:
        """(doc_id, paragraph, family, probability, similarity, confirmed) of each licence paragraph.

        Every paragraph with words is judged; those with a family, and those with a cue, are returned.
        ``family`` is ``unknown`` where the probability is not above the calibrated threshold; of families
        with one probability the first by name is taken; ``confirmed`` says that a notice of the family
        shares enough word pairs.  Null and empty texts have no paragraphs; a null or repeated doc_id is
        carried along; other columns are not looked at; an empty table gives an empty result.
        """
        known = F.col("probability") > self.least
        cued = F.col("text").rlike(CUES)
        texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
        needed = F.lit(True) if self.cues is None else F.arrays_overlap("w", F.array(*[F.lit(w) for w in self.cues]).cast("array<string>"))
        # a text that has none of the words has no paragraph that has
        texts = texts.withColumn("w", words_of(F.col("text"))).filter(needed | cued).select("doc_id", "text")
        rows = paragraphs(texts).select("doc_id", "paragraph", cued.alias("cue"), words_of(F.col("text")).alias("w")).filter((needed | F.col("cue")) & (F.size("w") > 0))
        rows = self._scored(rows).filter(known | F.col("cue"))
        rows = rows.withColumn("pairs", F.array_distinct(_grams(F.col("w"), 2)))
        best = F.lit(0.0)
        for family, words in self.templates:
            g = list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))
            if len(g) >= LEAST_PAIRS:
                like = F.size(F.array_intersect("pairs", F.array(*[F.lit(x) for x in g]))) / F.least(F.lit(len(g)), F.greatest(F.size("pairs"), F.lit(4)))
                best = F.greatest(best, F.when(F.col("predicted") == family, like).otherwise(0.0))
        rows = rows.withColumn("similarity", best)
        return rows.select(
            "doc_id", "paragraph", F.when(known, F.col("predicted")).otherwise(UNKNOWN).alias("family"), "probability", "similarity",
            (known & (F.col("similarity") >= self.similarity)).alias("confirmed"),
        )


def _by_notice():
    return W.orderBy("family", "notice")  # the constants above


def document_licences(found: DataFrame) -> DataFrame:
    """(doc_id, licences): the confirmed families of each document that has one, sorted."""
    return found.filter("confirmed").groupBy("doc_id").agg(F.sort_array(F.collect_set("family")).alias("licences"))


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return LicenceClassifier(docs).scan(docs)


QUERIES = {"op9_license_scans": op9_license_scans}
