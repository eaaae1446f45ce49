"""License scans, quality rules, language ID and the quality classifier against plain Python."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from kithgraph.llm import language_id, license_scan, quality_model, quality_rules, simhash, similar, textbytes
from kithgraph.llm.queries import ORACLE_SQL, QUERIES
from pyspark.sql import functions as F
from tests.llm.conftest import SF, clashing, rows

LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def _licenses(doc_id, text):
    """Every beginning by every template, word by word."""
    w = LICENSE_WORD.findall((text or "").translate(LOWER))
    templates = license_scan.TEMPLATES
    index = license_scan.index_of(templates)
    need = license_scan.needed(templates, index)
    base, labels, score = [], set(), 0.0
    for n, t in enumerate(templates):
        own = [a for a in index if a.template == n]
        for d in sorted({i - a.at for a in own for i in range(len(w)) if w[i] == a.word}):
            share = sum(any(w[k] == a.word for k in range(max(0, d + a.at), min(len(w), d + a.at + t.tolerance + 1))) for a in own)
            keys = (any(w[k : k + size] == p.split() for k in range(max(0, d + at - t.tolerance), d + at + t.tolerance + 1)) for at, size, p in t.keys)
            if share >= need[n] and all(keys):
                labels.add(t.label)
                score = max(score, share / len(own) * t.specific)
                if t.base:
                    assert w[d : d + len(t.words)] == list(t.words)
                    base.append((d, t.label))
    places = [d for d, _ in base]
    return doc_id, len(w), len(base), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), score


def test_license_scan(docs, odd, nothing):
    for df in (docs.limit(100), odd.where("doc_id is null or doc_id <> 4"), clashing(odd).where("doc_id <> 4")):
        got = rows(license_scan.summarised(license_scan.scan(df)))
        assert got == sorted((_licenses(r["doc_id"], r["text"]) for r in df.collect()), key=repr)
    assert license_scan.scan(nothing).collect() == []


def test_base_phrases_at_all_places(spark):
    texts = ["under the MIT license " * 5, "cc-by-nc cc by cc by nc", "Apache License, Version 2 under the mit license apache license version 2.0", "UNDER THE MIT licens", "nc by cc", "under the mit\u00e9 license"]
    got = license_scan.summarised(license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    found = {r["doc_id"]: (r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got}
    assert found == {0: (5, 0, 16, "mit"), 1: (2, 0, 5, "cc-by-nc"), 2: (3, 0, 8, "apache-2,mit"), 3: (0, None, None, ""), 4: (0, None, None, ""), 5: (0, None, None, "")}


#: Licences as they stand in real files.
MIT = """The MIT License (MIT)

Copyright (c) 2014 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
BSD = """Copyright (c) 2009, Somebody. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

* Redistributions of source code must retain the above copyright notice, this
  list of conditions and the following disclaimer.
* Redistributions in binary form must reproduce the above copyright notice,
  this list of conditions and the following disclaimer in the documentation
  and/or other materials provided with the distribution.
* Neither the name of Somebody nor the names of its contributors may be used to
  endorse or promote products derived from this software without specific prior
  written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT OWNER OR CONTRIBUTORS BE LIABLE FOR
ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON
ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
APACHE = """Copyright 2016 The Authors. All rights reserved.

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL = """This file is part of Something.

Something is free software. This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
ISC = """Copyright (c) 2017, Somebody

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""


def test_licences_are_found(spark):
    """As they stand, lightly edited, inside other text, and one sentence alone."""
    edits = {"modification": "modifications", "person": "human person", "AUTHORS": "ORIGINAL AUTHORS OF THIS WORK", "DIRECT": "DIRECT OR OTHER", "WHATSOEVER": "", "useful": "of some use"}
    texts, want = [], []
    for text, label in ((MIT, "mit"), (BSD, "bsd"), (BSD, "bsd-3"), (APACHE, "apache-2"), (GPL, "gpl-3"), (ISC, "isc")):
        edited = text
        for a, b in edits.items():
            edited = edited.replace(a, b)
        texts += [text, edited, "# ".join(f"{line}\n" for line in text.split("\n")), "words before it " * 300 + text + " words behind it" * 300]
        want += [label] * 4
    sentence = " ".join(MIT.split()[8:29])
    texts += [sentence, "nothing of the kind is granted to persons of this software", MIT.split("Permission")[0], " ".join(reversed(MIT.split()))]
    want += ["mit", None, None, None]
    got = {r["doc_id"]: r for r in license_scan.summarised(license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    for k, label in enumerate(want):
        labels = set(filter(None, got[k]["labels"].split(",")))
        assert (label in labels) if label else not labels, (label, labels, texts[k][:80])
        assert 0 <= got[k]["score"] <= 1
    assert got[0]["score"] >= got[1]["score"] > 0.5
    assert set(got[2]["labels"].split(",")) <= {"mit"} and "mit" not in got[20]["labels"].split(",")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_gives_the_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    found = con.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(found.columns)
    assert rows(got.select(*sorted(got.columns))) == sorted(found.project(", ".join(sorted(got.columns))).fetchall(), key=repr)


def _rules(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def test_quality_rules(docs, odd, nothing):
    for df in (docs, odd, clashing(odd)):
        got = rows(quality_rules.judged(df, most=2))
        data = df.collect()
        holders, texts = defaultdict(set), {}
        for r in data:
            for line in (r["text"] or "").split("\n"):
                if WORD.search(line):
                    holders[r["source"], " ".join(WORD.findall(line)).translate(LOWER)].add(r["doc_id"] if r["doc_id"] is not None else object())
        for r in data:
            left = sum(len(WORD.findall(line)) for line in (r["text"] or "").split("\n") if len(holders[r["source"], " ".join(WORD.findall(line)).translate(LOWER)]) <= 2)
            base = _rules(r["text"])
            failed = base[0] < 20 or 100 * base[4] > 30 * base[0]
            kept = not failed and left >= quality_rules.LEAST_WORDS and left >= quality_rules.LEAST_PART * base[0]
            texts.setdefault(repr((r["doc_id"], *base, left, failed, kept)), []).append(1)
        assert sorted(map(repr, got)) == sorted(k for k, v in texts.items() for _ in v)
    assert quality_rules.judged(nothing).collect() == []


def test_frequent_lines_deplete(spark):
    line = "the very same line of many words that stands in all of them again and again and again"
    made = [(k, f"{line}\nonly {k} own", "h", None, None) for k in range(40)] + [(100 + k, " ".join(f"w{k}x{i}" for i in range(40)), "h", None, None) for k in range(5)]
    df = spark.createDataFrame([(a, b, "en", c, None) for a, b, c, *_ in made], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in quality_rules.judged(df).where("kept").collect()}
    assert kept == {100, 101, 102, 103, 104}


def test_copies_are_documents_and_repeated_rows_are_not(spark):
    text = " ".join(f"w{i}" for i in range(50))
    made = [(k, text, "en", "copies", None) for k in range(60)] + [(100, text, "en", "rows", None)] * 60 + [(None, text, "en", "none", None)] * 60 + [(k, text, "en", "few", None) for k in range(200, 220)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r["doc_id"] is None, (r["doc_id"] or 0) // 100) for r in quality_rules.judged(df).where("kept").collect())
    assert got == {(False, 1): 60, (False, 2): 20}


def test_the_limit_does_not_grow_with_the_host(spark):
    """A line of 21 documents is frequent in a host of thousands too."""
    line = "a line of boilerplate that some documents share and nothing else in it at all to be said here"
    made = [(k, f"{line}\nown {k}" if k < 21 else " ".join(f"w{k}x{i}" for i in range(30)), "en", "hot", None) for k in range(12_000)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in quality_rules.judged(df).where("not kept").collect()} == set(range(21))


def _thue_morse(n: int) -> tuple[str, str]:
    bits = [k.bit_count() & 1 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_texts_of_much_structure_do_not_collide(spark):
    for n in (2048, 4096):
        a, b = _thue_morse(n)
        words = " ".join([a, b] * 5 + [b, a] * 4)
        text = f"{a}\n{b}\n{words}"
        (row,) = quality_rules.judged(spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")).collect()
        assert tuple(row)[1:6] == _rules(text) and row["n_dup_lines"] == 0


def test_long_texts_are_worked_on_in_stretches(monkeypatch):
    """Small stretches give what one gives."""
    rng = np.random.default_rng(4)
    text = "".join(rng.choice(["word", "Ünï", " ", "  ", "\n", "\t", "x" * 90, "#", "one two three four five six seven eight\n", "漢字"], 4000)).encode()
    whole = (quality_rules.counts_of(text), simhash.fingerprint_of(text), sorted(np.concatenate(list(quality_model.features(text)))), similar.shingles_of(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0].tolist())
    plain = textbytes.stretches
    cut = lambda t: plain(t, 50)
    for module in (textbytes, quality_rules, simhash, quality_model):
        monkeypatch.setattr(module, "stretches", cut)
    monkeypatch.setattr(quality_rules, "STRETCH_BYTES", 50)
    monkeypatch.setattr(quality_model, "_AT_ONCE", 64)
    assert b"".join(cut(text)) == text and len(list(cut(text))) > 100
    assert (quality_rules.counts_of(text), simhash.fingerprint_of(text), sorted(np.concatenate(list(quality_model.features(text)))), similar.shingles_of(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0].tolist()) == whole


def test_language_id(spark, docs, odd, nothing):
    network = language_id.fit(docs)
    got = language_id.predicted(docs, network).collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["lang"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)
    found = {(r["doc_id"], r["text"]): r for r in language_id.predicted(clashing(odd), network).collect()}
    for (_, text), r in found.items():
        assert (r["lang_pred"] == "und") == (text is None or not re.search(r"[^\W\d_]", text))
    assert language_id.predicted(nothing, network).collect() == []
    assert language_id.fit(nothing) is None
    assert {r["lang_pred"] for r in language_id.predicted(odd, None).collect()} == {"und"}


def test_rare_languages_are_learnt(spark):
    made = [(70 * k + i, f"word{i} " * 20, f"l{i:02}", "a", None) for i in range(70) for k in range(4 + (i < 64))]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long")
    named = {r[2] for r in made if zlib.crc32(str(r[0]).encode()) % 5}
    assert len(named) > 64 and set(language_id.fit(df).languages) == named


def test_tables_agree_with_the_network(docs):
    network = language_id.fit(docs, sample=20)
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (50, language_id.WINDOW), np.uint8)
    e = network.embedding[x]
    top = [sum(e[:, k : x.shape[1] - len(w) + 1 + k] @ w[k] for k in range(len(w))).max(axis=1) for w in network.filters]
    expected = language_id._softmax(np.maximum(np.concatenate(top, axis=1) + network.filter_bias, 0) @ network.out + network.out_bias)
    assert np.abs(network.scorer().windows(x) - expected).max() < 0.01


def test_predictions_do_not_depend_on_the_id(spark, docs):
    network = language_id.fit(docs, sample=20)
    other = docs.withColumn("doc_id", F.col("doc_id") + 1_000_000).withColumn("lang", F.lit(None).cast("string"))
    a = {(r["text"], r["lang_pred"], r["score"]) for r in language_id.predicted(docs, network).collect()}
    assert a == {(r["text"], r["lang_pred"], r["score"]) for r in language_id.predicted(other.repartition(5), network).collect()}


def test_quality_classifier(spark, docs, odd, nothing):
    labels = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet")
    many = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    model = quality_model.fit(many, labels)
    score = {r["doc_id"]: r["score"] for r in quality_model.scored(many, model).collect()}
    held = [r for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert sum((score[r["doc_id"]] >= 0.5) == r["quality"] for r in held) >= 0.9 * len(held)
    assert quality_model.scored(odd.select("doc_id", "text"), model).count() == odd.count()
    assert quality_model.scored(nothing, model).collect() == []
    none = quality_model.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r["score"] for r in quality_model.scored(odd, none).collect()} == {0.5}


def test_features_of_a_text(docs):
    for t in [r["text"].encode() for r in docs.limit(30).collect()] + [b"", b" ", b"one"]:
        n = sum(map(len, quality_model.features(t)))
        w = WORD.findall(t.decode())
        trigrams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        like = sum(a == b for a, b in zip(w, w[1:], strict=False)) + len(trigrams) - len(set(trigrams))
        assert n == 2 * len(w) + 2 * max(0, len(w) - 1) + like
        numbers, values = quality_model.vector_of(t)
        assert len(set(numbers)) == len(numbers) and (not n or values.sum() == pytest.approx(1))


def test_training_is_ftrl():
    """Against the update rule written out, one number at a time."""
    rng = np.random.default_rng(3)
    examples = []
    for k in range(60):
        some = np.unique(rng.integers(0, 40, 6))
        examples.append((some, np.full(len(some), 1 / len(some)), int(some.min() < 5) if k % 3 else k % 2))
    alpha, beta, l1, l2, epochs, seed = 2.0, 1.0, 1e-4, 1e-3, 3, 7
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * l1) / ((beta + n[i] ** 0.5) / alpha + l2)

    ones = sum(y for *_, y in examples)
    lift = [min(4.0, max(1.0, ones / (len(examples) - ones))) ** 0.5, min(4.0, max(1.0, (len(examples) - ones) / ones)) ** 0.5]
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(examples)):
            numbers, values, y = examples[k]
            x = {int(i): float(v) for i, v in zip(numbers, values, strict=True)} | {"bias": 1.0}
            p = 1 / (1 + np.exp(-sum(weight(i) * v for i, v in x.items())))
            now = {i: weight(i) for i in x}
            for i, v in x.items():
                g = (p - y) * v * lift[y]
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha * now[i]
                n[i] += g * g
    model = quality_model.train(examples, alpha, beta, l1, l2, epochs, seed)
    assert model.bias == pytest.approx(weight("bias"), rel=1e-9)
    assert all(model.weights[i] == pytest.approx(weight(i), rel=1e-5, abs=1e-7) for i in range(40))


def test_scores_are_dot_products():
    rng = np.random.default_rng(8)
    model = quality_model.Model(rng.normal(0, 3, 1 << quality_model.BITS).astype(np.float32), -0.3)
    for text in (b"", b"one", b"some words of a text that some words of a text repeat"):
        numbers, values = quality_model.vector_of(text)
        assert model.score(text) == pytest.approx(1 / (1 + np.exp(0.3 - float(model.weights[numbers].astype(float) @ values))), rel=1e-9)


def test_a_text_is_its_windows(docs):
    """The mean of the windows' probabilities by bytes, one window at a time; no n-gram is between two windows."""
    network = language_id.fit(docs, sample=20)
    scorer = network.scorer()
    step = language_id.STRIDE
    assert step == language_id.WINDOW - max(language_id.WIDTHS) + 1
    texts = [r["text"].encode() for r in docs.limit(20).collect()]
    texts += [b"a", b"x" * 64, b"y" * 65, b"z" * 61, b"", "é".encode() * 50, b"".join(texts) * 30]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    for text, got in zip(texts[:-1], scorer.texts(data, offsets), strict=False):
        starts = [k for k in range(0, len(text), step) if k == 0 or len(text) - k > language_id.WINDOW - step]
        want = np.zeros(len(network.languages))
        for n, k in enumerate(starts):
            own = step if n < len(starts) - 1 else len(text) - k
            w = text[k : k + language_id.WINDOW]
            assert own <= len(w)
            want += own * scorer.windows(np.frombuffer(w.ljust(language_id.WINDOW, b"\0"), np.uint8)[None])[0]
        assert np.allclose(got, want / max(1, len(text)))
    alone = scorer.texts(np.frombuffer(texts[-1], np.uint8), np.array([0, len(texts[-1])]))
    assert np.allclose(scorer.texts(data, offsets)[-1], alone[0])


def test_texts_are_passed_over_only_without_any_template(spark):
    """The scan of the whole table equals one that looks at every text."""
    texts = [t.text for t in license_scan.TEMPLATES] + ["CC\tBY\n\nNC", "cc-by_nc", "ccbync", "The Mozilla\u00a0Public License", "LICENSE"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in license_scan.summarised(license_scan.scan(df)).collect()}
    for k, t in enumerate(license_scan.TEMPLATES):
        assert t.label in got[k].split(",")
    assert [got[len(license_scan.TEMPLATES) + k] for k in range(5)] == ["cc-by-nc", "cc-by-nc", "", "", ""]
