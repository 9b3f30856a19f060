"""Quality classifier on held-out labels, licence scan on planted notices, and the pipeline."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkspark.llm import licences, quality, queries
from inkspark.llm.simhash import shingle_set

from .conftest import EDGE

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def model(spark, documents):
    return quality.fit(documents, spark.read.parquet(f"{DATA}/labels.parquet"), per_class=300)


def test_quality_on_held_out_labels(spark, documents, model):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = quality.score(documents, model).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 60 and sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_quality_edge_cases(spark, edge, empty, model):
    rows = quality.score(edge, model).collect()
    assert len(rows) == len(EDGE) and all(0 <= r.score <= 1 for r in rows)
    kept = quality.keep_good(edge, model)
    assert kept.columns == edge.columns and kept.count() == sum(r.predicted for r in rows)
    assert quality.score(empty, model).count() == 0
    none = quality.fit(edge, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in quality.score(edge, none).collect()} == {0.5}
    one = quality.fit(edge, spark.createDataFrame([(i, 1) for i in range(1, 8)] + [(1, None)], "doc_id long, quality int"))
    assert {r.score for r in quality.score(edge, one).collect()} == {1.0}


def test_vectors_and_scores_against_plain_loops():
    texts = ["Die Katze sitzt, und und lacht", "a b a b a", "", "x" * 100 + " 12 ABC"]
    words, shapes = quality.name_counts(texts)
    assert words == Counter(w for t in texts for w in t.split() if len(w) <= 64) and shapes == Counter(quality.shape(w) for t in texts for w in t.split())
    vocabulary, forms = sorted(words)[:5], sorted(shapes)[:4]
    model, own = quality.index(vocabulary, forms)
    of_form = lambda w: quality.index_vector(f"shape {quality.shape(w)}" if quality.shape(w) in forms else "shape ?")
    vector = lambda w: of_form(w) + (quality.index_vector(f"word {w}") if w in vocabulary else 0)
    around = {}
    for t in texts:
        ws = t.split()
        for i, w in enumerate(ws):
            name = w if w in vocabulary else (quality.shape(w) if quality.shape(w) in forms else "?",)
            for j in range(max(0, i - 2), min(len(ws), i + 3)):
                if j != i:
                    around[name] = around.get(name, 0) + vector(ws[j])
    model = quality.finish(model, own, quality.neighbours(texts, model, own))

    def plain(text):
        ws, total = text.split() or [""], np.zeros(64)
        for i, w in enumerate(ws):
            name = w if w in vocabulary else (quality.shape(w) if quality.shape(w) in forms else "?",)
            near = around.get(name, np.zeros(64))
            total += vector(w) + (near / np.linalg.norm(near) if np.linalg.norm(near) else 0)
            total += 4 * quality.index_vector("repetition") if i and w == ws[i - 1] else 0
        return total / len(ws)

    found = np.stack([model.pooled(t, model.rows()) for t in texts])
    assert np.allclose(found, [plain(t) for t in texts], atol=1e-5)
    rng = np.random.default_rng(1)
    model.net = {"mean": rng.standard_normal(64), "scale": rng.uniform(1, 2, 64), "w1": rng.standard_normal((64, 24)), "b1": rng.standard_normal(24), "w2": rng.standard_normal(24), "b2": rng.standard_normal(1)}
    model.temperature = 1.7
    for t, s in zip(texts, model.scores(texts, model.rows())):
        hidden = [np.tanh(sum((v - m) / c * w for v, m, c, w in zip(plain(t), model.net["mean"], model.net["scale"], column)) + b) for column, b in zip(model.net["w1"].T, model.net["b1"])]
        assert abs(s - 1 / (1 + np.exp(-(sum(h * w for h, w in zip(hidden, model.net["w2"])) + model.net["b2"][0]) / 1.7))) < 1e-4


def test_windows_over_long_texts_join():
    """Neighbours across the borders of the parts that long texts are summed in."""
    text = " ".join("abc"[i * i % 7 % 3] for i in range((1 << 15) + 50))
    model, own = quality.index(["a", "b", "c"], ["x "])
    at = [model.words[w] for w in text.split()]
    want = np.zeros_like(own, dtype=float)
    for i, r in enumerate(at):
        for j in range(max(0, i - 2), min(len(at), i + 3)):
            want[r] += own[at[j]] if i != j else 0
    assert np.allclose(quality.neighbours([text], model, own), want, rtol=1e-4)


def test_fitting_does_not_depend_on_rows_order_or_copies(spark, documents):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    one = quality.fit(documents, labels, per_class=40)
    two = quality.fit(documents.orderBy(F.rand(1)).unionByName(documents.where("doc_id % 3 = 0")), labels, per_class=40)
    assert one.words == two.words and np.allclose(one.table, two.table) and np.allclose(one.net["w1"], two.net["w1"])


def test_without_labels_nothing_goes(spark, edge):
    none = quality.fit(edge, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.keep_good(edge, none).count() == len(EDGE)


def test_licences(spark, documents, edge, empty):
    m = licences.fit(documents)
    prose = documents.select("text").first().text.split("\n")[0]
    texts = {f"{f} {i}": f"{prose}\n{t}\n{prose}" for f, ts in licences.TEMPLATES.items() for i, t in enumerate(ts)}
    texts |= {"none": prose, "mention": "A license to drive and a copyright dispute were reported."}
    rows = {r.doc_id: r for r in licences.scan(spark.createDataFrame(list(texts.items()), "doc_id string, text string"), m).collect()}
    for f, ts in licences.TEMPLATES.items():
        for i, t in enumerate(ts):
            (found,) = [x for x in rows[f"{f} {i}"].findings if x.confirmed]
            assert found.family == f and texts[f"{f} {i}"][found.start : found.end] == t and found.paragraph == 1
    assert not [x for k in ("none", "mention") for x in rows[k].findings if x.confirmed]
    assert licences.scan(edge, m).count() == len(EDGE) and licences.scan(empty, m).count() == 0
    bare = licences.fit(empty)
    assert [x.family for x in licences.scan(spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id long, text string"), bare).first().findings] == ["MIT"]


def test_each_window_of_a_long_line_keeps_its_finding(documents):
    """A text without line breaks that holds two licences, and an unconfirmed mention beside a confirmed notice."""
    m = licences.fit(documents)
    prose = " ".join(documents.select("text").first().text.split()[:300])
    line = f"{prose} {licences.TEMPLATES['MIT'][0]} {prose} {licences.TEMPLATES['Apache-2.0'][0]} {prose}"
    found = [(f[3], line[f[1] : f[2]]) for f in m.findings(line, 0.5, 0.5)[1] if f[6]]
    assert [f for f, _ in found] == ["MIT", "Apache-2.0"]
    assert "MIT License" in found[0][1] and "Apache License" in found[1][1] and "Apache" not in found[0][1]
    both = f"{licences.TEMPLATES['MIT'][0]} {licences.TEMPLATES['Proprietary'][0]}"
    assert {f[3] for f in m.findings(both, 0.5, 0.5)[1] if f[6]} == {"MIT", "Proprietary"}


def test_counts_and_sample_cover_whole_texts(spark):
    """Against a plain loop; the sample comes from anywhere in long texts."""
    texts = [f"start {i}\n" + "\n".join(f"license line {j} of {i}" + " word" * (j % 200) for j in range(60)) for i in range(20)] + [None, "", "no break " * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = licences.corpus_counts(df, frozenset({"license", "line", "absent"}), 0.1, "text", "doc_id").collect()
    windows = [w for t in texts for line in (t or "").split("\n") if line.strip() for _, w in licences.windows_of(licences.words_of(line))]
    seen = Counter()
    for r in rows:
        if r.word is not None:
            seen[r.word] += r.n
    assert seen == {"": len(windows), "license": sum("license" in w for w in windows), "line": sum("line" in w for w in windows)}
    picked = [r.window for r in rows if r.window is not None]
    assert 0.05 * len(windows) < len(picked) < 0.2 * len(windows)
    assert set(picked) <= {" ".join(w) for w in windows} and any("line 5" in w for w in picked)


def test_a_common_licence_word_keeps_its_template():
    """Where the corpus has all words of a template in ordinary text, its rarest word still lets it through."""
    seen = {"": 1000} | {w: 900 for w in "all rights reserved".split()} | {"rights": 500}
    templates = {f: [licences.words_of(t) for t in ts] for f, ts in licences.TEMPLATES.items()}
    gates = licences.gates_of(templates, seen)
    assert "rights" in gates and "reserved" not in gates
    assert all(not gates.isdisjoint(t) for ts in templates.values() for t in ts)


def test_common_words_of_licences_drop_no_window():
    """Where the corpus has a template's words in ordinary text, a notice without its rarest words is found still."""
    templates = {f: [licences.words_of(t) for t in ts] for f, ts in licences.TEMPLATES.items()}
    seen = {"": 1000} | {w: 900 for ts in templates.values() for t in ts for w in t} | {"redistributions": 500, "identifier": 500}
    ordinary = [[f"w{i * 7 + j}" for j in range(20)] for i in range(200)]
    m = licences.train(templates, seen, ordinary, np.random.default_rng(9))
    cut = {"BSD": licences.TEMPLATES["BSD"][3], "MIT": licences.TEMPLATES["MIT"][2], "Apache-2.0": licences.TEMPLATES["Apache-2.0"][1]}
    for family, text in cut.items():
        text = " ".join(w for w in text.split() if m.gates.isdisjoint(licences.words_of(w)))
        assert [f[3] for f in m.findings(text, 0.5, 0.5)[1]] == [family]
    # what is passed over has no finding: windows of all kinds, looked at and not
    rng = np.random.default_rng(1)
    words = sorted({w for ts in templates.values() for t in ts for w in t})
    for n in range(300):
        t = [*(ordinary[n % 200]), *map(str, rng.choice(words, n % 9)), *(templates["MIT"][2][n % 30 : n % 30 + n % 11])]
        if not m.may_tell(t):
            assert m.families[int(m.probabilities(licences._grams(t)).argmax())] == licences.UNKNOWN


#: Notices in other words than the templates', by family; None: ordinary text that uses words of licences.
HELD_OUT = [
    ("MIT", "This project is available under the MIT license; see LICENSE for details."), ("MIT", "Copyright 2021 A. Person. Licensed under MIT License."), ("MIT", "permission is granted, free of charge, to any person who obtains a copy of this software and its associated documentation files, to deal in the software without restriction"),
    ("Apache-2.0", "Code in this folder is licensed under the Apache License 2.0."), ("Apache-2.0", "You may not use these files except in compliance with the License; a copy of the License is at apache.org/licenses/LICENSE-2.0"), ("Apache-2.0", "Released under the terms of the Apache License, version 2.0"),
    ("BSD", "Distributed under the terms of the BSD license."), ("BSD", "redistribution and use in source or binary forms, with or without modifications, are permitted if the following conditions are met"), ("BSD", "Redistributions of the source code must retain the copyright notice above, this list of conditions and the disclaimer below."),
    ("GPL-3.0", "This software is licensed under the GNU General Public License version 3."), ("GPL-2.0", "Licensed under the GNU General Public License, version 2 only."), ("AGPL-3.0", "The server is released under the GNU Affero General Public License version 3."), ("LGPL", "The library is distributed under the GNU Lesser General Public License."),
    ("CC-BY", "Except where noted, content is licensed under a Creative Commons Attribution 4.0 license."), ("CC-BY-SA", "Shared under a Creative Commons Attribution-ShareAlike 4.0 license."), ("CC-BY-NC", "Photos are licensed under a Creative Commons Attribution-NonCommercial 4.0 license."), ("CC0", "The author has dedicated this to the public domain under CC0 1.0."),
    ("MPL-2.0", "This file is subject to the Mozilla Public License, version 2.0."), ("ISC", "Made available under the ISC license."), ("Unlicense", "This is free and unencumbered software which is released to the public domain."), ("Zlib", "The software is provided as-is, without any express or implied warranty, and in no event will the authors be held liable for damages."),
    ("Proprietary", "Copyright 2019 Some House. All rights are reserved."), ("Proprietary", "No part of this book may be reproduced or transmitted in any form without prior written permission of the publisher."), ("EPL-2.0", "Made available under the Eclipse Public License 2.0."), ("BSL-1.0", "Distributed under the Boost Software License version 1.0"), ("OFL-1.1", "The font is licensed under the SIL Open Font License version 1.1."),
    (None, "The driver lost the license after a second offence and had to redistribute the work."), (None, "Public domain experts met to discuss general terms of the new foundation."), (None, "A version of the story was published without permission, she said."), (None, "Conditions in the source region are met with a warning notice."), (None, "The software industry grew; free copies were sold to any person who asked."), (None, "He reserved all of his rights to the table by the window."),
    (None, "Creative people share common ground and give attribution freely."), (None, "The Eclipse of 1999 was seen in public by many; no license was needed."), (None, "Mozilla and Apache are names of software makers."), (None, "In no event will the show be moved because of rain."),
]


def test_held_out_wordings(documents):
    """Confirmed findings on wordings that are no templates: precision 0.9 and recall 0.8 at least (README has the figures)."""
    m = licences.fit(documents)
    found = [{f[3] for f in m.findings(t, 0.5, 0.5)[1] if f[6]} for _, t in HELD_OUT]
    right = sum(family in got for (family, _), got in zip(HELD_OUT, found) if family)
    print(f"recall {right} of {sum(family is not None for family, _ in HELD_OUT)}, precision {right} of {sum(map(len, found))}")
    assert right >= 0.8 * sum(family is not None for family, _ in HELD_OUT), [(f, t, got) for (f, t), got in zip(HELD_OUT, found) if f and f not in got]
    assert right >= 0.9 * sum(map(len, found)), [(f, t, got) for (f, t), got in zip(HELD_OUT, found) if got - {f}]


#: Sentences that no template has, and names of licences to put in: those of families, and others that are near misses.
FRAMES = [
    "Made available under {}.", "The code in this folder is distributed under {}.", "Files here are licensed under {}; see the file beside them.", "Copyright 2019 A. Person. Released under {}.", "All examples may be used under the terms of {}.",
    "Our documents and tools are covered by {} unless stated otherwise.", "We publish this package under {}.",
]
NAMES = {
    "MIT": "the MIT License", "Apache-2.0": "the Apache License, Version 2.0", "BSD": "the BSD License", "GPL-3.0": "the GNU General Public License, version 3", "GPL-2.0": "the GNU General Public License, version 2",
    "AGPL-3.0": "the GNU Affero General Public License, version 3", "LGPL": "the GNU Lesser General Public License", "MPL-2.0": "the Mozilla Public License, v. 2.0", "EPL-2.0": "the Eclipse Public License 2.0", "ISC": "the ISC License",
    "BSL-1.0": "the Boost Software License, Version 1.0", "OFL-1.1": "the SIL Open Font License, Version 1.1", "CC-BY": "a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA": "a Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-NC": "a Creative Commons Attribution-NonCommercial 4.0 International License",
}
NEAR_MISSES = [
    *(f.format(n) for f in FRAMES[:4] for n in ("the Apache License, Version 1.1", "the EUPL, Version 1.2", "a Creative Commons Attribution-NoDerivatives 4.0 International License", "a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
                                                 "the Sleepycat License", "the Netscape Public License, Version 1.1", "the Vovida Software License, Version 1.0", "the Ruby License", "the Mozilla Public License, v. 1.1", "the Microsoft Public License")),
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "Licensed under the Apache License, Version 1.1.", "Licensed under the EUPL.",
    "either version 2 of the book, or (at your option) any later version of the essay", "The conditions of the school, with or without modification, are permitted provided that the following conditions are met",
]


def test_held_out_names_and_near_misses(documents):
    """105 sentences on licences of the families and 45 near misses: precision and recall 0.9 at least."""
    m = licences.fit(documents)
    sure = lambda t: {f[3] for f in m.findings(t, 0.5, 0.5)[1] if f[6]}
    found = [(family, sure(frame.format(name))) for family, name in NAMES.items() for frame in FRAMES]
    right, false = sum(got == {family} for family, got in found), sum(map(len, map(sure, NEAR_MISSES)))
    print(f"recall {right} of {len(found)}, of confirmed {sum(len(got) for _, got in found) + false}, of near misses {false}")
    assert len(found) == 105 and len(NEAR_MISSES) == 45
    assert right >= 0.9 * len(found)
    assert right >= 0.9 * (sum(len(got) for _, got in found) + false)
    assert false == 0


def test_spdx_expressions(documents):
    assert licences.spdx_families("(MIT OR BSD-2-Clause) AND GPL-2.0-or-later WITH Classpath-exception-2.0") == ["MIT", "BSD", "GPL-2.0"]
    assert licences.spdx_families("apache-2.0") == ["Apache-2.0"] and licences.spdx_families("CC-BY-ND-4.0 or LGPL-3.0+") == ["unknown", "LGPL"]
    assert licences.spdx_families("MIT this file is old") == ["MIT"] and licences.spdx_families("") == []
    m = licences.fit(documents.limit(50))
    text = "// SPDX-License-Identifier: GPL-2.0-or-later\n# SPDX-License-Identifier: Foo-1.0 */\nx SPDX-License-Identifier: MIT"
    assert [(f[0], f[3], f[6], text[f[1] : f[2]].strip()) for f in m.findings(text, 0.5, 0.5)[1]] == [
        (0, "GPL-2.0", True, "SPDX-License-Identifier: GPL-2.0-or-later"), (1, "unknown", False, "SPDX-License-Identifier: Foo-1.0"), (2, "MIT", True, "SPDX-License-Identifier: MIT")
    ]


def test_findings_against_plain_loops(documents):
    """Windows, probabilities, similarity and what is confirmed, by loops over words."""
    m = licences.fit(documents)
    prose = " ".join(documents.select("text").first().text.split()[:170])
    templates = {f: [licences.words_of(t) for t in ts] for f, ts in licences.TEMPLATES.items()} | {licences.UNKNOWN: [licences.words_of(t) for t in licences.OTHERS]}

    def units(words):
        return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))}

    labels = [(f, set().union(*map(units, ts))) for f, ts in templates.items() if f != licences.UNKNOWN] + [(i, units(t)) for i, t in enumerate(templates[licences.UNKNOWN])]
    worth = lambda u: 1 / max(1, sum(u in own for _, own in labels))

    def core(words):
        return {"licen" if w.startswith("licen") else w[:7] for w in words if w in licences.CORE}

    def agreement(family, words):
        best, own = 0, units(words)
        for t in templates[family]:
            numbers, there = licences._versions(t), licences._versions(words)
            if 2 * len(core(t) & core(words)) >= len(core(t)) and not (numbers and there and not numbers & there):
                shared = sum(worth(u) for u in own & units(t))
                best = max(best, shared / sum(map(worth, units(t))), shared / sum(map(worth, own)) if len(words) >= 6 else 0)
        return best

    for text in [f"{prose} {HELD_OUT[0][1]} {prose}", HELD_OUT[6][1], NEAR_MISSES[0], licences.TEMPLATES["BSD"][1], prose]:
        words, want = licences.words_of(text), []
        for i in range(0, max(1, len(words) - 40), 40):
            part = words[i : i + 80]
            if not any(w in m.gates for w in part):
                continue
            grams = {" ".join(part[j : j + n]) for n in (1, 2, 3) for j in range(len(part) - n + 1)}
            z = [(m.bias[k] + sum(m.weight[m.features[g]][k] for g in grams if g in m.features)) / m.temperature for k in range(len(m.families))]
            p = np.exp(np.array(z) - max(z))
            p = p / p.sum()
            k = int(p.argmax())
            if m.families[k] != licences.UNKNOWN:
                similar = agreement(m.families[k], part)
                if similar >= 0.5 and similar >= agreement(licences.UNKNOWN, part) or p[k] >= 0.5:
                    want.append((m.families[k], float(p[k]), similar))
        got = [f for f in m.findings(text, 0.5, 0.5)[1]]
        for family in {f for f, *_ in want}:  # neighbouring windows of one family are one finding, with the most of each
            assert [(round(f[4], 4), round(f[5], 6)) for f in got if f[3] == family] == [(round(max(p for f, p, _ in want if f == family), 4), round(max(s for f, _, s in want if f == family), 6))]
        assert {f for f, *_ in want} <= {f[3] for f in got} and (want or not got)


def test_licences_of_documents(spark, documents):
    rows = queries.op8_licence_scan(spark, DATA).join(documents.select("doc_id", "text"), "doc_id").collect()
    said = {"MIT": "Released under the MIT", "Apache-2.0": "Apache License, Version 2.0", "Proprietary": "All rights reserved.", "GPL-3.0": "General Public License"}
    for r in rows:
        assert (r.n_confirmed > 0) == any(x in r.text for x in ("Released under the", "All rights reserved.", "Licensed under", "licensed under the"))
        assert all(said[f] in r.text for f in r.families.split(",") if f in said)


def test_pipeline(spark, documents):
    docs, seen = documents, [documents]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, DATA))
        seen.append(docs)
        assert name.startswith("byte") or docs.columns == documents.columns
    raw, good, distinct, unlike, mixed, encoded = seen
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    clean = {i for i, q in labels.items() if q == 1}
    assert len(clean & ids(good)) >= 0.98 * len(clean) and len((ids(raw) - clean) & set(labels) & ids(good)) <= 0.05 * len(labels)
    groups = {}
    for r in good.collect():
        groups[r.text] = max(r.doc_id, groups.get(r.text, -1))
    assert ids(distinct) == set(groups.values())
    texts = {r.doc_id: set(shingle_set(r.text, 5).tolist()) for r in distinct.collect()}
    left = ids(unlike)
    near = [(i, j) for i in texts for j in texts if i < j and min(len(texts[i]), len(texts[j])) >= 0.8 * max(len(texts[i]), len(texts[j]), 1) and len(texts[i] & texts[j]) >= 0.8 * len(texts[i] | texts[j])]
    assert sum(i not in left or j not in left for i, j in near) >= 0.9 * len(near)  # 64-bit fingerprints part some pairs at 0.8
    for i in set(texts) - left:
        assert any(len(texts[i] & texts[j]) >= 0.8 * len(texts[i] | texts[j]) for j in left if j < i)
    assert ids(mixed) == left and ids(encoded) == left and mixed.count() == encoded.count() <= 1.6 * len(left)
    assert encoded.where(F.octet_length("ids") != 4 * F.col("n_tokens")).count() == 0


@pytest.mark.parametrize("labelled", [True, False])
def test_pipeline_on_odd_tables(spark, edge, tmp_path, labelled):
    """Null and repeated ids, empty, null and very long texts, clashing columns; with labels, and with none, where nothing is rejected."""
    edge.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, i % 2) for i in range(1, 12)] if labelled else []
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {"doc_id", "n_tokens", "ids"} <= set(rows[0].asDict()) if rows else labelled
    if not labelled:
        texts = {t or "" for _, t, *_ in EDGE}
        assert {r.doc_id for r in rows} == {max((i for i, t, *_ in EDGE if (t or "") == x and i is not None), default=None) for x in texts}


def test_pipeline_on_empty_tables(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
