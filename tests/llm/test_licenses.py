from __future__ import annotations

import random
import re

from rankloom.llm import licenses
from rankloom.llm.license_rules import RULES
from tests.llm.odd import ROWS, docs, empty, lower


def scan(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in licenses.license_scan(df).collect()}


def test_base_against_brute_force(spark):
    rng = random.Random(3)
    bits = ["CC", "by", "General", "public", "LICENSE", "all", "rights", "reserved", "x", "é", "-", " ", ". ", "\n", "ccby", "\x85", " "]
    texts = [rng.choice(["", " "]).join(rng.choice(bits) + rng.choice(["", " ", ", "]) for _ in range(rng.randrange(25))) for _ in range(400)]
    got = scan(spark, texts)
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        places, labels = [], set()
        for phrase, label in licenses.BASE:
            p = phrase.split()
            for j in range(len(w) - len(p) + 1):
                if w[j : j + len(p)] == p:
                    places.append(j)
                    labels.add(label)
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))), t
        assert labels <= set(r.labels.split(",")) if labels else True
        assert 0 <= r.score <= 1


def test_rules_and_suppression(spark):
    texts = [
        "Licensed under the Apache License, Version 2.0 (the \"License\")", "SPDX-License-Identifier: GPL-3.0-or-later", "é Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this", "the weather is fine and the bus is late",
        "This is distributed under the terms of the GNU Lesser General Public License version 2.1", "CC BY-NC 4.0", "Copyright (c) 2020 Somebody. All rights reserved.",
    ]
    got = scan(spark, texts)
    assert [got[i].labels for i in range(8)] == ["apache-2.0", "gpl-3.0", "mit", "mit", "", "gpl,lgpl-2.1", "cc-by,cc-by-nc", "copyright,reserved"]
    d = got[2].detections
    assert [(x.label, texts[2][x.start : x.end]) for x in d] == [("mit", "Released under the MIT License")]
    assert len(licenses.rules()) > 200


def test_gates_drop_nothing(spark):
    short = {
        "apache license 2.0": "apache-2.0", "apache license v2": "apache-2.0", "apache license, version 2": "apache-2.0", "general public license v3": "gpl,gpl-3.0",
        "GNU General Public License version 3": "gpl,gpl-3.0", "expat license": "mit", "psf license": "python-2.0", "library general public license v2": "gpl,lgpl-2.1",
        "do what the fuck you want to public license": "wtfpl", "mozilla public license v2.0": "mpl-2.0", "creative commons attribution-sharealike 4.0 license": "cc", "cc0 1.0 universal": "cc0-1.0",
        "released into the public domain": "public-domain", "redistribution and use in source and binary forms": "bsd", "permission is hereby granted, free of charge, to any person obtaining a copy": "mit",
        "provided by the authors and contributors as is": "warranty-disclaimer", "copyright(c)2020": "copyright", "proprietary and confidential": "proprietary", "European Union Public Licence": "eupl-1.2",
        "open data commons attribution license": "odc-by-1.0", "University of Illinois/NCSA Open Source License": "ncsa", "cc by-nc-sa 4.0": "cc-by,cc-by-nc-sa",
    }
    texts = [t.replace(" ", s) for t in [*short, *(example for *_, example in RULES)] for s in (" ", "\n", "\r\n\t ", "  ")]
    got = scan(spark, texts)
    rules = licenses.rules()
    for i, t in enumerate(texts):
        low = lower(t).encode()
        found = licenses.suppress([(r.priority, m.start(), m.end(), k) for k, r in enumerate(rules) for m in r.pattern.finditer(low)])
        assert sorted({rules[k].label for *_, k in found}) == sorted({d.label for d in got[i].detections}), t
    for i, (t, labels) in enumerate((t, x) for t, x in short.items() for _ in range(4)):
        assert set(labels.split(",")) <= set(got[i].labels.split(",")), (t, got[i].labels)


def test_every_rule_takes_its_example_and_no_other_words(spark):
    rules = licenses.rules()
    assert len(rules) == len(RULES) == len({r[3] for r in RULES}) > 200
    for rule, (*_, example) in zip(rules, RULES):
        text = lower(example).encode()
        assert rule.pattern.search(text) and any(w in b" ".join(text.split()) for w in rule.keywords) and any(w in text for w in licenses.GATE), rule
        assert rule.pattern.search(b"\n  ".join(text.split())), rule  # wrapped
        for other in (re.sub(rb"(?<=[a-z0-9])(?![a-z0-9])", b"x", text), re.sub(rb"(?<![a-z0-9])(?=[a-z0-9])", b"x", text)):
            assert not rule.pattern.search(other), (rule, other)
    got = scan(spark, [example for *_, example in RULES])
    for i, (label, *_) in enumerate(RULES):
        assert label in got[i].labels.split(","), (RULES[i], got[i].labels)


def test_versions_and_spacing(spark):
    want = {
        "Apache License 2.0": "apache-2.0", "Apache License v2.0": "apache-2.0", "GNU General Public License v2": "gpl,gpl-2.0", "GNU Lesser General Public License v3": "gpl,lgpl-3.0",
        "Mozilla Public License 2.0": "mpl-2.0", "Mozilla Public License v2.0": "mpl-2.0", "GNU GPLv3": "gpl-3.0", "GNU LGPL v2.1": "lgpl-2.1", "Copyright 2020 Foo": "copyright", "(c)2020": "copyright",
        "GNU General Public License version 2.1": "gpl", "Mozilla Public License 2.01": "mpl", "Apache License 20": "apache", "GPLv20": "", "Copyright 20201": "", "(c) 1820": "", "a license to fish": "", "gnu gplx": "",
        "the permitted use": "", "public domains": "", "Eclipse Public License 1.5": "epl", "CC BY 5.0": "cc-by", "simple mpl example": "", "apache licensed": "",
    }
    got = scan(spark, list(want))
    assert [got[i].labels for i in range(len(want))] == list(want.values())


def test_suppression_against_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        found = [(rng.randrange(3), a, a + rng.randrange(1, 9), i) for i in range(rng.randrange(14)) for a in [rng.randrange(20)]]
        kept = []
        for d in sorted(found, key=lambda d: (d[0], d[1] - d[2], d[1], d[3])):
            if not any(k[1] <= d[1] and d[2] <= k[2] for k in kept):
                kept.append(d)
        assert licenses.suppress(found) == sorted(kept, key=lambda d: d[1:])


def test_odd_rows(spark):
    rows = licenses.license_scan(docs(spark)).collect()
    assert len(rows) == len(ROWS) and all(r.score == 0 and r.labels == "" for r in rows)
    assert [r.n_words for r in rows if r.doc_id == 7] == [40_000]
    assert licenses.license_scan(empty(spark)).count() == 0
