import re

from deltascape.llm.license_scan import PHRASES, rules, scan

from .helpers import documents, simple

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {i: i + 32 for i in range(65, 91)}
TEXTS = [
    "Licensed under the MIT License.", "mit license mit license MIT-LICENSE", "gnu general public license, version 3 and the Apache License, Version 2.0", "cc by 4.0", "CC\nBY-NC", "SPDX-License-Identifier: BSD-3-Clause", "no terms here", None, "",
    "permit license", "mitlicense", "émit license", "mit licenseé", "All rights reserved.", "released into the public domain", "GPL v3", "\u0001mit license\u0002", "the mit " * 2000 + "license", "Licensed under the Apache License, Version 2.0. " * 500,
    "Creative Commons Attribution-ShareAlike license", "under the terms of the Mozilla Public License", "4 mit license 5",
]


def brute(text):
    w = WORD.findall((text or "").translate(LOW))
    at, labels = [], set()
    for phrase, label in PHRASES:
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_base_equals_brute_force(spark):
    got = {r.doc_id: r for r in scan(simple(spark, TEXTS)).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t), t
        assert 0 <= r.score <= 1
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))


def test_labels_of_the_method(spark):
    want = {
        "Licensed under the MIT License.": "mit", "SPDX-License-Identifier: BSD-3-Clause": "bsd,bsd-3-clause", "released into the public domain": "public-domain", "All rights reserved.": "all-rights-reserved",
        "licensed under CC BY-NC 4.0": "cc-by,cc-by-nc", "nothing": "", "under the terms of the Mozilla Public License, version 2.0": "mpl", "GNU Lesser General Public License": "gpl,lgpl",
    }
    got = {r.doc_id: r.labels for r in scan(simple(spark, list(want))).collect()}
    for i, (t, labels) in enumerate(want.items()):
        assert set(filter(None, got[i].split(","))) & set(labels.split(",")) or got[i] == labels, (t, got[i])


def test_keywords_across_any_white_space(spark):
    want = {
        "GNU Lesser\nGeneral Public License": "lgpl", "Creative\nCommons Attribution license": "cc-by", "all rights\nreserved": "all-rights-reserved", "the public\n  domain": "public-domain", "without\nwarranty of any kind": "no-warranty",
        "CC\nBY-NC": "cc-by-nc", "mozilla  public\tlicense": "mpl", "public\u0001domain": "public-domain", "the PHP licence": "php", "a 2-clause license": "bsd-2-clause",
    }
    got = {r.doc_id: r.labels for r in scan(simple(spark, list(want))).collect()}
    for i, (t, label) in enumerate(want.items()):
        assert label in got[i].split(","), (t, got[i])


def test_contained_detections_go(spark):
    r = scan(simple(spark, ["It is licensed under the Apache License, Version 2.0."])).first()
    spans = [(f.start, f.end) for f in r.found]
    assert len(spans) == 1 and r.score == 0.8


def test_hundreds_of_ordered_rules(spark):
    table = rules(spark).collect()
    assert len(table) >= 300 and [r.rule for r in table] == list(range(len(table)))
    for r in table:
        re.compile(r.pattern.replace(r"\x{80}-\x{10FFFF}", "\u0080-\U0010ffff"))


def test_odd_rows(spark):
    docs = documents(spark, [(None, "mit license", None), (1, "mit license", "a"), (1, "mit license", "a")])
    assert [r.n_base for r in scan(docs).collect()] == [1, 1, 1]
    assert scan(simple(spark, [])).count() == 0
