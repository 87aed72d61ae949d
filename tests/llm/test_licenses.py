import re

import pytest

from coppice.llm.common import pick
from coppice.llm.licenses import BASE_PHRASES, beginning, evaluate, family, license_scan, tagged, to_postfix


def test_shunting_yard():
    assert to_postfix("MIT OR Apache-2.0 AND GPL-2.0 WITH Classpath-exception-2.0".split()) == [
        "MIT",
        "Apache-2.0",
        "GPL-2.0",
        "Classpath-exception-2.0",
        "with",
        "and",
        "or",
    ]
    assert evaluate("(MIT or GPL-3.0-only) and Apache-2.0") == (0.9, {"mit", "gpl", "apache"})
    assert evaluate("GPL-2.0 with Classpath-exception-2.0") == (0.4, {"gpl"})
    assert evaluate("Own-1.0") == (0.2, {"own-1.0"})
    for wrong in ("", "MIT OR", "AND MIT", "(MIT", "MIT)", "MIT GPL", "()", "MIT (GPL)"):
        with pytest.raises(ValueError):
            evaluate(wrong)


def test_families():
    assert [family(x) for x in ("GPL-3.0-only", "LGPL-2.1", "CC-BY-4.0", "MITX", "Apache-2.0")] == ["gpl", "lgpl", "cc-by", "mitx", "apache"]


def brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in BASE_PHRASES.items():
        p = phrase.split()
        hits = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += hits
        labels |= {label} if hits else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_places_as_by_brute_force(spark, sf, make, odd, odd_rows):
    texts = [
        "MIT License, mit-license MIT\nLICENSE mit license license",
        "the GNU General\n Public  License and Apache License cc by cc-by 4.0",
        "gnu general public licenses; xmit license; mit licensé",
    ]
    made = make([(i, t) for i, t in enumerate(texts)])
    given = spark.read.parquet(f"{sf}/documents.parquet")
    for docs in (made, given, odd):
        rows = [(r.doc_id, r.text) for r in pick(docs, "doc_id", "text").collect()]
        found = [tuple(r)[:6] for r in license_scan(docs).collect()]
        assert sorted(found, key=repr) == sorted([(i, *brute(t)) for i, t in rows], key=repr)


def test_labels_and_score(make, empty):
    docs = make([
        (1, "// SPDX-License-Identifier: MIT OR GPL-2.0\nx"),
        (2, "spdx-license-identifier: (MIT AND\nMozilla Public License"),
        (3, "SPDX License Identifier without an expression, MIT License"),
        (4, "nothing"),
        (5, "MIT license. SPDX-License-Identifier: GPL-3.0"),
    ])
    found = {r.doc_id: (r.base_labels, r.labels, r.score) for r in license_scan(docs).collect()}
    assert found == {
        1: ("", "gpl,mit", 1.0),
        2: ("", "mpl", 0.6),
        3: ("mit", "mit", 1.0),
        4: ("", "", 0.0),
        5: ("mit", "gpl,mit", 0.4),
    }
    assert license_scan(empty).collect() == []


def test_text_after_a_tag():
    tag = "SPDX-License-Identifier:"
    assert tagged(f"{tag} MIT. Copyright 2020 A. Person") == [(1.0, {"mit"})]
    assert tagged(f"{tag} (MIT OR GPL-2.0) this file is {tag} Apache-2.0 */ int x") == [(1.0, {"mit", "gpl"}), (0.9, {"apache"})]
    assert tagged(f"{tag} MIT OR\nGPL-2.0") == [(1.0, {"mit"})] and tagged(f"{tag} AND MIT") == tagged(f"{tag}\nMIT") == []
    for text, want in [("MIT OR", "MIT"), ("(MIT", ""), ("MIT)", "MIT"), ("MIT GPL", "MIT"), ("MIT (GPL)", "MIT"), ("()", ""), ("((MIT) AND BSD", "")]:
        assert beginning(text, 0) == want
