"""Telling words of licenses, and the query against a plain search for runs of words."""

import re
from collections import Counter

import pytest

from strandline.llm import license_scan

SF = "/root/testdata/sf0.001"
INDEX = license_scan.TemplateIndex(license_scan.TEMPLATES)


def names(text):
    raw = text.encode()
    return [(m[0], round(m[1], 2)) for m in license_scan.scan(raw, INDEX, INDEX.found([raw]).get(0, []), license_scan.COVERAGE)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Licensed under CC BY 4.0", ["CC-BY-4.0"]),
        ("Licensed under CC BY-SA 4.0", ["CC-BY-SA-4.0"]),
        ("Licensed under CC BY-NC 4.0", ["CC-BY-NC-4.0"]),
        ("Licensed under CC BY-NC-ND 3.0", ["CC-BY-NC-ND-3.0"]),
        ("Licensed under CC BY 2.5", []),
        ("This work is licensed under a Creative Commons Attribution 3.0 International License", ["CC-BY-3.0-statement"]),
        ("This work is licensed under a Creative Commons Attribution 3.0 Unported License", ["CC-BY-3.0-statement"]),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", ["CC-BY-NC-SA-4.0-statement"]),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.", []),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ["MPL-2.0"]),
        ("The contents of this file are subject to the Mozilla Public License Version 1.1", ["MPL-1.1"]),
        ("Licensed under the Apache License, Version 2.1", []),
        ("Licensed under the Apache License, Version 2.0", ["Apache-2.0"]),
        ("GNU General Public License version 2", ["GPL-2.0-name"]),
        ("licensed under the GNU General Public License, version 2", ["GPL-2.0"]),
        ("licensed under the GNU Lesser General Public License, version 3", []),
        (license_scan.TEMPLATES["GPL-2.0-notice"], ["GPL-2.0-notice"]),
        (license_scan.TEMPLATES["GPL-notice"], ["GPL-notice"]),
        (license_scan.TEMPLATES["BSD-3-Clause"].replace("met: ", "met: 1. "), ["BSD-3-Clause"]),
    ],
)
def test_telling_words_must_agree(text, want):
    assert [n for n, _ in names(text)] == want
    assert [n for n, _ in names(f"Some words before. {text} And some words that follow.")] == want


def test_query_equals_a_plain_search_for_whole_statements(spark):
    """On these tables all statements are whole ones, so every match is a run of a template's words, and the other way round."""
    words = lambda t: [m.group().lower() for m in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", t)]
    want = Counter()
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        own, found = words(r["text"] or ""), []
        for name, t in license_scan.TEMPLATES.items():
            run = words(t)
            found += [(k, k + len(run), name) for k in range(len(own) - len(run) + 1) if own[k : k + len(run)] == run]
        for a, b, name in found:
            if not any((x <= a and b <= y) and (y - x) > (b - a) for x, y, _ in found):
                want[r["doc_id"], name, b - a] += 1
    got = license_scan.op6_license_scan(spark, SF).collect()
    assert {r["coverage"] for r in got} == {1.0}
    assert Counter((r["doc_id"], r["license"], r["matched_words"]) for r in got) == want and len(want) > 0
