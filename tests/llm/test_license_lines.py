"""License scans: SPDX expressions, more licenses, notices without their usual anchors, long runs of anchors, odd rows."""

import random
import time

import pytest

from ledgerlens.llm import license_scan

FILES = "doc_id bigint, path string, text string, terms string, has int"


def scanned(spark, texts):
    df = spark.createDataFrame([(k, f"d/{k}", t, "x", 1) for k, t in enumerate(texts)], FILES)
    return {r["id"]: r["license"] for r in license_scan.scan(df).collect()}


def test_spdx_lines(spark):
    lines = {
        "// SPDX-License-Identifier: MIT OR Apache-2.0\nint x": "MIT OR Apache-2.0", "# spdx-license-identifier: (GPL-2.0-only  with Classpath-exception-2.0) and MIT -->": "(GPL-2.0 WITH Classpath-exception-2.0) AND MIT", "/* SPDX-License-Identifier: LGPL-2.1-or-later */": "LGPL-2.1",
        "SPDX-License-Identifier: AGPL-3.0-only": "AGPL-3.0", "SPDX-License-Identifier: MIT This is prose or not": "MIT", "SPDX-License-Identifier: BSL-1.0": "BSL-1.0", "SPDX-License-Identifier: LicenseRef-own+": "LicenseRef-own", "SPDX-License-Identifier: Zlib": "Zlib",
    }
    assert scanned(spark, list(lines)) == dict(enumerate(lines.values()))


def test_titles_and_notices_of_more_licenses(spark):
    prose = "river stone " * 60
    texts = {
        "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007\n" + prose: "AGPL-3.0", f"{prose}\n# it under the terms of the GNU Lesser General Public License as published by\n# the Free Software Foundation; either version 2.1 of the License, or\n# (at your option) any later version.": "LGPL-2.1",
        f"{prose} This is free and unencumbered software released into the public domain.": "Unlicense", f"Licensed under CC BY-SA 4.0. {prose}": "CC-BY-SA-4.0", prose: None,
    }
    assert scanned(spark, list(texts)) == {k: v for k, v in enumerate(texts.values()) if v}


def test_notices_with_changed_words_are_found(spark):
    """A short notice keeps its place by any of its rarer terms: each one is changed in turn, four at a time."""
    known = [t for t in license_scan.templates() if not t.top and 20 <= len(license_scan.terms_of(t.text)) <= license_scan.SHORT]
    r, texts = random.Random(3), []
    for t in known:
        first = [x for x, at in license_scan.anchors((t,)).items() if at]
        words = license_scan.terms_of(t.text)
        for _ in range(3):
            gone = set(r.sample(first, 2))
            texts.append((t.license, "stone river " * 10 + " ".join("changed" if w in gone else w for w in words) + " river stone" * 10))
    got = scanned(spark, [t for _, t in texts])
    found = sum(got.get(k) == license for k, (license, _) in enumerate(texts))
    assert found >= 0.9 * len(texts)


@pytest.mark.parametrize("words", ["mit license ", "license ", "spdx-license-identifier mit ", "gnu general public license version 3 "])
def test_many_anchors_in_one_text_take_linear_time(spark, words):
    took = []
    for n in (8_000, 64_000):
        df = spark.createDataFrame([(1, "a/b", words * n, "x", 1)], FILES)
        began = time.time()
        license_scan.scan(df).collect()
        took.append(time.time() - began)
    assert took[1] < 8 * took[0] + 10


def test_null_and_repeated_ids_and_other_columns(spark):
    notice = "Released under the MIT License."
    rows = [(None, "a/LICENSE", notice, "t", 1), (None, "a/x", "", "t", 1), (7, "a/y", None, "t", 1), (7, "a/y", None, "t", 1), (7, None, notice, "t", 1)]
    df = spark.createDataFrame(rows, FILES)
    got = sorted(((r["doc_id"], r["path"], r["license"], r["origin"]) for r in license_scan.inherit(df, license_scan.scan(df)).collect()), key=str)
    assert got == sorted([(None, "a/LICENSE", "MIT", "own"), (None, "a/x", "MIT", "inherited"), (7, "a/y", "MIT", "inherited"), (7, "a/y", "MIT", "inherited"), (7, None, "MIT", "own")], key=str)
