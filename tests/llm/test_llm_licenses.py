"""Licence texts as they stand in files: wrapped, commented, numbered, with titles and copyright lines."""

import re
import textwrap

import pytest

from tessera.llm import license_scan

WHOLE = [(rule, licence, text) for rule, licence, text in license_scan.TEXTS]


def scanned(spark, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id: r for r in license_scan.license_scan(df).collect()}


def test_every_rule_needs_a_hinted_sentence():
    hinted = {i for s, i in license_scan.SENTENCES.items() if re.search(license_scan._HINTS, s)}
    assert all(set(ids) & hinted or re.search(license_scan._HINTS, text) for (_, ids, _), (_, _, text) in zip(license_scan.RULES, WHOLE, strict=False))
    assert all(set(ids) & hinted for rule, ids, _ in license_scan.RULES[len(WHOLE) :] if not rule.startswith("cc0"))


@pytest.mark.parametrize("width", [40, 78, 100_000])
def test_texts_wrapped_commented_and_plain(spark, width):
    wrap = lambda t: "\n\n".join(textwrap.fill(p, width, break_long_words=False, break_on_hyphens=False) for p in t.split("\n"))
    plain = [wrap(t) for _, _, t in WHOLE]
    comment = ["".join(f" * {x}\n" for x in p.split("\n")) for p in plain]
    slash = ["\n".join(f"// {x}" for x in p.split("\n")) for p in plain]
    tight = [textwrap.fill(re.sub(r"\s+", " ", t), width, break_long_words=False, break_on_hyphens=False) for _, _, t in WHOLE]
    headed = [f"Some Title\nCopyright (c) 2020 A. Person, of Town\n{p}\n\nmore text follows" for p in plain]
    for kind, texts in (("plain", plain), ("comment", comment), ("slash", slash), ("headed", headed), ("tight", tight)):
        got = scanned(spark, texts)
        missed = [(rule, got[k].rule_ids) for k, (rule, _, _) in enumerate(WHOLE) if rule not in got[k].rule_ids]
        assert (kind, missed) == (kind, [])
        assert all(licence in got[k].licenses for k, (_, licence, _) in enumerate(WHOLE))


def test_the_published_mit_file(spark):
    text = next(t for r, _, t in WHOLE if r == "mit_text")
    a, b, c = text.split("\n")
    file = "MIT License\n\nCopyright (c) [year] [fullname]\n\n" + "\n\n".join(textwrap.fill(x, 78) for x in (a, b, c)) + "\n"
    r = scanned(spark, [file])[0]
    assert r.rule_ids == ["mit_text", "mit_title"] and r.licenses == ["MIT"] and r.n_unmatched == 0


def test_numbered_clauses(spark):
    p = next(t for r, _, t in WHOLE if r == "bsd3_text").split("\n")
    text = "\n\n".join(textwrap.fill(x, 72, initial_indent=f"{k}. " if 0 < k < 4 else "", subsequent_indent="   " if 0 < k < 4 else "") for k, x in enumerate(p))
    assert scanned(spark, [text])[0].rule_ids == ["bsd3_text"]


def test_lines_without_marks_and_odd_texts(spark):
    got = scanned(spark, ["prose here\nLicensed under the MIT license\nmore prose", "", None, "MIT\nlicense", "I like the MIT license very much", "Released under the\nApache License, Version 2.0."])
    assert [got[k].rule_ids for k in range(6)] == [["mit_notice"], [], [], ["mit_title"], [], ["apache2_notice"]]


@pytest.mark.parametrize(
    ("text", "licences"),
    [
        ("// SPDX-License-Identifier: MIT\nint x;", ["MIT"]),
        ("/* SPDX-License-Identifier: MIT OR Apache-2.0 */", ["Apache-2.0", "MIT"]),
        ("# SPDX-License-Identifier: GPL-2.0-or-later WITH Something-else", ["GPL-2.0-or-later"]),
        ("name: tool\nLicense: MIT\nversion: 3", ["MIT"]),
        ("Licensed under MIT", ["MIT"]),
        ("Copyright 2020 Me. Released under the MIT License (see LICENSE).", ["MIT"]),
        ("This software is distributed under the terms of the GNU General Public License version 3 or later.", ["GPL-3.0-or-later"]),
        ("Dual licensed under the MIT and GPLv3 licenses.", ["GPL-3.0-only", "MIT"]),
        ("They were released under heavy rain. License: none of these.", []),
        ("The game was released under the name of mit in the river", []),
    ],
)
def test_sentences_with_slots(spark, text, licences):
    assert scanned(spark, [text])[0].licenses == licences


def test_no_rule_reaches_over_other_prose(spark):
    parts = next(t for r, _, t in WHOLE if r == "mit_text").split("\n")
    prose = "\n\n".join(f"It was day {k} of the trip." for k in range(600))
    far, near = (f"\n\n{p}\n\n".join(parts) for p in (prose, "A heading of ours."))
    got = scanned(spark, [far, near])
    assert "mit_text" not in got[0].rule_ids and got[0].n_unmatched == len(got[0].sentence_ids) == len(got[1].sentence_ids)
    assert got[1].rule_ids == ["mit_text"] and got[1].n_unmatched == 0
