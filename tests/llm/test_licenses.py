"""License scans: names and spans against a plain alignment, edits, insertions, parts."""

import random

import pytest

from varve.llm import license_texts, licenses

FILLER = "some words of a quite different kind stand here and say nothing of rights "


def found(spark, *texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {}
    for r in sorted(licenses.license_matches(df, **options).collect(), key=lambda r: (r.doc_id, r.span_start)):
        out.setdefault(r.doc_id, []).append((r.license, round(r.coverage, 3), r.complete, r.span_start, r.span_end))
    return out


def plain_common(a, b):
    """Length of a longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_every_template_is_found_under_its_own_name(spark):
    wordings = [(name, w) for name, all_of in license_texts.TEMPLATES.items() for w in all_of]
    got = found(spark, *[FILLER + w + "\n" + FILLER for _, w in wordings])
    for k, (name, w) in enumerate(wordings):
        start = len(FILLER)
        assert [(m[0].removesuffix("-only").removesuffix("-or-later"), m[1], m[2]) for m in got[k]] == [(name.removesuffix("-only").removesuffix("-or-later"), 1.0, True)], name
        assert got[k][0][3] == start and start + len(w) - 3 <= got[k][0][4] <= start + len(w)


def test_names_that_differ_by_a_word(spark):
    got = found(
        spark, "Licensed under CC BY-SA 4.0.", "Licensed under CC BY-XY 4.0.", "SPDX-License-Identifier: MIT", license_texts.TEMPLATES["LGPL-2.1"][1],
        "# " + license_texts.MIT.replace("\n", "\n# "), FILLER * 30, None, "",
    )
    assert {k: [m[0] for m in v] for k, v in got.items()} == {0: ["CC-BY-SA-4.0"], 2: ["MIT"], 3: ["LGPL-2.1"], 4: ["MIT"]}


def test_edits_insertions_and_parts_are_measured(spark):
    rng = random.Random(2)
    words = license_texts.MIT.split()
    edited = [w if rng.random() > 0.06 else "changed" for w in words]
    longer = words[:40] + "an added clause of some twenty letters and more that the license does not have".split() + words[40:]
    half = " ".join(words[: len(words) * 2 // 3])
    texts = [" ".join(edited), " ".join(longer), half]
    got = found(spark, *[FILLER + t + " " + FILLER for t in texts])
    solid = lambda t: "".join(c for c in t.lower() if c.isalnum())
    for k, t in enumerate(texts):
        (name, coverage, complete, start, end), = got[k]
        span = solid((FILLER + t + " " + FILLER)[start:end])
        assert name == "MIT"
        assert coverage == pytest.approx(plain_common(solid(license_texts.MIT), span) / max(len(solid(license_texts.MIT)), len(span)), abs=0.02)
    assert got[1][0][1] < 0.96 and got[2][0][2] is False and 0.6 < got[2][0][1] < 0.72


def test_short_lines_match_word_by_word(spark):
    texts = ["Releasd under the MIT License.", "Released under the BIT License.", "Released under the MITX License.", "All rigths reserved", "Licenced under CC BY 4.0.", "Licensed under CC BY 5.0."]
    assert {k: [(m[0], m[2]) for m in v] for k, v in found(spark, *[FILLER + t for t in texts]).items()} == {0: [("MIT", True)], 4: [("CC-BY-4.0", True)]}
    assert licenses.kept_of(b"license", b"licence") == 6 and licenses.kept_of(b"released", b"release") == 7 and licenses.kept_of(b"license", b"licenses") == 7
    assert licenses.kept_of(b"apache", b"apxchx") == licenses.kept_of(b"mit", b"mi") == licenses.kept_of(b"license", b"") == 0
