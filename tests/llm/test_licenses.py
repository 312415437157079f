from anchorline.llm import licenses as op


def scan(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(op.report(docs, **options).collect())


def test_notices_are_found_with_their_place(spark):
    notice = op.TEMPLATES["GPL-3.0 notice"]
    words = notice.split()
    edited = " ".join(words[:12] + ["brand", "new"] + words[14:30] + words[31:])
    texts = [
        "é before\n" + op.TEMPLATES["MIT"] + " and after",
        "nothing here of the kind",
        f"// {notice.upper()}\n" + op.TEMPLATES["Apache-2.0"],
        edited,
        None,
        "",
        "licensed under",
        op.TEMPLATES["CC-BY-NC-4.0"],
    ]
    got = scan(spark, texts)
    found = [(r.doc_id, r.license, r.coverage == 1) for r in got]
    assert found == [
        (0, "MIT", True),
        (2, "Apache-2.0", True),
        (2, "GPL-3.0 notice", True),
        (3, "GPL-3.0 notice", False),
        (7, "CC-BY-NC-4.0", True),
    ]
    first = got[0]
    assert texts[0].encode()[first.start : first.end] == b"Released under the MIT License"
    changed = got[3]
    assert changed.n_matched == len(words) + notice.count("/") - 3
    assert len(changed.spans) == 3 - 1
    for span in changed.spans:
        assert changed.start <= span.lo < span.hi <= changed.end


def test_alignment_is_the_longest_common_subsequence_in_the_band():
    import random

    def lcs(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    rng = random.Random(5)
    for _ in range(200):
        template = [rng.randint(0, 6) for _ in range(rng.randint(1, 12))]
        text = [rng.randint(0, 6) for _ in range(rng.randint(1, 12))]
        pairs = op.align(template, text, 0, band=30)
        assert len(pairs) == lcs(template, text)
        assert all(template[i] == text[j] for i, j in pairs)
        assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:], strict=False))


def test_awkward_rows(docs, no_docs):
    assert op.report(docs).collect() == []
    assert op.report(no_docs).collect() == []


def test_repeated_notices_are_several_rows(spark):
    text = " filler words between them ".join([op.TEMPLATES["MIT"]] * 3)
    got = scan(spark, [text, text])
    assert [(r.doc_id, r.license) for r in got] == [(0, "MIT")] * 3 + [(1, "MIT")] * 3


def test_relatives_are_not_taken_for_each_other(spark):
    wanted = {
        "This work is licensed under the GNU General Public License, version 2.": ["GPL-2.0"],
        "This work is licensed under the GNU Lesser General Public License, version 3.": ["LGPL-3.0"],
        "This work is licensed under the GNU Affero General Public License, version 3.": ["AGPL-3.0"],
        "This work is licensed under the GNU General Public License, version 1.": [],
        "Licensed under CC BY-ND 4.0": ["CC-BY-ND-4.0"],
        "Licensed under CC BY-NC-SA 4.0": ["CC-BY-NC-SA-4.0"],
        "Licensed under CC BY 3.0": [],
        "Released under the BSD 3-Clause License": ["BSD-3-Clause"],
        "Released under the XYZ License": [],
        "Released under the License": [],
        "This work is licensed under the GNU General Public License": [],
        "Licensed under the Apache License, Version 1.1": [],
        op.TEMPLATES["MPL-2.0"]: ["MPL-2.0"],
        op.TEMPLATES["LGPL-2.1 notice"]: ["LGPL-2.1 notice"],
    }
    got = scan(spark, list(wanted))
    assert [[r.license for r in got if r.doc_id == at] for at in range(len(wanted))] == list(wanted.values())
    alone = {"GPL-3.0": op.TEMPLATES["GPL-3.0"]}  # the relative has no template of its own
    texts = [op.TEMPLATES["LGPL-3.0"], op.TEMPLATES["AGPL-3.0"], op.TEMPLATES["GPL-2.0"]]
    assert scan(spark, texts, templates=alone) == []


def test_words_between_lower_the_coverage(spark):
    words = op.TEMPLATES["MIT"].split()
    (row,) = scan(spark, [" ".join([words[0], "some", *words[1:]])])
    assert (row.license, row.n_matched, row.coverage) == ("MIT", 5, 5 / 6)
    assert scan(spark, [" ".join([words[0], "some", "of", *words[1:]])]) == []


def test_every_template_against_brute_force(spark):
    """Templates with edits in prose: every diagonal of every template is aligned."""
    import random
    import re

    rng = random.Random(21)
    filler = ["lorem", "ipsum", "the", "of", "dolor", "software", "is", "amet"]
    texts = []
    for text in op.TEMPLATES.values():
        words = re.findall(r"[A-Za-z0-9]+", text)
        for edits in (0, len(words) // 12, len(words) // 3):
            own = list(words)
            for _ in range(edits):
                at = rng.randrange(len(own))
                own[at : at + rng.randint(0, 1)] = [rng.choice(filler)] * rng.randint(0, 1)
            texts.append(" ".join([*rng.choices(filler, k=5), *own, *rng.choices(filler, k=5)]))

    def longest(template, text, first):
        band = op.BAND
        best = {}
        for i in range(len(template) + 1):
            for d in range(-band, band + 1):
                j = first + i + d  # words of the text before this cell
                found = []
                if i and j > 0 and j <= len(text) and template[i - 1] == text[j - 1]:
                    found.append(best.get((i - 1, d), 0) + 1)
                best[i, d] = max([*found, best.get((i - 1, d + 1), 0) if i else 0, best.get((i, d - 1), 0) if i else 0])
        return max(best[len(template), d] for d in range(-band, band + 1))

    got = {(r.doc_id, r.license): r.n_matched for r in scan(spark, texts)}
    split = {name: re.findall(r"[a-z0-9]+", text.lower()) for name, text in op.TEMPLATES.items()}
    for doc, text in enumerate(texts):
        words = text.lower().split()
        whole = list(split)[doc // 3]
        if doc % 3 == 0:  # the untouched one is found whole
            assert got[doc, whole] == len(split[whole])
        for name in {n for d, n in got if d == doc}:  # whatever is found, no diagonal holds more of it
            most = max(longest(split[name], words, f) for f in range(-op.BAND, len(words)))
            assert 0.8 * len(split[name]) <= got[doc, name] <= most
            if len(split[name]) == len(split[whole]):
                assert re.sub(r"\d", "", name) == re.sub(r"\d", "", whole)  # a version may be lost


def test_templates_from_a_folder(spark, tmp_path):
    (tmp_path / "own-1.0.txt").write_text("May be used by anyone\nfor anything at all, forever.")
    found = op.stored_templates(spark, str(tmp_path))
    assert list(found) == ["own-1.0"]
    (row,) = scan(spark, ["so: may be used by anyone for anything at all forever"], templates=found)
    assert (row.license, row.coverage) == ("own-1.0", 1.0)
    import pytest

    with pytest.raises(ValueError):
        op.stored_templates(spark, str(tmp_path), limit=5)
