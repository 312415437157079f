from collections import Counter

import corpus_pipeline as pipeline
import pytest
from conftest import corpus, frame, prose
from test_decontaminate import brute as contaminated
from test_neardup import brute as components
from test_packing import expected_pieces
from test_suffixes import gone_bytes

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    import random

    folder = tmp_path_factory.mktemp("tables")
    rows = [row for row in dict(corpus()[:-5]).items()]
    rng = random.Random(9)
    leak = prose(rng, 30)
    rows += [(500, prose(rng, 80) + " " + leak + " " + prose(rng, 20))]
    frame(spark, rows).select(*COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, leak), (2, "never seen " * 9)], "item_id long, text string").write.parquet(
        f"{folder}/benchmark.parquet"
    )
    return str(folder), rows, [(1, leak), (2, "never seen " * 9)]


def test_stages_against_brute_force(spark, sf):
    folder, rows, items = sf
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [name for name, _ in pipeline.STAGES]
    assert names == ["language", "near_duplicates", "repeats", "decontamination", "packing"]
    steps = dict(pipeline.STAGES)

    found = steps["language"](spark, docs, folder)
    rows = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    assert found.columns == COLUMNS and sorted((r.doc_id, r.text) for r in found.collect()) == sorted(rows)

    found = steps["near_duplicates"](spark, frame(spark, rows).select(*COLUMNS), folder)
    keep = {i for i, _, c in components(rows, 5) if i == c}
    assert 0 < len(keep) < len(rows)
    rows = [(i, t) for i, t in rows if i in keep]
    assert found.columns == COLUMNS and sorted((r.doc_id, r.text) for r in found.collect()) == sorted(rows)

    found = steps["repeats"](spark, frame(spark, rows).select(*COLUMNS), folder)
    shortened = []
    for (doc_id, text), (_, gone) in zip(rows, gone_bytes(rows, pipeline.REPEATS.window), strict=True):
        kept, at = [], 0
        for c in text:
            width = len(c.encode())
            if not all(i in gone for i in range(at, at + width)):
                kept.append(c)
            at += width
        shortened.append((doc_id, "".join(kept)))
    assert shortened != rows
    assert found.columns == COLUMNS and sorted((r.doc_id, r.text) for r in found.collect()) == sorted(shortened)
    assert all(r.n_chars == len(r.text) for r in found.collect())
    rows = shortened

    found = steps["decontamination"](spark, frame(spark, rows).select(*COLUMNS), folder)
    bad = {k[0] for k in contaminated(rows, items) if k[-1]}
    assert 500 in bad
    rows = [(i, t) for i, t in rows if i not in bad]
    assert found.columns == COLUMNS and sorted((r.doc_id, r.text) for r in found.collect()) == sorted(rows)

    found = steps["packing"](spark, frame(spark, rows).select(*COLUMNS), folder).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == Counter(expected_pieces(rows))

    whole = pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in whole) == Counter((r.doc_id, r.piece, r.ids_crc32) for r in found)


def test_awkward_rows_and_empty_tables(spark, docs, no_docs, sf):
    folder, _, _ = sf
    for name, step in pipeline.STAGES:
        assert step(spark, no_docs, folder).collect() == []
        found = step(spark, docs, folder)
        if name != "packing":
            assert found.columns == docs.columns
        assert found.count() > 0


def test_one_row_of_each_group_whatever_the_ids(spark):
    """Copies without an id go too, equal rows are one, and odd column names do no harm."""
    import random

    rng = random.Random(5)
    a, b, c = (prose(rng, 90) for _ in range(3))
    rows = [(5, a), (None, a + " x"), (9, b), (None, b + " y"), (7, a), (7, b), (3, c), (3, c), (None, ""), (None, None)]
    odd = spark.createDataFrame([(i, t, n, n, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, `a.b` long, _kept long, id_key long")
    found = pipeline.one_of_near_copies(spark, odd, "")
    assert found.columns == odd.columns
    got = Counter((r.doc_id, r.text) for r in found.collect())
    assert got == Counter([(5, a), (7, b), (3, c), (None, ""), (None, None)])
    again = pipeline.without_repeats(spark, odd, "")
    assert again.columns == odd.columns and again.count() == len(rows)
