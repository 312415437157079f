import math
from collections import Counter

import pytest
from oracle_check import compare, duck

import __spark_entry__ as entry
from anchorline.llm import lm as op


def brute(rows, min_count):
    texts = [(t or "").encode().split() for _, t in rows]
    counts = [Counter(tuple(w[i : i + n]) for w in texts for i in range(len(w) - n + 1)) for n in range(1, 4)]
    total = sum(counts[0].values())

    def score(gram):
        if len(gram) == 1:
            return math.log(counts[0][gram] / total)
        seen = counts[len(gram) - 1][gram]
        if seen >= min_count:
            return math.log(seen / counts[len(gram) - 2][gram[:-1]])
        return math.log(op.BACKOFF) + score(gram[1:])

    sums, sizes = Counter(), Counter()
    for (doc_id, _), words in zip(rows, texts, strict=True):
        sums[doc_id] += sum(score(tuple(words[max(0, i - 2) : i + 1])) for i in range(len(words)))
        sizes[doc_id] += len(words)
    return {i: (sizes[i], sums[i]) for i in sizes}


@pytest.mark.parametrize("min_count", [1, 2, 5])
def test_against_brute_force(docs, rows, min_count):
    expected = brute(rows, min_count)
    got = op.word_report(docs, min_count).collect()
    assert {r.doc_id for r in got} == set(expected) and len(got) == len(expected)
    for r in got:
        size, total = expected[r.doc_id]
        assert r.n_words == size
        if size:
            assert r.log_score == pytest.approx(total, abs=2e-3)
            assert r.mean_log_score == pytest.approx(total / size, abs=2e-6)
        else:
            assert r.log_score is None and r.mean_log_score is None


def test_an_order_of_words_that_bytes_do_not_show_scores_lower(spark):
    line = "ab ba aa bb ab ab ba ba aa bb"
    rows = [(i, line) for i in range(9)] + [(9, " ".join(line.split()[::-1]))]
    got = {r.doc_id: r.mean_log_score for r in op.word_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[9] < got[0]


def test_an_empty_table(no_docs):
    assert op.word_report(no_docs).collect() == []


def test_registered_word_form_against_sql(spark, sf_dir):
    name = "op10_word_backoff"
    actual, expected = compare(entry.queries()[name](spark, sf_dir), duck(sf_dir), entry.oracle_sql()[name])
    assert actual == expected
