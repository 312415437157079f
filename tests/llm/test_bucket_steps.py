"""Buckets worked on in steps give what they give at once."""

import random

import numpy as np
import pyarrow as pa
import pytest

from anchorline.llm import substrings, suffixes, superkmers


def bucket(rng, n, length):
    """Strings over two letters, so that windows repeat often, as a bucket's table."""
    strings = sorted({bytes(rng.choice(b"ab") for _ in range(rng.randint(length, 2 * length))) for _ in range(n)})
    return pa.table(
        {
            "minimiser": pa.array([5] * len(strings), pa.int64()),
            "content": pa.array(range(len(strings)), pa.int64()),
            "copies": pa.array([rng.randint(1, 2) for _ in strings], pa.int64()),
            "packed": pa.array(strings, pa.binary()),
        }
    )


def arrays(scheme, table, **options):
    rows = [r for batch in suffixes._scan(scheme, **options)(table) for r in batch.to_pylist()]
    return sorted(map(repr, rows))


@pytest.mark.parametrize("step", [1, 7, 100])
def test_classes_of_windows_give_the_same_arrays(step):
    scheme = superkmers.Scheme(window=6, k=3, words=False)
    table = bucket(random.Random(step), 60, 8)
    whole = arrays(scheme, table)
    assert arrays(scheme, table, step=step) == whole != []


def test_window_hashes_of_steps():
    rng = np.random.default_rng(3)
    data, sizes = rng.integers(0, 9, 300).astype(np.uint8), np.array([50, 7, 43, 200])
    begins = np.cumsum(sizes) - sizes
    whole = suffixes.Prefix(data).windows(7)
    wanted = np.concatenate([whole[b : b + n - 6] for b, n in zip(begins, sizes, strict=True)])
    assert (suffixes._heads(data, begins, sizes, 7) == wanted).all()


@pytest.mark.parametrize("budget", [1, 60, 200, 10_000])
def test_steps_cut_between_rows_only_and_keep_them_all(budget):
    sizes, cuts = np.array([50, 7, 43, 200, 1, 1]), np.array([1, 3, 4, 6])
    edges = superkmers.step_edges(sizes, cuts, budget)
    assert edges[0] == 0 and edges[-1] == 6 and set(edges[1:]) <= set(cuts.tolist())
    for a, b in zip(edges, edges[1:], strict=False):
        assert a < b and (sizes[a:b].sum() <= budget or not set(range(a + 1, b)) & set(cuts.tolist()))


def test_counts_of_windows_in_steps():
    rng = random.Random(9)
    strings = [b" ".join(rng.choice([b"a", b"b"]) for _ in range(rng.randint(5, 20))) for _ in range(40)]
    copies, ids = [1] * 40, [rng.randint(0, 9) for _ in range(40)]
    whole = list(substrings.count_windows(strings, copies, ids, 5))
    assert list(substrings.count_windows(strings, copies, ids, 5, step=100)) == whole != []
