from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from anchorline.operators import first_with_next, next_in_key

T0 = datetime(2100, 1, 1)
SCHEMA = "k int, t timestamp_ntz, id int"


def brute_next(rows):
    """(row, following time) by time with NULLs last, then id."""
    out = []
    for key in {r[0] for r in rows}:
        mine = sorted(
            (r for r in rows if r[0] == key), key=lambda r: (r[1] is None, r[1] or T0, r[2])
        )
        for row, after in zip(mine, mine[1:] + [None]):
            out.append((*row, after[1] if after else None))
    return out


def frames(hours):
    return [
        (k, None if h is None else T0 + timedelta(hours=h), i) for i, (k, h) in enumerate(hours)
    ]


row = st.tuples(st.integers(0, 2), st.one_of(st.none(), st.integers(0, 80)))


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(row, min_size=1, max_size=25))
def test_next_and_first_match_brute_force(spark, hours):
    rows = frames(hours)
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(brute_next(rows), key=repr)
    got = next_in_key(df, "k", "t", "id", "after")
    assert got.columns == ["k", "t", "id", "after"]
    assert sorted(map(tuple, got.collect()), key=repr) == want
    firsts = {}
    for r in brute_next(rows):
        firsts.setdefault(r[0], r)
    first = first_with_next(df, "k", "t", ["id"], "after").collect()
    assert sorted(map(tuple, first), key=repr) == sorted(firsts.values(), key=repr)


def test_rows_without_key_are_kept(spark):
    df = spark.createDataFrame([(None, T0, 1), (None, T0, 2)], SCHEMA)
    assert [r.after for r in next_in_key(df, "k", "t", "id", "after").collect()] == [None, None]
