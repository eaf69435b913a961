import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomwire.llm import pieces


def greedy(text, limit, overlap):
    """The same cuts, one after the other."""
    start, out = 0, []
    ranks = [sorted(set(map(int, r))) for r in pieces.boundaries(text, limit // 2 - overlap)]
    nodes = sorted({0, len(text), *[p for r in ranks for p in r]})
    at = 0
    while at != len(text):
        start = at - overlap if at else 0
        if start + limit >= len(text):
            end = len(text)
        else:
            least = max(start + int(limit * pieces.MIN_FILL), at + 1)
            end = next((max(p for p in r if p <= start + limit) for r in ranks if any(least <= p <= start + limit for p in r)), None)
            if end is None:
                end = max(p for p in nodes if p <= start + limit)
                end = end if end > at else min(start + limit, len(text))
        out.append((start, end))
        at = end
    return out


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. \n我。，é", max_size=400), st.integers(0, 9))
def test_equals_greedy_walk(text, overlap):
    a, b = pieces.cuts(text, 24, overlap)
    assert list(zip(a.tolist(), b.tolist())) == (greedy(text, 24, overlap) if len(text) > 24 else [(0, len(text))])
    assert a[0] == 0 and b[-1] == len(text) and (b - a).max() <= 24 and (a[1:] == b[:-1] - overlap).all()


def test_natural_ends():
    text = ("A sentence here. " * 30 + "\n\n") * 20
    a, b = pieces.cuts(text, 1000, 100)
    assert all(text[:e].endswith("\n\n") or e == len(text) for e in b)
    assert pieces.cuts("word " * 900, 1000, 0)[1].tolist() == [1000, 2000, 3000, 4000, 4500]
    # no boundary at all, and no cut before a combining mark
    assert all(x[0] != "́" for x in (("é" * 5000)[i:j] for i, j in zip(*pieces.cuts("é" * 5000, 999, 0))))
    with pytest.raises(ValueError):
        pieces.cuts("x" * 50, 10, 5)


def test_rows(spark, rows):
    df = spark.createDataFrame([(1, "x " * 3000, "c"), (2, "y" * 4000, "c"), (3, None, "c"), (4, "", "c"), (1, "x " * 3000, "c")], "item_id int, raw string, pieces string")
    assert rows(pieces.split_oversized(df), "item_id") == [(1,), (1,)]
    got = pieces.piece_rows(df).where("item_id = 1").collect()
    assert {r.piece_no for r in got} == {1, 2} and all(len(r.piece) <= 4000 and r.end - r.start == len(r.piece) for r in got)
    assert pieces.split_oversized(df.where("false")).count() == 0
