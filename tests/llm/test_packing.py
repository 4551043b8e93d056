"""Problem 8: containers within capacity, every token placed once, bounds that hold."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from candlery.llm import packing


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_best_fit_and_bound(sizes):
    sizes = np.array(sorted(sizes, reverse=True), np.int64)
    placed, left = packing.best_fit(sizes, 40)
    used = np.bincount(placed, weights=sizes, minlength=len(left)) if len(sizes) else np.zeros(0)
    assert (used <= 40).all() and (40 - used == left).all()
    bound = packing.lower_bound(sizes, 40)
    assert bound <= len(left) and bound >= -(-sizes.sum() // 40)
    if len(sizes) <= 7:
        assert bound <= exact(sizes.tolist(), 40)


def exact(sizes, capacity):
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity:
                bins[k] += sizes[i]
                go(i + 1, bins)
                bins[k] -= sizes[i]
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best


def test_many_groups(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), True, 0, 0, int(s)) for i, s in enumerate(rng.integers(1, 2049, 4000))]
    items = spark.createDataFrame(rows, packing.ITEM)
    for groups, slack in ((4, 1.02), (40, 1.04)):  # sizes up to a whole container are the hardest to pack in small groups
        out = packing.pack_items(items, groups).toPandas()
        assert sorted(out.doc_id) == list(range(4000))
        used = out.groupby(["round", "grp", "bin"]).n_tokens.sum()
        assert used.max() <= 2048
        assert len(used) <= slack * packing.lower_bound(np.array([r[4] for r in rows]))


def test_documents(spark):
    pytest.importorskip("tiktoken")
    rows = [(1, "word " * 5000, 0), (2, None, 0), (3, "", 0), (4, "short", 0), (5, "short", 0)]
    out = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, piece int")).toPandas()
    long = out[out.doc_id == 1].sort_values("piece")
    assert long.n_tokens.tolist()[:2] == [2048, 2048] and long.token_start.tolist() == [0, 2048, 4096]
    assert out[out.doc_id.isin([2, 3])].container.isna().all() and len(out) == 7
    assert out.groupby("container").n_tokens.sum().max() <= 2048
    assert set(out.containers) == {out.container.nunique()} and (out.least <= out.containers).all()
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_groups_exchange_at_any_scale_and_ids_may_be_null(spark, monkeypatch):
    pytest.importorskip("tiktoken")
    monkeypatch.setattr(packing, "GROUP_CONTAINERS", 2)
    rng = np.random.default_rng(5)
    rows = [(None if i % 10 == 0 else i + 2**60, "word " * int(n)) for i, n in enumerate(rng.integers(1, 1500, 80))]
    out = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert len(out) == 80 and out.doc_id.isna().sum() == 8
    assert out.groupby("container").n_tokens.sum().max() <= 2048
    rounds = {c.split("-")[0] for c in out.container}
    assert len({c.split("-")[1] for c in out.container if c[0] == "0"}) > 4 and len(rounds) > 1
    assert out.container.nunique() <= out.least.iloc[0] + 2
