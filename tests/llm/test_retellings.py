"""Problem 1: pairs against brute force, alignment against the textbook, groups."""

import itertools
import os
import re
from collections import Counter

import numpy as np
import pytest

from candlery.llm import retellings


def distance(a, b):
    """Insertions and deletions between two sequences."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] if x == y else min(row[j], new[-1]) + 1)
        row = new
    return row[-1]


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        k = int(rng.integers(len(words) + 1))
        if rng.random() < 0.5 and words:
            words.pop(min(k, len(words) - 1))
        else:
            words.insert(k, f"new{rng.integers(99)}")
    return words


def flat(sequences):
    return np.concatenate([np.asarray(x, np.int64) for x in sequences]), np.array([len(x) for x in sequences])


def test_banded_alignment():
    rng = np.random.default_rng(1)
    a = [rng.integers(0, 6, rng.integers(0, 14)) for _ in range(300)]
    b = [np.array([hash(w) % 97 if isinstance(w, str) else w for w in edited(rng, x, int(rng.integers(5)))], np.int64) for x in a]
    band = rng.integers(0, 7, 300)
    truth = np.array([distance(x.tolist(), y.tolist()) for x, y in zip(a, b, strict=True)])
    found = retellings.banded_edits(*flat(a), *flat(b), band)
    assert (found[truth <= band] == truth[truth <= band]).all()
    assert ((found == -1) | (found >= truth)).all()


def test_words_of_many_texts_at_once():
    texts = ["One, two.  TWO 1.5 x", "", "…", "да́та і मूल्य 价格上涨 ราคา١٢ e\u0301", "İstanbul ΣΑΣ, a_b", "x" * 70_000]
    hashes, lengths, begins = retellings.tokenised(texts)
    expected = [re.findall(r"[^\W_]+", t.lower()) for t in texts]
    assert lengths.tolist() == [len(w) for w in expected]
    seen = {}
    for word, h in zip([w for words in expected for w in words], hashes.tolist(), strict=True):
        assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)
    assert begins.tolist()[:6] == [True, False, True, False, False, False]


def test_moved_sentences_are_aligned():
    a = "The bank sold nine rigs. Lenders froze forty accounts at noon! A court in Pell cut its fee? Miners moved north."
    b = "A court in Pell cut its fee. Miners moved north. Lenders froze forty accounts at noon. The bank sold nine rigs."
    edits, similar = retellings.judged_pairs([a, a, a], [b, a, "nothing of that"], 0.7)
    assert edits.tolist() == [0, 0, -1] and similar.tolist() == [True, True, False]
    keys = [set(retellings.sketch_keys(*retellings.tokenised([t]))[0].tolist()) for t in (a, b)]
    assert keys[0] == keys[1]


def test_candidates_cost_no_more_than_they_need(monkeypatch):
    """A text of several candidate pairs is cut once; only similar pairs are aligned."""
    rng = np.random.default_rng(5)
    one = [f"w{k}" for k in rng.integers(0, 10**6, 60)]
    near, far = one[:55] + ["x"] * 5, one[:30] + [f"v{k}" for k in range(30)]
    texts = [" ".join(x) for x in (one, near, far)]
    first, second = [texts[0]] * 10, [texts[1]] + [texts[2]] * 9
    cut, aligned = [], []
    words, edits = retellings.tokenised, retellings.banded_edits
    monkeypatch.setattr(retellings, "tokenised", lambda x: cut.extend(x) or words(x))
    monkeypatch.setattr(retellings, "banded_edits", lambda a, la, *rest: aligned.extend(la.tolist()) or edits(a, la, *rest))
    found = retellings.judged_pairs(first, second, 0.7)
    assert found[0].tolist() == [10] + [-1] * 9 and found[1].tolist() == [True] + [False] * 9
    assert sorted(cut) == sorted(texts) and aligned == [60]


def test_pairs_against_counted_words():
    """Words that come again, moved words, empty texts: similar is what the counts say, edits never say more."""
    rng = np.random.default_rng(11)
    words = [rng.integers(0, 30, rng.integers(0, 40)).astype(str).tolist() for _ in range(400)]
    others = [rng.permutation(edited(rng, w, int(rng.integers(0, 12)))).tolist() if k % 2 else edited(rng, w, int(rng.integers(0, 12))) for k, w in enumerate(words)]
    edits, similar = retellings.judged_pairs([" ".join(w) for w in words], [" ".join(w) for w in others], 0.7)
    for a, b, e, s in zip(words, others, edits.tolist(), similar.tolist(), strict=True):
        shared, total = sum((Counter(a) & Counter(b)).values()), sum((Counter(a) | Counter(b)).values())
        assert s == (total > 0 and shared / total >= 0.7 - 1e-9)
        assert e == -1 or (s and len(a) + len(b) - e <= 2 * shared)
    assert 100 < similar.sum() < 400


def test_sketches_of_long_and_empty_texts():
    sentences = [" ".join(f"s{k}w{j}" for j in range(50)) + "." for k in range(100)]
    keys, owners = retellings.sketch_keys(*retellings.tokenised([" ".join(sentences), "", " ".join(sentences[::-1])]))
    assert set(owners.tolist()) == {0, 2} and set(keys[owners == 0].tolist()) == set(keys[owners == 2].tolist())
    assert [len(x) for x in retellings.sketch_keys(*retellings.tokenised(["", "..."]))] == [0, 0]


@pytest.mark.parametrize(("replaced", "least"), [(12, 0.6), (10, 0.85), (8, 0.95)])
def test_recall_by_similarity(replaced, least):
    """Texts of 80 words, some replaced, with their sentences moved: how many pairs share a sketch."""
    rng = np.random.default_rng(3)
    firsts, seconds, n = [], [], 2_000
    for _ in range(n):
        words = [f"w{k}" for k in rng.integers(0, 10**6, 80)]
        other = list(words)
        for k in rng.choice(80, replaced, replace=False):
            other[k] = f"n{rng.integers(10**6)}"
        first, second = (" ".join(w + ("." if k % 10 == 9 else "") for k, w in enumerate(x)) for x in (words, other))
        firsts.append(first)
        seconds.append(" ".join(second.split(". ")[::-1]))
    keys = [set(zip(*(x.tolist() for x in retellings.sketch_keys(*retellings.tokenised(side))[::-1]), strict=True)) for side in (firsts, seconds)]
    met = len({text for text, _ in keys[0] & keys[1]})
    assert met >= least * n


def stories(rng, n):
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        words = [vocabulary[k] for k in rng.integers(0, 400, rng.integers(3, 70))]
        for _ in range(int(rng.integers(1, 4))):
            text = edited(rng, words, int(rng.integers(0, 1 + len(words) // 6)))
            cut = int(rng.integers(len(text) + 1))
            if rng.random() < 0.2:
                text = text[cut:] + text[:cut]
            rows.append((len(rows), " ".join(text[:5]).upper(), ", ".join(text[5:]), "clash"))
    return rows


def truth(rows):
    bags = [(i, Counter(re.findall(r"[^\W_]+", f"{t or ''} {s or ''}".lower()))) for i, t, s, _ in rows]
    out = set()
    for (i, x), (j, y) in itertools.combinations(bags, 2):
        shared = sum((x & y).values())
        total = sum((x | y).values())
        if i != j and total and shared / total >= 0.7:
            out.add((min(i, j), max(i, j)))
    return out


def test_pairs_and_groups(spark):
    rows = stories(np.random.default_rng(7), 90)
    extra = [(900, None, None, None), (901, "", "...", None), (902, "same", None, None), (903, None, "SAME!", None), (904, "same", None, None), (904, "same", None, None)]
    items = spark.createDataFrame(rows + extra, "news_id long, title string, summary string, cls string")
    found = [tuple(r) for r in retellings.similar_pairs(items, "news_id", "title", "summary").collect()]
    expected = truth(rows + extra)
    assert len(found) == len(set(found)) and set(found) <= expected
    assert len(expected - set(found)) <= 0.02 * len(expected)
    groups = {r.item: r for r in retellings.story_groups(items, "news_id", "title", "summary").collect()}
    assert len(groups) == len(rows) + 3 and all(groups[a].story == groups[b].story for a, b in found)
    assert groups[902].copies == 3 and groups[902].links == 0


def test_empty(spark):
    empty = spark.createDataFrame([], "news_id long, title string, summary string")
    assert retellings.similar_pairs(empty, "news_id", "title", "summary").count() == 0
    assert retellings.story_groups(empty, "news_id", "title", "summary").count() == 0


def test_components_of_long_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(100, 300)]
    star = [(1_000, 2_000 + k) for k in range(50)]
    pairs = [(7, 5), (5, 7), (9, 9)]
    edges = spark.createDataFrame(chain + star + pairs, "a long, b long")
    found = {r.node: r.least for r in retellings.components(edges).collect()}
    expected = {k: 100 for k in range(100, 301)} | {k: 1_000 for k in [1_000, *range(2_000, 2_050)]} | {5: 5, 7: 5}
    assert found == expected


# all pairs of items by the words they share, through an inverted index of words told apart by their occurrence.
P1_FOUND_SQL = r"""with i as (select distinct news_id, regexp_extract_all(lower(concat_ws(' ', title, summary)), '([\p{L}\p{N}]+)', 1) as ws from news_items where news_id is not null),
 d as (select news_id, ws, len(ws) as n from i where len(ws) > 0), w as (select news_id, n, unnest(ws) as word from d), l as (select news_id, n, word, row_number() over (partition by news_id, word) as k from w),
 s as (select a.news_id as news_id_a, b.news_id as news_id_b, a.n as na, b.n as nb, count(*) as shared from l a join l b on a.word = b.word and a.k = b.k and a.news_id < b.news_id and a.n >= 0.7 * b.n and b.n >= 0.7 * a.n group by 1, 2, 3, 4)
 select news_id_a, news_id_b from s where shared >= 0.7 * (na + nb - shared) - 1e-9"""


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data here")
def test_recall_on_news(spark):
    import duckdb

    folder = "/root/testdata/sf0.01"
    connection = duckdb.connect()
    connection.execute(f"create view news_items as select * from '{folder}/news_items.parquet'")
    expected = set(connection.execute(P1_FOUND_SQL).fetchall())
    found = {tuple(r) for r in retellings.similar_pairs(spark.read.parquet(f"{folder}/news_items.parquet"), "news_id", "title", "summary").collect()}
    assert found <= expected and len(found) >= 0.995 * len(expected) > 100
