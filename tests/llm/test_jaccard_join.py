"""What travels in the Jaccard join: groups of sets that share shingles by chance alone, and groups of many blocks."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.llm import jaccard_join


def _want(texts, n, percent):
    """(n_shingles, component_id, n_links) of each text, by every pair."""
    sets, parent, links = [], list(range(len(texts))), Counter()
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    find = lambda a: a if parent[a] == a else find(parent[a])
    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if x and y and percent * max(len(x), len(y)) <= 100 * min(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                links.update((a, b))
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {k: (len(x), find(k), links[k]) for k, x in enumerate(sets)}


def _run(spark, texts, n, percent, monkeypatch):
    """What similar_components finds, and the bytes of shingles that were sent to each call of _joined."""
    sent, joined = [], jaccard_join._joined

    def counted(sets, percent):
        sent.append(sets.agg(F.sum(F.length("shingles"))).first()[0] or 0)
        return joined(sets, percent)

    monkeypatch.setattr(jaccard_join, "_joined", counted)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.similar_components(table, n, percent).collect()}, sent


def _edited(rng, words, many):
    words = list(words)
    for _ in range(many):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(1000)}"
    return words


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (2, 80)])
def test_shingles_shared_by_chance_make_no_groups(spark, n, percent, monkeypatch):
    """Over half of the shingles stand in other texts too; all the same only texts that are alike may be sent to be joined."""
    monkeypatch.setattr(jaccard_join, "TREE_SHINGLES", 5000)
    rng = random.Random(8)
    words = [f"w{k}" for k in range(45 if n == 3 else 300)]
    texts = [[rng.choice(words) for _ in range(rng.randint(100, 300))] for _ in range(500)]
    texts += [_edited(rng, texts[k], k % 6) for k in range(40)]
    texts = [" ".join(t) for t in texts]
    want = _want(texts, n, percent)
    got, sent = _run(spark, texts, n, percent, monkeypatch)
    assert got == want and sum(x[2] > 0 for x in want.values()) >= 40
    # before, all texts were one group of over 15 blocks, and each block was sent to each
    assert sum(sent) < 8 * sum(x[0] for x in want.values()) / 2


def test_large_groups_are_joined_in_rounds(spark, monkeypatch):
    """Copies that are all alike are a group of many blocks: no round sends more than all sets and the single blocks."""
    monkeypatch.setattr(jaccard_join, "TREE_SHINGLES", 1500)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    texts = [" ".join(_edited(rng, base, 1 + k % 3)) for k in range(150)] + [" ".join(f"x{k}y{i}" for i in range(40)) for k in range(60)]
    want = _want(texts, 3, 90)
    got, sent = _run(spark, texts, 3, 90, monkeypatch)
    assert got == want and max(x[2] for x in want.values()) > 40
    assert len(sent) > 3 and max(sent) <= 3 * 8 * sum(x[0] for x in want.values())


@pytest.mark.parametrize(("n", "percent"), [(3, 75), (1, 75), (1, 74), (2, 50), (3, 100)])
def test_other_thresholds(spark, n, percent, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT_LEAST", 2)
    rng = random.Random(10)
    words = [f"w{k}" for k in range(400)]
    texts = [[rng.choice(words) for _ in range(rng.choice([2, 4, 9, 20, 60]))] for _ in range(80)]
    texts += [_edited(rng, texts[k], rng.randrange(1 + len(texts[k]) // 6)) for k in range(80)]
    texts = [" ".join(t) for t in texts]
    assert _run(spark, texts, n, percent, monkeypatch)[0] == _want(texts, n, percent)


def test_sets_that_link_share_a_part():
    rng = np.random.default_rng(11)
    for percent in (75, 80, 90, 95):
        pairs = 0
        for _ in range(1500):
            size = int(rng.integers(1, 40)) if rng.random() < 0.6 else int(rng.integers(40, 700))
            base = rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2)
            differ = int(rng.integers(0, size * (100 - percent) // 100 + 2))
            own = int(rng.integers(0, differ + 1))
            a = np.unique(base[: max(1, size - own)])
            b = np.unique(np.append(base[min(size - 1, differ - own) :], rng.integers(0, 1 << 63, int(rng.integers(0, 2)), dtype=np.uint64)))
            if np.array_equal(a, b) or 100 * len(np.intersect1d(a, b)) < percent * len(np.union1d(a, b)):
                continue
            pairs += 1
            token, sign = jaccard_join._parts(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), percent)
            one, other = (set(token[sign == s].tolist()) for s in np.unique(sign))
            assert one & other, (percent, len(a), len(b))
        assert pairs > 200
