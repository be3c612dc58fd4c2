import random
from itertools import combinations

import numpy as np
import pytest

from tidemill.llm import ngram_join as nj


def brute(rows, k, num, den):
    sets = []
    for _, t in rows:
        w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")).replace("\n", " ").replace("\t", " ").split(" ") if x]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and den * len(a & b) >= num * len(a | b):
            up[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[root(i)] = min([x for x in (low.get(root(i)), d) if x is not None], default=None)
    return sorted(((d, len(sets[i]), low[root(i)]) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, groups, size, words=60):
    r, vocab = random.Random(seed), [f"w{i}" for i in range(40)]
    rows = []
    for _ in range(groups):
        base = [r.choice(vocab) for _ in range(r.choice([3, 5, 8, 20, words, 3 * words]))]
        for _ in range(r.randint(1, size)):
            own = list(base)
            for _ in range(r.randint(0, max(1, len(own) // 40))):
                own[r.randrange(len(own))] = r.choice(vocab)
            if r.random() < 0.3:
                own.insert(r.randrange(len(own)), "X" * r.randint(1, 3))
            rows.append((len(rows), " ".join(own)))
    return rows


@pytest.mark.parametrize("k,num,den", [(4, 85, 100), (5, 80, 100)])
def test_equals_brute_force(spark, k, num, den, monkeypatch):
    rows = corpus(k, 12, 40) + [(9001, None), (9002, ""), (9003, " \n\t"), (None, "one two three"), (9004, "One two  three"), (9004, "One two  three"), (9005, "é" * 40)]
    monkeypatch.setattr(nj, "BLOCK", 7)
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n long, node string").repartition(5)
    got = nj.ngram_jaccard_join(docs, k, num, den).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, k, num, den)


def test_counts_every_link(spark, monkeypatch):
    r, vocab = random.Random(9), [f"w{i}" for i in range(300)]
    base = [r.choice(vocab) for _ in range(120)]
    rows = [(i, " ".join(w for j, w in enumerate(base) if not (i and j in (i, i // 3)))) for i in range(60)] + corpus(4, 5, 8) + [(9001, None), (9002, " ".join(base))]
    monkeypatch.setattr(nj, "BLOCK", 7)
    got = nj.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 4, 85, 100).collect()
    cut = lambda t: (t or "").lower().split()
    sets = [frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset() for w in (cut(t) for _, t in rows)]
    links = [sum(1 for b in set(sets) if a and b and a != b and 100 * len(a & b) >= 85 * len(a | b)) for a in sets]
    assert sorted((r.doc_id, r.n_links) for r in got) == sorted((d, n) for (d, _), n in zip(rows, links, strict=True))
    assert max(links) > 30


def test_empty_table(spark):
    assert nj.ngram_jaccard_join(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_pieces_of_long_texts_hash_like_the_whole(monkeypatch):
    text = " ".join(f"word{i % 97}" for i in range(3000))
    whole = next(nj.text_sets([text], 4))
    monkeypatch.setattr(nj, "_PIECE", 1 << 10)
    assert np.array_equal(whole, next(nj.text_sets([text], 4)))


@pytest.mark.parametrize("rows", [10, 10_000, 10_000_000])
def test_allocation_meets_the_pigeonhole_bound(rows):
    for low, high in nj.bands(5000, 85, 100):
        exact, deletion = nj.allocate(low, high, rows, 85, 100)
        budget = 2 * high * 15 // 185
        assert exact + 2 * deletion == (budget + 1 if budget else 0)


def test_fine_histograms_bound_the_overlap():
    r = np.random.default_rng(5)
    draw = lambda n: np.unique(r.integers(0, 1 << 64, n, np.uint64, endpoint=False) if n else np.zeros(0, np.uint64))
    assert nj._fine(draw(1000)) is None
    for n, m, both in [(3000, 3000, 2800), (4000, 4200, 3700), (5000, 5000, 0), (8191, 8193, 7000)]:
        shared = draw(both)
        a, b = (np.unique(np.concatenate((shared, draw(x - both)))) for x in (n, m))
        top = nj._overlap(nj._fine(a), nj._fine(b))
        assert top >= len(np.intersect1d(a, b))
        assert top == nj._overlap(nj._fine(b), nj._fine(a))
        if not both:
            assert 100 * top < 85 * (len(a) + len(b) - top)
