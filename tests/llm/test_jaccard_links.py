"""Links of the n-gram Jaccard join near the threshold, against brute force."""

import random

import numpy as np
import pytest

from forecourt.llm import jaccard_join
from forecourt.llm.jaccard_join import compared, ngram_jaccard_groups, shingle_sets


def shingles(text, size):
    words = text.lower().split()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set())


def brute_force(rows, size, num, den):
    sets = {i: shingles(t, size) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            common = len(sets[i] & sets[j])
            if common and den * common >= num * (len(sets[i]) + len(sets[j]) - common):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return sorted((i, len(sets[i]), root(i)) for i in ids)


def test_chains_near_the_threshold_stay_together(spark):
    """First and second, second and third link; first and third don't, although sketches allow it."""
    rows = []
    for g in range(500):
        words = [f"g{g}w{i}" for i in range(220)]
        rows += [(3 * g + k, " ".join(words[a:b])) for k, (a, b) in enumerate([(0, 201), (1, 202), (17, 218)])]
    found = ngram_jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == 1500 and all(r.component_id == r.doc_id // 3 * 3 for r in found)


@pytest.mark.parametrize(("size", "num", "den"), [(4, 85, 100), (5, 80, 100)])
def test_groups_like_brute_force(spark, size, num, den):
    """Texts of many sizes with a stretch of words replaced, so that pairs lie on both sides of the threshold."""
    rng, rows = random.Random(size), []
    for g in range(25):
        words = [f"g{g}w{i}" for i in range(rng.choice([3, 6, 30, 200, 1500]))]
        for _ in range(rng.randrange(2, 7)):
            copy, n = list(words), rng.randrange(0, 1 + len(words) // 8)
            at = rng.randrange(0, len(words) - n + 1)
            copy[at : at + n] = [f"x{rng.randrange(10**6)}" for _ in range(n)]
            rows.append((len(rows), " ".join(copy)))
    shared = " ".join(f"s{i}" for i in range(40))
    rows += [(len(rows) + k, shared + " " + " ".join(f"own{k}w{i}" for i in range(20 * (k + 1)))) for k in range(8)]
    found = ngram_jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), size, num, den)
    assert sorted(map(tuple, found.collect())) == brute_force(rows, size, num, den)


@pytest.mark.parametrize("tile_bytes", [100, 8 << 20])
def test_every_pair_is_compared_once(spark, tile_bytes):
    rng = np.random.default_rng(2)
    sets = {i: np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for i in range(30)}
    bodies = spark.createDataFrame([(i, len(v), bytearray(v.tobytes())) for i, v in sets.items()], "class long, n long, body binary")
    pairs = [(i, j) for i in range(30) for j in range(i + 1, 30) if (i + j) % 3]
    found = compared(spark.createDataFrame(pairs, "a long, b long"), bodies, jaccard_join._alike, 1, 3, tile_bytes)
    want = [(i, j) for i, j in pairs if 3 * len(np.intersect1d(sets[i], sets[j])) >= len(np.union1d(sets[i], sets[j]))]
    assert sorted(map(tuple, found.collect())) == want and want
    assert compared(spark.createDataFrame([], "a long, b long"), bodies, jaccard_join._alike, 1, 3).count() == 0


def test_wide_sketches_tell_long_sets_apart():
    import pyarrow as pa

    texts = pa.array([" ".join(f"{k}w{i}" for i in range(6000)) for k in range(2)] + [" ".join(f"0w{i}" for i in range(200, 6200))])
    values, first = shingle_sets(texts, 5)
    wide, n = jaccard_join._wide_sketches(values, first), np.diff(first).tolist()
    assert not jaccard_join._near(wide[0], wide[1], n[0], n[1], 80, 100)
    assert jaccard_join._near(wide[0], wide[2], n[0], n[2], 80, 100)
