"""Keyed permutations: bijections, and sets of positions that are all alike."""

from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronograin.functions import permute


def keys_of(rows, seed=0):
    return np.random.default_rng(seed).integers(0, 1 << 52, size=(rows, permute.ROUNDS))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 15, 16, 17, 64, 1000, 4097])
def test_images_are_a_permutation(n):
    keys = np.repeat(keys_of(1, n), n, axis=0)
    found = permute.permuted(np.arange(n), np.full(n, n), keys)
    assert sorted(found.tolist()) == list(range(n))


def test_large_ranges_stay_exact():
    n = (1 << 40) + 7
    found = permute.permuted(np.arange(2000), np.full(2000, n), np.repeat(keys_of(1, 3), 2000, axis=0))
    assert len(set(found.tolist())) == 2000 and found.min() >= 0 and found.max() < n and found.max() > n // 2


@pytest.mark.parametrize(("n", "k"), [(3, 2), (5, 2), (6, 3), (9, 2), (17, 4), (20, 6)])
def test_pairs_and_subsets_are_alike(n, k):
    rows = 40_000
    keys = np.repeat(keys_of(rows, n), k, axis=0)
    drawn = permute.permuted(np.tile(np.arange(k), rows), np.full(rows * k, n), keys).reshape(rows, k)
    pairs = Counter(p for row in np.sort(drawn, axis=1).tolist() for p in combinations(row, 2))
    expect = rows * k * (k - 1) / (n * (n - 1))
    assert len(pairs) == n * (n - 1) // 2
    chi = sum((c - expect) ** 2 / expect for c in pairs.values()) / (len(pairs) - 1)
    assert chi < 3.5
    if n <= 9:
        sets = Counter(map(tuple, np.sort(drawn, axis=1).tolist()))
        want = rows / len(list(combinations(range(n), k)))
        assert all(abs(c / want - 1) < 0.12 for c in sets.values()) and len(sets) == len(list(combinations(range(n), k)))


def test_positions_of_rows(spark):
    df = spark.range(0, 60).select("id", (F.col("id") % 30 + 1).alias("n"))
    rows = df.select("n", permute.positions_drawn(F.col("n"), 7, permute.round_keys(5, "id")).alias("p")).collect()
    assert all(len(r.p) == len(set(r.p)) == min(7, r.n) and min(r.p) >= 1 and max(r.p) <= r.n for r in rows)
    again = df.repartition(7).select("id", permute.positions_drawn(F.col("n"), 7, permute.round_keys(5, "id")).alias("p")).orderBy("id")
    assert [r.p for r in again.collect()] == [r.p for r in rows]
    assert df.limit(0).select(permute.positions_drawn(F.col("n"), 7, permute.round_keys(5, "id"))).count() == 0
