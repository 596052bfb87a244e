"""The set-similarity join against all pairs, with and without a scope, equal sizes and sets of one element."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from docloom.operators.similarity import similar_sets


@pytest.mark.parametrize(("by", "share", "ratio"), [("jaccard", 0.9, 0.9), ("jaccard", 0.5, 0.5), ("containment", 0.9, 0.6), ("containment", 0.75, 0.3)])
def test_all_pairs(spark, by, share, ratio):
    rng, sets = random.Random(8), []
    for i in range(260):
        if sets and rng.random() < 0.6:
            base = set(rng.choice(sets)[2])
            for _ in range(rng.randint(0, 4)):
                base ^= {rng.randrange(500)}
            base = set(list(base)[: rng.randint(1, 60)]) if rng.random() < 0.2 else base
        else:
            base = {int(rng.paretovariate(0.6)) % 500 if rng.random() < 0.5 else rng.randrange(500) for _ in range(rng.randint(1, 40))}
        sets.append((i, f"s{i % 3}", sorted(base)))
    df = spark.createDataFrame([*sets, (900, "s0", []), (901, "s0", [])], "id long, scope string, grams array<long>")

    def linked(x, y):
        if not x or not y:
            return False
        same, small, large = len({*x} & {*y}), min(len(x), len(y)), max(len(x), len(y))
        return same / small >= share and small >= ratio * large if by == "containment" else same / len({*x} | {*y}) >= share

    for scoped in (False, True):
        want = {(i, j) for (i, s, x), (j, t, y) in itertools.combinations(sets, 2) if linked(x, y) and (not scoped or s == t)}
        got = similar_sets(df if scoped else df.drop("scope"), share, ratio, by).select(F.least("a", "b"), F.greatest("a", "b")).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
        assert len(want) > 15
