"""The bootstrap draws exactly n with replacement in every replicate, whatever the blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from callscope.operators import resampling


def groups(spark):
    r = np.random.default_rng(1)
    rows = [("a", f"k{i}", float(x)) for i, x in enumerate(r.normal(1, 2, 300))] + [("b", f"k{i}", float(i % 3)) for i in range(41)] + [("one", "k", 5.0), ("one", "none", None)]
    return rows, spark.createDataFrame(rows, "grp string, key string, diff double").repartition(3)


@pytest.mark.parametrize("block", [4096, 8])
def test_every_replicate_draws_n(spark, monkeypatch, block):
    monkeypatch.setattr(resampling, "BLOCK", block)
    _, frame = groups(spark)
    got = resampling.replicate_sums(frame, 500).groupBy("grp").agg(F.count("*").alias("r"), F.min("draws").alias("lo"), F.max("draws").alias("hi"))
    assert sorted(map(tuple, got.collect())) == [("a", 500, 300, 300), ("b", 500, 41, 41), ("one", 500, 1, 1)]


@pytest.mark.parametrize("block", [4096, 16])
def test_bounds_are_those_of_a_plain_bootstrap(spark, monkeypatch, block):
    monkeypatch.setattr(resampling, "BLOCK", block)
    rows, frame = groups(spark)
    got = {x.grp: (x.lo, x.hi) for x in resampling.bootstrap(frame, 4000).collect()}
    r = np.random.default_rng(2)
    for grp in ("a", "b"):
        d = np.array([x for g, _, x in rows if g == grp])
        means = np.sort(d[r.integers(0, len(d), (4000, len(d)))].mean(axis=1))
        spread = d.std() / len(d) ** 0.5
        assert got[grp][0] == pytest.approx(means[100], abs=0.2 * spread)
        assert got[grp][1] == pytest.approx(means[3899], abs=0.2 * spread)
    assert got["one"] == (5.0, 5.0)


def test_counts_of_keys_are_multinomial(spark, monkeypatch):
    """Over a tree of small leaves each key is drawn once on average, with variance 1 - 1/n."""
    monkeypatch.setattr(resampling, "BLOCK", 4)
    n, reps = 64, 3000
    rows = [(f"g{j}", f"k{i}", float(i == j)) for j in range(0, n, 16) for i in range(n)]
    sums = resampling.replicate_sums(spark.createDataFrame(rows, "grp string, key string, diff double"), reps)
    for x in sums.groupBy("grp").agg(F.avg("total").alias("m"), F.var_pop("total").alias("v")).collect():
        assert x.m == pytest.approx(1, abs=0.1)
        assert x.v == pytest.approx(1 - 1 / n, abs=0.15)


def test_reruns_agree(spark):
    _, frame = groups(spark)
    assert sorted(map(tuple, resampling.bootstrap(frame, 300).collect())) == sorted(map(tuple, resampling.bootstrap(frame.repartition(2), 300).collect()))
