"""Exact quantiles: groups held whole and groups cut into pieces give what numpy gives."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitometra.operators import stats

WANTED = {"lo": 0.01, "q25": 0.25, "mid": 0.5, "q75": 0.75, "hi": 0.995}


def _groups():
    rng = np.random.default_rng(3)
    return {
        "wide": rng.lognormal(3, 2, 6000),
        "narrow": 1 + rng.normal(0, 1e-9, 4000),
        "ties": rng.integers(0, 3, 5000).astype(float),
        "signs": rng.normal(0, 5, 3000),
        "one": np.array([7.0]),
        None: np.array([1.0, 2.0, 4.0, 8.0]),
    }


def _frame(spark):
    return spark.createDataFrame([(k, float(x)) for k, v in _groups().items() for x in v] + [("one", None), ("none", None)], "k string, x double")


@pytest.mark.parametrize("held", [1_000_000, 0])
def test_quantiles(spark, held):
    got = {r["k"]: r for r in stats.quantiles(_frame(spark), "x", ["k"], WANTED, held).collect()}
    assert set(got) == set(_groups())
    for k, v in _groups().items():
        assert got[k]["n"] == len(v)
        for name, p in WANTED.items():
            assert got[k][name] == pytest.approx(np.quantile(v, p), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("held", [1_000_000, 0])
def test_mad_and_whole_table(spark, held):
    rows = stats.mad(_frame(spark), "x", ["k"], held).groupBy("k").agg(F.count("*").alias("n"), F.max("_med").alias("med"), F.max("_mad").alias("mad"))
    got = {r["k"]: r for r in rows.collect()}
    assert got["none"]["med"] is None and got["none"]["n"] == 1 and got["one"]["n"] == 2
    for k, v in _groups().items():
        med = np.median(v)
        assert got[k]["med"] == pytest.approx(med, rel=1e-12)
        assert got[k]["mad"] == pytest.approx(np.median(np.abs(v - med)), rel=1e-9, abs=1e-15)
    every = np.concatenate(list(_groups().values()))
    assert stats.clip_tail(_frame(spark), "x", 0.9, held).count() == int((every <= np.quantile(every, 0.9)).sum())
    assert stats.quantiles(_frame(spark).limit(0), "x", [], WANTED, held).count() == 0


def test_summary_is_the_same_either_way(spark):
    whole, cut = (sorted(map(tuple, stats.robust_summary(_frame(spark), "x", ["k"], winsor=(0.05, 0.95), held=h).collect())) for h in (1_000_000, 0))
    assert [r[:2] for r in whole] == [r[:2] for r in cut]
    assert np.allclose([r[2:] for r in whole], [r[2:] for r in cut], rtol=1e-12)
