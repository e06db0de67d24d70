import numpy as np
import pytest

from colloquy.operators import ranks

from .conftest import rows


@pytest.fixture(scope="module")
def values(spark):
    draw = np.random.default_rng(2)
    groups = {
        "even": draw.standard_normal(3000),
        "few": np.array([3.0, -1.0, 2.5]),
        "same": np.full(500, 7.0),
        "steps": draw.integers(0, 5, 2000).astype(float),
        "skewed": np.concatenate([draw.random(2500) * 1e-9, [1e12, -1e12]]),
        "near": 1 + np.arange(900) * np.finfo(float).eps,
        "wide": np.concatenate([[-1.7e308, 1.7e308], draw.random(700)]),
    }
    data = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("few", None), ("few", float("nan")), ("null", None)]
    return groups, spark.createDataFrame(data, "g string, v double").repartition(5)


@pytest.mark.parametrize("bins,few", [(4, 8), (64, 1), (4096, 4096)])
def test_order_statistics_equal_sorting(spark, values, bins, few):
    groups, df = values
    wanted = [(g, r) for g, v in groups.items() for r in sorted({0, 1, len(v) // 3, len(v) - 1, len(v)})] + [("null", 0), ("gone", 0)]
    found = ranks.order_statistics(df, ["g"], "v", spark.createDataFrame(wanted, "g string, rank long"), bins, few)
    assert rows(found, "g", "rank", "value") == sorted([(g, r, float(np.sort(groups[g])[r])) for g, r in wanted if g in groups and r < len(groups[g])], key=repr)


@pytest.mark.parametrize("share", [0.1, 0.5, 1.0])
def test_quantile_equals_numpy(spark, values, share):
    groups, df = values
    got = {r.g: r["quantile"] for r in ranks.quantile(df.where("g != 'wide'"), ["g"], "v", share, bins=32, few=16).collect()}
    assert got.keys() == groups.keys() - {"wide"} and all(np.isclose(got[g], np.quantile(groups[g], share), rtol=1e-12, atol=1e-300) for g in got)
