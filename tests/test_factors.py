"""Pruning of the factor catalogue and its freedom from look-ahead."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import factors


@pytest.fixture()
def panel(spark):
    rng = np.random.default_rng(1)
    rows = []
    for a in range(8):
        price = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 140)))
        for i in range(140):
            rows.append((f"a{a}", datetime(2024, 1, 1) + timedelta(days=i), float(price[i]), float(rng.integers(1, 50)), float(price[i] * rng.integers(1, 50)), float(price[i] * (1 + rng.normal(0, 0.002))), float(rng.normal(0, 1e-4)), float(rng.integers(100, 200)), bool(rng.random() < 0.9)))
    return spark.createDataFrame(rows, "asset string, ts timestamp_ntz, close double, volume double, vol_quote double, spot double, funding double, open_interest double, eligible boolean")


def test_only_what_is_asked_for_is_computed(panel):
    plan = factors.compute(panel, ["momentum_24h"], day=1)._jdf.queryExecution().optimizedPlan().toString()
    assert "stddev" not in plan and "spot" not in plan.split("Relation")[0].split("LogicalRDD")[0]
    with pytest.raises(KeyError):
        factors.compute(panel, ["no_such"])


@pytest.mark.parametrize("cut", [60, 100, 130])
def test_no_factor_looks_ahead(panel, cut):
    """Every factor's value at a time is the same whether later rows are there, changed or gone."""
    at = datetime(2024, 1, 1) + timedelta(days=cut)
    later = F.col("ts") > F.lit(at)
    changed = panel.withColumns({c: F.when(later, F.col(c) * 3 + 1).otherwise(F.col(c)) for c in ("close", "volume", "vol_quote", "spot", "funding", "open_interest")})
    get = lambda d: sorted((tuple(r) for r in factors.compute(d, day=1).where(F.col("ts") == F.lit(at)).collect()), key=lambda r: r[0])
    whole = get(panel)
    assert len(whole) == 8 and any(v is not None for v in whole[0][2:])
    for other in (get(changed), get(panel.where(~later))):
        for a, b in zip(whole, other, strict=True):
            assert a[:2] == b[:2] and all((x is None and y is None) or x == pytest.approx(y, rel=1e-9, abs=1e-12) for x, y in zip(a[2:], b[2:], strict=True))
