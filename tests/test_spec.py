import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidegrid.plans import spec
from tidegrid.plans.study_queries import CANDIDATES


def test_faults_are_named():
    with pytest.raises(spec.SpecError) as e:
        spec.Candidate.of({**CANDIDATES[0], "direction": "up", "hypothesis": "", "panel_formula": "ts_delay(close, -1)", "required_fields": ["close", "mid"]})
    assert all(w in str(e.value) for w in ("hypothesis is missing", "no 'up'", "whole number", "['mid']"))


def test_equal_formulas_share_a_signal():
    a, b = (spec.Candidate.of({**CANDIDATES[0], "panel_formula": f}) for f in ("sma(close,3)", "sma( close, 3 )"))
    assert a.signal_key() == b.signal_key() and a.signature() == b.signature()


def test_short_is_the_mirror_of_long(spark):
    rows = [(f"a{k}", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), 100.0 + (k * 7 + i * i * (k + 1)) % 13) for k in range(8) for i in range(12)]
    p = spark.createDataFrame(rows, "asset string, ts timestamp, close double").selectExpr("*", "close as open", "close as high", "close as low", "1D as volume", "close as size")
    p = p.withColumn("r", F.lit(0.01))
    c = [spec.Candidate.of({**CANDIDATES[0], "candidate_id": d, "direction": d, "weighting_modes": ["rank"]}) for d in ("long", "short")]
    got = {}
    for r in spec.evaluate(p, c, "r").collect():
        got.setdefault(r.ts, {})[r.candidate] = r
    assert all(v["long"].turnover == pytest.approx(v["short"].turnover) and v["long"].gross == pytest.approx(-v["short"].gross) for v in got.values())
    assert sum(v["long"].turnover for v in got.values()) > 0
