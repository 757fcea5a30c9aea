"""Rates by halving over whole batches, in a LAMBDA and with long terms; cumulated interest and principal."""

import numpy as np
import pytest

from lattica.functions import row_formula
from lattica.functions.lower import Cells, lower


def _values(spark, *texts):
    return list(spark.range(1).select(*[lower(t, Cells({})).col.alias(f"c{k}") for k, t in enumerate(texts)]).first())


def test_roots_are_found_outside_the_row(spark):
    df = spark.createDataFrame([(24.0, -50.0, 1000.0), (360.0, -6.0, 1000.0), (24.0, 50.0, 1000.0), (None, -50.0, 1000.0)], "n double, pay double, pv double")
    made = df.select(row_formula(df, "RATE(n,pay,pv)").alias("r"))
    assert "ArrowEvalPython" in made._jdf.queryExecution().executedPlan().toString()
    found = [r["r"] for r in made.collect()]
    for r, (n, pay, pv) in zip(found[:2], [(24, -50, 1000), (360, -6, 1000)], strict=True):
        assert pv + pay * (1 - (1 + r) ** -n) / r == pytest.approx(0, abs=1e-8)
    assert found[2:] == [None, None]


def test_flows(spark):
    texts = "IRR({-100;60;60})", "IRR({" + ";".join(["-1000"] + ["10"] * 400) + "})", "IRR({100;60})", "XIRR({-100;60;60},{100;465;830})", "XIRR({-100;60},{100;465;830})"
    irr, long, none, dated, short = _values(spark, *texts)
    assert irr == pytest.approx(0.13066238629, abs=1e-11)
    assert 1000 == pytest.approx(10 * (1 - (1 + long) ** -400) / long, abs=1e-8)
    assert none is None and short is None
    assert dated == pytest.approx(irr, abs=1e-11)


def test_flows_of_columns(spark):
    rows = [(1, -100.0, 60.0, 60.0), (2, -100.0, 110.0, None), (3, None, None, None), (4, -100.0, None, 121.0), (5, None, -100.0, 110.0)]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double").repartition(1)
    made = df.select("k", row_formula(df, "IRR(HSTACK(a,b,c))").alias("r"), row_formula(df, "XIRR(HSTACK(a,b,c),HSTACK(0,365,730))").alias("x")).collect()
    assert {r["k"]: r["r"] for r in made} == {1: pytest.approx(0.13066238629), 2: pytest.approx(0.1), 3: None, 4: pytest.approx(0.21), 5: pytest.approx(0.1)}  # empty cells are left out
    assert {r["k"]: r["x"] for r in made} == {1: pytest.approx(0.13066238629), 2: None, 3: None, 4: None, 5: None}
    lists = spark.createDataFrame([([-100.0, 60.0, 60.0],)], "flows array<double>")
    assert lists.select(row_formula(lists, "IRR(flows)")).first()[0] == pytest.approx(0.13066238629)


def test_rates_in_a_lambda(spark):
    grid, once = _values(spark, "MAP({-100,-90},LAMBDA(p,RATE(12,p,1000)))", "REDUCE(0,{60,70},LAMBDA(t,x,t+IRR(HSTACK(-100,x,x))))")
    assert np.round(grid[0], 6).tolist() == np.round(_values(spark, "RATE(12,-100,1000)", "RATE(12,-90,1000)"), 6).tolist()
    assert once == pytest.approx(sum(_values(spark, "IRR({-100;60;60})", "IRR({-100;70;70})")))


@pytest.mark.parametrize("when", [0, 1])
def test_cumulated_parts_are_their_sums(spark, when):
    got = _values(spark, f"CUMIPMT(0.01,12,1000,3,9,{when})", f"CUMPRINC(0.01,12,1000,3,9,{when})", f"CUMPRINC(0.01,12,1000,1,12,{when})", f"CUMIPMT(0.01,12,1000,1,1,{when})", f"CUMIPMT(0.01,12,1000,5,4,{when})")
    each = lambda name, ks: sum(_values(spark, *[f"{name}(0.01,{k},12,1000,0,{when})" for k in ks]))
    assert got[:4] == pytest.approx([each("IPMT", range(3, 10)), each("PPMT", range(3, 10)), -1000, each("IPMT", [1])], abs=1e-9)
    assert got[4] is None
