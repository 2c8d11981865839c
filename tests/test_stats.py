"""Published-value tests for the special functions, and the fixture
statistics recorded in FIXTURES.md."""

import math

import pytest
from pyspark.sql import functions as F

from tablelens.functions.special import chi2_sf, f_sf, probit, probit_py
from tablelens.operators import relations
from tablelens.plans import fixtures as fx
from tablelens.plans.fixtures import Tables

from conftest import SF_ORACLE


@pytest.mark.parametrize("f,d1,d2,p", [(4.9646, 1, 10, 0.05), (3.4780, 4, 10, 0.05), (5.9943, 4, 10, 0.01),
                                        (2.3719, 4, 100, 0.0575)])
def test_f_tail_tables(f, d1, d2, p):
    assert f_sf(f, d1, d2) == pytest.approx(p, abs=6e-4)


@pytest.mark.parametrize("x,k,p", [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (6.634897, 1, 0.01),
                                    (18.307038, 10, 0.05), (0.0, 3, 1.0)])
def test_chi2_tail_tables(x, k, p):
    assert chi2_sf(x, k) == pytest.approx(p, abs=1e-6)


@pytest.mark.parametrize("p,z", [(0.975, 1.959964), (0.5, 0.0), (0.01, -2.326348), (0.999, 3.090232),
                                 (1e-6, -4.753424)])
def test_probit_python(p, z):
    assert probit_py(p) == pytest.approx(z, abs=1e-5)


def test_probit_column_matches_python(spark):
    ps = [0.001, 0.02, 0.3, 0.5, 0.7, 0.98, 0.999]
    rows = spark.createDataFrame([(p,) for p in ps], "p double").select("p", probit(F.col("p")).alias("z")).collect()
    for r in rows:
        assert r["z"] == pytest.approx(probit_py(r["p"]), abs=1e-12)


def test_anova_fixture_values(spark):
    t = Tables(spark, SF_ORACLE)
    r = relations.with_f_pvalue(relations.anova(fx.events_plain(t))).first()
    assert r["f_stat"] == pytest.approx(1.399096, abs=1e-6)
    assert (r["df_between"], r["df_within"]) == (4, 9995)
    assert r["p_value"] == pytest.approx(0.231472, abs=1e-6)
    shifted = relations.with_f_pvalue(relations.anova(fx.events_shift(t))).first()
    assert shifted["p_value"] < 1e-10


def test_chi2_fixture_values(spark):
    t = Tables(spark, SF_ORACLE)
    r = relations.with_chi2_pvalue(relations.chi_square(fx.flags(t))).first()
    assert r["chi2"] == pytest.approx(0.095540, abs=1e-6)
    assert r["dof"] == 2 and not r["yates"]
    assert r["p_value"] == pytest.approx(math.exp(-0.095540 / 2), abs=1e-6)


def test_chi2_yates_2x2(spark):
    t = Tables(spark, SF_ORACLE)
    r = relations.chi_square(fx.status_2x2(t)).first()
    # cells 7,910 / 2,002 / 4,112 / 976 (FIXTURES.md), Yates-corrected by hand
    o = [[7910, 2002], [4112, 976]]
    n = sum(map(sum, o))
    rs, cs = [sum(x) for x in o], [o[0][0] + o[1][0], o[0][1] + o[1][1]]
    chi = 0.0
    for i in range(2):
        for j in range(2):
            e = rs[i] * cs[j] / n
            d = abs(o[i][j] - e)
            chi += (d - min(0.5, d)) ** 2 / e
    assert r["yates"] and r["dof"] == 1
    assert r["chi2"] == pytest.approx(chi, rel=1e-9)
