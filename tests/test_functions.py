"""Check digits, distribution functions and distances against known values."""

import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions import checkdigits as K
from plumbline.functions import numeric as M
from plumbline.functions.special import betainc, chi_square_quantile, grubbs_critical, t_cdf, t_quantile
from plumbline.operators.drift import anderson_p, cvm_p, limit_cvm_sf  # noqa: F401
from plumbline.operators.schema_evolution import jaro_winkler


@pytest.mark.parametrize("fn,good,bad", [
    ("luhn", "4111111111111111", "4111111111111112"), ("verhoeff", "2363", "2364"), ("damm", "5724", "5727"),
    ("gs1", "4006381333931", "4006381333932"), ("isbn10", "0306406152", "0306406153"), ("isbn10", "080442957X", "0804429571"),
    ("iban", "GB82WEST12345698765432", "GB82WEST12345698765433"), ("mod11", "0365327", "0365328"),
    ("korean_business", "1208147521", "1208147522"), ("my_number", "123456789018", "123456789019"),
    ("chinese_id", "11010519491231002X", "110105194912310021"), ("chinese_uscc", "91350100M000100Y43", "91350100M000100Y44"),
    ("cpf", "52998224725", "52998224724"),
])
def test_check_digits(spark, fn, good, bad):
    row = spark.createDataFrame([(good, bad)], "g string, b string").select(
        getattr(K, fn)(F.col("g")).alias("g"), getattr(K, fn)(F.col("b")).alias("b")).first()
    assert (row.g, row.b) == (True, False)


def test_korean_rrn_digit(spark):
    body = "900101123456"
    digit = (11 - sum(int(d) * w for d, w in zip(body, K.KOREAN_RRN)) % 11) % 10
    row = spark.range(1).select(K.korean_rrn(F.lit(body + str(digit))).alias("ok")).first()
    assert row.ok


def test_upce(spark):
    row = spark.range(1).select(K.upce_to_upca(F.lit("04252614")).alias("a"), K.gs1(K.upce_to_upca(F.lit("04252614"))).alias("ok")).first()
    assert row.a == "042100005264" and row.ok


@pytest.mark.parametrize("expr,want,tol", [
    (lambda: M.normal_cdf(F.lit(1.96)), 0.9750021, 1e-6), (lambda: M.normal_cdf(F.lit(-3.0)), 0.0013499, 1e-7),
    (lambda: M.two_sided_t(F.lit(2.228), F.lit(10.0)), 0.05, 1e-4), (lambda: M.two_sided_t(F.lit(2.0), F.lit(1.0)), 0.295167, 1e-5),
    (lambda: M.two_sided_t(F.lit(2.262), F.lit(9.0)), 0.05, 1e-4), (lambda: M.two_sided_t(F.lit(1.984), F.lit(100.0)), 0.05, 1e-4),
    (lambda: M.chi_square_sf(F.lit(11.07), F.lit(5.0)), 0.05, 1e-3),
    (lambda: M.kolmogorov_sf(F.lit(1.358 / math.sqrt(5000)), F.lit(10000.0), F.lit(10000.0)), 0.05, 1e-3),
    (lambda: M.haversine_km(F.lit(48.8566), F.lit(2.3522), 51.5074, -0.1278), 343.56, 0.1),
])
def test_numeric(spark, expr, want, tol):
    assert spark.range(1).select(expr().alias("v")).first().v == pytest.approx(want, abs=tol)


def test_special():
    assert betainc(2, 3, 0.5) == pytest.approx(0.6875)
    assert t_cdf(2.228, 10) == pytest.approx(0.975, abs=1e-4)
    assert t_quantile(0.975, 10) == pytest.approx(2.2281, abs=1e-3)
    assert chi_square_quantile(0.975, 2) == pytest.approx(7.378, abs=0.05)
    assert grubbs_critical(10, 0.05) == pytest.approx(2.290, abs=2e-3)
    assert limit_cvm_sf(0.46136) == pytest.approx(0.05, abs=1e-3)
    assert limit_cvm_sf(0.74346) == pytest.approx(0.01, abs=1e-3)
    assert jaro_winkler("MARTHA", "MARHTA") == pytest.approx(0.9611, abs=1e-4)
    assert jaro_winkler("DIXON", "DICKSONX") == pytest.approx(0.8133, abs=1e-4)


def test_polygon(spark):
    square = [(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 0.0)]
    df = spark.createDataFrame([(5.0, 5.0), (15.0, 5.0), (-1.0, 5.0)], "lat double, lon double")
    assert [r.i for r in df.select(M.in_polygon(F.col("lat"), F.col("lon"), square).alias("i")).collect()] == [True, False, False]
