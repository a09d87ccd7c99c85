from pyspark.sql import functions as F

from pmspark.functions import scalar as S


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_decimal_seconds_round_half_to_even_and_reject_exponents(spark):
    rows = [("1.0000000005",), ("1.0000000015",), ("1.5",), ("1e3",), ("x",), (None,)]
    got = [r[0] for r in values(spark, rows, "t string", S.decimal_seconds_to_ns(F.col("t")))]
    assert got == [1_000_000_000, 1_000_000_002, 1_500_000_000, None, None, None]


def test_cent_prices(spark):
    rows = [("0.42",), ("1.0",), ("1",), ("42",), ("100",), ("101",), ("-1",), ("x",)]
    got = [r[0] and float(r[0]) for r in values(spark, rows, "t string", S.normalize_cent_price(F.col("t")))]
    assert got == [0.42, 1.0, 0.01, 0.42, 1.0, None, None, None]


def test_tradable_prices_and_sides(spark):
    rows = [("0", "buy "), ("0.5", "SELL"), ("1", "mint"), ("abc", None)]
    got = values(spark, rows, "p string, s string", S.tradable_price(F.col("p")), S.normalize_side(F.col("s")))
    assert got == [(False, "BUY"), (True, "SELL"), (False, "UNKNOWN"), (False, "UNKNOWN")]


def test_money_text(spark):
    rows = [("1_234.50 USDC",), ("−3 USD",), ("1e5",), ("none",)]
    got = [r[0] and float(r[0]) for r in values(spark, rows, "t string", S.money_text(F.col("t")))]
    assert got == [1234.5, -3.0, 1.0, None]


def test_fees(spark):
    q, p = F.col("q"), F.col("p")
    got = values(spark, [(100.0, 0.5), (1.0, 0.99)], "q double, p double", S.taker_fee(q, p, F.lit(200)).cast("double"), S.cent_fee(q, p, F.lit(0.07)).cast("double"))
    assert got == [(0.5, 1.75), (0.0002, 0.01)]


def test_fixed_raw_is_half_even(spark):
    got = [int(r[0]) for r in values(spark, [(0.125,), (0.375,)], "p double", S.fixed_raw(F.col("p"), 2))]
    assert got == [12 * 10**14, 38 * 10**14]


def test_ns_text_keeps_the_last_nanoseconds_of_a_second(spark):
    ns = [1_706_745_599_999_999_999, 1_706_745_600_000_000_000, 1_706_745_599_999_999_900, 0, -1, -1_000_000_000]
    got = [r[0] for r in values(spark, [(x,) for x in ns], "ns bigint", S.ns_text(F.col("ns")))]
    assert got == [
        "2024-01-31T23:59:59.999999999Z", "2024-02-01T00:00:00.000000000Z", "2024-01-31T23:59:59.999999900Z",
        "1970-01-01T00:00:00.000000000Z", "1969-12-31T23:59:59.999999999Z", "1969-12-31T23:59:59.000000000Z",
    ]
