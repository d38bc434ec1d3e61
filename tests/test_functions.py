import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions import scalars as sc


def column(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.select("i", expr(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_amounts(spark):
    assert column(spark, ["$1,001 - $15,000", "$50,000,000", "--", None, "Over $5 and $7 and $9"], sc.amount_midpoint) == [8000.5, 5e7, 0.0, 0.0, 6.0]


def test_signs(spark):
    kinds = ["Purchase", "Sale (Full)", "Exchange", "P", "S", "S (partial)", "s.", "E", "", None, "GIBBERISH"]
    assert column(spark, kinds, sc.trade_sign) == [1, -1, 0, 1, -1, -1, -1, 0, 0, 0, 0]
    assert column(spark, kinds, lambda c: sc.trade_sign(c, "english")) == [1, -1, 0, 0, 0, 0, 0, 0, 0, 0, 0]
    assert column(spark, ["sell", "S (x)", "p"], lambda c: sc.trade_sign(c, "profile")) == [-1, -1, 1]


def test_dates(spark):
    assert column(spark, ["05-FEB-2024", "31-feb-2024", None, "x"], sc.month_name_day) == [dt.date(2024, 2, 5), None, None, None]
    assert column(spark, ["02/05/2024", "2024-02-05", "?"], lambda c: sc.day_of(c, "MM/dd/yyyy", "yyyy-MM-dd")) == [dt.date(2024, 2, 5)] * 2 + [None]


def test_names_and_symbols(spark):
    assert column(spark, ["Hon. Ann  B. Smith, Jr.", None], sc.person_key) == ["ann b smith", ""]
    assert column(spark, ["Acme Widgets, Inc.", "Acme Corp"], sc.company_key) == ["Acme Widgets", "Acme"]
    assert column(spark, ["BRK.B", "A", "TOOLONG", "bad", "", None, "BRK/AB"], sc.valid_symbol) == [True, True, False, False, False, False, True]


def test_roles(spark):
    assert column(spark, ["Director,Officer", "Director,TenPercentOwner", "TenPercentOwner", None], sc.owner_role) == ["officer", "director", "owner", "other"]


def test_bands(spark):
    assert column(spark, [1.0, 0.6, 0.2, -0.2, -0.3, None], sc.conviction, "double") == [5, 4, 3, 2, 1, None]
    assert column(spark, [0.5, 0.0, -0.5], sc.case_side, "double") == ["bull", None, "risk"]
    assert column(spark, [-1, 30, 31, 46, 91, None], sc.lag_band, "int") == [None, "0-30", "31-45", "46-90", "90+", None]
    assert column(spark, [0.0, 90.0], lambda c: sc.half_life_decay(c, 90), "double") == [1.0, 0.5]


def test_null_mean_and_content_id(spark):
    row = spark.createDataFrame([(1.0, None, 3.0)], "a double, b double, c double")
    got = row.select(sc.null_mean(F.col("a"), F.col("b"), F.col("c")), sc.null_mean(F.col("b")), sc.content_id(F.col("a"), F.col("b"))).first()
    assert got[0] == 2.0 and got[1] is None and len(got[2]) == 16
