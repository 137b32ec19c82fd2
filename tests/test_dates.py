"""Date texts against what a reader would make of them."""

import pytest
from pyspark.sql import functions as F

from talweg.functions import dates, maths

READ = [
    ("21–22 May 1809", ("1809-05-21", "1809-05-22", "day", False)),
    ("May 5-7, 1864", ("1864-05-05", "1864-05-07", "day", False)),
    ("21 May 1809", ("1809-05-21", None, "day", False)),
    ("Sept. 3rd, 1650", ("1650-09-03", None, "day", False)),
    ("Spring 208 BC", ("0208-01-01 BC", None, "year", False)),
    ("15 November [ O.S. 3 November ] 1812", ("1812-11-15", None, "day", False)),
    ("18 June 1815; 208 years ago", ("1815-06-18", None, "day", False)),
    ("c. 1200 BC", ("1200-01-01 BC", None, "year", True)),
    ("late 1250s", ("1250-01-01", None, "decade", True)),
    ("1255s", None),
    ("1805 or 1806", ("1805-01-01", None, "year", True)),
    ("310 or 309 BC", ("0310-01-01 BC", None, "year", True)),
    ("12 and 13 March 1912", ("1912-03-12", "1912-03-13", "day", False)),
    ("3 June - 2 July 1500", ("1500-06-03", "1500-07-02", "day", False)),
    ("30 December 1800 to 2 January 1801", ("1800-12-30", "1801-01-02", "day", False)),
    ("June - August 1500", ("1500-06-01", "1500-08-31", "month", False)),
    ("1618 - 1648", ("1618-01-01", "1648-12-31", "year", False)),
    ("February 1500 BC", ("1500-02-01 BC", None, "month", False)),
    ("29 February 1900", None),
    ("29 February 5 BC", ("0005-02-29 BC", None, "day", False)),
    ("0216-08-02 BC", ("0216-08-02 BC", None, "day", False)),
    ("1809-05-21 - 1809-05-22", ("1809-05-21", "1809-05-22", "day", False)),
    ("1809-02-30", None),
    ("3rd day, 5th month of 755", ("0755-01-01", None, "year", False)),
    ("sometime in May 1809", None),
    ("400 AD or 30 BC", None),
    ("", None),
    ("  ", None),
    (None, None),
    ("31", ("0031-01-01", None, "year", False)),
    ("mid 1944", ("1944-01-01", None, "year", False)),
    ("12345", None),
]


@pytest.fixture(scope="module")
def got(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(READ)], "i int, t string")
    return {r["i"]: r["d"] and tuple(r["d"]) for r in df.select("i", dates.parse_date(F.col("t")).alias("d")).collect()}


@pytest.mark.parametrize("i", range(len(READ)), ids=[str(t) for t, _ in READ])
def test_parse_date(got, i):
    assert got[i] == READ[i][1]


def test_safe_dates_and_years(spark):
    rows = [("1809-05-21", None, "year"), ("21 May 1809", "23 May 1809", "century"), ("no date", "23 May 1809", "day"), (None, "1809-05-21", "day"), ("1809-05-21", "May 1809", "wrong")]
    df = spark.createDataFrame(rows, "a string, b string, p string")
    assert [tuple(r[0]) for r in df.select(dates.safe_dates(F.col("a"), F.col("b"), F.col("p"))).collect()] == [
        ("1809-05-21", None, "year"), ("1809-05-21", "1809-05-23", "day"), (None, None, None), (None, None, None), ("1809-05-21", "1809-05-01", "day"),
    ]
    df = spark.createDataFrame([(y,) for y in (1769, 1, 0, -43, None)], "y int")
    assert [r[0] for r in df.select(dates.year_literal(F.col("y"))).collect()] == ["1769-01-01", "0001-01-01", "0001-01-01 BC", "0044-01-01 BC", None]
    assert [r[0] for r in df.select(maths.astronomical_year(dates.year_literal(F.col("y")))).collect()] == [1769, 1, 0, -43, None]


def test_days_in_month(spark):
    import calendar

    df = spark.range(1, 2400, 37).selectExpr("cast(id as int) as y").crossJoin(spark.range(1, 13).selectExpr("cast(id as int) as m"))
    for r in df.select("y", "m", dates.days_in_month(F.col("y"), F.col("m"), F.lit(False)).alias("ad"), dates.days_in_month(F.col("y"), F.col("m"), F.lit(True)).alias("bc")).collect():
        assert r["ad"] == calendar.monthrange(2000 + r["y"] % 400, r["m"])[1]
        assert r["bc"] == calendar.monthrange(2000 + (1 - r["y"]) % 400, r["m"])[1]
