"""Date texts of usual forms against plain Python."""

import datetime

import pytest

from threadloom.functions import dates

AT = datetime.datetime
DAY, NIGHT, SECOND = AT(2026, 7, 3), AT(2026, 7, 3, 23, 8), AT(2026, 7, 3, 23, 8, 1)
FORMS = {
    "2026-07-03": DAY, "2026/07/03": DAY, "2026.07.03": DAY, "2026-7-3": DAY, "20260703": DAY, " 2026-07-03 ": DAY,
    "03-07-2026": DAY, "3-7-2026": DAY, "03.07.2026": DAY, "3.7.26": DAY, "07/03/2026": DAY, "7/3/2026": DAY, "7/3/26": DAY,
    "13/07/2026": AT(2026, 7, 13), "07/13/2026": AT(2026, 7, 13), "07-13-2026": AT(2026, 7, 13), "13.07.2026": AT(2026, 7, 13),
    "3 Jul 2026": DAY, "03 July 2026": DAY, "3rd July 2026": DAY, "3-Jul-2026": DAY, "3-Jul-26": DAY, "3Jul2026": DAY, "3rd of July 2026": DAY,
    "Jul 3, 2026": DAY, "July 3 2026": DAY, "JULY 3RD, 2026": DAY, "Jul. 3, 2026": DAY, "Jul-3-2026": DAY, "2026 Jul 3": DAY, "2026-Jul-03": DAY,
    "Fri, 3 Jul 2026": DAY, "Friday 3 July 2026": DAY, "Friday, July 3, 2026": DAY,
    "2026-07-03 23:08": NIGHT, "2026-07-03T23:08": NIGHT, "2026-07-03t23:08:01": SECOND, "2026-07-03 23:08:01": SECOND,
    "20260703T23:08:01": SECOND, "03-07-2026 23:08": NIGHT, "07/03/2026 23:08:01": SECOND, "07/03/2026, 11:08 PM": NIGHT,
    "7/3/2026 11:08:01 p.m.": SECOND, "July 3, 2026 at 11:08 pm": NIGHT, "July 3, 2026, 11:08pm": NIGHT, "3 Jul 2026 11 PM": AT(2026, 7, 3, 23),
    "7/3/2026 12:08 AM": AT(2026, 7, 3, 0, 8), "7/3/2026 12:08 PM": AT(2026, 7, 3, 12, 8), "2026-07-03 00:00:00": DAY,
    "2026-07-03T23:08:01Z": SECOND, "2026-07-03T23:08:01.250Z": AT(2026, 7, 3, 23, 8, 1, 250000), "2026-07-03 23:08:01,5": AT(2026, 7, 3, 23, 8, 1, 500000),
    "2026-07-03T23:08:01.123456789": AT(2026, 7, 3, 23, 8, 1, 123456), "2026-07-03T23:08:01+02:00": AT(2026, 7, 3, 21, 8, 1),
    "2026-07-03 23:08:01 -0530": AT(2026, 7, 4, 4, 38, 1), "2026-07-03 23:08:01 UTC": SECOND, "Fri, 03 Jul 2026 23:08:01 GMT": SECOND,
    "Fri, 03 Jul 2026 23:08:01 +0000": SECOND, "2026-07-04 00:08:01+01": SECOND, "1/2/68": AT(2068, 1, 2), "1/2/69": AT(1969, 1, 2),
    "2024-02-29": AT(2024, 2, 29), "0001-01-01": AT(1, 1, 1), "2026-07-03 23:59:59": AT(2026, 7, 3, 23, 59, 59),
}
NOT_DATES = ["", "soon", "yesterday", "2026", "07/2026", "2026-13-01", "2026-02-30", "2023-02-29", "31/31/2026", "00/07/2026", "2026-07-03 25:00",
             "2026-07-03 23:61", "13:00 PM", "7/3/2026 13:08 PM", "7/3/2026 0:08 AM", "2026-07-03 x", "x 2026-07-03", "1783112880", "12.5", "3 Foo 2026",
             "2026-07-03 23:08:61", "1.2.3.4", "2026-07-03 23", None]


def test_there_are_sixty_forms():
    assert len(FORMS) >= 60


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_forms(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        values = [*FORMS, *NOT_DATES]
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
        got = {r.v: r.t for r in rows.select("v", dates.parse_date_text(rows.v).alias("t")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert {v: got[v] for v in FORMS} == FORMS
    assert {v: got[v] for v in NOT_DATES} == dict.fromkeys(NOT_DATES)


def test_every_day_of_a_leap_year_in_all_orders(spark):
    days = [AT(2024, 1, 1) + datetime.timedelta(d) for d in range(366)]
    forms = ("%Y-%m-%d", "%Y%m%d", "%m/%d/%Y", "%d.%m.%Y", "%d-%m-%Y %H:%M", "%d %b %Y", "%B %d, %Y", "%a, %d %b %Y %H:%M:%S +0000", "%Y-%b-%d")
    rows = spark.createDataFrame([(d, d.strftime(f)) for d in days for f in forms], "d timestamp_ntz, v string")
    assert rows.where(~rows.d.eqNullSafe(dates.parse_date_text(rows.v))).collect() == []
