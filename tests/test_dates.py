"""Dates of mail headers and logs: equal to the parser that the corpus was built with (pandas)."""

import warnings

import pandas as pd
import pytest
from pyspark.sql import functions as F

from threatlens.functions import text as X

from conftest import col1

FORMS = ["Mon, 14 May 2001 16:39:00 -0700 (PDT)", "14 May 2001 09:00:00 +0000", "2005-01-01 10:00:00+00:00", "Tue, 5 Feb 2002 08:01:02 -0800", "5 Feb 2002 08:01 -0800",
"Fri, 13 Jul 2001 05:12:33 GMT", "13 July 2001 05:12:33 EST", "Wednesday, 04 September 2002 11:22:33 +0200", "04 Sep 02 11:22:33 +0200", "4 Sep 95 11:22",
"Sep 4, 2002 11:22:33", "September 4, 2002 11:22 AM", "September 4 2002 11:22:33 PM +0100", "Wed Sep 4 11:22:33 2002", "Wed Sep  4 11:22:33 EDT 2002", "Wed Sep 04 11:22:33 +0200 2002",
"2002-09-04T11:22:33Z", "2002-09-04T11:22:33.123Z", "2002-09-04T11:22:33+05:30", "2002-09-04 11:22:33 -0400", "2002-09-04 11:22", "2002-09-04", "2002/09/04 11:22:33", "20020904T112233", "20020904",
"9/4/2002", "9/4/2002 11:22", "9/4/2002 11:22:33 PM", "09/04/2002 1:02:03 am", "9/4/02 11:22 AM", "12/31/1999 23:59:59", "4-Sep-2002 11:22:33", "04-Sep-02 11:22", "4-Sep-2002", "4.9.2002 11:22", "Thu, 1 Jan 1970 00:00:00 +0000",
"Mon, 14 May 2001 16:39:00 -0700 (Pacific Daylight Time)", "Mon 14 May 2001 16:39:00 -0700", "14 May 2001, 16:39", "May 14, 2001", "14 May 2001", "May 2001 14 16:39", "16:39 14 May 2001", "11:22:33 PM September 4, 2002",
"Mon, 14 May 2001 16:39:00 UT", "Mon, 14 May 2001 16:39:00 Z", "Mon, 14 May 2001 16:39:00 +00:00", "Mon, 14 May 2001 16:39:00 GMT+0200", "Mon, 14 May 2001 12:39:00 AM", "not a date", "", "32 May 2001", "14 Foo 2001", "Mon, 14 May 2001 25:00:00", "2002-13-01", "2002-02-30 10:00:00", "14 May 2001 16h39", "  14 May 2001 16:39:00  ", "14 may 2001 16:39:00 pdt", "Sat, 29 Feb 2003 10:00:00 +0000"]

# Zone names that mail software knows are offsets here; the other parser drops or refuses them.
NAMED_ZONES = {"13 July 2001 05:12:33 EST": "2001-07-13 10:12:33", "Wed Sep  4 11:22:33 EDT 2002": "2002-09-04 15:22:33",
               "Mon, 14 May 2001 16:39:00 -0700 (Pacific Daylight Time)": "2001-05-14 23:39:00", "14 may 2001 16:39:00 pdt": "2001-05-14 23:39:00"}


def reference(s):
    t = pd.to_datetime(s, errors="coerce", utc=True)
    return None if t is None or pd.isna(t) else t.strftime("%Y-%m-%d %H:%M:%S")


def parsed(spark, values):
    return col1(spark, values, lambda c: F.date_format(X.parse_timestamp_utc(c), "yyyy-MM-dd HH:mm:ss"))


def test_sixty_forms(spark):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        want = [NAMED_ZONES.get(f, reference(f)) for f in FORMS]
    assert len(FORMS) >= 50 and parsed(spark, FORMS) == want


@pytest.mark.parametrize("junk", ["May", "11:22", "May 2001", "1 2 3 4", "14 May 2001 and more", "14 May June 2001", "1/2/3/2004", "2001", "Monday",
                                  "x 14 May 2001", "14 May 2001 13:00 PM", "99/99/9999"])
def test_what_is_no_whole_date_is_null(spark, junk):
    assert parsed(spark, [junk, None]) == [None, None]
