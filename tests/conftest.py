import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tidewatch.session import local_session

    s = local_session(cpus=8, shuffle_partitions=4, memory="8g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tr_calendar(spark):
    from datetime import date

    from tidewatch.operators.calendar import calendar_dim
    from tidewatch.session import settle
    from tidewatch.sources.holidays import build_holidays, fixed_holidays, movable_holidays

    years = spark.range(2024, 2029).selectExpr("cast(id as int) as year")
    h = build_holidays(fixed_holidays(spark), movable_holidays(spark), years)
    return settle(calendar_dim(spark, h, date(2024, 1, 1), date(2028, 1, 31)), "cal")
