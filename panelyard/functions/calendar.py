"""Business-day arithmetic without a calendar table: weekends only."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from panelyard import vocab
from panelyard.functions.numeric import as_col


def next_business_day(d: Column | str) -> Column:
    d = as_col(d)
    dow = F.weekday(d)  # Monday = 0
    return F.date_add(d, F.when(dow == 4, 3).when(dow == 5, 2).otherwise(1))


def last_business_day(d: Column | str) -> Column:
    """``d`` itself on a weekday, else the Friday before."""
    d = as_col(d)
    dow = F.weekday(d)
    return F.date_sub(d, F.when(dow == 5, 1).when(dow == 6, 2).otherwise(0))


def weekdays_before(d: Column | str) -> Column:
    """Number of weekdays from the Monday 1969-12-29 up to, not including, ``d``."""
    days = F.unix_date(as_col(d)) + 3
    week = F.floor(days / 7)
    return (week * 5 + F.least(days - week * 7, F.lit(5))).cast("int")


def business_days(first: Column | str, last: Column | str) -> Column:
    """Weekdays in the closed interval; 0 if it is empty."""
    return F.greatest(weekdays_before(F.date_add(as_col(last), 1)) - weekdays_before(first), F.lit(0))


def effective_date(filing_date: Column | str, accepted: Column | str) -> Column:
    """First day the market could act on a filing: after the close means the next business day."""
    local_hour = F.hour(F.from_utc_timestamp(as_col(accepted), vocab.MARKET_ZONE))
    return F.when(local_hour >= vocab.CLOSE_HOUR, next_business_day(filing_date)).otherwise(as_col(filing_date))


def day_number(d: Column | str) -> Column:
    return F.unix_date(as_col(d))
