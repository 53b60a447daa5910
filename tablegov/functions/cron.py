"""Validity of cron expressions with 6 or 7 fields, as one boolean Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablegov.functions.text import let

# Per field the range bounds, the step bounds (largest start,
# largest step, largest sum), plain words and the pattern of other forms.
_MINUTE = dict(low=0, high=59, start=(0, 58), step=(1, 59), total=59, words=["*"],
               pattern=r"^(?:[0-5]?\d|59)(?:,[0-5]?\d|59)*$")
_HOUR = dict(low=0, high=23, start=(0, 22), step=(1, 23), total=23, words=["*"],
             pattern=r"^(?:0|[1-9]|1\d|2[0-3])(?:,(?:0|[1-9]|1\d|2[0-3]))*$")
_DAY = dict(low=1, high=31, start=(1, 30), step=(1, 30), total=31, words=["*", "?", "L"],
            pattern=r"^(?:[1-9]|1\d|2\d|3[01])W$|^(?:0|[1-9]|1\d|2[0-9]|3[0-1])(?:,(?:0|[1-9]|1\d|2[0-9]|3[0-1]))*$")
_MONTH = dict(low=1, high=12, start=(1, 11), step=(1, 11), total=12, words=["*"],
              pattern=r"^(?:0|[1-9]|1[0-2])(?:,(?:0|[1-9]|1[0-2]))*$")
_WEEK = dict(low=1, high=7, start=None, step=None, total=0, words=["*", "?"],
             pattern=r"^[1-7]#[1-4]$|^[1-7]L$|^[1-7](?:,[1-7])*$")
LAST_YEAR = 2099
YEARS_AHEAD = 8


def _pair(field: Column, sign: str) -> tuple[Column, Column, Column]:
    """Does the field read ``number sign number``, and the two numbers."""
    first, second = (F.split_part(field, F.lit(sign), F.lit(i)).try_cast("long") for i in (1, 2))
    return field.rlike(rf"^\d+{sign}\d+$"), first, second


def _field(field: Column, rule: dict) -> Column:
    # The cheap tests come first; the others are only reached when they fail.
    ok = field.isin(rule["words"]) | field.rlike(rule["pattern"])
    fits, first, last = _pair(field, "-")
    ok = ok | (fits & (first >= rule["low"]) & (first < last) & (last <= rule["high"]))
    if rule["start"]:
        fits, start, step = _pair(field, "/")
        ok = ok | (fits & start.between(*rule["start"]) & step.between(*rule["step"])
                   & (start + step <= rule["total"]))
    return F.coalesce(ok, F.lit(False))


def _year(field: Column, year: int) -> Column:
    rule = dict(low=year, high=LAST_YEAR, start=(year, LAST_YEAR - 1), step=(1, LAST_YEAR - year), total=LAST_YEAR,
                words=["*"], pattern=r"^[1-7]#[1-4]$|^[1-7]L$")
    near = [str(y) for y in range(year, min(year + YEARS_AHEAD, LAST_YEAR) + 1)]
    listed = (F.length(field) == 4) | F.contains(field, F.lit(","))
    return _field(field, rule) | (listed & F.forall(F.split(field, ","), lambda item: item.isin(near)))


def valid_cron(s: Column, year: int) -> Column:
    """``year`` is the current year; year fields look at most eight years ahead."""
    def check(parts: Column) -> Column:
        ok = F.size(parts).isin(6, 7)
        for i, rule in enumerate([_MINUTE, _MINUTE, _HOUR, _DAY, _MONTH, _WEEK]):
            ok = ok & _field(F.get(parts, i), rule)
        return ok & ((F.size(parts) == 6) | _year(F.get(parts, 6), year))

    # The parts are named once: repeated in the text they would be split for
    # every test of every field.
    return F.coalesce(let(F.split(F.regexp_replace(s, r"^\s+|\s+$", ""), r"\s+"), check), F.lit(False))
