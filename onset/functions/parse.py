"""Scalar parsing and formatting as native columns. Bad input gives null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of a presence flag, and of a missing value.
TRUE_WORDS = ["1", "true", "t", "yes", "y", "pv", "present"]
FALSE_WORDS = ["0", "false", "f", "no", "n", "non_pv", "non-pv", "absent"]
MISSING_WORDS = ["", "nan", "none", "null", "nat"]


#: Characters that are stripped from both ends.
BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u2028\u2029\u3000"


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is named there.
    Columns that name one another are merged by the optimizer, and a text is then
    parsed again for each name."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def missing(text: Column) -> Column:
    return F.lower(strip(text)).isin(MISSING_WORDS)


def iso_date(text: Column) -> Column:
    """The first ten characters as a date; unpadded months and days count."""
    return F.try_to_date(F.substring(strip(text), 1, 10), "yyyy-M-d")


def slash_date(text: Column) -> Column:
    return F.try_to_date(strip(text), "yyyy/MM/dd")


def slash_text(date: Column) -> Column:
    return F.date_format(date, "yyyy/MM/dd")


def date_text(date: Column) -> Column:
    return F.coalesce(F.date_format(date, "yyyy-MM-dd"), F.lit(""))


def flag(text: Column) -> Column:
    word = F.lower(strip(text))
    return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False)


def number(text: Column) -> Column:
    endless = lambda w: F.when(F.lower(w).rlike(r"^[+-]?inf(inity)?$"), F.when(w.startswith("-"), float("-inf")).otherwise(float("inf")))
    return once(strip(text), lambda w: F.when(w.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), w.try_cast("double")).otherwise(endless(w)))


def whole_number(text: Column) -> Column:
    """Through a double, its fraction cut off."""
    return number(text).try_cast("int")


def required(value: Column, name: str) -> Column:
    """``value``; raises where it is null."""
    return F.when(value.isNull(), F.raise_error(F.lit(f"missing {name}"))).otherwise(value)


def first_date(texts: list[Column]) -> Column:
    """The first of some texts that is a date."""
    return F.coalesce(*(iso_date(t) for t in texts))


def yearly(start: Column, end: Column, month: int, day: int) -> Column:
    """One date a year, both years included; a day that a year lacks raises."""
    return F.transform(F.sequence(start, end), lambda y: F.make_date(y, F.lit(month), F.lit(day)))


def location_arg(lon: Column, lat: Column) -> Column:
    """``lat,lon`` with ten decimals."""
    return F.format_string("%.10f,%.10f", lat.cast("double"), lon.cast("double"))


def box_args(lon0: Column, lat0: Column, lon1: Column, lat1: Column) -> tuple[Column, Column]:
    """Lower left and upper right corner as texts, whichever way they were given."""
    return location_arg(F.least(lon0, lon1), F.least(lat0, lat1)), location_arg(F.greatest(lon0, lon1), F.greatest(lat0, lat1))


def presence(flag_text: Column, scores: list[Column], threshold: float = 0.5) -> tuple[Column, Column]:
    """Presence and score: the flag wins, else the first score that parses."""
    score = F.coalesce(*(number(s) for s in scores))
    return F.coalesce(flag(flag_text), score >= threshold), score


def token(text: Column, charset: str = "A-Za-z0-9_.-", edge: str = "._-", default: str = "task", most: int = 120, lower: bool = False) -> Column:
    """A name safe in paths: runs of other characters become one underscore."""
    plain = F.regexp_replace(strip(text), f"[^{charset}]+", "_")
    bare = F.regexp_replace(plain, f"^[{edge}]+|[{edge}]+$", "")
    out = F.left(F.when(bare == "", default).otherwise(bare), F.lit(most))
    return F.lower(out) if lower else out


def join_path(root: Column, name: Column) -> Column:
    windows = root.rlike(r"^[A-Za-z]:[\\/]|^\\\\")
    return F.when(windows, F.concat_ws("\\", F.regexp_replace(root, r"[\\/]+$", ""), name)).otherwise(F.concat_ws("/", F.regexp_replace(root, "/+$", ""), name))


def task_dir(save_to: Column, name: Column) -> Column:
    """Where a task's files are: its folder by that of the drive, and its name."""
    return once(drive_to_mount(save_to), lambda root: join_path(root, name))


def drive_to_mount(path: Column) -> Column:
    at = r"^([A-Za-z]):[\\/](.*)$"
    return F.when(path.rlike(at), F.concat(F.lit("/mnt/"), F.lower(F.regexp_extract(path, at, 1)), F.lit("/"), F.translate(F.regexp_extract(path, at, 2), "\\", "/"))).otherwise(path)


def fixed(value: Column, digits: int) -> Column:
    """Text with so many decimals; blank unless finite."""
    good = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(good, F.format_string(f"%.{digits}f", value.cast("double"))).otherwise("")


def tri_text(value: Column) -> Column:
    return F.when(value, "1").when(~value, "0").otherwise("")


def midpoint(start: Column, end: Column) -> Column:
    return F.date_add(start, F.floor(F.datediff(end, start) / 2).cast("int"))


def appears_confidence(days: Column) -> Column:
    return F.when(days <= 183, "high").when(days <= 730, "medium").otherwise("low")


def census_confidence(days: Column) -> Column:
    return F.when(days <= 365, "high").otherwise("medium")
