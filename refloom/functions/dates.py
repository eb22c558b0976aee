"""Citation dates: the accepted written forms, their check and their ISO 8601 text.

Each form is one line of a table: a pattern and the capture groups that hold year, month and day of one or two
dates. The checks run once on the captured parts and not per form.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from refloom.functions.core import ColumnOrName, col, is_set, let, lookup, matches

# Month names (long, then short), seasons and the one proper name.
MONTHS = (
    "January February March April May June July August September October November December"
).split()
SEASONS = {"Winter": 21, "Spring": 22, "Summer": 23, "Fall": 24, "Autumn": 24}
PROPER_NAMES = {"Christmas": 31}
SEASON_KEYWORDS = {21: "winter", 22: "spring", 23: "summer", 24: "fall", 31: "Christmas"}
MONTH_NUMBERS = {name: i + 1 for i, name in enumerate(MONTHS)} | {
    name[:3]: i + 1 for i, name in enumerate(MONTHS)
}

JULIAN_END = 1582
FIRST_ACCESS_DATE = "2001-01-15"


def month_number(name: ColumnOrName) -> Column:
    """1–12 for a correctly spelled long or short month name, else 0."""
    return F.coalesce(lookup(MONTH_NUMBERS, col(name)), F.lit(0))


def season_number(name: ColumnOrName) -> Column:
    """21–24 for a season, else 0."""
    return F.coalesce(lookup(SEASONS, col(name)), F.lit(0))


def proper_name_number(name: ColumnOrName) -> Column:
    return F.coalesce(lookup(PROPER_NAMES, col(name)), F.lit(0))


def part_number(name: ColumnOrName) -> Column:
    """Month, season or proper name as a number, else 0."""
    return F.coalesce(lookup({**PROPER_NAMES, **SEASONS, **MONTH_NUMBERS}, col(name)), F.lit(0))


def valid_year(year: ColumnOrName, as_of_year: int) -> Column:
    """No later than the year after `as_of_year`."""
    return col(year) <= as_of_year + 1


def valid_date(year: ColumnOrName, month: ColumnOrName, day: ColumnOrName, as_of_year: int) -> Column:
    """Day exists in that month; leap years are Julian before 1582."""
    y, m, d = col(year), col(month), col(day)
    leap = F.when(y < JULIAN_END, y % 4 == 0).otherwise((y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0)))
    length = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    return F.coalesce(valid_year(y, as_of_year) & m.between(1, 12) & (d <= length), F.lit(False))


def same_month_style(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Both month names long or both short; May is both."""
    x, y = col(a), col(b)
    short_a, short_b = F.length(x) == 3, F.length(y) == 3
    return (F.length(x) == F.length(y)) | (x == "May") | (y == "May") | ~(short_a | short_b)


def valid_month_range(start: ColumnOrName, end: ColumnOrName) -> Column:
    """Months or seasons from earlier to later; fall to winter is allowed, month to season is not."""
    a, b = col(start), col(end)
    ma, mb, sa, sb = month_number(a), month_number(b), season_number(a), season_number(b)
    return F.when(ma > 0, (ma < mb) & same_month_style(a, b)).otherwise(
        (sa > 0) & ((sa < sb) | ((sa == 24) & (sb == 21)))
    )


@dataclass(frozen=True)
class Form:
    """A written form: pattern, then the groups of (year, month, day) for the first and the second date.

    Group 0 stands for "not written"; a second date that shares its year or month repeats the group.
    """

    name: str
    pattern: str
    first: tuple[int, int, int]
    second: tuple[int, int, int] = (0, 0, 0)


_Y4 = r"([1-9]\d{3})"
_Y3 = r"([1-9]\d{2,3})"
_D = r"([1-9]\d?)"
_M = r"([A-Za-z]+)"
_X = r"[A-Za-z]?"

FORMS = [
    Form("ymd", r"^(\d{4})-(\d{2})-(\d{2})$", (1, 2, 3)),
    Form("mdy", rf"^{_M} +{_D}, +{_Y4}{_X}$", (3, 1, 2)),
    Form("md-dy", rf"^{_M} +{_D}–{_D}, +{_Y4}{_X}$", (4, 1, 2), (4, 1, 3)),
    Form("dmy", rf"^{_D} +{_M} +{_Y4}{_X}$", (3, 2, 1)),
    Form("d-dmy", rf"^{_D}–{_D} +{_M} +{_Y4}{_X}$", (4, 3, 1), (4, 3, 2)),
    Form("dm-dmy", rf"^{_D} +{_M} – {_D} +{_M} +{_Y4}{_X}$", (5, 2, 1), (5, 4, 3)),
    Form("md-mdy", rf"^{_M} +{_D} – {_M} +{_D}, +{_Y4}{_X}$", (5, 1, 2), (5, 3, 4)),
    Form("dmy-dmy", rf"^{_D} +{_M} +{_Y4} – {_D} +{_M} +{_Y4}{_X}$", (3, 2, 1), (6, 5, 4)),
    Form("mdy-mdy", rf"^{_M} +{_D}, +{_Y4} – {_M} +{_D}, +{_Y4}{_X}$", (3, 1, 2), (6, 4, 5)),
    Form("sy-yy", rf"^{_M} +{_Y4}–(\d\d){_X}$", (2, 1, 0), (3, 0, 0)),
    Form("sy-y", rf"^{_M} +{_Y4}–{_Y4}{_X}$", (2, 1, 0), (3, 0, 0)),
    Form("my-my", rf"^{_M} +{_Y4} – {_M} +{_Y4}{_X}$", (2, 1, 0), (4, 3, 0)),
    Form("m-my", rf"^{_M}–{_M} +{_Y4}{_X}$", (3, 1, 0), (3, 2, 0)),
    Form("my", rf"^{_M} +(\d{{4}}){_X}$", (2, 1, 0)),
    Form("y-y", rf"^{_Y3}–{_Y3}{_X}$", (1, 0, 0), (2, 0, 0)),
    Form("y-yy", rf"^{_Y4}–(\d\d){_X}$", (1, 0, 0), (2, 0, 0)),
    Form("y", rf"^{_Y3}{_X}$", (1, 0, 0)),
]

_PARTS = "struct<form:string,year:string,month:string,day:int,year2:string,month2:string,day2:int>"


def _form(c: Column) -> Column:
    """Name of the first form that fits. A form begins with a digit or a letter and has a dash or none, so the others are not tried."""

    def first(digit: bool, dash: bool) -> Column:
        out = F.lit(None).cast("string")
        for f in reversed(FORMS):
            if f.pattern.startswith("^([A-Za-z]") != digit and ("–" in f.pattern) == dash:
                out = F.when(matches(c, f.pattern), f.name).otherwise(out)
        return out

    def fits(digit: bool) -> Column:
        return F.when(F.contains(c, F.lit("–")), first(digit, True)).otherwise(first(digit, False))

    return F.when(F.substring(c, 1, 1).between("0", "9"), fits(True)).otherwise(fits(False))


_GROUPS = {f.name: "".join(str(g) for g in f.first + f.second) for f in FORMS}
#: Every group of a form is a run of digits or letters of its own, so the groups are these runs in order.
_RUNS = r"\d+|[A-Za-z]+"


def _parts(c: Column, form: Column) -> Column:
    """Written parts of a date text of a known form: the form names the groups.

    The groups are found by one fixed pattern; one that depends on the row would be compiled anew for every part.
    """

    def read(groups: Column, runs: Column) -> Column:
        def text(place: int) -> Column:
            group = F.substring(groups, place, 1).cast("int")
            return F.when(group > 0, F.get(runs, group - 1))

        short = form.isin("sy-yy", "y-yy")
        return F.struct(
            form.alias("form"),
            text(1).alias("year"),
            text(2).alias("month"),
            text(3).try_cast("int").alias("day"),
            F.when(short, F.concat(F.substring(text(1), 1, 2), text(4))).otherwise(text(4)).alias("year2"),
            text(5).alias("month2"),
            text(6).try_cast("int").alias("day2"),
        )

    runs = F.regexp_extract_all(c, F.lit(_RUNS), F.lit(0))
    return let(F.struct(lookup(_GROUPS, form).alias("g"), runs.alias("r")), lambda x: read(x["g"], x["r"]))


def _numbers(p: Column) -> Column:
    """Written parts plus their numbers."""
    month = F.when(p["form"] == "ymd", p["month"].try_cast("int")).otherwise(
        F.coalesce(part_number(p["month"]), F.lit(0))
    )
    return F.struct(
        *[p[k].alias(k) for k in ("form", "year", "month", "day", "year2", "month2", "day2")],
        p["year"].try_cast("int").alias("y"),
        p["year2"].try_cast("int").alias("y2"),
        month.alias("m"),
        part_number(p["month2"]).alias("m2"),
    )


def _checked(p: Column, as_of_year: int) -> Column:
    """True when the written parts are a real date or range."""
    form, m, m2, year, year2 = p["form"], p["m"], p["m2"], p["y"], p["y2"]
    whole = F.when(p["day"].isNotNull(), valid_date(year, m, p["day"], as_of_year)).otherwise(True)
    whole2 = F.when(p["day2"].isNotNull(), valid_date(year2, m2, p["day2"], as_of_year)).otherwise(True)
    months = m.between(1, 12) & m2.between(1, 12)
    both_seasons = m.between(21, 24) & m2.between(21, 24)
    last_year = F.coalesce(year2, year)
    style = same_month_style(p["month"], p["month2"])
    ordered = (months & (m < m2) & style) | (
        m.between(21, 24) & (m2.between(21, 24) & ((m < m2) | ((m == 24) & (m2 == 21))))
    )
    rule = (
        F.when(form == "ymd", m.between(1, 12) & (year > JULIAN_END))
        .when(form.isin("mdy", "dmy"), m.between(1, 12))
        .when(form.isin("md-dy", "d-dmy"), m.between(1, 12) & (p["day"] < p["day2"]))
        .when(form.isin("dm-dmy", "md-mdy"), ordered)
        .when(form.isin("dmy-dmy", "mdy-mdy"), (year < year2) & style & months)
        .when(form.isin("sy-yy", "sy-y"), p["month"].isin("Winter", "Summer") & (year2 - year == 1))
        .when(form == "my-my", (year < year2) & ((months & style) | both_seasons))
        .when(form == "m-my", ordered)
        .when(form == "my", m > 0)
        .when(form == "y-y", year < year2)
        .when(form == "y-yy", (F.substring(p["year2"], 3, 2).try_cast("int") >= 13) & (year < year2))
        .otherwise(True)
    )
    return F.coalesce(rule & whole & whole2 & valid_year(last_year, as_of_year), F.lit(False))


_RESULT = (
    "struct<valid:boolean,form:string,iso:string,chron:string,season:string,start:date,finish:date>"
)


def _described(p: Column) -> Column:
    """ISO text and the rest of a date that was found valid."""
    month, month2 = p["m"], p["m2"]
    ranged = p["year2"].isNotNull()
    years = F.when(
        ranged & (p["year2"] != p["year"]), F.format_string("%04d/%04d", p["y"], p["y2"])
    ).otherwise(p["year"])

    def one(y: Column, m: Column, d: Column) -> Column:
        return (
            F.when(d.isNotNull(), F.concat(y, F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0")))
            .when(m > 0, F.concat(y, F.lit("-"), F.lpad(m, 2, "0")))
            .otherwise(y)
        )

    full = F.concat(
        one(p["year"], month, p["day"]),
        F.when(ranged, F.concat(F.lit("/"), one(p["year2"], month2, p["day2"]))).otherwise(""),
    )
    named = lookup(SEASON_KEYWORDS, month.cast("string"))
    named2 = lookup(SEASON_KEYWORDS, month2.cast("string"))
    chron_text = F.when(
        month > 20,
        F.when((month2 == 0) & (month > 30), named)
        .when(
            (month2 > 0) & (p["year"] != p["year2"]),
            F.concat_ws(" ", named, p["year"], F.lit("–"), named2, p["year2"]),
        )
        .when(month2 > 0, F.concat(named, F.lit("–"), named2)),
    )

    def day_of(y: Column, m: Column, d: Column) -> Column:
        return F.when(d.isNotNull() & (y >= JULIAN_END), one(y.cast("string"), m, d).try_cast("date"))

    return F.struct(
        F.lit(True).alias("valid"),
        p["form"].alias("form"),
        F.when((p["y"] < JULIAN_END) | (month > 20), years).otherwise(full).alias("iso"),
        chron_text.alias("chron"),
        F.when((month > 20) & (month < 30), named).alias("season"),
        day_of(p["y"], month, p["day"]).alias("start"),
        day_of(
            F.coalesce(p["y2"], p["y"]),
            F.when(ranged, month2).otherwise(month),
            F.when(ranged, p["day2"]).otherwise(p["day"]),
        ).alias("finish"),
    ).cast(_RESULT)


def parse_date(text: ColumnOrName, as_of_year: int) -> Column:
    """`struct<valid,form,iso,chron,season,start,finish>` of a written date; null for a null text.

    `iso` is ISO 8601 (a range has a slash), reduced to years before 1582 and for seasons. `chron` is free text
    for season ranges and proper names, `season` one of four keywords. `start`/`finish` are dates, null when the
    day is not written.
    """

    def of_form(form: Column) -> Column:
        none = F.lit(None).cast("string")
        no_day = F.lit(None).cast("date")
        return F.struct(
            F.lit(False).alias("valid"), form.alias("form"), none.alias("iso"), none.alias("chron"),
            none.alias("season"), no_day.alias("start"), no_day.alias("finish"),
        ).cast(_RESULT)

    return _judged(text, lambda p: F.when(_checked(p, as_of_year), _described(p)), of_form)


def _judged(text: ColumnOrName, right: Callable[[Column], Column], wrong: Callable[[Column], Column]) -> Column:
    """`right` of the written parts and their numbers, or `wrong` of the form where the text has none or `right` is null; null
    for a null text."""

    def of_form(c: Column, form: Column) -> Column:
        parts = let(let(_parts(c, form), _numbers), lambda p: F.coalesce(right(p), wrong(form)))
        return F.when(form.isNull(), wrong(form)).otherwise(parts)

    return let(col(text), lambda c: F.when(c.isNotNull(), let(_form(c), lambda form: of_form(c, form))))


def is_date(text: ColumnOrName, as_of_year: int) -> Column:
    """`valid` of `parse_date` alone."""
    return _judged(text, lambda p: _checked(p, as_of_year), lambda _: F.lit(False))


def iso_date(text: ColumnOrName, as_of_year: int) -> Column:
    return parse_date(text, as_of_year)["iso"]


def chron(text: ColumnOrName, as_of_year: int) -> Column:
    """Free-form rest: season range or proper name, else the text itself when it is no date."""
    c = col(text)
    return let(
        parse_date(c, as_of_year),
        lambda p: F.coalesce(p["chron"], F.when(p["iso"].isNull(), c), F.lit("")),
    )


def season(text: ColumnOrName, as_of_year: int) -> Column:
    return parse_date(text, as_of_year)["season"]


def approx_or_no_date(text: ColumnOrName) -> Column:
    """`approx` for `c. 1900`, `none` for `n.d.` or `nd`, else null."""
    c = col(text)
    return F.when(c.startswith("c") & matches(c, rf"^c\. {_Y3}{_X}$"), "approx").when(
        c.startswith("n") & matches(c, r"^(?:n\.d\.[A-Za-z]?|nd[A-Za-z]?$)"), "none"
    )


def acceptable_date(text: ColumnOrName, as_of_year: int) -> Column:
    """A value the date field may hold: a real date, a circa year up to next year, or `n.d.`."""
    c = col(text)
    circa = F.regexp_extract(c, r"^c\. (\d{3,4})", 1).try_cast("int")
    return let(
        approx_or_no_date(c),
        lambda kind: F.when(kind == "approx", valid_year(circa, as_of_year))
        .when(kind == "none", True)
        .otherwise(F.coalesce(is_date(c, as_of_year), F.lit(False))),
    )


def year_date_mismatch(year: ColumnOrName, date: ColumnOrName) -> Column:
    """0 when the year is not in the date, 1 when it is, 2 when it is and marked by a letter on a YYYY-MM-DD date."""
    y, d = col(year), col(date)
    plain = F.regexp_extract(y, r"(\d{3,4})", 1)
    first = F.regexp_extract(d, r"(\d{3,4})", 1)
    two = r"(\d{3,4}).*?(\d{3,4})"
    short = r"(\d{4})[\s\-–]+(\d\d)"

    def among(*years: Column) -> Column:
        hit = F.lit(False)
        for v in years:
            hit = hit | (plain == v)
        return F.when(hit, 1).otherwise(0)

    marked = matches(d, r"\d{4}-\d\d-\d\d") & matches(y, r"\d{4}[A-Za-z]")
    return (
        F.when(
            marked,
            F.when(F.regexp_extract(y, r"(\d{4})", 1) == F.regexp_extract(d, r"(\d{4})", 1), 2).otherwise(0),
        )
        .when(matches(d, two), among(F.regexp_extract(d, two, 1), F.regexp_extract(d, two, 2)))
        .when(
            matches(d, short),
            among(
                F.regexp_extract(d, short, 1),
                F.concat(F.substring(F.regexp_extract(d, short, 1), 1, 2), F.regexp_extract(d, short, 2)),
            ),
        )
        .when(matches(d, r"\d{3,4}"), among(first))
        .otherwise(1)
    )


def valid_access_date(date: ColumnOrName, as_of: ColumnOrName) -> Column:
    """A day from 15 January 2001 up to the day after `as_of` (both DATE columns)."""
    d, day = col(date), col(as_of)
    return F.coalesce(
        (d >= F.lit(FIRST_ACCESS_DATE).cast("date")) & (d < F.date_add(day, 2)), F.lit(False)
    )


def embargoed(date: ColumnOrName, as_of: ColumnOrName) -> Column:
    """The embargo day is today or later."""
    return F.coalesce(col(date) >= col(as_of), F.lit(False)) & is_set(col(date).cast("string"))
