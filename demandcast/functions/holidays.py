"""Public-holiday calendar generated by Spark from a rule table.

The rules produce ``(date, name)`` rows for a range of years with built-in
date expressions (fixed day, n-th weekday of a month, Easter offset, weekend
substitution). Substitute days declared by proclamation and one-off days are
not rules; pass them as ``extra`` rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Public holidays of Victoria, Australia.
# (name, kind, args, weekend rule, first year)
#   kind "fixed": args (month, day)
#   kind "nth_weekday": args (month, weekday with Monday = 0, n)
#   kind "easter": args (days after Easter Sunday,)
#   kind "on_or_after": args (month, day, weekday with Monday = 0), the first
#   such weekday from that day on, but for the years of MOVED
#   weekend rule "next_monday": if the day is a Saturday or Sunday, the next
#   Monday is also a holiday; "plus_two": the day two days later is.
VIC_RULES = (
    ("New Year's Day", "fixed", (1, 1), "next_monday", None),
    ("Australia Day", "fixed", (1, 26), "next_monday", None),
    ("Labour Day", "nth_weekday", (3, 0, 2), None, None),
    ("Good Friday", "easter", (-2,), None, None),
    ("Easter Saturday", "easter", (-1,), None, None),
    ("Easter Sunday", "easter", (0,), None, 2016),
    ("Easter Monday", "easter", (1,), None, None),
    ("Anzac Day", "fixed", (4, 25), None, None),
    ("Queen's Birthday", "nth_weekday", (6, 0, 2), None, None),
    ("Grand Final Friday", "on_or_after", (9, 24, 4), None, 2015),
    ("Melbourne Cup", "nth_weekday", (11, 1, 1), None, None),
    ("Christmas Day", "fixed", (12, 25), "plus_two", None),
    ("Boxing Day", "fixed", (12, 26), "plus_two", None),
)

# Years in which a day was proclaimed for another date.
MOVED = {"Grand Final Friday": {2015: (10, 2), 2020: (10, 23), 2022: (9, 23)}}


def easter_sql(y: str = "y") -> str:
    """SQL text of Gregorian Easter Sunday of year ``y`` (anonymous Gregorian
    algorithm, integer arithmetic), as one expression."""
    a, b, c = f"({y} % 19)", f"({y} div 100)", f"({y} % 100)"
    d, e, f = f"({b} div 4)", f"({b} % 4)", f"(({b} + 8) div 25)"
    g = f"(({b} - {f} + 1) div 3)"
    h = f"((19 * {a} + {b} - {d} - {g} + 15) % 30)"
    i, k = f"({c} div 4)", f"({c} % 4)"
    l_ = f"((32 + 2 * {e} + 2 * {i} - {h} - {k}) % 7)"
    m = f"(({a} + 11 * {h} + 22 * {l_}) div 451)"
    # days after 1 March
    return f"date_add(make_date({y}, 3, 1), CAST({h} + {l_} - 7 * {m} + 21 AS INT))"


def _rule_date_sql(kind: str, args: tuple, name: str = "") -> str:
    if kind == "fixed":
        return f"make_date(y, {int(args[0])}, {int(args[1])})"
    if kind == "nth_weekday":
        month, weekday, n = (int(a) for a in args)
        first = f"make_date(y, {month}, 1)"
        return f"date_add({first}, CAST(({weekday} - weekday({first}) + 7) % 7 + {7 * (n - 1)} AS INT))"
    if kind == "easter":
        return f"date_add(easter, {int(args[0])})"
    if kind == "on_or_after":
        month, day, weekday = (int(a) for a in args)
        first = f"make_date(y, {month}, {day})"
        rule = f"date_add({first}, CAST(({weekday} - weekday({first}) + 7) % 7 AS INT))"
        moved = "".join(f" WHEN y = {y} THEN make_date(y, {m}, {d})"
                        for y, (m, d) in MOVED.get(name, {}).items())
        return f"CASE{moved} ELSE {rule} END" if moved else rule
    raise ValueError(f"unknown rule kind {kind!r}")


def _weekend_substitute_sql(day: str, rule: str) -> str:
    if rule == "next_monday":
        shifted = f"date_add({day}, CAST(7 - weekday({day}) AS INT))"
    elif rule == "plus_two":
        shifted = f"date_add({day}, 2)"
    else:
        raise ValueError(f"unknown weekend rule {rule!r}")
    return f"CASE WHEN weekday({day}) >= 5 THEN {shifted} END"


def _sql_string(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _entries(rules) -> list[tuple[str, str]]:
    """(name, SQL text of the date in year ``y`` or null) of every rule."""
    entries = []
    for name, kind, args, weekend, since in rules:
        day = _rule_date_sql(kind, args, name)
        ok = "true" if since is None else f"y >= {int(since)}"
        entries.append((name, f"CASE WHEN {ok} THEN {day} END"))
        if weekend is not None:
            sub = _weekend_substitute_sql(day, weekend)
            entries.append((name + " (Observed)", f"CASE WHEN {ok} THEN {sub} END"))
    return entries


def _conditions(date: str, rules) -> list[tuple[str, str]]:
    """(name, SQL condition) of every rule for a row's own date.

    Each is guarded by the months it can fall in, so most rows compare a few
    integers only; Easter is one expression, and its days are offsets to it.
    """
    column = "`" + date.replace("`", "``") + "`"
    year = f"CAST(year({column}) AS INT)"

    def own_year(text: str) -> str:
        return re.sub(r"(?<![A-Za-z0-9_`])y(?![A-Za-z0-9_`])", year, text)

    out = []
    days = dict(_entries(rules))
    for name, kind, args, weekend, since in rules:
        if kind == "easter":
            ok = "" if since is None else f" AND {year} >= {int(since)}"
            out.append((name, f"month({column}) IN (3, 4){ok} AND "
                              f"datediff({column}, {own_year(easter_sql('y'))}) = {int(args[0])}"))
            continue
        months = {int(args[0])} | {m for m, _ in MOVED.get(name, {}).values()}
        guard = f"month({column}) IN ({', '.join(map(str, sorted(months)))})"
        out.append((name, f"{guard} AND {own_year(days[name])} = {column}"))
        if weekend is not None:
            observed = f"{name} (Observed)"
            out.append((observed, f"{guard} AND {own_year(days[observed])} = {column}"))
    return out


def holiday_names(date: str = "date", rules=VIC_RULES) -> Column:
    """The names of the holidays that fall on a row's date (an array, maybe empty).

    The rules are evaluated for the year of the date itself, so any year is
    covered and no calendar is joined. Substitute days stay in their month.
    """
    cases = [f"CASE WHEN {cond} THEN {_sql_string(name)} END" for name, cond in _conditions(date, rules)]
    return F.expr(f"array_compact(array({', '.join(cases)}))")


def is_holiday(date: str = "date", rules=VIC_RULES) -> Column:
    """Whether a row's date is a holiday (false for a null date)."""
    either = " OR ".join(f"({cond})" for _, cond in _conditions(date, rules))
    return F.expr(f"coalesce({either}, false)")


def holiday_calendar(spark: SparkSession, years, rules=VIC_RULES,
                     extra: DataFrame | None = None) -> DataFrame:
    """(date DATE, name STRING) for every rule and year in ``years`` (inclusive).

    Built from ``spark.range`` with SQL expressions: no driver-side list.
    ``extra`` (date, name) rows are appended as given.
    """
    entries = [f"named_struct('date', {day}, 'name', {_sql_string(name)})"
               for name, day in _entries(rules)]
    # One partition: a few thousand rows, so de-duplicating needs no shuffle.
    cal = (spark.range(years[0], years[1] + 1, 1, numPartitions=1)
           .selectExpr("CAST(id AS INT) AS y")
           .selectExpr("y", f"{easter_sql('y')} AS easter")
           .selectExpr(f"explode(array({', '.join(entries)})) AS h")
           .selectExpr("h.date AS date", "h.name AS name")
           .filter("date IS NOT NULL"))
    if extra is not None:
        return cal.unionByName(extra.select(F.col("date").cast("date"),
                                            F.col("name").cast("string")))
    return cal
