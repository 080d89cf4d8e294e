"""Dates in texts: relative expressions resolved against the day on which they were said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Modifiers of calendar periods and the steps that they take; references that no calendar defines.
STEPS = {"last": -1, "past": -1, "this": 0, "next": 1, "coming": 1}
UNITS = ("week", "weekend", "month", "year")
SEASONS = ("spring", "summer", "autumn", "fall", "winter")
DAYS = {"yesterday": -1, "today": 0, "tomorrow": 1}
FUZZY = rf"(?i)\b(?:(?:{'|'.join(STEPS)})\s+(?:{'|'.join(SEASONS)})|a\s+while\s+(?:ago|back)|recently|some\s+time\s+ago|soon)\b"


def iso(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def period(step: int | Column, unit: str, day: Column) -> Column:
    """What a calendar period is called, at its own granularity, seen from a day."""
    step = F.lit(step) if isinstance(step, int) else step
    monday = F.to_date(F.date_trunc("week", day))
    if unit == "week":
        return F.concat(F.lit("the week of "), iso(F.date_add(monday, step * 7)))
    if unit == "weekend":
        return F.concat(F.lit("the weekend of "), iso(F.date_add(monday, step * 7 + 5)))
    if unit == "month":
        return F.date_format(F.add_months(day, step), "MMMM yyyy")
    return F.year(F.add_months(day, step * 12)).cast("string")


def rewrite_relative(text: Column, day: Column) -> Column:
    """The text with yesterday, today, tomorrow and named periods replaced by what they meant on that day."""
    for word, step in DAYS.items():
        text = F.regexp_replace(text, F.lit(rf"(?i)\b{word}\b"), iso(F.date_add(day, step)))
    for name, step in STEPS.items():
        for unit in UNITS:
            pattern = rf"(?i)\b(?:the\s+)?{name}\s+{unit}\b"
            text = F.regexp_replace(text, F.lit(pattern), period(step, unit, day))
    return text


def span_days(first: Column, second: Column) -> Column:
    return F.abs(F.date_diff(first, second))


def asks_since(question: Column) -> Column:
    """Whether a question asks how long ago something was."""
    return F.coalesce(question.rlike(r"(?i)\b(?:how long (?:ago|since|has it been)|(?:days|weeks|months|years) (?:ago|since|has it been)|since when|time since)\b"), F.lit(False))


def signed_span(event: Column, day: Column) -> Column:
    """How far an event lies from a day, in words."""
    n = F.date_diff(day, event)
    unit = F.when(F.abs(n) == 1, F.lit(" day")).otherwise(F.lit(" days"))
    return (
        F.when(n == 0, F.lit("today"))
        .when(n > 0, F.concat(n.cast("string"), unit, F.lit(" ago")))
        .otherwise(F.concat(F.lit("in "), (-n).cast("string"), unit))
    )


def shifted(day: Column, count: Column, unit: Column) -> Column:
    """The day moved by a count of days, weeks, months or years; other units give null."""
    return (
        F.when(unit == "day", F.date_add(day, count))
        .when(unit == "week", F.date_add(day, count * 7))
        .when(unit == "month", F.add_months(day, count))
        .when(unit == "year", F.add_months(day, count * 12))
    )


def ago_or_in(text: Column, day: Column) -> Column:
    """The day that the first `N unit ago`, or else `in N unit`, of a text names."""
    ago, ahead = r"(?i)\b(\d{1,4})\s+(day|week|month|year)s?\s+ago\b", r"(?i)\bin\s+(\d{1,4})\s+(day|week|month|year)s?\b"

    def resolved(pattern: str, sign: int) -> Column:
        count = F.regexp_extract(text, pattern, 1).try_cast("int")
        return shifted(day, count * sign, F.lower(F.regexp_extract(text, pattern, 2)))

    return F.coalesce(resolved(ago, -1), resolved(ahead, 1))


def payload_time(payload: Column, field: str) -> Column:
    """A date or instant of a JSON field, as a date; null if it is missing or not one."""
    return F.regexp_extract(payload, rf'"{field}"\s*:\s*"(\d{{4}}-\d{{2}}-\d{{2}})', 1).try_cast("date")


def effective_bounds(phrase: Column, day: Column, said: Column, kind: str = "point") -> Column:
    """The half-open [from, to) that a phrase of a turn means, as a struct of dates; null where it means none.

    The phrase must occur in the turn. ISO dates and yesterday, today and tomorrow are days, `in March 2024`-like months
    whole months; last, this and next week or weekend count only for periods. A bare year is no bound, and
    hedged phrases have none.
    """
    hedged = phrase.rlike(r"(?i)\b(?:about|around|roughly|maybe|perhaps|probably|circa)\b")
    low = F.lower(F.trim(phrase))
    iso_day = F.regexp_extract(low, r"^(\d{4}-\d{2}-\d{2})$", 1).try_cast("date")
    relative = F.when(low == "yesterday", F.date_add(day, -1)).when(low == "today", day).when(low == "tomorrow", F.date_add(day, 1))
    one = F.coalesce(iso_day, relative)
    month = F.try_to_timestamp(F.concat(F.lit("1 "), F.initcap(low)), F.lit("d MMMM yyyy")).cast("date")
    step = F.when(low.rlike(r"^(?:the )?(?:last|past) "), -1).when(low.rlike(r"^(?:the )?this "), 0).when(low.rlike(r"^(?:the )?(?:next|coming) "), 1)
    monday = F.date_add(F.to_date(F.date_trunc("week", day)), step * 7)

    def span(first: Column, last: Column) -> Column:
        return F.struct(first.alias("from"), last.alias("to"))

    found = F.when(one.isNotNull(), span(one, F.date_add(one, 1))).when(month.isNotNull(), span(month, F.add_months(month, 1)))
    if kind == "period":
        found = found.when(low.rlike(r" week$") & monday.isNotNull(), span(monday, F.date_add(monday, 7)))
        found = found.when(low.rlike(r" weekend$") & monday.isNotNull(), span(F.date_add(monday, 5), F.date_add(monday, 7)))
    return F.when(F.contains(F.lower(said), low) & ~hedged, found)


def residual(text: Column, day: Column, most: int = 6) -> Column:
    """The relative references that a text still holds, in order, with what each means on a day (null: nothing fixed)."""
    named = "|".join((*DAYS, "recently", "soon"))
    periods = rf"(?:{'|'.join(STEPS)})\s+(?:{'|'.join((*UNITS, *SEASONS))})"
    pattern = rf"(?i)\b(?:{named}|{periods}|\d{{1,4}}\s+(?:day|week|month|year)s?\s+ago)\b"
    found = F.slice(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), F.lower)), 1, most)

    def meant(phrase: Column) -> Column:
        rewritten = rewrite_relative(phrase, day)
        fixed = F.when(rewritten != phrase, rewritten)
        return F.struct(phrase.alias("phrase"), F.coalesce(iso(ago_or_in(phrase, day)), fixed).alias("meaning"))

    return F.transform(found, meant)
