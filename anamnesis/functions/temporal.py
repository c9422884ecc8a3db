"""Days, dates in text and temporal expressions, as native column functions.

Days are numbered from 1970-01-01 in UTC. Windows are half-open; an open end is the
least or the greatest 64-bit number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names in English, Italian and Spanish, without accents.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "gennaio": 1, "febbraio": 2, "marzo": 3, "aprile": 4, "maggio": 5, "giugno": 6, "luglio": 7, "agosto": 8, "settembre": 9, "ottobre": 10, "novembre": 11, "dicembre": 12,
    "enero": 1, "febrero": 2, "abril": 4, "mayo": 5, "junio": 6, "julio": 7, "septiembre": 9, "octubre": 10, "noviembre": 11, "diciembre": 12,
}

#: Weekday names in the same languages, numbered from Monday; the first that a text has counts.
WEEKDAYS = {
    "monday": 0, "tuesday": 1, "wednesday": 2, "thursday": 3, "friday": 4, "saturday": 5, "sunday": 6,
    "lunedi": 0, "martedi": 1, "mercoledi": 2, "giovedi": 3, "venerdi": 4, "sabato": 5, "domenica": 6,
    "lunes": 0, "martes": 1, "miercoles": 2, "jueves": 3, "viernes": 4, "sabado": 5, "domingo": 6,
}

#: Patterns of the expressions, on lower-case text without accents.
TODAY, YESTERDAY, TOMORROW = r"\b(today|oggi|hoy)\b", r"\b(yesterday|ieri|ayer)\b", r"\b(tomorrow|domani|manana)\b"
AGO = r"\b(\d+)\s+(days?|weeks?|months?)\s+ago\b|\b(\d+)\s+(giorni|settimane|mesi)\s+fa\b|\bhace\s+(\d+)\s+(dias|semanas|meses)\b"
LAST_WEEK, THIS_WEEK = r"\b(last\s+week|la\s+settimana\s+scorsa|la\s+semana\s+pasada)\b", r"\b(this\s+week|questa\s+settimana|esta\s+semana)\b"
LAST_MONTH, THIS_MONTH = r"\b(last\s+month|il\s+mese\s+scorso|el\s+mes\s+pasado)\b", r"\b(this\s+month|questo\s+mese|este\s+mes)\b"
LAST_YEAR, THIS_YEAR = r"\blast\s+year\b", r"\bthis\s+year\b"
BOUND = r"\b(since|before)\s+(.+)"
IN_MONTH = r"\b(?:in|a|en)\s+([a-z]+)(?:\s+(\d{4}))?\b"
ON_DAY = r"\b(?:on|il|el)\s+([a-z]+\s+\d{1,2}(?:,?\s+\d{4})?|\d{1,2}\s+[a-z]+(?:\s+\d{4})?)\b"
ANY_DATE = r"(\d{4}-\d{2}-\d{2}|[A-Za-zÀ-ÿ]+\s+\d{1,2}(?:,?\s+\d{4})?|\d{1,2}\s+[A-Za-zÀ-ÿ]+(?:\s+\d{4})?)"
FULL_DATE = r"(\d{4}-\d{2}-\d{2}|[A-Za-zÀ-ÿ]+\s+\d{1,2},\s*\d{4}|\d{1,2}\s+[A-Za-zÀ-ÿ]+\s+\d{4})"
ISO, MONTH_DAY, DAY_MONTH = r"^\s*(\d{4})-(\d{2})-(\d{2})\s*$", r"^\s*([A-Za-zÀ-ÿ]+)\s+(\d{1,2})(?:,?\s*(\d{4}))?\s*$", r"^\s*(\d{1,2})\s+([A-Za-zÀ-ÿ]+)(?:\s+(\d{4}))?\s*$"

#: Letters that change, and what they become. Capitals with accents stay, but for Ñ.
CAPITALS, ACCENTED, BARE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáèéìíòóùúñÑ", "aaeeiioouunn"

#: Months that "... months ago" may lead back.
MOST_MONTHS = 20_000

OPEN_START, OPEN_END = -(2**63), 2**63 - 1


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often the result names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def plain(text: Column) -> Column:
    """ASCII lower case without the accents of the three languages."""
    return F.translate(text, CAPITALS + ACCENTED, CAPITALS.lower() + BARE)


def utc_day(seconds: Column) -> Column:
    return F.floor(seconds / 86400.0).cast("long")


def date_of(day: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int"))


def day_of(date: Column) -> Column:
    return F.unix_date(date).cast("long")


def utc_date(seconds: Column) -> Column:
    return F.date_format(date_of(utc_day(seconds)), "yyyy-MM-dd")


def time_ago(seconds: Column) -> Column:
    """'just now' under a minute (or for the future), then whole minutes, hours or days."""
    part = lambda n, unit: F.concat((seconds / n).cast("long").cast("string"), F.lit(f"{unit} ago"))
    return F.when(seconds < 60, "just now").when(seconds < 3600, part(60, "m")).when(seconds < 86400, part(3600, "h")).otherwise(part(86400, "d"))


def month_number(name: Column) -> Column:
    pairs = [F.lit(x) for kv in MONTHS.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), plain(name))


def _group(text: Column, pattern: str, i: int) -> Column:
    """A group of the first match, null if it is empty or nothing matches."""
    return F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))


def valid_day(year: Column, month: Column, day: Column) -> Column:
    """The day's number; null if there is no such date."""
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    return day_of(F.when(year.isNotNull() & month.isNotNull() & day.isNotNull(), text).try_cast("date"))


def parse_date(text: Column, default_year: Column) -> Column:
    """The day of an ISO date, 'Month D[, YYYY]' or 'D Month [YYYY]' that is the whole text."""

    def parsed(t: Column) -> Column:
        year = lambda p: F.coalesce(_group(t, p, 3), default_year.cast("string"))
        parts = (
            F.when(t.rlike(ISO), F.array(_group(t, ISO, 1), _group(t, ISO, 2), _group(t, ISO, 3)))
            .when(t.rlike(MONTH_DAY), F.array(year(MONTH_DAY), month_number(_group(t, MONTH_DAY, 1)).cast("string"), _group(t, MONTH_DAY, 2)))
            .when(t.rlike(DAY_MONTH), F.array(year(DAY_MONTH), month_number(_group(t, DAY_MONTH, 2)).cast("string"), _group(t, DAY_MONTH, 1)))
        )
        return bound(parts, lambda p: valid_day(p[0], p[1], p[2]))

    return bound(text, parsed)


def first_date(text: Column, default_year: Column) -> Column:
    """The day of the first date-like place; null if it is no date, whatever follows."""
    return parse_date(_group(text, ANY_DATE, 1), default_year)


def mentioned_days(text: Column, reference: Column) -> Column:
    """All days that a text names, sorted without repeats: today and yesterday relative to ``reference``, and full dates."""
    today, lower = utc_day(reference), plain(text)
    relative = bound(lower, lambda t: F.array(F.when(t.rlike(TODAY), today), F.when(t.rlike(YESTERDAY), today - 1)))
    explicit = F.transform(F.regexp_extract_all(text, F.lit(FULL_DATE), 1), lambda t: parse_date(t, F.year(date_of(today))))
    return F.array_sort(F.array_distinct(F.filter(F.concat(relative, explicit), lambda d: d.isNotNull())))


def both_mentioned_days(user: Column, assistant: Column, reference: Column) -> Column:
    return F.array_sort(F.array_union(mentioned_days(user, reference), mentioned_days(assistant, reference)))


def window(query: Column, now: Column) -> Column:
    """struct(start_day, end_day) of the first temporal expression by the order of the rules below; null if there is none."""
    return bound(plain(query), lambda text: bound(utc_day(now), lambda today: _window(text, today)))


def _span(start: Column, end: Column) -> Column:
    return F.struct(start.cast("long").alias("start_day"), end.cast("long").alias("end_day"))


def _one(day: Column) -> Column:
    """The window of one day; null for no day."""
    return bound(day, lambda d: F.when(d.isNotNull(), _span(d, d + 1)))


def _window(text: Column, today: Column) -> Column:
    date = date_of(today)
    year = F.year(date)

    def ago(m: Column) -> Column:
        # a count that leads out of the calendar gives no window
        count, unit = m[0].try_cast("int").cast("long"), m[1]
        months = F.when(count <= MOST_MONTHS, day_of(F.add_months(date, -count.cast("int"))))
        return F.when(unit.isin("day", "days", "giorni", "dias"), today - count).when(unit.isin("week", "weeks", "settimane", "semanas"), today - 7 * count).otherwise(months)

    found = F.array(F.coalesce(*(_group(text, AGO, i) for i in (1, 3, 5))), F.coalesce(*(_group(text, AGO, i) for i in (2, 4, 6))))
    weekday = F.coalesce(*(F.when(text.rlike(rf"\b({name})\s+(last|scorso|pasado)\b"), F.lit(day)) for name, day in WEEKDAYS.items()))
    last = bound(weekday, lambda w: bound(F.pmod(F.weekday(date) - w, F.lit(7)), lambda back: today - F.when(back == 0, 7).otherwise(back)))
    monday, month, new_year = day_of(F.trunc(date, "week").cast("date")), F.trunc(date, "month"), F.trunc(date, "year")
    since = bound(first_date(_group(text, BOUND, 2), year), lambda d: F.when(d.isNotNull(), F.when(_group(text, BOUND, 1) == "since", _span(d, F.lit(OPEN_END))).otherwise(_span(F.lit(OPEN_START), d))))
    start = valid_day(F.coalesce(_group(text, IN_MONTH, 2), year.cast("string")), month_number(_group(text, IN_MONTH, 1)), F.lit(1))
    in_month = bound(start, lambda d: F.when(d.isNotNull(), _span(d, day_of(F.add_months(date_of(d), 1)))))
    fixed = (
        F.when(text.rlike(TODAY), _span(today, today + 1)).when(text.rlike(YESTERDAY), _span(today - 1, today)).when(text.rlike(TOMORROW), _span(today + 1, today + 2))
        .when(text.rlike(AGO), _one(bound(found, ago))).when(weekday.isNotNull(), _one(last))
        .when(text.rlike(LAST_WEEK), _span(monday - 7, monday)).when(text.rlike(THIS_WEEK), _span(monday, monday + 7))
        .when(text.rlike(LAST_MONTH), _span(day_of(F.add_months(month, -1)), day_of(month))).when(text.rlike(THIS_MONTH), _span(day_of(month), day_of(F.add_months(month, 1))))
        .when(text.rlike(LAST_YEAR), _span(day_of(F.add_months(new_year, -12)), day_of(new_year))).when(text.rlike(THIS_YEAR), _span(day_of(new_year), day_of(F.add_months(new_year, 12))))
    )
    return F.coalesce(fixed, since, in_month, _one(parse_date(_group(text, ON_DAY, 1), year)), _one(first_date(text, year)))


def in_window(created: Column, days: Column, start: Column, end: Column) -> Column:
    """Whether a row was created, or mentions a day, in a window."""
    inside = lambda d: (d >= start) & (d < end)
    return inside(utc_day(created)) | F.exists(days, inside)
