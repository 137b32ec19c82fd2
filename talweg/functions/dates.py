"""Free-text dates: literals with an era, a precision and whether they are approximate.

A literal is ``YYYY-MM-DD`` with `` BC`` before year 1; there is no year 0.
Texts that can't be read in full give null rather than a guess.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talweg.functions.common import named

#: Words of a date text.
MONTHS = ("jan|january", "feb|february", "mar|march", "apr|april", "may", "jun|june", "jul|july", "aug|august", "sep|sept|september", "oct|october", "nov|november", "dec|december")
SEASONS, QUALIFIERS, ABOUT, FILLER = "spring|summer|autumn|fall|winter", "early|mid|late", "c|ca|circa|about", "or|of|the"
PRECISIONS = ("day", "month", "year", "decade", "century")

_ISO = r"(\d{4})-(\d{2})-(\d{2})(\s+BC)?"
_ERA = r"(?i)\b(B\.?\s?C\.?(?:\s?E\.?)?|A\.?\s?D\.?|C\.?\s?E\.?)(?![A-Za-z])"


def astronomical(year: Column, bc: Column) -> Column:
    """1 BC is 0, 2 BC is -1; null without a year."""
    return F.when(bc, 1 - year).otherwise(year)


def days_in_month(year: Column, month: Column, bc: Column) -> Column:
    """Length of a month in the proleptic Gregorian calendar; null for no such month."""
    like = (2000 + F.pmod(astronomical(year, bc), F.lit(400))).cast("int")  # leap years repeat after 400 years
    return F.when(month.between(1, 12), F.day(F.last_day(F.try_make_timestamp(like, F.greatest(F.least(month, F.lit(12)), F.lit(1)).cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0.0)).cast("date"))))


def _fits(year: Column, month: Column, day: Column, bc: Column) -> Column:
    return F.coalesce(year.between(1, 9999) & month.between(1, 12) & (day >= 1) & (day <= days_in_month(year, month, bc)), F.lit(False))


def literal(year: Column, month: Column, day: Column, bc: Column) -> Column:
    """``YYYY-MM-DD`` and `` BC`` where ``bc`` holds."""
    return F.concat(F.format_string("%04d-%02d-%02d", year, month, day), F.when(bc, " BC").otherwise(""))


def year_literal(year: Column) -> Column:
    """1 January of an astronomical year (0 is 1 BC) as a literal; null stays null."""
    return F.when(year.isNotNull(), literal(F.when(year >= 1, year).otherwise(1 - year), F.lit(1), F.lit(1), year < 1))


def _date(start: Column, end: Column, precision: Column, about: Column) -> Column:
    return F.named_struct(F.lit("date_start"), start, F.lit("date_end"), end, F.lit("precision"), precision, F.lit("circa"), about)


def _absent(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def _iso(value: Column) -> Column:
    """One or two literals; null for any other text and for days that don't exist."""
    pattern = rf"(?i)^{_ISO}(?:\s*-\s*{_ISO})?$"
    get = lambda i: F.regexp_extract(F.trim(value), pattern, i)

    def one(at: int) -> Column:
        year, month, day, bc = get(at).try_cast("int"), get(at + 1).try_cast("int"), get(at + 2).try_cast("int"), get(at + 3) != ""
        return F.when(_fits(year, month, day, bc), literal(year, month, day, bc))

    whole = F.regexp_like(F.trim(value), F.lit(pattern)) & one(1).isNotNull() & ((get(5) == "") | one(5).isNotNull())
    return F.when(whole, _date(one(1), F.when(get(5) != "", one(5)), F.lit("day"), F.lit(False)))


def _clean(value: Column) -> Column:
    """Without bracketed asides and what follows the first line; dashes alike, "12 and 13" as "12-13"."""
    out = F.regexp_replace(F.replace(value, F.lit(" "), F.lit(" ")), r"\([^)]*\)|\[[^\]]*\]", " ")
    out = F.regexp_extract(F.regexp_replace(out, r"^\s+", ""), r"^([^;\n]*)", 1)
    out = F.regexp_replace(out, r"[‐-―−�]", "-")
    out = F.regexp_replace(out, r"(?i)\b(\d{1,2})\s*(?:/|\band\b|\bor\b)\s*(\d{1,2})\b", "$1-$2")
    return F.regexp_replace(F.regexp_replace(out, r"\s+", " "), r"^[ ,;.]+|[ ,;.]+$", "")


def _tokens(text: Column) -> Column:
    """Words, numbers and marks as kinds: M05 a month, D1250 a decade, 12 a number, - a span, s a season, c an estimate, ? an unknown word; others go."""

    def kind(token: Column) -> Column:
        word = F.regexp_replace(F.lower(token), r"\.+$", "")
        is_one: object = lambda words: F.regexp_like(word, F.lit(f"^(?:{words})$"))
        out = F.when(F.regexp_like(token, F.lit(r"(?i)^\d{3,4}s$")), F.concat(F.lit("D"), F.regexp_extract(token, r"^(\d+)", 1)))
        out = out.when(is_one(SEASONS), "s").when(is_one(ABOUT), "c").when(is_one("to|-"), "-")
        out = out.when(is_one(QUALIFIERS) | is_one(FILLER) | F.regexp_like(token, F.lit("^[,/]$")), "")
        for i, names in enumerate(MONTHS):
            out = out.when(is_one(names), f"M{i + 1:02d}")
        return out.when(F.regexp_like(token, F.lit(r"^\d")), F.regexp_extract(token, r"^(\d+)", 1)).otherwise("?")

    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z]+\.?|\d+(?:st|nd|rd|th|s)?|[,/-]"), F.lit(0)), kind), lambda k: k != "")


def _part(piece: Column, bare_is_day: Column) -> Column:
    """struct(year, month, day) of one side of a span, null where it can't be read."""
    words = F.filter(F.split(piece, " "), lambda w: w != "")
    months = F.filter(words, lambda w: F.startswith(w, F.lit("M")))
    numbers = F.transform(F.filter(words, lambda w: ~F.startswith(w, F.lit("M"))), lambda w: w.try_cast("int"))
    month = F.substring(F.get(months, F.lit(0)), 2, 2).cast("int")
    one, two, n = F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1)), F.size(numbers)
    part = lambda y, m, d: F.named_struct(F.lit("year"), y.cast("int"), F.lit("month"), m.cast("int"), F.lit("day"), d.cast("int"))
    none = F.lit(None)
    readable = (F.size(months) <= 1) & (n <= 2) & ((n > 0) | (F.size(months) > 0)) & ~F.exists(numbers, lambda x: x.isNull())
    pair = month.isNotNull() & (one <= 31) & (two != 0)
    return F.when(
        readable,
        F.when(n == 0, part(none, month, none)).when(n == 2, F.when(pair, part(two, month, one))).when((one > 31) | (month.isNull() & ~bare_is_day), part(one, month, none)).otherwise(part(none, month, one)),
    )


def _single(p: Column, bc: Column, vague: Column, about: Column) -> Column:
    year_alone = vague | about | p["month"].isNull()
    one = F.lit(1)
    return (
        F.when(p.isNull() | p["year"].isNull() | ~p["year"].between(1, 9999), _absent("struct<date_start:string,date_end:string,precision:string,circa:boolean>"))
        .when(year_alone, _date(literal(p["year"], one, one, bc), _absent(), F.lit("year"), about))
        .when(p["day"].isNull(), _date(literal(p["year"], p["month"], one, bc), _absent(), F.lit("month"), about))
        .when(_fits(p["year"], p["month"], p["day"], bc), _date(literal(p["year"], p["month"], p["day"], bc), _absent(), F.lit("day"), about))
    )


def _span(a: Column, b: Column, bc: Column, about: Column) -> Column:
    """From the first day of ``a`` to the last day of ``b``; each takes from the other the year, and a day the month, that it leaves out."""
    year_a, year_b = F.coalesce(a["year"], b["year"]), F.coalesce(b["year"], a["year"])
    month_a = F.coalesce(a["month"], F.when(a["day"].isNotNull(), b["month"]))
    month_b = F.coalesce(b["month"], month_a)
    first_month, last_month = F.coalesce(month_a, F.lit(1)), F.coalesce(month_b, F.lit(12))
    first_day, last_day = F.coalesce(a["day"], F.lit(1)), F.coalesce(b["day"], days_in_month(year_b, last_month, bc))
    fine = _fits(year_a, first_month, first_day, bc) & _fits(year_b, last_month, last_day, bc)
    grade = lambda day, month: F.when(day.isNotNull(), 2).when(month.isNotNull(), 1).otherwise(0)
    least = F.least(grade(a["day"], month_a), grade(b["day"], month_b))
    precision = F.when(least == 2, "day").when(least == 1, "month").otherwise("year")
    return F.when(a.isNotNull() & b.isNotNull() & fine, _date(literal(year_a, first_month, first_day, bc), literal(year_b, last_month, last_day, bc), precision, about))


def parse_date(value: Column) -> Column:
    """struct(date_start, date_end, precision, circa) of a date text; null where it can't be read in full.

    Reads literals, "21 May 1809", "May 5-7, 1864", "3 June - 2 July 1500",
    "Spring 208 BC", "c. 1200 BC", "late 1250s", "1805 or 1806" and the like.
    Null and blank texts give null.
    """
    iso = _iso(value)
    ordinal = F.regexp_extract(value, r"(?i)\d+(?:st|nd|rd|th)\s+day,?\s+\d+(?:st|nd|rd|th)\s+month\s+of\s+(\d{1,4})\b", 1)

    def body(text: Column) -> Column:
        eras = F.transform(F.regexp_extract_all(text, F.lit(_ERA), F.lit(1)), lambda e: F.startswith(F.upper(e), F.lit("B")))
        bc = F.coalesce(F.get(eras, F.lit(0)), F.lit(False))
        clash = F.exists(eras, lambda e: e) & F.exists(eras, lambda e: ~e)
        return named(_tokens(F.regexp_replace(text, _ERA, " ")), lambda tokens: F.when(~clash & ~F.array_contains(tokens, "?"), read(tokens, bc)))

    def read(tokens: Column, bc: Column) -> Column:
        vague, about = F.array_contains(tokens, "s"), F.array_contains(tokens, "c")
        kept = F.array_join(F.filter(tokens, lambda k: ~k.isin("s", "c")), " ")
        decade = F.regexp_extract(kept, r"^D(\d+)$", 1).try_cast("int")
        low, high = (F.regexp_extract(kept, r"^(\d{3,4}) (\d{3,4})$", i).try_cast("int") for i in (1, 2))
        year = F.when(bc, F.greatest(low, high)).otherwise(F.least(low, high))
        one = F.lit(1)
        # "M05 5 - 7 1864": the second number of the end is a year, the first a day of the named month
        turned = F.regexp_replace(kept, r"^(M\d\d) (\d{1,2}) - (\d{1,2}) (\d+)$", "$2 - $3 $1 $4")
        pieces = F.filter(F.transform(F.split(turned, " ?- ?"), lambda p: F.trim(p)), lambda p: p != "")
        last = _part(F.element_at(pieces, -1), F.lit(False))

        def span(b: Column) -> Column:
            return named(_part(F.get(pieces, F.lit(0)), F.coalesce(b["month"].isNotNull() & b["year"].isNotNull(), F.lit(False))), lambda a: _span(a, b, bc, about))

        return (
            F.when(F.regexp_like(kept, F.lit("D")), F.when(~vague & decade.between(1, 9999) & (decade % 10 == 0), _date(literal(decade, one, one, bc), _absent(), F.lit("decade"), F.lit(True))))
            .when(year.isNotNull(), F.when(year.between(1, 9999), _date(literal(year, one, one, bc), _absent(), F.lit("year"), F.lit(True))))
            .when(F.size(pieces) == 1, named(last, lambda p: _single(p, bc, vague, about)))
            .when(F.size(pieces) == 2, named(last, span))
        )

    counted = F.when(ordinal.try_cast("int") >= 1, _date(literal(ordinal.try_cast("int"), F.lit(1), F.lit(1), F.lit(False)), _absent(), F.lit("year"), F.lit(False)))
    return F.when(iso.isNotNull(), iso).when(ordinal != "", counted).otherwise(named(_clean(value), body))


def safe_dates(start: Column, end: Column, precision: Column) -> Column:
    """struct(date_start, date_end, precision) that a store can take: literals as they are, other texts parsed, all null where the start can't be read.

    The end is the start text's own, else the end text's last day. A literal's
    given precision stands; a parsed text has its own.
    """

    def told(first: Column) -> Column:
        last = named(parse_date(end), lambda e: F.coalesce(e["date_end"], e["date_start"]))
        keep = F.coalesce(_iso(start).isNotNull() & precision.isin(*PRECISIONS), F.lit(False))
        fields = F.named_struct(F.lit("date_start"), first["date_start"], F.lit("date_end"), F.coalesce(first["date_end"], last), F.lit("precision"), F.when(keep, precision).otherwise(first["precision"]))
        return F.when(first.isNotNull(), fields).otherwise(F.named_struct(*[x for n in ("date_start", "date_end", "precision") for x in (F.lit(n), _absent())]))

    return named(parse_date(start), told)
