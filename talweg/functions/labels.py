"""What names, titles and contexts of figures say."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from talweg.functions.common import named
from talweg.functions.text import fold_name

#: Beginnings of an engagement's name that don't tell it from others, and the words that number one.
GENERIC = (
    "battle of the", "battle of", "battles of", "siege of the", "siege of", "capture of", "storming of", "assault on", "action of", "action at", "combat of", "raid on",
)
ORDINALS = ("first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "1st", "2nd", "3rd", "4th", "5th")
#: What a title begins with that isn't an engagement's, and what it holds that is.
NAMESPACES = (
    "file", "image", "category", "template", "help", "portal", "wikipedia", "special", "talk", "user", "draft", "module", "mediawiki", "book", "wikt", "s", "commons",
)
INDEXES = ("list of", "lists of", "timeline of", "timelines of", "outline of", "index of", "chronology of", "category of", "bibliography of", "order of battle")
ENGAGEMENTS = (
    "battles?", "sieges?", "blockade", "bombardment", "raid", "raids", "skirmish", "ambush", "massacre", "mutiny", r"naval\s+action", r"action\s+of", r"assault\s+on",
    r"attack\s+on", r"capture\s+of", r"sack\s+of", r"storming\s+of", r"relief\s+of", r"fall\s+of", r"defen[cs]e\s+of", r"landing\s+at", "operation", "engagement",
)
#: What a figure counts that isn't people, words that may not stand between the two, and people that such a word may describe.
THINGS = (
    "ships?", "boats?", "vessels?", "galleys?", "galleons?", "warships?", "battleships?", "ironclads?", "timberclads?", "junks?", "transports?", "submarines?", "panokseons?",
    "aircraft", "planes?", "helicopters?", "tanks?", "tankettes?", "stug'?s?", "assault guns?", "apcs?", "trucks?", "guns?", "cannons?", "artillery pieces?", "batteries",
    "elephants?", "horses?", "mortars?", "camels?", "luftflotte",
)
BETWEEN = (
    "men|soldiers|troops|infantry|cavalry|personnel|marines|archers|warriors|crews?|crewmen|sailors|seamen|rowers|oarsmen|on|in|aboard|of|and|with|from|for"
)
PEOPLE = "crews?|crewmen|sailors|seamen|marines|men|personnel|soldiers|troops|infantry|gunners|rowers|oarsmen"
MONTHS = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"

_FIGURE = r"\d+(?:,\d{3})*(?:\.\d+)?"
_DASH = r"[-‐-―−]"


def _numbers(found: Column) -> Column:
    return F.transform(F.filter(found, lambda x: x != ""), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double"))


def core_name(name: Column) -> Column:
    """A folded engagement name without a generic beginning; the whole one where nothing would be left."""
    folded = fold_name(name)
    rest = F.trim(F.regexp_replace(folded, "^(?:" + "|".join(GENERIC) + ") ", ""))
    return F.when(rest != "", rest).otherwise(folded)


def ordinal(name: Column) -> Column:
    """The first word that numbers an engagement; null where there is none."""
    return F.get(F.filter(F.split(fold_name(name), " "), lambda w: w.isin(*ORDINALS)), F.lit(0))


def polity_key(identifier: Column, label: Column) -> Column:
    """The trimmed identifier, else the trimmed label, else "unknown"."""
    own = lambda c: F.nullif(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(""))
    return F.coalesce(own(identifier), own(label), F.lit("unknown"))


def categories(source: Column) -> Column:
    """Distinct category names of wikitext and of rendered pages, in order of appearance, wikitext's first."""
    wiki = F.regexp_extract_all(source, F.lit(r"(?i)\[\[\s*Category\s*:\s*([^\]|]+)"), F.lit(1))
    page = F.regexp_extract_all(source, F.lit(r'(?i)href="/wiki/Category:([^"#?]+)'), F.lit(1))
    # a plus sign is itself in a path
    told = F.transform(page, lambda x: F.replace(F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x), F.lit("_"), F.lit(" ")))
    return F.array_distinct(F.filter(F.transform(F.concat(wiki, told), lambda x: F.trim(x)), lambda x: x != ""))


def is_engagement_title(title: Column) -> Column:
    """Whether a title names one engagement: no namespace, no index page, and a word for an engagement; null and blank don't."""
    text = F.lower(F.trim(title))
    is_other = F.regexp_like(text, F.lit(rf"^\s*(?:{'|'.join(NAMESPACES)})\s*:")) | F.regexp_like(text, F.lit(f"^(?:{'|'.join(INDEXES)})"))
    return F.coalesce(~is_other & F.regexp_like(text, F.lit(rf"\b(?:{'|'.join(ENGAGEMENTS)})\b")), F.lit(False))


def date_label_numbers(context: Column) -> Column:
    """Day, second day and year of a context that is a date label ("16-17 October 1813:"); null for any other context."""
    pattern = rf"(?i)^\W*(?:(?:on|as of|by|from|at)\s+)?(\d{{1,2}})(?:\s*{_DASH}\s*(\d{{1,2}}))?\s+(?:{MONTHS})\.?(?:\s+(\d{{4}}))?\s*:\s*$"
    return F.when(F.regexp_like(context, F.lit(pattern)), _numbers(F.array(*[F.regexp_extract(context, pattern, i) for i in (1, 2, 3)])))


def is_stated_total(context: Column) -> Column:
    """Whether a context begins with the word "total"."""
    return F.coalesce(F.regexp_like(context, F.lit(r"(?i)^\W*total\b")), F.lit(False))


def counts_things(value: Column, context: Column) -> Column:
    """Whether a value stands in its context, with two words between at most, before a word for things that doesn't describe people."""
    gap = rf"(?:(?!(?:{BETWEEN})\b)[^\W\d][\w'-]*\s+){{0,2}}"
    pattern = rf"(?i)({_FIGURE})(?:\s*(?:{_DASH}|to)\s*({_FIGURE}))?\s*{gap}(?:{'|'.join(THINGS)})\b(?!(?:'s)?\s+(?:{PEOPLE})\b)"
    fleet = rf"(?i)\bluftflotte\s*({_FIGURE})"
    found = F.concat(*[F.regexp_extract_all(context, F.lit(p), F.lit(i)) for p, i in ((pattern, 1), (pattern, 2), (fleet, 1))])
    return F.coalesce(F.exists(_numbers(found), lambda x: x == value), F.lit(False))


def is_bracketed_part(value: Column, context: Column) -> Column:
    """Whether a value stands in brackets only, and a larger figure outside them."""
    figures = lambda text: _numbers(F.regexp_extract_all(text, F.lit(_FIGURE), F.lit(0)))
    inside = figures(F.array_join(F.regexp_extract_all(context, F.lit(r"\([^()]*\)"), F.lit(0)), " "))
    outside = figures(F.regexp_replace(context, r"\([^()]*\)", " "))
    told = named(outside, lambda o: F.exists(inside, lambda x: x == value) & ~F.exists(o, lambda x: x == value) & F.exists(o, lambda x: x > value))
    return F.coalesce(told, F.lit(False))


def first_match(value: Column, year: Column, rules: Sequence[tuple[str, int, int, str]]) -> Column:
    """The reason of the first rule (whole-value pattern, first and last year, reason) that a label and a year meet; null otherwise."""
    text = F.regexp_replace(F.lower(F.trim(value)), r"\s+", " ")
    out = F.when(F.lit(False), F.lit(""))
    for pattern, first, last, reason in rules:
        out = out.when(F.regexp_like(text, F.lit(f"^(?:{pattern})$")) & year.between(first, last), reason)
    return out
