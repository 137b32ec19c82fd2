"""String, URL, hash and JSON functions: Column in, Column out, no UDFs.

Nulls give null unless a docstring says otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters and what they fold to, in the same order.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿāēīōūăąćčďđęěğłńňőřśşšťůűźżž"
PLAIN = "aaaaaaceeeeiiiinoooooouuuuyyaeiouaaccddeeglnnorssstuuzzz"


def fold_accents(value: Column) -> Column:
    """Lower case with accents taken off by a fixed table."""
    return F.translate(F.lower(value), ACCENTED, PLAIN)


def tidy(value: Column) -> Column:
    """Runs of blanks as one, none at the ends or before closing punctuation."""
    return F.trim(F.regexp_replace(F.regexp_replace(value, r"\s+", " "), r" ([,.;:)\]])", "$1"))


def fold_name(value: Column) -> Column:
    """A name's key: accents folded, punctuation as blanks, a leading "the" dropped."""
    words = F.trim(F.regexp_replace(fold_accents(value), r"[^a-z0-9]+", " "))
    return F.regexp_replace(words, r"^the ", "")


def squashed(value: Column) -> Column:
    """The folded name without blanks."""
    return F.replace(fold_name(value), F.lit(" "), F.lit(""))


def clean_surface(value: Column) -> Column:
    """A mention without bracketed notes, daggers and a label before a colon."""
    bare = F.regexp_replace(value, r"\([^)]*\)|\[[^\]]*\]|[†‡*]", " ")
    return tidy(F.regexp_replace(bare, r"^[^:]{1,40}:\s+", ""))


def strip_titles(folded: Column, titles: Sequence[str]) -> Column:
    """A folded name without its leading rank titles, however many."""
    return F.regexp_replace(folded, "^((" + "|".join(sorted(titles, key=lambda t: (-len(t), t))) + ") )+", "")


def uninvert(value: Column) -> Column:
    """"Surname, Forename" turned round; other forms stay."""
    parts = F.split(value, r"\s*,\s*")
    return F.when((F.size(parts) == 2) & (parts[0] != "") & (parts[1] != ""), F.concat_ws(" ", parts[1], parts[0])).otherwise(value)


def name_keys(value: Column, titles: Sequence[str]) -> Column:
    """Distinct keys of a name, in order: folded, without titles, without "of ...", turned round."""
    cleaned = clean_surface(value)
    folded = fold_name(cleaned)
    bare = strip_titles(folded, titles)
    keys = F.array(folded, bare, F.regexp_replace(bare, r" of .*$", ""), fold_name(uninvert(cleaned)))
    return F.array_distinct(F.filter(keys, lambda k: k != ""))


def strip_markup(value: Column) -> Column:
    """Wiki markup as plain text: comments, references, links, emphasis, flat templates and tags."""
    text = F.regexp_replace(value, r"(?s)<!--.*?-->|<ref[^>/]*/>|<ref[^>]*>.*?</ref>", " ")
    text = F.regexp_replace(text, r"\[\[(?:[^\]|]*\|)?([^\]|]*)\]\]", "$1")
    text = F.regexp_replace(text, r"\[https?://\S+\s+([^\]]*)\]", "$1")
    text = F.regexp_replace(text, r"\{\{[^{}]*\}\}|'{2,}|<[^>]+>", " ")
    return tidy(text)


def list_items(value: Column) -> Column:
    """Items of a list written with line breaks, bullets or <br>; blank ones go."""
    return F.filter(F.transform(F.split(value, r"(?i)<br\s*/?>|[\n•*]+"), lambda x: F.trim(x)), lambda x: x != "")


def parse_number(value: Column) -> Column:
    """The first number of a text as double: digits grouped by commas, and a scale word after it."""
    pattern = r"(?i)(\d+(?:,\d{3})*(?:\.\d+)?)(?:\s*(hundred|thousand|million|billion)\b)?"
    number, scale = F.regexp_extract(value, pattern, 1), F.lower(F.regexp_extract(value, pattern, 2))
    factor = F.when(scale == "hundred", 1e2).when(scale == "thousand", 1e3).when(scale == "million", 1e6).when(scale == "billion", 1e9).otherwise(1.0)
    return F.when(number != "", F.replace(number, F.lit(","), F.lit("")).try_cast("double") * factor)


def number_range(value: Column) -> Column:
    """struct(lower, upper) of "A-B", "A to B" or "between A and B"; both null otherwise."""
    pattern = r"(?i)(\d[\d,]*)\s*(?:[-–—]|to|and)\s*(\d[\d,]*)"
    low, high = (F.replace(F.regexp_extract(value, pattern, i), F.lit(","), F.lit("")).try_cast("double") for i in (1, 2))
    fine = low.isNotNull() & high.isNotNull() & (low <= high)
    return F.struct(F.when(fine, low).alias("lower"), F.when(fine, high).alias("upper"))


def keyword_class(value: Column, classes: Sequence[tuple[str, str]], default: str | None) -> Column:
    """The label of the first pattern (case ignored) that occurs; null texts and no match give ``default``."""
    out = None
    for pattern, label in classes:
        hit = F.coalesce(F.regexp_like(value, F.lit("(?i)" + pattern)), F.lit(False))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return (out if out is not None else F.when(F.lit(False), "")).otherwise(F.lit(default))


def nearest_label(value: Column, figure: Column, markers: Mapping[str, str], default: str) -> Column:
    """The label whose marker stands nearest to ``figure`` in the text.

    Bracketed notes don't count. One label found decides; none, or several with
    the figure absent or at equal distance, give ``default``.
    """
    text = F.regexp_replace(value, r"\[[^\]]*\]", "")
    at = F.call_function("locate", figure, text)
    hits = F.filter(F.array(*[F.struct(F.call_function("regexp_instr", text, F.lit("(?i)" + p)).alias("at"), F.lit(label).alias("label")) for label, p in markers.items()]), lambda h: h["at"] > 0)
    far = F.transform(hits, lambda h: F.abs(h["at"] - at))
    least = F.array_min(far)
    near = F.filter(hits, lambda h: F.abs(h["at"] - at) == least)
    one = F.element_at(hits, 1)["label"]
    return F.when(F.size(hits) == 1, one).when((F.size(hits) > 1) & (at > 0) & (F.size(near) == 1), F.element_at(near, 1)["label"]).otherwise(default)


def mention_density(value: Column, pattern: str) -> Column:
    """Matches for every 1,000 characters; 0 for empty texts."""
    return F.coalesce(F.try_divide(1000.0 * F.regexp_count(value, F.lit(pattern)), F.length(value)), F.when(value.isNotNull(), 0.0))


def url_host(url: Column) -> Column:
    """Host of a URL in lower case, null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return F.nullif(host, F.lit(""))


def host_allowed(host: Column, domains: Sequence[str]) -> Column:
    """Whether a host is one of ``domains`` or below one; null hosts aren't."""
    fits = [(host == d) | F.endswith(host, F.lit("." + d)) for d in domains]
    out = F.lit(False)
    for f in fits:
        out = out | f
    return F.coalesce(out, F.lit(False))


def normalise_url(href: Column, base: Column) -> Column:
    """A link resolved against its page's URL: absolute, protocol-relative, rooted or relative; fragments go, mail and script links give null."""
    link = F.regexp_replace(F.trim(href), "#.*$", "")
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?<=[^/])/[^/]*$", "")
    return (
        F.when((link == "") | F.regexp_like(link, F.lit(r"^(?i)(mailto|javascript|data|tel):")), F.lit(None).cast("string"))
        .when(F.regexp_like(link, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://")), link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, link))
        .when(F.startswith(link, F.lit("/")), F.concat(root, link))
        .otherwise(F.concat(folder, F.lit("/"), link))
    )


def title_from_url(url: Column) -> Column:
    """The last path segment, decoded, underscores as blanks."""
    return F.replace(F.try_url_decode(F.regexp_extract(url, r"([^/?#]*)(?:[?#].*)?$", 1)), F.lit("_"), F.lit(" "))


def short_id(value: Column, length: int = 10) -> Column:
    """The beginning of a SHA-256 as a short stable id."""
    return F.substring(F.sha2(value, 256), 1, length)


def safe_filename(url: Column, suffix: str) -> Column:
    """A file name from a URL: its title with other than word characters as "_", and a digest against clashes."""
    return F.concat(F.regexp_replace(F.substring(title_from_url(url), 1, 80), r"[^A-Za-z0-9]+", "_"), F.lit("-"), short_id(url), F.lit(suffix))


def request_hash(**fields: Column) -> Column:
    """SHA-256 over JSON with sorted names: equal requests have equal hashes whatever the order of their fields."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def json_number(value: Column, path: str, missing: float | None = None) -> Column:
    """The number at a JSON path, ``missing`` where there is none."""
    found = F.get_json_object(value, path).try_cast("double")
    return found if missing is None else F.coalesce(found, F.lit(missing))


def json_key_count(value: Column) -> Column:
    """Number of keys of a JSON object; 0 for anything else."""
    return F.coalesce(F.size(F.json_object_keys(value)), F.lit(0))


def first_token(value: Column) -> Column:
    return F.element_at(F.split(value, " "), 1)


def last_token(value: Column) -> Column:
    return F.element_at(F.split(value, " "), -1)


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """100 for equal strings, down to 0: a similarity on the scale of a fuzzy score (two empty strings: 100)."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.coalesce(100.0 * F.try_divide(longest - F.levenshtein(a, b), longest), F.when(a.isNotNull() & b.isNotNull(), 100.0))


def coalesce_label(*values: Column, default: str) -> Column:
    """The first label that isn't blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values], F.lit(default))
