"""Table functions for nested text: infoboxes, quantities and passages.

These need a parser's state, which SQL expressions don't have; they work on
Arrow batches of whole articles, one article at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_NUMBER = r"\d{1,3}(?:,\d{3})+|\d+(?:\.\d+)?"
_SCALE = {"hundred": 1e2, "thousand": 1e3, "million": 1e6}
#: Words that tell what a figure counts and how surely.
SCOPES = (("casualt|killed|wounded|dead|losses", "casualties"), ("garrison", "garrison"), ("reserve", "reserve"), ("population|inhabitants|civilians", "population"))
BRANCHES = (("infantry|foot", "infantry"), ("cavalry|horse", "cavalry"), ("artillery|guns|cannons?", "artillery"), ("ships?|vessels?|galleys?", "naval"), ("aircraft|planes?", "air"))
_AROUND = re.compile(r"(?i)\b(about|around|circa|ca?\.|approximately|est\.?|estimated|some|over|up to|at least)\s*$")


def template_fields(text: str) -> dict[str, str]:
    """Fields of the first infobox template of a text: balanced braces, links and nested templates stay within their field."""
    start = re.search(r"\{\{\s*infobox", text, re.IGNORECASE)
    if not start:
        return {}
    depth, links, parts, last, i = 0, 0, [], start.end(), start.start()
    while i < len(text):
        two = text[i : i + 2]
        if two == "{{":
            depth, i = depth + 1, i + 2
        elif two == "}}":
            depth, i = depth - 1, i + 2
            if depth == 0:
                parts.append(text[last : i - 2])
                break
        elif two == "[[":
            links, i = links + 1, i + 2
        elif two == "]]":
            links, i = max(0, links - 1), i + 2
        else:
            if text[i] == "|" and depth == 1 and not links:
                parts.append(text[last:i])
                last = i + 1
            i += 1
    out = {}
    for part in parts[1:]:
        name, sign, value = part.partition("=")
        if sign and value.strip():
            out[name.strip().lower()] = value.strip()
    return out


def quantities(text: str) -> list[tuple[float, bool, bool, bool, str, str]]:
    """(value, lower, upper, estimate, scope, branch) of the counts in a text.

    "A-B" and "A to B" give a lower and an upper bound; "at least" and "over" a
    lower, "up to" an upper one. Years in brackets and ordinals aren't counts.
    """
    bare = re.sub(r"\[[^\]]*\]|\(\d{3,4}(?:\s*[-–]\s*\d{2,4})?\)", " ", text)
    found = []
    number = re.compile(rf"(?<![\w.,])({_NUMBER})(?!\d*(?:st|nd|rd|th)\b)(?:\s*(hundred|thousand|million)\b)?", re.IGNORECASE)
    at = 0
    while m := number.search(bare, at):
        at = m.end()
        value = float(m[1].replace(",", "")) * _SCALE.get((m[2] or "").lower(), 1)
        before, after = bare[max(0, m.start() - 20) : m.start()], bare[m.end() : m.end() + 40]
        around = _AROUND.search(before)
        word = around[1].lower() if around else ""
        context = bare[max(0, m.start() - 30) : m.end() + 40].lower()
        scope = next((label for p, label in SCOPES if re.search(rf"\b({p})", context)), "total")
        branch = next((label for p, label in BRANCHES if re.search(rf"\b({p})\b", after.lower().split(",")[0].split(";")[0])), "total")
        rest = re.match(rf"\s*(?:[-–—]|to)\s*({_NUMBER})(?:\s*(hundred|thousand|million)\b)?", after, re.IGNORECASE)
        if rest:
            top = float(rest[1].replace(",", "")) * _SCALE.get((rest[2] or "").lower(), 1)
            if rest[2] and not m[2]:
                value *= _SCALE[rest[2].lower()]
            if top >= value:
                tail = after[rest.end() :].lower()
                branch = next((label for p, label in BRANCHES if re.search(rf"\b({p})\b", tail.split(",")[0].split(";")[0])), "total")
                found += [(value, True, False, True, scope, branch), (top, False, True, True, scope, branch)]
                at = m.end() + rest.end()
                continue
        found.append((value, word in ("over", "at least"), word == "up to", bool(word), scope, branch))
    return found


def infobox_fields(articles: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, name, value): a row per infobox field of each article."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, k, v) for i, t in zip(batch["id"], batch["text"], strict=True) if t for k, v in template_fields(t).items()]
            yield pd.DataFrame(rows, columns=["id", "name", "value"])

    base = articles.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    return base.mapInPandas(parse, f"id {base.schema['id'].dataType.simpleString()}, name string, value string")


def text_quantities(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, value, is_lower, is_upper, is_estimate, scope, branch): a row per count in each text."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, *q) for i, t in zip(batch["id"], batch["text"], strict=True) if t for q in quantities(t)]
            yield pd.DataFrame(rows, columns=["id", "value", "is_lower", "is_upper", "is_estimate", "scope", "branch"])

    base = texts.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    return base.mapInPandas(parse, f"id {base.schema['id'].dataType.simpleString()}, value double, is_lower boolean, is_upper boolean, is_estimate boolean, scope string, branch string")


def passages(articles: DataFrame, id_col: str, text_col: str, most: int, least: int) -> DataFrame:
    """(id, place, section, text): articles cut at headings and packed to at most ``most`` characters, shorter than ``least`` dropped."""

    def cut(text: str) -> Iterator[tuple[str, str]]:
        parts = re.split(r"(?m)^==+\s*(.*?)\s*==+\s*$", text)
        for title, body in zip(["", *parts[1::2]], parts[::2], strict=True):
            held = ""
            for p in (x.strip() for x in re.split(r"\n\s*\n", body)):
                if held and len(held) + 2 + len(p) > most:
                    yield title, held
                    held = ""
                held = f"{held}\n\n{p}" if held and p else held or p
                while len(held) > most:
                    yield title, held[:most]
                    held = held[most:]
            if held:
                yield title, held

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, n, s, p) for i, t in zip(batch["id"], batch["text"], strict=True) if t for n, (s, p) in enumerate((s, p) for s, p in cut(t) if len(p) >= least)]
            yield pd.DataFrame(rows, columns=["id", "place", "section", "text"])

    base = articles.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    return base.mapInPandas(parse, f"id {base.schema['id'].dataType.simpleString()}, place int, section string, text string")
