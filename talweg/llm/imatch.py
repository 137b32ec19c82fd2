"""I-Match document fingerprints, in DataFrame functions alone.

Terms whose inverse document frequency lies in a band make up the lexicon. A
fingerprint hashes a document's sorted distinct lexicon terms, once for the
whole lexicon and once for each of several randomised subsets of it: ``SLOTS``
disjoint subsets at each of ``LEVELS`` rates, every level four times sparser
than the one before, so that short and long documents alike have subsets with a
term or two, which survive an edit elsewhere in the text.

Terms are counted in 2**20 hash buckets, so the lexicon is a bitmap of fixed size.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BITS = 20
LEVELS, SLOTS, FIRST_RATE = 6, 8, 16
#: What separates terms once a text is lower-cased: ASCII other than letters and digits.
GAP = r"[\x00-/:-`{-\x7F]+"


def terms(text: Column) -> Column:
    """Distinct term numbers of a text, -1 standing for nothing between two gaps."""
    return F.array_distinct(F.transform(F.split(F.lower(text), GAP), lambda w: F.when(w == "", F.lit(-1)).otherwise(F.xxhash64(w).bitwiseAND((1 << BITS) - 1).cast("int"))))


def lexicon(docs: DataFrame, text_col: str, idf_low: float, least_df: int) -> list[int]:
    """Bitmap (longs) of the term numbers in the band: idf of ``idf_low`` at least, in ``least_df`` documents at least."""
    counted = docs.select(F.explode(terms(F.col(text_col))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    most = docs.count() / math.exp(idf_low)
    inside = counted.filter((F.col("term") >= 0) & (F.col("df") >= least_df) & (F.col("df") <= most))
    found = inside.groupBy(F.shiftright("term", 6).alias("cell")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("term").bitwiseAND(63))).alias("bits"))
    cells = [0] * (1 << (BITS - 6))
    for r in found.collect():  # 2**14 rows at most
        cells[r["cell"]] = r["bits"]
    return cells


def slots(text: Column, cells: list[int]) -> Column:
    """The fingerprint's parts as an array: the whole lexicon's hash, then one for each subset, '' where a subset has no term.

    A text without lexicon terms has its own hash as the first part.
    """
    bitmap = F.lit(cells)
    kept = F.filter(terms(text), lambda t: (t >= 0) & (F.call_function("shiftrightunsigned", F.element_at(bitmap, F.shiftright(t, 6) + 1), t.bitwiseAND(63)).bitwiseAND(1) == 1))
    hashed: Callable[[Column], Column] = lambda x: F.lower(F.lpad(F.hex(F.xxhash64(x).bitwiseAND(0xFFFFFFFF)), 8, "0"))
    one: Callable[[Column, Callable], Column] = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)  # noqa: E731  gives a value a name

    def subsets(found: Column) -> Column:
        # a term's level and slot come from a second hash: level l has a share of SLOTS / (FIRST_RATE * 4**l)
        def drawn(t: Column) -> Column:
            u = F.xxhash64(t, F.lit("subset")).bitwiseAND((1 << 30) - 1)
            low, level, slot = 0, F.lit(-1), F.lit(0)
            for k in range(LEVELS):
                width = (1 << 30) // (FIRST_RATE * 4**k)
                level = F.when((u >= low) & (u < low + SLOTS * width), F.lit(k)).otherwise(level)
                slot = F.when((u >= low) & (u < low + SLOTS * width), ((u - low) / width).cast("int")).otherwise(slot)
                low += SLOTS * width
            return F.named_struct(F.lit("level"), level, F.lit("slot"), slot, F.lit("term"), t)

        def of_level(k: int, all_drawn: Column) -> Column:
            return one(
                F.filter(all_drawn, lambda d: d["level"] == k),
                lambda some: F.transform(
                    F.sequence(F.lit(0), F.lit(SLOTS - 1)),
                    lambda s: one(F.transform(F.filter(some, lambda d: d["slot"] == s), lambda d: d["term"]), lambda x: F.when(F.size(x) > 0, hashed(x)).otherwise("")),
                ),
            )

        return one(F.filter(F.transform(found, drawn), lambda d: d["level"] >= 0), lambda all_drawn: F.concat(*[of_level(k, all_drawn) for k in range(LEVELS)]))

    return one(F.array_sort(kept), lambda found: F.concat(F.array(F.when(F.size(found) > 0, hashed(found)).otherwise(F.concat(F.lit("t"), F.substring(F.sha2(text, 256), 1, 16)))), subsets(found)))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal parts among those where either fingerprint has one."""
    pairs = F.filter(F.zip_with(a, b, lambda x, y: F.named_struct(F.lit("a"), x, F.lit("b"), y)), lambda p: (p["a"] != "") | (p["b"] != ""))
    return F.size(F.filter(pairs, lambda p: p["a"] == p["b"])) / F.size(pairs)


def in_buckets(docs: DataFrame, id_col: str, rows_per_bucket: int, most_buckets: int) -> tuple[DataFrame, list[int]]:
    """``docs`` with ``bucket``, which rises with the id over ranges of about equal row counts, and the occupied buckets."""
    n = docs.count()
    count = max(1, min(most_buckets, n // rows_per_bucket))
    bounds = sorted({int(b) for b in docs.approxQuantile(id_col, [i / count for i in range(1, count)], 0.2 / count)}) if count > 1 else []
    if not bounds:
        return docs.withColumn("bucket", F.lit(0)), [0] if n else []
    step = math.isqrt(len(bounds)) + 1  # two short searches rather than one long one
    tops, groups = bounds[::step], [bounds[i : i + step] for i in range(0, len(bounds), step)]
    top = F.size(F.filter(F.lit(tops), lambda b: b < F.col(id_col)))
    groups_col = F.array(*[F.lit(g) for g in groups])
    within = F.size(F.filter(F.element_at(groups_col, F.greatest(top, F.lit(1))), lambda b: b < F.col(id_col)))
    placed = docs.withColumn("bucket", F.when(top == 0, F.lit(0)).otherwise((top - 1) * step + within))
    return placed, sorted(r["bucket"] for r in placed.select("bucket").distinct().collect())  # most_buckets rows at most


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", idf_low: float = 1.5, least_df: int = 2, rows_per_bucket: int = 500, most_buckets: int = 50_000) -> DataFrame:
    """One row per row of ``docs``: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 2) code points
    replaced by the first as many (or all) of the next document's, in
    descending id order (null ids last, equal ids by descending text), the last
    one's next being the first. ``near_edited`` and ``near_next``: likeness of
    the fingerprint to that of the edited text and of the next document. Null
    texts are empty texts; repeated rows get a row each; a single row follows
    itself; an empty table gives no rows; other columns are not looked at.

    Texts move once, to buckets of neighbouring ids, along with the one document
    that follows each bucket, so that no order over all rows is needed.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cells = lexicon(base, "text", idf_low, least_df)
    keyed = base.withColumn("key", F.coalesce("id", F.lit(-(1 << 63))))
    placed, occupied = in_buckets(keyed, "key", rows_per_bucket, most_buckets)
    if not occupied:
        return base.select("id", *[F.lit(None).cast(t).alias(c) for c, t in (("n_chars", "long"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double"))])
    heads = {r["bucket"]: r["head"] for r in placed.groupBy("bucket").agg(F.max("key").alias("head")).collect()}  # one row per bucket
    # the row that follows a bucket's last (lowest) id heads the next lower bucket; the topmost head follows the lowest bucket
    follows = {b: occupied[i + 1] if i + 1 < len(occupied) else occupied[0] for i, b in enumerate(occupied)}
    size = max(occupied) + 1
    at = F.col("bucket") + 1
    is_head = F.element_at(F.lit([heads.get(b, 0) for b in range(size)]), at) == F.col("key")
    also = F.element_at(F.lit([follows.get(b, 0) for b in range(size)]), at)
    here = F.struct(F.col("bucket").cast("int").alias("part"), F.lit(False).alias("extra"))
    there = F.struct(also.cast("int").alias("part"), F.lit(True).alias("extra"))
    rows = placed.select("id", "key", "text", slots(F.col("text"), cells).alias("print"), F.explode(F.when(is_head, F.array(here, there)).otherwise(F.array(here))).alias("to"))
    rows = rows.select("id", "key", "text", "print", F.col("to.part").alias("part"), F.col("to.extra").alias("extra"))
    along = Window.partitionBy("part").orderBy("extra", F.desc("key"), F.desc("text"))
    paired = rows.select("*", F.lead("text").over(along).alias("next_text"), F.lead("print").over(along).alias("next_print")).filter("not extra")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = paired.select("id", n.cast("long").alias("n_chars"), "print", "next_print", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)).alias("edited"))
    edited = edited.select("*", slots(F.col("edited"), cells).alias("edited_print"))
    return edited.select(
        "id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.array_join("print", "-").alias("fingerprint"),
        F.array_join("edited_print", "-").alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
