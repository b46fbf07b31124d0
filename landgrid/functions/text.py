"""Text columns of feature records: tokens, property maps, envelope and point strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token: a run of letters or digits, or a single CJK character.
TOKEN = r"[一-鿿]|[\p{L}\p{N}&&[^一-鿿]]+"


def tokens(text: Column) -> Column:
    """Lower-case words; CJK characters stand alone."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def one_line(text: Column) -> Column:
    return F.regexp_replace(text, r"\r|\n", "")


def property_map(text: Column) -> Column:
    """'k:v' parts between tabs as a map; parts without a colon are dropped, and what follows a second colon is lost."""
    parts = F.filter(F.split(text, "\t"), lambda p: p.contains(":"))
    pairs = F.transform(parts, lambda p: F.struct(F.split_part(p, F.lit(":"), F.lit(1)).alias("key"), F.split_part(p, F.lit(":"), F.lit(2)).alias("value")))
    # of a key that comes again, the last value stays
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def format_envelope(box: Column) -> Column:
    return F.concat_ws("\t", *(box[c].cast("string") for c in ("xmin", "ymin", "xmax", "ymax")))


def parse_envelope(text: Column) -> Column:
    parts = F.split(text, "\t")
    return F.struct(*(F.get(parts, i).cast("double").alias(c) for i, c in enumerate(("xmin", "ymin", "xmax", "ymax"))))


def format_point(x: Column, y: Column) -> Column:
    return F.concat(x.cast("string"), F.lit(","), y.cast("string"))


def parse_point(text: Column) -> Column:
    parts = F.split(text, ",")
    return F.struct(F.get(parts, 0).cast("double").alias("x"), F.get(parts, 1).cast("double").alias("y"))
