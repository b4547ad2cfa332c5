"""Lenient JSON columns of source rows: solutions and test cases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_text


def as_text(c: Column | str) -> Column:
    """null and NaN as ''."""
    c = F.col(c) if isinstance(c, str) else c
    s = c.cast("string")
    return F.when(s.isNull() | (s == "NaN"), F.lit("")).otherwise(s)


def parse(c: Column | str) -> Column:
    """A VARIANT; blank or malformed JSON is null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(is_text(c), F.try_parse_json(c))


def strings_at(variant: Column, path: str) -> Column:
    """The array at path with null for every item that is no string; null if there is no array."""
    items = F.try_variant_get(variant, path, "array<variant>")
    return F.transform(items, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))


def solutions(c: Column | str) -> Column:
    """Non-blank strings of a JSON array; a text that is no JSON array gives none."""
    return F.coalesce(F.filter(strings_at(parse(c), "$"), is_text), F.array().cast("array<string>"))


def tests(c: Column | str) -> Column:
    """array<struct<input, output>> of {"inputs": [...], "outputs": [...]}.

    Lists of unequal length give no test; a pair that is not two strings is left out.
    """
    v = parse(c)
    i, o = strings_at(v, "$.inputs"), strings_at(v, "$.outputs")
    pairs = F.transform(F.arrays_zip(i.alias("i"), o.alias("o")), lambda p: F.struct(p["i"].alias("input"), p["o"].alias("output")))
    kept = F.filter(pairs, lambda p: p["input"].isNotNull() & p["output"].isNotNull())
    return F.when(F.size(i) == F.size(o), kept).otherwise(F.array().cast("array<struct<input:string,output:string>>"))


def protocol(fn_name: Column, starter_code: Column) -> Column:
    """'stdio' if neither a function name nor starter code is given, else 'call_based'."""
    return F.when(~is_text(as_text(fn_name)) & ~is_text(as_text(starter_code)), F.lit("stdio")).otherwise(F.lit("call_based"))
