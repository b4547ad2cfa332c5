"""Keys, identities and content hashes as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

_SHORT = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
_CONTROLS = [chr(c) for c in range(32) if chr(c) not in _SHORT]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def json_string(c: Column | str) -> Column:
    """A string as a JSON literal: no ASCII escaping, control characters as lower-case hex escapes."""
    out = _col(c)
    for char, escape in _SHORT.items():
        out = F.replace(out, F.lit(char), F.lit(escape))
    rare = out
    for char in _CONTROLS:
        rare = F.replace(rare, F.lit(char), F.lit(f"\\u{ord(char):04x}"))
    out = F.when(out.rlike("[\\x00-\\x1f]"), rare).otherwise(out)
    return F.concat(F.lit('"'), out, F.lit('"'))


def stable_json(**fields: Column) -> Column:
    """A JSON object with sorted keys and no blanks; string columns are escaped, null prints as null.

    Values are strings, integers or booleans, or columns that already hold JSON (see `json_array`).
    """
    parts: list[Column] = []
    for i, name in enumerate(sorted(fields)):
        parts += [F.lit(("{" if i == 0 else ",") + f'"{name}":'), F.coalesce(fields[name], F.lit("null"))]
    return F.concat(*parts, F.lit("}")) if parts else F.lit("{}")


def json_array(c: Column | str) -> Column:
    """An array of strings as JSON."""
    return F.concat(F.lit("["), F.array_join(F.transform(_col(c), json_string), ","), F.lit("]"))


def stable_hash(json: Column) -> Column:
    return F.sha2(json, 256)


def split_order_key(problem_id: Column | str, seed: int) -> Column:
    """Hash by which problems are ordered before they are split or sampled."""
    return stable_hash(stable_json(problem_id=json_string(problem_id), seed=F.lit(str(seed))))


def testcase_fingerprint(input_: Column | str, output: Column | str) -> Column:
    return stable_hash(stable_json(input=json_string(input_), output=json_string(output)))


def make_problem_id(source: Column | str, source_id: Column | str) -> Column:
    """source:source_id; null where either is empty or null (see validate.assert_none)."""
    s, i = _col(source), _col(source_id)
    return F.when((s != "") & (i != ""), F.concat(s, F.lit(":"), i))


def make_source_id(split: Column | str, index: Column | str) -> Column:
    s, i = F.lower(strip(split)), strip(_col(index).cast("string"))
    return F.when((s != "") & (i != ""), F.concat(s, F.lit(":"), i))


def source_split(source_id: Column | str) -> Column:
    """The text before the first colon; null without a colon or where it is empty."""
    c = _col(source_id)
    return F.when(c.contains(":"), F.nullif(F.substring_index(c, ":", 1), F.lit("")))


def split_label(metadata_split: Column | str, source_id: Column | str) -> Column:
    """The split that the metadata names, else the one in the id, else 'unknown'; in lower case."""
    named = F.nullif(F.lower(strip(F.coalesce(_col(metadata_split), F.lit("")))), F.lit(""))
    return F.coalesce(named, source_split(source_id), F.lit("unknown"))


def id_label(source_id: Column | str) -> Column:
    """The text before the first colon, the whole id where there is none."""
    return F.substring_index(_col(source_id), ":", 1)


def source_index(source_id: Column | str) -> Column:
    c = _col(source_id)
    return F.when(c.contains(":"), F.substring(c, F.instr(c, ":") + 1, F.length(c))).otherwise(c)
