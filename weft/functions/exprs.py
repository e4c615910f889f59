"""Column expressions of the record-to-entity core.

Each function returns Spark columns only; what can go wrong is a second column (null
when all is well), so that errors are values until a writer decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

PATH_SEPARATOR = "|:~"
COMPOSITE_SEPARATOR = "-"
#: Mappings of more entries than this are joined as a table instead of written into the plan.
MAX_LITERAL_MAP = 1000
_INTEGER = r"^[+-]?[0-9]+$"


@dataclass(frozen=True)
class Resolved:
    """A value, whether the cell was missing, and what is wrong with it (or null)."""

    value: Column
    is_na: Column
    error: Column


def cell(column: Column) -> Column:
    """A delimited cell: absent text is the empty string, white space around it goes."""
    return F.trim(F.coalesce(column, F.lit("")))


def is_na(column: Column, missing: Iterable[str]) -> Column:
    missing = list(missing)
    return F.coalesce(column.isin(missing), F.lit(False)) if missing else F.lit(False)


def invert_mapping(mapping: Mapping[str, object]) -> dict[str, object]:
    """``{canonical: raw or [raw, ...]}`` as ``{raw: canonical}``; a raw value given twice is an error."""
    out: dict[str, object] = {}
    for canonical, raws in mapping.items():
        for raw in raws if isinstance(raws, (list, tuple, set, frozenset)) else [raws]:
            if raw in out and out[raw] != canonical:
                raise ValueError(f"{raw!r} maps to both {out[raw]!r} and {canonical!r}")
            out[raw] = canonical
    return out


def map_value(column: Column, lookup: Mapping[str, object] | None) -> tuple[Column, Column]:
    """Mapped value and error; without a mapping the value passes through."""
    if lookup is None:
        return column, F.lit(None).cast("string")
    if len(lookup) > MAX_LITERAL_MAP:
        raise ValueError("join a mapping of this size as a table (see operators.joins.map_by_table)")
    entries = [F.lit(x) for pair in lookup.items() for x in pair]
    if not entries:
        return F.lit(None).cast("string"), F.when(column.isNotNull(), F.concat(F.lit("no mapping for "), column))
    table = F.create_map(*entries)
    known = column.isin(list(lookup))
    return F.when(known, table[column]), F.when(column.isNotNull() & ~known, F.concat(F.lit("no mapping for "), column))


def to_long(column: Column) -> Column:
    return F.when(F.trim(column).rlike(_INTEGER), F.trim(column).try_cast("bigint"))


def to_double(column: Column) -> Column:
    return column.try_cast("double")


def to_boolean(column: Column) -> Column:
    low = F.lower(column)
    return F.when(low.isin("true", "false"), low == "true")


def to_instant(column: Column) -> Column:
    return column.try_cast("timestamp_ntz")


def to_keyword(column: Column) -> Column:
    """An enum or reference cell: a leading colon marks a keyword and goes."""
    return F.regexp_replace(column, "^:", "")


#: Kinds without an entry (uuid, uri, bytes, ...) pass through as text.
COERCIONS = {
    "long": to_long, "int": to_long, "double": to_double, "float": to_double, "boolean": to_boolean, "instant": to_instant,
    "ref": to_keyword, "bigdec": lambda c: c.try_cast("decimal(38,18)"), "bigint": lambda c: F.when(c.rlike(_INTEGER), c.try_cast("decimal(38,0)")),
}


def coerce(column: Column, kind: str) -> tuple[Column, Column]:
    """Typed value, and an error where a cell has no such value."""
    if kind not in COERCIONS:
        return column, F.lit(None).cast("string")
    value = COERCIONS[kind](column)
    return value, F.when(column.isNotNull() & value.isNull(), F.concat(F.lit(f"not a {kind}: "), column))


def resolve(column: Column, kind: str = "string", missing: Iterable[str] = (), lookup: Mapping[str, object] | None = None, enum: Iterable[str] | None = None) -> Resolved:
    """Missing marker, then mapping, then type, then allowed values: the order every cell goes through."""
    na = is_na(column, missing)
    present = F.when(~na, column)
    mapped, wrong_map = map_value(present, lookup)
    value, wrong_type = coerce(mapped.cast("string"), kind) if lookup is None or kind != "boolean" else (mapped, F.lit(None).cast("string"))
    wrong_enum = F.lit(None).cast("string")
    if enum is not None:
        wrong_enum = F.when(value.isNotNull() & ~value.isin(list(enum)), F.concat(F.lit("unknown enum value "), value.cast("string")))
    return Resolved(value, na, F.coalesce(wrong_map, wrong_type, wrong_enum))


def delimiter_pattern(delimiter: str) -> str:
    """A single special character stands for itself; anything longer is a pattern."""
    return re.escape(delimiter) if len(delimiter) == 1 else delimiter


def split_many(column: Column, delimiter: str) -> Column:
    """Split a cell into many; trailing empty parts go, as they do in Java's split."""
    parts = F.split(column, delimiter_pattern(delimiter))
    last = F.array_max(F.transform(parts, lambda x, i: F.when(x != "", i + 1).otherwise(0)))
    # a cell without the delimiter stays one part, even if it is empty
    return F.when(F.size(parts) == 1, parts).otherwise(F.slice(parts, 1, F.coalesce(last, F.lit(0))))


def as_set(column: Column) -> Column:
    """Values of a many-valued attribute: a set, in a fixed order."""
    return F.array_sort(F.array_distinct(column))


def synthetic_id(*raw: Column) -> Column:
    """Raw component cells joined by the separator; absent components are skipped, and a blank result is null."""
    joined = F.concat_ws(COMPOSITE_SEPARATOR, *raw)
    return F.when(F.trim(joined) != "", joined)


def composite(separator: str, *parts: Column) -> Column:
    return F.concat_ws(separator, *[p.cast("string") for p in parts])


def uid_path(*context_ids: Column) -> Column:
    """Path of context ids from below the dataset to the entity itself."""
    return F.concat_ws(PATH_SEPARATOR, *[c.cast("string") for c in context_ids])


def uid_hash(path: Column) -> Column:
    return F.md5(path)


def name_uuid(namespace: str, name: Column) -> Column:
    """A version 5 UUID of a name in a namespace, which is given as text and hashed as such."""
    sha = F.sha1(F.concat(F.lit(namespace), name.cast("string")))
    variant = F.translate(F.substring(sha, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    part = lambda at, n: F.substring(sha, at, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def to_date(column: Column) -> Column:
    """A year, month and day; empty text is no date."""
    return F.nullif(column, F.lit("")).try_cast("date")


def piped(column: Column) -> Column:
    """The parts of a cell between pipes, without quotation marks; empty text is none."""
    return F.when(column != "", F.split(F.replace(column, F.lit('"'), F.lit("")), r"\|"))


def invalid_uid(path: Column) -> Column:
    """Null, empty, or a path with an empty step."""
    sep = PATH_SEPARATOR
    return path.isNull() | (path == "") | path.startswith(sep) | path.endswith(sep) | path.contains(sep + sep)


def tuple_of(*elements: Column) -> Column:
    """A typed tuple: fields _1, _2, ..."""
    return F.struct(*[e.alias(f"_{i}") for i, e in enumerate(elements, 1)])
