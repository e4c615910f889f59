"""Reshaping records into entities: tidy, long and matrix layouts, tuples, reverse references."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import exprs


def tidy(df: DataFrame, columns: Mapping[str, tuple[str, str]], constants: Mapping[str, object] | None = None) -> DataFrame:
    """``{attribute: (column, kind)}`` to typed attributes, with constants beside them."""
    picked = [exprs.coerce(F.col(c).cast("string"), kind)[0].alias(a) for a, (c, kind) in columns.items()]
    return df.select(*picked, *[F.lit(v).alias(a) for a, v in (constants or {}).items()])


def omit_na(df: DataFrame, flags: Mapping[str, Column], required: str | Sequence[str] = ()) -> DataFrame:
    """Drop rows in which a required attribute (``"*"``: any) is missing; elsewhere just the attribute becomes null."""
    names = list(flags) if required == "*" else [n for n in required]
    unknown = [n for n in names if n not in flags]
    if unknown:
        raise ValueError(f"no missing-value flag for {unknown}")
    for name in names:
        df = df.where(~flags[name])
    return df.withColumns({n: F.when(~flag, F.col(n)) for n, flag in flags.items()})


def molten(df: DataFrame, keep: Sequence[str], variable: str, value: str, variables: Mapping[str, tuple[str, str]], missing: Iterable[str] = ()) -> DataFrame:
    """Long rows: the variable names the attribute, the value is typed as that attribute.

    ``variables`` is ``{variable: (attribute, kind)}``.  Rows stay long, one entity a row;
    entities of one id meet in the store.  Unknown variables fill ``_error``.
    """
    raw = F.col(value).cast("string")
    out, wrong = [], []
    for name, (attribute, kind) in variables.items():
        here = F.col(variable) == name
        found = exprs.resolve(raw, kind, missing)
        out.append(F.when(here, found.value).alias(attribute))
        wrong.append(F.when(here, found.error))
    unknown = F.when(~F.coalesce(F.col(variable).isin(list(variables)), F.lit(False)), F.concat(F.lit("unknown variable "), F.coalesce(F.col(variable), F.lit("null"))))
    return df.select(*keep, *out, F.coalesce(unknown, *wrong).alias("_error"))


def reverse_references(children: DataFrame, parent_key: str, child_key: str, name: str = "children") -> DataFrame:
    """The parent's view of references that its children state: a sorted set of child keys."""
    return children.groupBy(parent_key).agg(F.array_sort(F.collect_set(child_key)).alias(name))


def group_tuples(df: DataFrame, key: str, elements: Sequence[str], name: str = "tuples") -> DataFrame:
    """Rows of one key as a sorted list of tuples (equal tuples count once)."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set(exprs.tuple_of(*map(F.col, elements)))).alias(name))


def matrix_long(df: DataFrame, index: Sequence[str], target: str, value: str = "value") -> DataFrame:
    """A dense matrix (index columns, then one column for each target id) as one row a cell."""
    cells = [c for c in df.columns if c not in index]
    if len(set(df.columns)) != len(df.columns):
        raise ValueError("a header names a column twice")
    if not cells:
        raise ValueError("a dense matrix needs a column besides its index")
    return df.unpivot(list(index), cells, target, value)


def check_sparse(columns: Sequence[str], index: Sequence[str]) -> str:
    """The one value column of a sparse matrix; anything else is an error."""
    rest = [c for c in columns if c not in index]
    if len(rest) != 1 or len(columns) != len(index) + 1:
        raise ValueError("a sparse matrix has its index columns and one value column")
    return rest[0]


def matrix_entity(cells: DataFrame, key: str, dimensions: Sequence[str]) -> DataFrame:
    """One row a matrix: the ids that each dimension takes, and the number of cells."""
    return cells.groupBy(key).agg(*[F.array_sort(F.collect_set(d)).alias(f"{d}s") for d in dimensions], F.count("*").alias("n_cells"))


def matrix_errors(cells: DataFrame, value: str, rule: Column, limit: int = 1000) -> DataFrame:
    """Cells that break ``rule`` (a missing cell breaks none), of which a report holds at most ``limit``."""
    return cells.where(F.col(value).isNotNull() & ~F.coalesce(rule, F.lit(False))).limit(limit)


def eav(df: DataFrame, key: str, attributes: Sequence[str]) -> DataFrame:
    """Entity, attribute, value: one row for each value that is there."""
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.col(a).cast("string").alias("v")) for a in attributes])
    return df.select(F.col(key).alias("e"), F.explode(pairs).alias("_p")).select("e", "_p.a", "_p.v").where("v IS NOT NULL")


def wide(triples: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """``eav`` undone for attributes of one value."""
    return triples.groupBy("e").agg(*[F.max(F.when(F.col("a") == a, F.col("v"))).alias(a) for a in attributes])
