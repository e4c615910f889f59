"""From planned jobs to entity frames: one ``select`` a job, no shuffle.

Order of evaluation for a record: trim, width, missing values, mapping, reference or
type, allowed values; long rows, tuples and many values; synthetic id from *raw* cells;
identity; omission; rules.  What is wrong with a record is listed in ``_errors``.

Every frame has ``_kind, _dataset, _path`` (ids below the dataset; null for kinds with
global ids), ``_uid`` (MD5 of the path), ``_parent`` (path of the parent), ``_file,
_line, _stage, _order, _errors`` beside the kind's attributes.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions import exprs
from weft.operators import entities, reshape, validate
from weft.plans.config import ImportPlan, Job, Literal
from weft.plans.schema import Attribute, Kind, Schema
from weft.sources import delimited

BOOKKEEPING = ["_kind", "_dataset", "_path", "_uid", "_parent", "_file", "_line", "_stage", "_order", "_errors"]
Mappings = Mapping[str, Mapping[str, object]]


class Preparer:
    def __init__(self, spark: SparkSession, schema: Schema, plan: ImportPlan, mappings: Mappings | None = None, rules: Mapping | None = None) -> None:
        self.spark, self.schema, self.plan = spark, schema, plan
        self.mappings, self.rules = mappings or {}, rules or {}

    # -- cells ---------------------------------------------------------------------

    def _type(self, attribute: Attribute) -> str:
        return "string" if attribute.ref_to else attribute.type

    def mapped(self, kind: Kind, job: Job, raw: DataFrame) -> DataFrame:
        """Mappings too large for the plan, joined as tables: ``_map_<attribute>`` holds the canonical value of each plain column's cell."""
        for name, column in job.columns.items():
            table = self.mappings.get(kind.attributes[name].ident)
            if table is not None and len(table) > exprs.MAX_LITERAL_MAP:
                rows = self.spark.createDataFrame([(raw_value, str(v).lower() if isinstance(v, bool) else str(v)) for raw_value, v in table.items()], f"_raw_{name} string, _map_{name} string")
                raw = raw.join(rows, exprs.cell(F.col(f"`{column}`")) == F.col(f"_raw_{name}"), "left").drop(f"_raw_{name}")
        return raw

    def _column(self, attribute: Attribute, column: str, job: Job) -> exprs.Resolved:
        """A plain column's cell, by a joined table where its mapping is one."""
        cell = F.col(f"`{column}`")
        table = self.mappings.get(attribute.ident)
        if table is None or len(table) <= exprs.MAX_LITERAL_MAP:
            return self.resolve(attribute, cell, job)
        canonical = F.col(f"_map_{attribute.name}")
        na = exprs.is_na(cell, job.na)
        found = self.resolve(attribute, F.when(~na, canonical), job, mapped=True)
        missing = F.when(~na & canonical.isNull(), F.concat(F.lit("no mapping for "), cell))
        return exprs.Resolved(found.value, na, F.coalesce(missing, found.error))

    def resolve(self, attribute: Attribute, cell: Column, job: Job, mapped: bool = False) -> exprs.Resolved:
        """A cell's value; ``mapped`` cells have been through a joined mapping (only plain columns are: elsewhere a large one is an error)."""
        found = exprs.resolve(cell, self._type(attribute), job.na, None if mapped else self.mappings.get(attribute.ident), attribute.enum or None)
        before = job.references.get(attribute.name)
        value = found.value if not before else F.when(found.value.isNotNull(), exprs.uid_path(F.lit(before), found.value))
        return exprs.Resolved(value, found.is_na, found.error)

    def _constant(self, attribute: Attribute, value: object, job: Job) -> exprs.Resolved:
        if isinstance(value, str):
            return self.resolve(attribute, F.lit(value), job)
        return exprs.Resolved(F.lit(value), F.lit(False), F.lit(None).cast("string"))

    def _many(self, attribute: Attribute, cell: Column, delimiter: str, job: Job) -> exprs.Resolved:
        """Each part is resolved by itself; one missing part makes the whole missing."""
        parts = exprs.split_many(cell, delimiter)
        value = F.transform(parts, lambda x: self.resolve(attribute, x, job).value)
        errors = F.array_compact(F.transform(parts, lambda x: self.resolve(attribute, x, job).error))
        na = F.exists(parts, lambda x: exprs.is_na(x, job.na))
        return exprs.Resolved(F.when(~na, exprs.as_set(F.array_compact(value))), na, F.when(~na & (F.size(errors) > 0), F.array_join(errors, "; ")))

    def _tuple(self, attribute: Attribute, columns: tuple[str, ...], job: Job) -> exprs.Resolved:
        kinds = attribute.tuple_of or ("string",) * len(columns)
        if len(kinds) != len(columns):
            raise ValueError(f"{attribute.ident}: {len(columns)} columns for a tuple of {len(kinds)}")
        found = [exprs.resolve(F.col(f"`{c}`"), k if k in exprs.COERCIONS else "string", job.na) for c, k in zip(columns, kinds, strict=True)]
        na = found[0].is_na
        for f in found[1:]:
            na = na | f.is_na
        built = exprs.tuple_of(*[f.value for f in found])
        return exprs.Resolved(F.when(~na, F.array(built) if attribute.many else built), na, F.coalesce(*[f.error for f in found]))

    # -- jobs ----------------------------------------------------------------------

    def scan(self, job: Job, provenance: bool = True) -> DataFrame:
        if provenance:
            return delimited.scan(self.spark, job.inputs, job.separator, job.required())
        by_names: dict[tuple[str, ...], list[str]] = {}
        for path in job.inputs:
            names = delimited.header(self.spark, path, job.separator)
            delimited.require(names, job.required(), path)
            by_names.setdefault(tuple(names), []).append(path)
        frames = [delimited.native(self.spark, paths, names, job.separator).withColumns({"_file": F.lit(paths[0]), "_line": F.lit(None).cast("long")}) for names, paths in by_names.items()]
        return entities.union_kinds(*frames)

    def job(self, job: Job, provenance: bool = True) -> DataFrame:
        if job.matrix:
            return self.matrix(job)
        kind = self.schema.kind(job.kind)
        raw = self.mapped(kind, job, self.scan(job, provenance))
        found: dict[str, exprs.Resolved] = {}
        # later entries win: long rows, tidy columns, constants, tuples, many values
        for name in dict.fromkeys(job.variables.values()):
            here = F.col(f"`{job.variable}`").isin([v for v, a in job.variables.items() if a == name])
            one = self.resolve(kind.attributes[name], F.col(f"`{job.value}`"), job)
            found[name] = exprs.Resolved(F.when(here, one.value), here & one.is_na, F.when(here, one.error))
        for name, column in job.columns.items():
            found[name] = self._column(kind.attributes[name], column, job)
        for name, value in job.constants.items():
            found[name] = self._constant(kind.attributes[name], value, job)
        for name, columns in job.tuples.items():
            found[name] = self._tuple(kind.attributes[name], columns, job)
        for name, (column, delimiter) in job.many.items():
            found[name] = self._many(kind.attributes[name], F.col(f"`{column}`"), delimiter, job)
        errors = [F.when(F.col(delimited.BAD).isNotNull(), F.concat(F.lit("record of the wrong width: "), F.col(delimited.BAD)))]
        if job.variable:
            known = F.col(f"`{job.variable}`").isin(list(job.variables))
            errors.append(F.when(~F.coalesce(known, F.lit(False)) & F.col(delimited.BAD).isNull(), F.concat(F.lit("unknown variable "), F.col(f"`{job.variable}`"))))
        errors += [F.when(r.error.isNotNull(), F.concat(F.lit(f"{kind.name}/{n}: "), r.error)) for n, r in found.items()]
        ident = self._identity(kind, job, found)
        paths = [F.lit(i) for i in job.scope.ids]
        if job.reverse:
            paths = [*paths[: self._depth(job.reverse[1])], F.col(f"`{job.reverse[0]}`")]
        path = exprs.uid_path(*paths, ident) if kind.scope == "context" else F.lit(None).cast("string")
        if kind.scope == "context":
            errors.append(F.when(ident.isNull() | exprs.invalid_uid(path), F.concat(F.lit("no proper identity: "), F.coalesce(path, F.lit("null")))))
        parent = exprs.uid_path(*paths) if paths else F.lit(None).cast("string")
        values = {}
        for name, attribute in kind.attributes.items():
            value = found[name].value if name in found else F.lit(None)
            if attribute.many and name in found and name not in job.many and name not in job.tuples:
                value = F.when(value.isNotNull(), F.array(value))
            values[name] = value.cast(attribute.spark_type)
        if kind.synthetic and kind.id and kind.id not in found:
            values[kind.id] = ident.cast(kind.attributes[kind.id].spark_type)
        out = raw.select(
            F.lit(kind.name).alias("_kind"), F.lit(self.plan.dataset).alias("_dataset"), path.alias("_path"), exprs.uid_hash(path).alias("_uid"), parent.alias("_parent"),
            "_file", "_line", F.lit(job.stage).alias("_stage"), F.lit(job.order).alias("_order"), F.array_compact(F.array(*errors)).alias("_errors"),
            *[v.alias(n) for n, v in values.items()], *[r.is_na.alias(f"_na_{n}") for n, r in found.items()],
        )
        flags = {n: F.coalesce(F.col(f"_na_{n}"), F.lit(False)) for n in found}
        if job.omit:
            out = reshape.omit_na(out, flags, job.omit if isinstance(job.omit, str) else [o for o in job.omit if o in flags])
        return self._ruled(out, kind).drop(*[f"_na_{n}" for n in found])

    def _ruled(self, df: DataFrame, kind: Kind) -> DataFrame:
        rules = {a: r for a, r in ((n, self.rules.get(f"{kind.name}/{n}")) for n in kind.attributes) if r}
        if not rules:
            return df
        found = F.transform(validate.attribute_errors(rules), lambda e: F.concat(F.lit(f"{kind.name}/"), e["attribute"], F.lit(" is not "), e["rule"], F.lit(": "), e["value"]))
        return df.withColumn("_errors", F.concat("_errors", found))

    def _depth(self, kind: str) -> int:
        """How many ids stand above an entity of a kind, below the dataset."""
        return max(0, len(self.schema.family(kind)) - 2)

    def _identity(self, kind: Kind, job: Job, found: Mapping[str, exprs.Resolved]) -> Column:
        if kind.id and kind.id in found:
            return found[kind.id].value.cast("string")
        if kind.synthetic:  # raw cells, missing values and all; constants and split cells take no part
            raw = [F.col(f"`{job.columns[p]}`") for p in kind.synthetic if p in job.columns]
            return exprs.synthetic_id(*raw) if raw else F.lit(None).cast("string")
        return F.lit(None).cast("string")

    # -- matrices and literals ------------------------------------------------------

    def cells(self, job: Job) -> tuple[DataFrame, dict[str, str]]:
        """A matrix job's cells: one row each, with the index columns, ``value`` and ``_bad``; and column by dimension."""
        matrix = job.matrix
        index = list(matrix.indexed_by)
        names = delimited.header(self.spark, job.inputs[0], job.separator)
        raw = self.scan(job, provenance=False)
        dims = {a: c for c, a in matrix.indexed_by.items()}
        if matrix.sparse:
            value = reshape.check_sparse(names, index)
            long = raw.select(*index, F.col(f"`{value}`").alias("_cell"))
        else:
            long = reshape.matrix_long(raw.select(*names), index, "_target", "_cell")
            dims[matrix.column_attribute] = "_target"
        found = exprs.resolve(F.col("_cell"), matrix.value_type, ("NA", *job.na))
        return long.select(*[c for c in long.columns if c != "_cell"], found.value.alias("value"), found.error.alias("_error")), dims

    def matrix(self, job: Job) -> DataFrame:
        """The matrix as one entity: the ids along each dimension, its constants, and its cell errors (at most 1000)."""
        kind = self.schema.kind(job.kind)
        cells, dims = self.cells(job)
        gathered = cells.agg(
            *[F.array_sort(F.collect_set(F.col(f"`{c}`"))).alias(a) for a, c in dims.items()],
            F.slice(F.array_sort(F.collect_set("_error")), 1, 1000).alias("_errors"),
        )
        ident = F.lit(str(job.constants.get(kind.id, job.inputs[0])))
        path = exprs.uid_path(*[F.lit(i) for i in job.scope.ids], ident)
        values = {}
        for name, attribute in kind.attributes.items():
            if name in dims:
                before = job.references.get(name)
                value = F.transform(F.col(name), self._within(before)) if before else F.col(name)
            elif name in job.constants:
                one = F.lit(job.constants[name])
                value = F.array(one) if attribute.many else one
            else:
                value = F.lit(None)
            values[name] = value.cast(attribute.spark_type)
        return gathered.select(
            F.lit(kind.name).alias("_kind"), F.lit(self.plan.dataset).alias("_dataset"), path.alias("_path"), exprs.uid_hash(path).alias("_uid"),
            F.lit(job.scope.path() or None).cast("string").alias("_parent"), F.lit(job.inputs[0]).alias("_file"), F.lit(None).cast("long").alias("_line"),
            F.lit(job.stage).alias("_stage"), F.lit(job.order).alias("_order"), "_errors", *[v.alias(n) for n, v in values.items()],
        )

    @staticmethod
    def _within(before: str):
        return lambda x: exprs.uid_path(F.lit(before), x)

    def literals(self, kind: str) -> DataFrame | None:
        """Entities written into the configuration; a driver-side list."""
        own = [x for x in self.plan.literals if x.kind == kind]
        if not own:
            return None
        spec = self.schema.kind(kind)
        fields = [T.StructField(c, T.StringType()) for c in ("_path", "_parent")]
        rows = []
        for x in own:
            rows.append((x.path, x.scope.path() or None, *[self._literal(a, x) for a in spec.attributes.values()]))
        df = self.spark.createDataFrame(rows, T.StructType([*fields, *[T.StructField(a.name, T.ArrayType(T.StringType()) if a.many else T.StringType()) for a in spec.attributes.values()]]))
        return df.select(
            F.lit(kind).alias("_kind"), F.lit(self.plan.dataset).alias("_dataset"), "_path", exprs.uid_hash(F.col("_path")).alias("_uid"), "_parent", F.lit(None).cast("string").alias("_file"),
            F.lit(None).cast("long").alias("_line"), F.lit(own[0].stage).alias("_stage"), F.lit(-1).alias("_order"), F.array().cast("array<string>").alias("_errors"),
            *[F.col(a.name).cast(a.spark_type).alias(a.name) if not a.tuple_of else F.lit(None).cast(a.spark_type).alias(a.name) for a in spec.attributes.values()],
        )

    @staticmethod
    def _literal(attribute: Attribute, literal: Literal) -> object:
        value = literal.attributes.get(attribute.name)
        if value is None:
            return None
        if attribute.many:
            return [str(v) for v in (value if isinstance(value, list) else [value])]
        return str(value).lower() if isinstance(value, bool) else str(value)

    def prepare(self, provenance: bool = True) -> dict[str, DataFrame]:
        """One lazy frame for each kind that the plan makes."""
        parts: dict[str, list[DataFrame]] = {}
        for kind in dict.fromkeys(x.kind for x in self.plan.literals):
            parts.setdefault(kind, []).append(self.literals(kind))
        for job in self.plan.jobs:
            parts.setdefault(job.kind, []).append(self.job(job, provenance))
        return {kind: entities.union_kinds(*frames) for kind, frames in parts.items()}


def good(frame: DataFrame) -> DataFrame:
    return frame.where(F.size("_errors") == 0)


def bad(frame: DataFrame) -> DataFrame:
    return frame.where(F.size("_errors") > 0)
