"""Validation: rules on attributes, shapes of kinds, and checks across entities.

Rules are data: an attribute name and a rule name with its parameters.  A broken rule
is an element of ``_errors``; earlier findings are never dropped by later checks.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import exprs

#: The one-letter codes of amino-acid sequences.
AMINO_ACIDS = "ARNDCEQGHILKMFPSTWYVBZX"

RULES: dict[str, Callable[..., Column]] = {
    "non_negative": lambda c: c >= 0,
    "positive": lambda c: c > 0,
    "zero_to_one": lambda c: c.between(0, 1),
    "between": lambda c, low, high: c.between(low, high),
    "integer": lambda c: c == F.floor(c),
    "one_of": lambda c, *values: c.isin(*values),
    "alphabet": lambda c, letters=AMINO_ACIDS: F.translate(c, letters, "") == "",
    "max_length": lambda c, n: F.length(c) <= n,
    "composite_of": lambda c, separator, *parts: c.eqNullSafe(exprs.composite(separator, *map(F.col, parts))),
}


def register_rule(name: str, rule: Callable[..., Column]) -> None:
    """Add a rule: a function of the attribute's column (and parameters) that is true where all is well."""
    RULES[name] = rule


def attribute_errors(rules: Mapping[str, Sequence[object]]) -> Column:
    """``{attribute: [rule name, parameter, ...]}`` as an array of (attribute, rule, value) that broke."""
    found = []
    for attribute, (name, *parameters) in rules.items():
        column = F.col(attribute)
        fine = F.coalesce(RULES[name](column, *parameters), F.lit(False))
        broken = column.isNotNull() & ~fine
        found.append(F.when(broken, F.struct(F.lit(attribute).alias("attribute"), F.lit(name).alias("rule"), column.cast("string").alias("value"))))
    return F.array_compact(F.array(*found))


def checked(df: DataFrame, rules: Mapping[str, Sequence[object]]) -> DataFrame:
    """Rows with ``_errors``, added to any that are there already."""
    errors = attribute_errors(rules)
    return df.withColumn("_errors", F.concat("_errors", errors) if "_errors" in df.columns else errors)


def closed_shape(required: Sequence[str], optional: Sequence[str], columns: Sequence[str]) -> Column:
    """All required attributes are there, and none beyond the optional ones."""
    out = F.lit(True)
    for name in required:
        out = out & (F.col(name).isNotNull() if name in columns else F.lit(False))
    for name in columns:
        if name not in required and name not in optional:
            out = out & F.col(name).isNull()
    return out


def has_any(names: Sequence[str], columns: Sequence[str]) -> Column:
    """At least one of the attributes is there."""
    there = [F.col(n).isNotNull() for n in names if n in columns]
    return F.greatest(*there) if len(there) > 1 else there[0] if there else F.lit(False)


def shape_errors(df: DataFrame, spec: Mapping[str, object], columns: Sequence[str]) -> Column:
    """What is wrong with an entity's shape, as an array of texts.

    ``spec`` may hold ``required`` attributes, ``one_of`` (groups, each of which must be
    there in whole, one at least), ``value`` (one of which must be there) and ``closed``
    (named shapes ``{"required": [...], "optional": [...]}``, one of which must fit with
    nothing beyond it).  Only ``columns`` count as attributes.
    """
    found = [F.when(~(F.col(n).isNotNull() if n in columns else F.lit(False)), F.lit(f"no {n}")) for n in spec.get("required", ())]
    groups = spec.get("one_of", ())
    if groups:
        fits = [closed_shape(g, columns, columns) for g in groups]
        found.append(F.when(~(F.greatest(*fits) if len(fits) > 1 else fits[0]), F.lit("none of " + " or ".join("+".join(g) for g in groups))))
    if "value" in spec:
        found.append(F.when(~has_any(spec["value"], columns), F.lit("no value")))
    if "closed" in spec:
        fits = [closed_shape(s["required"], s.get("optional", ()), columns) for s in spec["closed"].values()]
        found.append(F.when(~(F.greatest(*fits) if len(fits) > 1 else fits[0]), F.lit("fits none of " + ", ".join(spec["closed"]))))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def order_is_complete(df: DataFrame, key: str, member: str, order: str) -> DataFrame:
    """Keys whose members' orders run from 1 to their number."""
    found = df.groupBy(key).agg(F.count_distinct(member).alias("n"), F.max(order).alias("top"))
    return found.withColumn("complete", F.col("n") == F.col("top"))


def namespace_collisions(triples: DataFrame) -> DataFrame:
    """Entities whose attributes (``kind/name``) come from more than one kind."""
    kind = F.split_part(F.col("a"), F.lit("/"), F.lit(1))
    return triples.groupBy("e").agg(F.array_sort(F.collect_set(kind)).alias("kinds")).where(F.size("kinds") > 1)


def expectations(q: Callable[..., DataFrame], document: Mapping[str, object]) -> list[dict[str, object]]:
    """Run a document of named queries against the rows they allow.

    ``{"rules": [...], "validations": [{"name", "query", "allowed"}]}``; ``allowed`` is a
    list of rows or another query.  One finding for each query whose rows are others: its
    name, and up to 20 rows on either side that the other lacks.  Rows are compared by
    anti joins, not on the driver.
    """
    rules = document.get("rules") or []
    findings = []

    def rows(query: Mapping[str, object]) -> DataFrame:
        return q(query, *([rules] if "%" in query.get("in", ()) else []))

    for entry in document["validations"]:
        found = rows(entry["query"])
        allowed = entry["allowed"]
        names = [f"_{k}" for k in range(len(found.columns))]
        found = found.toDF(*names)
        if isinstance(allowed, Mapping):
            wanted = rows(allowed).toDF(*names)
        else:
            kinds = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, found.schema, strict=True))
            wanted = found.sparkSession.createDataFrame([tuple(r) for r in allowed], kinds)
        more, less = found.subtract(wanted), wanted.subtract(found)
        # a query may allow one of several rows: then it is enough that nothing else is found
        any_of = bool(entry.get("any_of"))
        unexpected = [tuple(r) for r in more.limit(20).collect()]
        missing = [] if any_of else [tuple(r) for r in less.limit(20).collect()]
        if unexpected or missing:
            findings.append({"name": entry["name"], "unexpected": unexpected, "missing": missing})
    return findings


def measured_technologies(measurements: DataFrame, technologies: Mapping[str, Mapping[str, Sequence[str]]], technology: str = "technology") -> DataFrame:
    """Measurements whose assay's technology isn't one that their attributes come from: the row and ``rule``, one row for each broken rule.

    ``technologies`` is ``{rule: {"attributes": [...], "allowed": [...]}}``; a measurement that names no technology breaks none.
    """
    broken = []
    for name, rule in technologies.items():
        allowed = F.col(technology).isin(list(rule["allowed"]))
        broken.append(F.when(has_any(rule["attributes"], measurements.columns) & F.col(technology).isNotNull() & ~allowed, F.lit(name)))
    return measurements.select("*", F.explode(F.array_compact(F.array(*broken))).alias("rule"))


def technology_errors(measurements: DataFrame, allowed: Mapping[str, Sequence[str]], technology: str = "technology") -> DataFrame:
    """Measurements whose attribute isn't one that their assay's technology yields."""
    rules = [F.when(F.col(a).isNotNull() & ~F.coalesce(F.col(technology).isin(list(techs)), F.lit(False)), F.lit(a)) for a, techs in allowed.items()]
    return measurements.withColumn("_wrong", F.array_compact(F.array(*rules))).where(F.size("_wrong") > 0)


def locations(errors: DataFrame, annotations: DataFrame, key: str) -> DataFrame:
    """Findings with the file and the lines that their entities came from."""
    lines = annotations.groupBy(key, "_file").agg(F.min("_line").alias("first_line"), F.max("_line").alias("last_line"))
    return errors.join(lines, key, "left")
