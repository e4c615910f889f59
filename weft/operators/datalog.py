"""A Datalog subset over kinds, compiled to joins and aggregates.

A query is a mapping (JSON or the like)::

    {"find": ["?x", ["count", "?y", "n"]], "with": ["?z"], "in": ["?a", ["?b", "..."], [["?c", "?d"]], "%"],
     "where": [["?e", "kind/attr", "?v"], [[">", "?v", 3]], ["or", [clause, ...], ...], ["not", clause, ...], ["rule", "?x"]]}

``find`` takes variables and aggregates (``count``, ``count-distinct``, ``min``,
``max``, with an optional result name); ``["max", 3, "?x"]`` and ``["min", 3, "?x"]`` give
an array of up to three values, the first the best.  Inputs are scalars, collections, relations and
rules (``%``).  Bindings are a set: results are distinct over the found and ``with``
variables before anything is counted.  ``["pull", "?e", ["name", {"region": ["name"]}]]``
in ``find`` gives an entity's attributes as a struct, with those of an entity it refers
to nested once; ``["*"]`` pulls all.  ``scalar``, ``column`` and ``row`` fetch the results
of queries that find one value, one column or one row.  An attribute that holds many values binds each
of them.  Anything else is refused with an error.

A clause may go on to a fourth term, the transaction that asserted the value, and a fifth,
whether it was an assertion (only those count where it isn't named); and its attribute may
be a variable.  Such clauses read the history of all kinds, in which values are text
unless the clause names their attribute.  Each blank (``_``) stands for itself alone.

Each kind is one table, so patterns of one entity variable and kind read the table
once and need no join.  Patterns are joined from the most bound to the least.  Bindings
are made distinct only where repeats would count and can occur.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_COMPARE = {
    ">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b, "not=": lambda a, b: a != b,
}
_AGGREGATES = {"count": F.count, "count-distinct": F.count_distinct, "min": F.min, "max": F.max}
#: Aggregates that are the same however often a binding is repeated.
_OF_SETS = ("count-distinct", "min", "max")


class QueryError(ValueError):
    """A query that this subset doesn't take."""


def is_variable(x: object) -> bool:
    return isinstance(x, str) and x.startswith("?") and len(x) > 1


def _is_top(f: object) -> bool:
    """Whether an item of ``find`` is the top-n form of ``min`` or ``max``."""
    return (
        isinstance(f, (list, tuple)) and len(f) in (3, 4) and f[0] in ("min", "max")
        and isinstance(f[1], int) and not isinstance(f[1], bool) and f[1] > 0 and is_variable(f[2])
    )


def _top(bindings: DataFrame, groups: list[str], name: str, n: int, largest: bool) -> DataFrame:
    """``_g0..., _top``: the ``n`` best values of each group; no group is held as a whole."""
    value = F.col(f"`{name}`")
    rows = bindings.where(value.isNotNull()).select(*[F.col(f"`{g}`").alias(f"_g{i}") for i, g in enumerate(groups)], value.alias("_v"))
    keys = [f"_g{i}" for i in range(len(groups))]
    order = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_v").desc() if largest else F.col("_v")))
    best = rows.withColumn("_r", order).where(F.col("_r") <= n)
    return best.groupBy(*keys).agg(F.sort_array(F.collect_list("_v"), not largest).alias("_top"))


def _plain(name: str) -> str:
    return name.lstrip(":")


class Views:
    """Kinds as relations: ``{kind: (table, key column)}``; the key stands for the entity.

    An entity may have several rows, one for each value of an attribute, say.  ``unique``
    names, for kinds where that is known, the columns whose values no two rows share.
    """

    def __init__(self, kinds: Mapping[str, tuple[DataFrame, str]], history: DataFrame | None = None, unique: Mapping[str, Sequence[str]] | None = None) -> None:
        self.kinds = dict(kinds)
        self.unique = dict(unique or {})
        #: ``e, a, v, tx, added`` of every value ever brought, ``a`` as ``kind/name``.
        self.history = history

    # -- clauses -------------------------------------------------------------------

    def _patterns(self, patterns: Sequence[Sequence[object]]) -> list[DataFrame]:
        """One frame of bindings for each entity and kind."""
        grouped: dict[tuple[str, str], list[tuple[str, object]]] = {}
        past = []
        for number, (entity, attribute, *value) in enumerate(patterns):
            if is_variable(attribute) or len(value) > 1:
                past.append(self._past(entity, attribute, *value))
                continue
            if entity == "_":
                entity = f"_{number}"
            kind, _, name = _plain(str(attribute)).partition("/")
            if kind not in self.kinds:
                raise QueryError(f"no kind {kind!r}")
            if name not in self.kinds[kind][0].columns:
                raise QueryError(f"no attribute {attribute!r}")
            grouped.setdefault((json.dumps(entity), kind), []).append((name, value[0] if value else "_"))
        out = past
        for (entity_json, kind), pairs in grouped.items():
            entity = json.loads(entity_json)
            df, key = self.kinds[kind]
            blank = isinstance(entity, str) and entity.startswith("_")
            named: list[tuple[object, Column]] = [] if blank else [(entity, F.col(key))]
            for name, value in pairs:
                if isinstance(df.schema[name].dataType, T.ArrayType):
                    df = df.withColumn(f"_{name}_each", F.explode(name))
                    named.append((value, F.col(f"_{name}_each")))
                else:
                    df = df.where(F.col(name).isNotNull())
                    named.append((value, F.col(name)))
            columns: dict[str, Column] = {}
            for value, column in named:
                if value == "_":
                    continue
                if not is_variable(value):
                    df = df.where(column == F.lit(value))
                elif value in columns:
                    df = df.where(column == columns[value])
                else:
                    columns[value] = column
            out.append(df.select(*[c.alias(v) for v, c in columns.items()]) if columns else df.select(F.lit(1).alias("?_")).limit(1))
        return out

    def _past(self, entity: object, attribute: object, value: object = "_", tx: object = "_", added: object = True) -> DataFrame:
        """Bindings of one clause over the history."""
        if self.history is None:
            raise QueryError("no history to read transactions or variable attributes from")
        df, v, e = self.history, F.col("v"), F.col("e")
        if not is_variable(attribute):
            kind, _, name = _plain(str(attribute)).partition("/")
            if kind not in self.kinds or name not in self.kinds[kind][0].columns:
                raise QueryError(f"no attribute {attribute!r}")
            table, key = self.kinds[kind]
            kinds = {f.name: f.dataType for f in table.schema}
            of = kinds[name].elementType if isinstance(kinds[name], T.ArrayType) else kinds[name]
            v, e, attribute = F.col("v").cast(of), F.col("e").cast(kinds[key]), f"{kind}/{name}"
        columns: dict[str, Column] = {}
        for term, column in ((entity, e), (attribute, F.col("a")), (value, v), (tx, F.col("tx")), (added, F.col("added"))):
            if term == "_":
                continue
            if not is_variable(term):
                df = df.where(column == F.lit(term))
            elif term in columns:
                df = df.where(column.cast("string") == columns[term].cast("string"))
            else:
                columns[term] = column
        return df.select(*[c.alias(n) for n, c in columns.items()]).distinct() if columns else df.select(F.lit(1).alias("?_")).limit(1)

    def _rule(self, clause: Sequence[object], rules: Mapping[str, list], stack: tuple[str, ...]) -> DataFrame:
        name, *given = clause
        if name in stack:
            raise QueryError(f"rule {name!r} is recursive")
        branches = []
        for head, body in rules[name]:
            if len(head) != len(given):
                raise QueryError(f"rule {name!r} takes {len(head)} arguments")
            solved = self._solve(body, rules, [], (*stack, name))
            for parameter, value in zip(head, given, strict=True):
                if not is_variable(value):
                    solved = solved.where(F.col(f"`{parameter}`") == F.lit(value))
            kept = {v: p for p, v in zip(head, given, strict=True) if is_variable(v)}
            branches.append(solved.select(*[F.col(f"`{p}`").alias(v) for v, p in kept.items()]))
        return reduce(lambda a, b: a.unionByName(b), branches).distinct()

    def _solve(self, where: Sequence[object], rules: Mapping[str, list], frames: list[DataFrame], stack: tuple[str, ...] = ()) -> DataFrame:
        frames, patterns, tests, without = list(frames), [], [], []
        for clause in where:
            if not isinstance(clause, (list, tuple)) or not clause:
                raise QueryError(f"not a clause: {clause!r}")
            head = clause[0]
            if isinstance(head, (list, tuple)):
                if len(clause) != 1 or len(head) != 3 or head[0] not in _COMPARE:
                    raise QueryError(f"not a comparison: {clause!r}")
                tests.append(head)
            elif head in ("or", "or-join"):
                bodies = clause[1:] if head == "or" else clause[2:]
                found = [self._solve(b if isinstance(b[0], (list, tuple)) and not (len(b) == 1 and isinstance(b[0][0], (list, tuple))) else [b], rules, [], stack) for b in bodies]
                shared = list(clause[1]) if head == "or-join" else [c for c in found[0].columns if all(c in f.columns for f in found)]
                if not shared:
                    raise QueryError("branches of or share no variable")
                frames.append(reduce(lambda a, b: a.unionByName(b), [f.select(*[F.col(f"`{c}`") for c in shared]) for f in found]).distinct())
            elif head == "not":
                without.append(clause[1:])
            elif head in rules:
                frames.append(self._rule(clause, rules, stack))
            elif 2 <= len(clause) <= 5 and isinstance(clause[1], str) and ("/" in clause[1] or is_variable(clause[1])):
                patterns.append(clause)
            else:
                raise QueryError(f"not supported: {clause!r}")
        frames += self._patterns(patterns)
        if not frames:
            raise QueryError("where binds nothing")
        out = self._joined(frames)
        for op, a, b in tests:
            sides = [F.col(f"`{x}`") if is_variable(x) else F.lit(x) for x in (a, b)]
            if any(is_variable(x) and x not in out.columns for x in (a, b)):
                raise QueryError(f"{a} {op} {b} compares an unbound variable")
            out = out.where(_COMPARE[op](*sides))
        for body in without:
            found = self._solve(body, rules, [], stack)
            shared = [c for c in found.columns if c in out.columns]
            if not shared:
                raise QueryError("not shares no variable with the query")
            out = out.join(found.select(*[F.col(f"`{c}`") for c in shared]).distinct(), shared, "left_anti")
        return out

    @staticmethod
    def _joined(frames: list[DataFrame]) -> DataFrame:
        rest = list(frames)
        out = rest.pop(0)
        while rest:
            best = max(rest, key=lambda f: len(set(f.columns) & set(out.columns)))
            shared = [c for c in best.columns if c in out.columns]
            if not shared:
                raise QueryError("clauses share no variable; a product of bindings is refused")
            kinds = dict(out.dtypes), dict(best.dtypes)
            for c in shared:  # values of the history are text
                if "string" in (kinds[0][c], kinds[1][c]) and kinds[0][c] != kinds[1][c]:
                    out, best_cast = out.withColumn(c, F.col(f"`{c}`").cast("string")), best.withColumn(c, F.col(f"`{c}`").cast("string"))
                    rest[rest.index(best)] = best_cast
                    best = best_cast
            out = out.join(best, shared)
            rest.remove(best)
        return out

    def _without_repeats(self, where: Sequence[Sequence[object]], needed: Sequence[str]) -> bool:
        """Whether no two rows that the clauses bind agree in all that is needed.

        That is known where the needed variables lead, from pattern to pattern, to the
        unique columns of every pattern's kind; only patterns and comparisons are judged.
        """
        bound: dict[tuple[str, str], dict[str, list[object]]] = {}
        for clause in where:
            if isinstance(clause[0], (list, tuple)):
                continue
            if not is_variable(clause[0]) or len(clause) not in (2, 3) or not isinstance(clause[1], str) or "/" not in clause[1]:
                return False
            kind, _, name = _plain(clause[1]).partition("/")
            if kind not in self.unique or isinstance(self.kinds[kind][0].schema[name].dataType, T.ArrayType):
                return False
            terms = bound.setdefault((clause[0], kind), {self.kinds[kind][1]: [clause[0]]})
            terms.setdefault(name, []).append(clause[2] if len(clause) == 3 else "_")
        known, rest = set(needed), list(bound.items())
        while rest:
            told = [item for item in rest if all(any(t != "_" and (t in known or not is_variable(t)) for t in item[1].get(c, ())) for c in self.unique[item[0][1]])]
            if not told:
                return False
            known |= {t for _, terms in told for own in terms.values() for t in own if is_variable(t)}
            rest = [item for item in rest if item not in told]
        return True

    # -- queries ---------------------------------------------------------------------

    def q(self, query: Mapping[str, object] | str, *inputs: object) -> DataFrame:
        """The bindings that ``find`` names, as columns without the question mark."""
        query = {_plain(k): v for k, v in (json.loads(query) if isinstance(query, str) else dict(query)).items()}
        unknown = set(query) - {"find", "with", "in", "where"}
        if unknown or "find" not in query or "where" not in query:
            raise QueryError(f"a query has find, with, in and where, not {sorted(unknown)}")
        wanted = list(query.get("in", []))
        if len(wanted) != len(inputs):
            raise QueryError(f"{len(wanted)} inputs are named and {len(inputs)} given")
        spark = next(iter(self.kinds.values()))[0].sparkSession
        frames, rules = [], {}
        for name, value in zip(wanted, inputs, strict=True):
            if name == "%":
                for (rule, *head), *body in value:
                    rules.setdefault(rule, []).append((head, body))
            elif is_variable(name):
                frames.append(F.broadcast(spark.createDataFrame([(value,)], [name])))
            elif len(name) == 2 and name[1] == "...":
                frames.append(F.broadcast(spark.createDataFrame([(v,) for v in value], [name[0]]).distinct()))
            elif len(name) == 1 and isinstance(name[0], (list, tuple)):
                frames.append(F.broadcast(spark.createDataFrame([tuple(v) for v in value], list(name[0])).distinct()))
            else:
                raise QueryError(f"not an input: {name!r}")
        solved = self._solve(query["where"], rules, frames)
        pulls = [f for f in query["find"] if isinstance(f, (list, tuple)) and f and f[0] == "pull"]
        plain = [f if is_variable(f) else f[1] for f in query["find"] if is_variable(f) or f in pulls]
        aggregates = [f for f in query["find"] if not is_variable(f) and f not in pulls]
        if pulls and aggregates:
            raise QueryError("pull and aggregates in one find")
        for f in aggregates:
            if _is_top(f):
                continue
            if not isinstance(f, (list, tuple)) or len(f) not in (2, 3) or f[0] not in _AGGREGATES or not is_variable(f[1]):
                raise QueryError(f"not an aggregate: {f!r}")
        needed = list(dict.fromkeys([*plain, *[f[2] if _is_top(f) else f[1] for f in aggregates], *query.get("with", [])]))
        absent = [v for v in needed if v not in solved.columns]
        if absent:
            raise QueryError(f"unbound in find or with: {absent}")
        bindings = solved.select(*[F.col(f"`{v}`").alias(v[1:]) for v in needed])
        of_sets = bool(aggregates) and all(f[0] in _OF_SETS and not _is_top(f) for f in aggregates)
        if not of_sets and (wanted or not self._without_repeats(query["where"], needed)):
            bindings = bindings.distinct()
        if not aggregates:
            out = bindings.select(*[F.col(f"`{v[1:]}`") for v in plain]).distinct()
            for pull in pulls:
                out = self._pulled(out, query["where"], *pull[1:])
            return out
        groups = [v[1:] for v in plain]
        if not any(map(_is_top, aggregates)):
            made = [_AGGREGATES[f[0]](F.col(f"`{f[1][1:]}`")).alias(f[2] if len(f) == 3 else f"{f[0]}_{f[1][1:]}") for f in aggregates]
            return bindings.groupBy(*[f"`{g}`" for g in groups]).agg(*made)
        names = [f[-1] if len(f) == (4 if _is_top(f) else 3) else f"{f[0]}_{f[2 if _is_top(f) else 1][1:]}" for f in aggregates]
        made = [_AGGREGATES[f[0]](F.col(f"`{f[1][1:]}`")).alias(f"_a{k}") for k, f in enumerate(aggregates) if not _is_top(f)]
        out = bindings.groupBy(*[f"`{g}`" for g in groups]).agg(*(made or [F.count("*").alias("_n")]))
        for k, f in enumerate(aggregates):
            if _is_top(f):
                best = _top(bindings, groups, f[2][1:], f[1], f[0] == "max").withColumnRenamed("_top", f"_a{k}")
                same = [F.col(f"`{g}`").eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)]
                out = out.join(best, reduce(Column.__and__, same), "left").drop(*[f"_g{i}" for i in range(len(groups))]) if same else out.crossJoin(best)
        return out.select(*[F.col(f"`{g}`") for g in groups], *[F.coalesce(f"_a{k}", F.array()).alias(n) if _is_top(f) else F.col(f"_a{k}").alias(n) for k, (f, n) in enumerate(zip(aggregates, names, strict=True))])

    def _pulled(self, out: DataFrame, where: Sequence[object], variable: str, wanted: Sequence[object]) -> DataFrame:
        """Replace an entity variable's column by a struct of its attributes."""
        name = variable[1:]
        kinds = {_plain(str(c[1])).partition("/")[0] for c in where if isinstance(c, (list, tuple)) and len(c) >= 2 and c[0] == variable and isinstance(c[1], str)}
        if len(kinds) != 1:
            raise QueryError(f"pull needs {variable} to be of one kind, not {sorted(kinds)}")
        table, key = self.kinds[kinds.pop()]
        parts, joined = [], table
        for item in table.columns if list(wanted) == ["*"] else wanted:
            if isinstance(item, Mapping):
                ((attribute, inner),) = item.items()
                attribute = _plain(str(attribute)).rpartition("/")[2]
                target = self.kinds.get(attribute)
                if target is None or attribute not in table.columns:
                    raise QueryError(f"{attribute!r} names no kind to nest")
                other = target[0].select(F.col(target[1]).alias(f"_k_{attribute}"), F.struct(*[_plain(str(a)).rpartition("/")[2] for a in inner]).alias(f"_n_{attribute}"))
                joined = joined.join(other, F.col(attribute) == F.col(f"_k_{attribute}"), "left")
                parts.append(F.col(f"_n_{attribute}").alias(attribute))
            else:
                parts.append(F.col(_plain(str(item)).rpartition("/")[2]))
        pulled = joined.select(F.col(key).alias("_pull_key"), F.struct(*parts).alias("_pull"))
        rest = [c for c in out.columns if c != name]
        return out.join(pulled, F.col(f"`{name}`") == F.col("_pull_key")).select(*rest, F.col("_pull").alias(name))

    def scalar(self, query: Mapping[str, object] | str, *inputs: object) -> object:
        """The one value that a query finds; None where it finds nothing."""
        found = self.q(query, *inputs).head(1)
        return found[0][0] if found else None

    def row(self, query: Mapping[str, object] | str, *inputs: object) -> tuple | None:
        found = self.q(query, *inputs).head(1)
        return tuple(found[0]) if found else None

    def column(self, query: Mapping[str, object] | str, *inputs: object) -> DataFrame:
        """The first column that a query finds."""
        found = self.q(query, *inputs)
        return found.select(found.columns[0]).distinct()
