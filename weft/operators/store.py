"""The entity store: append-only tables, a ledger of committed batches, upserts, history.

Under one folder: ``rows/kind=...`` (dataset, entity, transaction, the attributes) and
``ledger`` (a row for each committed batch; written last, it is the commit marker).
A batch's id is a hash of the import, of where the batch stands and of what it holds, and
of how often the import was taken back before.  So a load that broke off is taken up
again, a second load of the same files changes nothing, a corrected file brings its
changed batches, and an import that was retracted can be loaded again.

The first batch of an import is the import itself.  A kind's table is the merge of its
rows that nothing took back; entities of reference kinds name the import that brought
them last.  Numbers are given by ranges, batches and ledger rows by distributed ranks;
the driver holds one row a stage and kind.

Reading a table never needs more than the folder of its kind.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions import exprs
from weft.operators import entities, joins, validate
from weft.operators.datalog import Views
from weft.plans.config import STAGE_IMPORT
from weft.plans.prepare import good
from weft.plans.schema import Schema, compatible, compile_dsl, infer_dsl

MIN_BATCH, MAX_BATCH = 21, 199
#: Lines of a file that one task numbers.
RANGE_LINES = 1 << 20
IMPORT = "import"


class StoreError(ValueError):
    pass


class Store:
    def __init__(self, spark: SparkSession, path: str, schema: Schema) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    # -- files ----------------------------------------------------------------------

    def _exists(self, name: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def ledger(self) -> DataFrame:
        schema = "tx_id string, import_name string, dataset string, stage int, tx long, n long, added boolean"
        return self.spark.read.schema(schema).parquet(f"{self.path}/ledger") if self._exists("ledger") else self.spark.createDataFrame([], schema)

    def _folder(self, kind: str) -> str:
        return f"rows/kind={kind}"

    def _rows(self, kind: str) -> DataFrame | None:
        """Every row ever committed of a kind."""
        if not self._exists(self._folder(kind)):
            return None
        rows = self.spark.read.parquet(f"{self.path}/{self._folder(kind)}")
        return rows.join(self.ledger().where("added").select("tx_id", "tx"), "tx_id", "left_semi")

    # -- loading ----------------------------------------------------------------------

    def key(self, kind: str) -> str:
        return "_path" if self.schema.kind(kind).scope == "context" else self.schema.kind(kind).id or "_path"

    def load(
        self, frames: Mapping[str, DataFrame], import_name: str, batch: int = entities.BATCH, annotations: bool = True, continue_on_error: bool = False, user: str | None = None
    ) -> DataFrame:
        """Load prepared frames in stage order; returns the ledger rows it added.

        A record with errors stops the load before anything is written,
        unless ``continue_on_error``, which loads the good ones.
        """
        if not MIN_BATCH <= batch <= MAX_BATCH:
            raise StoreError(f"a batch has {MIN_BATCH} to {MAX_BATCH} entities")
        found: dict[int, list[str]] = {}
        for kind, frame in frames.items():
            wrong = F.size("_errors") > 0
            first = F.min(F.when(wrong, F.struct("_file", "_line", F.array_join("_errors", "; ").alias("what"))))
            for r in frame.groupBy("_stage").agg(first.alias("first")).collect():
                found.setdefault(r._stage, []).append(kind)
                if r.first is not None and not continue_on_error:
                    raise StoreError(f"{kind}, {r.first._file}:{r.first._line}: {r.first.what}")
        top = self._top()
        attempt = self.ledger().where((F.col("import_name") == import_name) & ~F.col("added")).select("tx").distinct().count()
        self._stage({IMPORT: self._import_row(import_name, user)}, STAGE_IMPORT, import_name, batch, True, attempt)
        for stage in sorted(found):
            self._stage({kind: good(frames[kind].where(F.col("_stage") == stage)) for kind in found[stage]}, stage, import_name, batch, annotations, attempt)
        return self.ledger().where(F.col("tx") > top)

    def _top(self) -> int:
        top = self.ledger().agg(F.max("tx")).first()[0]
        return -1 if top is None else top

    def _import_row(self, import_name: str, user: str | None) -> DataFrame:
        row = self.spark.createDataFrame([(import_name, user)], "name string, user string")
        none = F.lit(None).cast("string")
        return row.select(
            F.lit(IMPORT).alias("_kind"), none.alias("_dataset"), F.col("name").alias("_path"), exprs.uid_hash(F.col("name")).alias("_uid"), none.alias("_parent"), none.alias("_file"),
            F.lit(None).cast("long").alias("_line"), F.lit(STAGE_IMPORT).alias("_stage"), F.lit(0).alias("_order"), F.array().cast("array<string>").alias("_errors"), "name", "user",
        )

    def _stage(self, frames: Mapping[str, DataFrame], stage: int, import_name: str, batch: int, annotations: bool, attempt: int) -> None:
        """Write one stage's rows, then its ledger rows."""
        committed, marks = self.ledger().select("tx_id"), []
        for kind, frame in frames.items():
            rows = self._batched(kind, frame, import_name, batch, attempt)
            if not annotations:
                rows = rows.withColumns({"_file": F.lit(None).cast("string"), "_line": F.lit(None).cast("long")})
            rows = rows.join(committed, "tx_id", "left_anti")
            folder = f"{self.path}/{self._folder(kind)}"
            if self._exists(self._folder(kind)):  # written, but not committed, by a load that broke off
                rows = rows.join(self.spark.read.parquet(folder).select("tx_id").distinct(), "tx_id", "left_anti")
            rows.write.mode("append").parquet(folder)
            fresh = self.spark.read.parquet(folder).where((F.col("_import") == import_name) & (F.col("_stage") == stage)).join(committed, "tx_id", "left_anti")
            marks.append(fresh.groupBy("tx_id").agg(F.min("_dataset").alias("dataset"), F.count("*").alias("n")))
        part = F.conv(F.substring("tx_id", 1, 3), 16, 10)  # the ids are hashes, so these ranges are even
        ranked = entities.ranked(entities.union_kinds(*marks), ["tx_id"], part=part, name="tx")
        self._append(ranked.select("tx_id", F.lit(import_name).alias("import_name"), "dataset", F.lit(stage).alias("stage"), (F.col("tx") + self._top() + 1).cast("long").alias("tx"), "n", F.lit(True).alias("added")))

    def _append(self, entries: DataFrame) -> None:
        schema = self.ledger().schema
        entries.select(*[F.col(f.name).cast(f.dataType) for f in schema]).write.mode("append").parquet(f"{self.path}/ledger")

    def _batched(self, kind: str, frame: DataFrame, import_name: str, batch: int, attempt: int) -> DataFrame:
        """Rows with the id of their batch, file by file in the order of lines."""
        content = [c for c in frame.columns if c not in ("_errors", "_stage", "_order", "_file", "_line")]
        frame = frame.withColumn("_from", F.coalesce("_file", F.lit("literal"))).withColumn("_content", F.xxhash64(*content))
        place = ["_from", "_order", "_batch"]
        numbered = entities.batches(frame, ["_line", "_path", "_content"], batch, place[:2], "_batch", F.floor(F.coalesce("_line", F.lit(0)) / RANGE_LINES))
        held = numbered.groupBy(*place).agg(F.sum(F.col("_content").cast("decimal(38,0)")).alias("_sum"), F.count("*").alias("_n"))
        key = F.concat_ws(":", F.lit(kind), *[F.col(c).cast("string") for c in (*place, "_sum", "_n")], F.lit(str(attempt)))
        ids = held.select(*place, F.sha2(F.concat_ws("/", F.lit(import_name), key), 256).alias("tx_id"))
        return numbered.join(ids, place).withColumn("_import", F.lit(import_name)).drop("_from", "_batch", "_errors", "_content")

    # -- reading -----------------------------------------------------------------------

    def table(self, kind: str) -> DataFrame | None:
        """The current entities of a kind: rows merged by identity, the last value of each attribute, sets of many."""
        spec = self.schema.kind(kind)
        rows = self._rows(kind)
        if rows is None:
            return None
        taken = self.ledger().where("NOT added").select("tx_id").distinct()
        rows = rows.join(taken, "tx_id", "left_anti").join(self.ledger().where("added").select("tx_id", "tx"), "tx_id")
        key = self.key(kind)
        keys = list(dict.fromkeys(["_dataset", key] if spec.scope == "context" else [key]))
        one = [a.name for a in spec.attributes.values() if not a.many and a.name not in keys]
        many = [a.name for a in spec.attributes.values() if a.many]
        if spec.reference_data:
            rows = rows.withColumn("_most_recent", F.col("_import"))
            one.append("_most_recent")
        return entities.upsert_merge(rows, keys, [*one, *[c for c in ("_uid", "_parent") if c not in keys]], many, ["tx", "_stage", "_order", "_file", "_line"])

    def brought_by(self, kind: str, import_name: str) -> DataFrame | None:
        """The reference entities that an import brought last; what earlier imports brought isn't judged again."""
        table = self.table(kind)
        return None if table is None else table.where(F.col("_most_recent") == import_name)

    def views(self) -> Views:
        """Kinds as relations for the query front end; the identity stands for the entity."""
        found, history = {}, []
        for kind in self.schema.kinds:
            table = self.table(kind)
            if table is not None:
                found[kind] = (table, self.key(kind))
                history.append(self.datoms(kind))
        taken = self.ledger().where("NOT added").select("tx_id").distinct()
        live = self.ledger().where("added").join(taken, "tx_id", "left_anti")
        found[IMPORT] = (self.import_entities(), "name")
        found["import-tx"] = (live.select("tx_id", "tx", F.col("import_name").alias("import"), "dataset", "n"), "tx_id")
        return Views(found, entities.union_kinds(*history) if history else None)

    def import_entities(self) -> DataFrame:
        """``name, user`` of every import that isn't taken back in whole."""
        if not self._exists(self._folder(IMPORT)):
            return self.spark.createDataFrame([], "name string, user string")
        taken = self.ledger().where("NOT added").select("tx_id").distinct()
        rows = self.spark.read.parquet(f"{self.path}/{self._folder(IMPORT)}").join(self.ledger().where("added").select("tx_id", "tx"), "tx_id").join(taken, "tx_id", "left_anti")
        return rows.groupBy("name").agg(F.max_by("user", "tx").alias("user"))

    def q(self, query: Mapping | str, *inputs: object) -> DataFrame:
        return self.views().q(query, *inputs)

    def imports(self) -> DataFrame:
        """Imports, the newest first."""
        rows = self.ledger().where("added").groupBy("import_name").agg(F.min("tx").alias("first_tx"), F.max("tx").alias("last_tx"), F.sum("n").alias("n"))
        return rows.orderBy(F.desc("last_tx"))

    def contains(self, tx_id: str) -> bool:
        return bool(self.ledger().where(F.col("tx_id") == tx_id).head(1))

    def install_seed(self, kind: str, frame: DataFrame, count: int, name: str) -> bool:
        """Load prepared seed entities unless at least ``count`` are stored; says whether it loaded."""
        stored = self.table(kind)
        if stored is not None and stored.count() >= count:
            return False
        self.load({kind: frame}, name)
        return True

    def head(self) -> dict[str, object] | None:
        """The latest committed batch."""
        found = self.ledger().orderBy(F.desc("tx")).head(1)
        return found[0].asDict() if found else None

    # -- history ------------------------------------------------------------------------

    def retract(self, dataset: str) -> int:
        """Take back the dataset's latest import (entities and reference data alike); returns the number of batches."""
        gone = self.ledger().where("NOT added").select("tx_id")
        live = self.ledger().where("added").join(gone, "tx_id", "left_anti")
        newest = live.where(F.col("dataset") == dataset).agg(F.max_by("import_name", "tx")).first()[0]
        if newest is None:
            return 0
        rows = live.where((F.col("import_name") == newest) & ((F.col("dataset") == dataset) | (F.col("stage") == STAGE_IMPORT)))
        n = rows.count()
        self._append(rows.withColumns({"tx": F.lit(self._top() + 1), "added": F.lit(False)}))
        return n

    def crosscheck(self, frames: Mapping[str, DataFrame]) -> DataFrame:
        """Reference entities that are stored with other values than an import brings."""
        out = [self.spark.createDataFrame([], "kind string, key string, attribute string, old string, new string")]
        for kind, frame in frames.items():
            spec, stored = self.schema.kind(kind), self.table(kind)
            if not spec.reference_data or stored is None:
                continue
            names = [a.name for a in spec.attributes.values() if not a.many and a.name != self.key(kind)]
            if not names:
                continue
            out.append(joins.upsert_conflicts(good(frame), stored, self.key(kind), names).select(F.lit(kind).alias("kind"), "key", "attribute", "old", "new"))
        return entities.union_kinds(*out)

    # -- checks across entities -----------------------------------------------------------

    def dangling(self) -> DataFrame:
        """References to entities that no one defined: ``kind, attribute, key, target``."""
        out = [self.spark.createDataFrame([], "kind string, attribute string, key string, target string")]
        tables = {k: t for k in self.schema.kinds if (t := self.table(k)) is not None}
        for kind, table in tables.items():
            key = self.key(kind)
            for a in self.schema.kind(kind).attributes.values():
                if not a.ref_to:
                    continue
                refs = table.select(F.col(key).cast("string").alias("key"), (F.explode(a.name) if a.many else F.col(a.name)).alias("target")).where("target IS NOT NULL")
                if a.ref_to in tables:
                    refs = joins.dangling(refs, "target", tables[a.ref_to].withColumn("_t", F.col(self.key(a.ref_to)).cast("string")), "_t")
                out.append(refs.select(F.lit(kind).alias("kind"), F.lit(a.name).alias("attribute"), "key", F.col("target").cast("string").alias("target")))
        return entities.union_kinds(*out)

    def invalid_uids(self) -> DataFrame:
        out = [self.spark.createDataFrame([], "kind string, path string")]
        for kind, spec in self.schema.kinds.items():
            if spec.scope == "context" and (table := self.table(kind)) is not None:
                out.append(table.where(exprs.invalid_uid(F.col("_path"))).select(F.lit(kind).alias("kind"), F.col("_path").alias("path")))
        return entities.union_kinds(*out)

    def annotations(self, kind: str) -> DataFrame | None:
        """Where each entity came from: key, file, first and last line."""
        rows = self._rows(kind)
        if rows is None:
            return None
        key = F.col(self.key(kind)).cast("string").alias("key")
        return rows.where("_line IS NOT NULL").groupBy(key, "_file").agg(F.min("_line").alias("first_line"), F.max("_line").alias("last_line"))

    def datoms(self, kind: str) -> DataFrame | None:
        """A kind's history as entity, attribute, value, transaction, added; many values are a row each."""
        rows = self._rows(kind)
        if rows is None:
            return None
        plain = [a for a in self.schema.kind(kind).attributes.values() if not a.tuple_of]
        marks = self.ledger().select("tx_id", "tx", "added")
        values = [F.transform(F.col(a.name), lambda v: v.cast("string")) if a.many else F.array(F.col(a.name).cast("string")) for a in plain]

        def named(ident: str, value: Column) -> Column:
            return F.transform(F.coalesce(value, F.array().cast("array<string>")), lambda x: F.struct(F.lit(ident).alias("a"), x.alias("v")))

        pairs = F.flatten(F.array(*[named(a.ident, v) for a, v in zip(plain, values, strict=True)]))
        flat = rows.join(marks, "tx_id").select(F.col(self.key(kind)).cast("string").alias("e"), F.explode(pairs).alias("_p"), "tx", "added")
        return flat.select("e", "_p.a", "_p.v", "tx", "added").where("v IS NOT NULL")

    # -- schema ------------------------------------------------------------------------------

    def install(self, schema: Schema) -> bool:
        """Keep the schema beside the rows if it changes what is there; says whether it did.

        What is installed must be of the same major and minor version, and the new schema
        must have all of its attributes, of the same type and cardinality.
        """
        installed = self.installed()
        if installed is not None:
            compatible(installed.version, schema.version)
            changed = {i for i, a in installed.attributes.items() if i not in schema.attributes or (schema.attributes[i].type, schema.attributes[i].many) != (a.type, a.many)}
            if changed:
                raise StoreError(f"attributes would change or go: {sorted(changed)}")
            if installed == schema:
                return False
        text = json.dumps({"version": schema.version, "kinds": infer_dsl(schema)}, sort_keys=True)
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/schema")
        self.schema = schema
        return True

    def installed(self) -> Schema | None:
        if not self._exists("schema/_SUCCESS"):
            return None
        found = json.loads(self.spark.read.text(f"{self.path}/schema", wholetext=True).first().value)
        return Schema(compile_dsl(found["kinds"]).kinds, found["version"])

    # -- everything at once --------------------------------------------------------------------

    def validate(self, import_name: str | None = None, rules: Mapping[str, Sequence] | None = None, shapes: Mapping[str, Mapping] | None = None, technologies: Mapping[str, Mapping] | None = None) -> DataFrame:
        """All findings across the store: ``check, kind, key, what, file, first_line, last_line``.

        Reference kinds are judged for the entities that ``import_name`` (by default the
        newest import) brought last, others in whole.  Rules, shapes and technologies are
        documents as ``operators.domain`` has them.
        """
        newest = self.imports().head(1)
        import_name = import_name or (newest[0].import_name if newest else None)
        out = [self.spark.createDataFrame([], "check string, kind string, key string, what string")]

        def found(check: str, kind: str, key: str, what: object, df: DataFrame) -> None:
            what = F.col(what) if isinstance(what, str) else what
            out.append(df.select(F.lit(check).alias("check"), F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), what.cast("string").alias("what")))

        for kind, spec in self.schema.kinds.items():
            table = self.table(kind)
            if table is None:
                continue
            key = self.key(kind)
            own = table if not spec.reference_data else table.where(F.col("_most_recent") == import_name)
            names = [a.name for a in spec.attributes.values()]
            own = own.withColumns({a.name: F.when(F.size(a.name) > 0, F.col(a.name)) for a in spec.attributes.values() if a.many})  # an empty set is none
            mine = {a: rules[f"{kind}/{a}"] for a in names if rules and f"{kind}/{a}" in rules}
            mine = {a: r for a, r in mine.items() if r[0] != "composite_of" or set(r[2:]) <= set(names)}
            if mine:
                broken = own.select(key, F.explode(validate.attribute_errors(mine)).alias("_e"))
                found("rule", kind, key, F.concat_ws(" ", "_e.attribute", F.lit("is not"), "_e.rule", "_e.value"), broken)
            if shapes and kind in shapes:
                shaped = own.withColumn("uid", F.col("_uid")) if spec.scope == "context" and "uid" not in names else own
                found("shape", kind, key, "_e", shaped.select(key, F.explode(validate.shape_errors(shaped, shapes[kind], [c for c in shaped.columns if not c.startswith("_")])).alias("_e")))
        for r, what in ((self.dangling(), F.concat_ws(" ", F.lit("no"), "attribute", "target")), (self.invalid_uids().withColumnRenamed("path", "key"), F.lit("no proper identity"))):
            out.append(r.select(F.lit("reference" if "target" in r.columns else "identity").alias("check"), "kind", "key", what.alias("what")))
        out.append(self._shared_keys())
        if technologies:
            out.append(self._technologies(technologies))
        findings = entities.union_kinds(*out)
        places = [p.withColumn("kind", F.lit(k)) for k in self.schema.kinds if (p := self.annotations(k)) is not None]
        if not places:
            return findings
        lines = entities.union_kinds(*places).groupBy("kind", "key").agg(F.min("_file").alias("file"), F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"))
        return findings.join(lines, ["kind", "key"], "left").select("check", "kind", "key", "what", "file", "first_line", "last_line")

    def _shared_keys(self) -> DataFrame:
        """Identities of global kinds that entities of more than one kind have."""
        keys = [t.select(F.col(self.key(k)).cast("string").alias("e"), F.lit(f"{k}/id").alias("a")) for k, s in self.schema.kinds.items() if s.scope == "context" and (t := self.table(k)) is not None]
        if not keys:
            return self.spark.createDataFrame([], "check string, kind string, key string, what string")
        found = validate.namespace_collisions(entities.union_kinds(*keys))
        return found.select(F.lit("namespace").alias("check"), F.get("kinds", F.lit(0)).alias("kind"), F.col("e").alias("key"), F.concat(F.lit("is of "), F.array_join("kinds", ", ")).alias("what"))

    def _technologies(self, technologies: Mapping[str, Mapping]) -> DataFrame:
        """Measurements that their assay's technology doesn't yield; parents are found by path."""
        tables = [self.table(k) if k in self.schema.kinds else None for k in ("measurement", "assay")]
        if any(t is None for t in tables) or "technology" not in self.schema.kind("assay").attributes:
            return self.spark.createDataFrame([], "check string, kind string, key string, what string")
        measurements, assays = tables
        assay = F.split_part(F.col("_path"), F.lit(exprs.PATH_SEPARATOR), F.lit(1))
        known = assays.select(F.col("_dataset").alias("_d"), F.col("_path").alias("_a"), "technology")
        joined = measurements.drop("technology").join(known, (F.col("_dataset") == F.col("_d")) & (assay == F.col("_a")), "left")
        found = validate.measured_technologies(joined, technologies)
        return found.select(F.lit("technology").alias("check"), F.lit("measurement").alias("kind"), F.col("_path").alias("key"), F.concat_ws(" ", "rule", F.lit("with"), "technology").alias("what"))
