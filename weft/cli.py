"""Command line: ``python -m weft.cli TASK ...``.

Tasks: compile-schema, infer-schema, infer-json-schema, infer-metaschema, copy-schema, prepare,
create-db, load, retract, validate, crosscheck, list-dbs, delete-db.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from weft.operators import domain, entities, validate
from weft.operators.store import MAX_BATCH, MIN_BATCH, Store
from weft.plans import config, prepare, schema
from weft.sources import configs, delimited, edn, sinks


def warehouse(given: str | None) -> str:
    """Where databases live: the option, the environment, a folder here."""
    return given or os.environ.get("WEFT_WAREHOUSE") or os.path.abspath("weft-warehouse")


def read_schema(path: str) -> schema.Schema:
    """A saved schema (.json), the short form (.edn), or a folder of schema, enums and metamodel documents."""
    if os.path.isdir(path):
        return schema.from_documents(*[edn.read_file(os.path.join(path, f"{n}.edn")) for n in ("schema", "enums", "metamodel")])
    return schema.load(path) if path.endswith(".json") else schema.compile_dsl(edn.read_file(path))


def planned(spark: SparkSession, kinds: schema.Schema, path: str) -> prepare.Preparer:
    tree = configs.read_config(path)
    root = os.path.dirname(os.path.abspath(path))
    plan = config.plan(tree, kinds, root, lambda folder, pattern: delimited.files(spark, folder, pattern))
    mappings = configs.compile_mappings(configs.read_config(os.path.join(root, plan.mappings))) if plan.mappings else {}
    configs.check_mapping_enums(mappings, kinds.enums)
    return prepare.Preparer(spark, kinds, plan, mappings)


def write_schema(kinds: schema.Schema, folder: str) -> None:
    """A folder of schema, enums and metamodel documents."""
    os.makedirs(folder, exist_ok=True)
    for name, document in zip(("schema", "enums", "metamodel"), schema.to_documents(kinds), strict=True):
        with open(os.path.join(folder, f"{name}.edn"), "w", encoding="utf-8") as file:
            file.write(edn.write(document))


def read_rules(path: str | None) -> dict:
    """A document of rules, shapes, technologies and validations (JSON); without one, those of ``operators.domain``."""
    if path is None:
        return {"rules": domain.rules(), "shapes": domain.SHAPES, "technologies": domain.TECHNOLOGIES}
    with open(path, encoding="utf-8") as file:
        return json.load(file)


def check(store: Store, document: dict, import_name: str | None) -> int:
    """Print all findings; returns how many there are."""
    findings = store.validate(import_name, document.get("rules"), document.get("shapes"), document.get("technologies"))
    found = findings.limit(1000).collect()
    for r in found:
        print("\t".join("" if v is None else str(v) for v in r))
    wrong = validate.expectations(store.q, {"rules": document.get("query-rules", []), "validations": document["validations"]}) if document.get("validations") else []
    for w in wrong:
        print(f"query\t{w['name']}\tunexpected {w['unexpected']}\tmissing {w['missing']}")
    return len(found) + len(wrong)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="weft", description=__doc__)
    out.add_argument("task", choices=["compile-schema", "infer-schema", "infer-json-schema", "infer-metaschema", "copy-schema", "prepare", "create-db", "load", "retract", "validate", "crosscheck", "list-dbs", "delete-db"])
    out.add_argument("--schema", help="schema: .json, .edn short form, or a folder of documents")
    out.add_argument("--config", help="import configuration (.edn, .yaml)")
    out.add_argument("--output", help="file or folder to write")
    out.add_argument("--warehouse")
    out.add_argument("--database")
    out.add_argument("--dataset")
    out.add_argument("--import-name")
    out.add_argument("--batch-size", type=int, default=entities.BATCH, help=f"{MIN_BATCH} to {MAX_BATCH}")
    out.add_argument("--skip-annotations", action="store_true")
    out.add_argument("--continue-on-error", action="store_true")
    out.add_argument("--rules", help="validate: rules, shapes, technologies and expected query results (JSON)")
    out.add_argument("--resume", action="store_true", help="prepare: leave kinds that are already written as they are")
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    root = warehouse(args.warehouse)
    if args.task == "list-dbs":
        print("\n".join(sorted(os.listdir(root))) if os.path.isdir(root) else "")
        return 0
    if args.task != "delete-db" and not args.schema:
        sys.exit("--schema is needed")
    if args.task in ("compile-schema", "infer-schema", "infer-json-schema", "infer-metaschema", "copy-schema"):
        kinds = read_schema(args.schema)
        if args.task == "compile-schema":
            schema.save(kinds, args.output)
        elif args.task == "copy-schema":
            write_schema(kinds, args.output)
        else:
            found = {"infer-schema": schema.infer_dsl, "infer-json-schema": schema.json_schema, "infer-metaschema": schema.metaschema}[args.task](kinds)
            with open(args.output, "w", encoding="utf-8") if args.output else sys.stdout as out:
                json.dump(found, out, indent=1, sort_keys=True)
        return 0
    if not args.database and args.task != "prepare":
        sys.exit("--database is needed")
    spark = SparkSession.builder.appName("weft").getOrCreate()
    if args.task == "delete-db":
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{args.database}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        return 0
    kinds = read_schema(args.schema)
    if args.task == "prepare":
        sinks.write_entities(planned(spark, kinds, args.config).prepare(), args.output, args.resume)
        return 0
    store = Store(spark, f"{root}/{args.database}", kinds)
    if args.task == "create-db":
        print("installed" if store.install(kinds) else "as it was")
    elif args.task == "load":
        store.install(kinds)
        prepared = planned(spark, kinds, args.config)
        name = args.import_name or prepared.plan.dataset
        added = store.load(prepared.prepare(), name, args.batch_size, not args.skip_annotations, args.continue_on_error, prepared.plan.user)
        print(f"{added.count()} batches")
    elif args.task == "retract":
        print(f"{store.retract(args.dataset)} batches taken back")
    elif args.task == "crosscheck":
        store.crosscheck(planned(spark, kinds, args.config).prepare()).show(1000, False)
    else:
        return 1 if check(store, read_rules(args.rules), args.import_name) else 0
    return 0


if __name__ == "__main__":
    sys.exit(main())
