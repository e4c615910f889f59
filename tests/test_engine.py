"""Configuration to store, on small inline fixtures."""

import pytest

from weft.plans import config, prepare, schema
from weft.operators.store import Store, StoreError
from weft.sources import configs, delimited, edn, parsers
from weft.streaming import incremental

DSL = """
{:dataset {:id {:type :string :attribute :name :scope :global} :attributes [[:description :string :cardinality-one ""]]}
 :subject {:id {:type :string :attribute :id :scope :context} :parent :dataset
           :attributes [[:sex {:enum-of [:male :female]} :cardinality-one "sex"] [:age :long :cardinality-one ""] [:hla :string :cardinality-many ""]
                        [:therapies {:ref-to :therapy} :cardinality-many ""] [:smoker :boolean :cardinality-one ""]]}
 :therapy {:id {:type :string :attribute :order :scope :context} :parent :subject
           :attributes [[:regimen {:ref-to :regimen} :cardinality-one ""]]}
 :regimen {:id {:type :string :attribute :name :scope :context} :parent :dataset}
 :assay {:id {:type :string :attribute :name :scope :context} :parent :dataset :attributes [[:technology {:enum-of [:elisa :pcr]} :cardinality-one ""]]}
 :measurement-set {:id {:type :string :attribute :name :scope :context} :parent :assay}
 :population {:id {:type :string :attribute :name :scope :context} :parent :measurement-set}
 :measurement {:id {:type :string :attribute :id :scope :context} :parent :measurement-set :synthetic-id [:subject :population]
               :attributes [[:subject {:ref-to :subject} :cardinality-one ""] [:population {:ref-to :population} :cardinality-one ""] [:gene {:ref-to :gene} :cardinality-one ""]
                            [:count :long :cardinality-one ""] [:percent :double :cardinality-one ""] [:weights {:tuple-of [:string :double]} :cardinality-many ""]]}
 :matrix {:id {:type :string :attribute :name :scope :context} :parent :measurement-set
          :attributes [[:subjects {:ref-to :subject} :cardinality-many ""] [:genes {:ref-to :gene} :cardinality-many ""]]}
 :gene {:id {:type :string :attribute :symbol :scope :global} :reference-data true :attributes [[:alias {:ref-to :gene} :cardinality-one ""] [:coordinate {:ref-to :coordinate} :cardinality-one ""]]}
 :coordinate {:id {:type :string :attribute :id :scope :global} :reference-data true}}
"""

CONFIG = """
{:job/import {:user "me" :mappings "mappings.edn"}
 :coordinate [{:id "c1"}]
 :gene [{:job/input-csv-file "genes.csv" :symbol "Symbol" :coordinate "Coord" :job/na ""}]
 :dataset {:name "d1"
           :subjects [{:job/input-tsv-file "subjects.tsv" :job/na ["NA"] :job/omit-if-na [:subject/age]
                       :id "ID" :sex "Sex" :age "Age (years)" :smoker "Smokes" :hla {:job/many-delimiter ";" :job/many-variable "HLA"}}]
           :regimens [{:name "A"} {:name "B"}]
           :therapies [{:job/input-tsv-file "therapies.tsv" :order "order" :regimen "arm" :job/reverse {:job/rev-variable "ID" :job/rev-attr :subject/therapies}}]
           :assays [{:name "cyto" :technology :assay.technology/elisa
                     :measurement-sets [{:name "m1" :populations [{:name "p1"} {:name "p2"}]
                                         :measurements [{:job/input-tsv-file #glob ["." "cells_*.tsv"] :subject "ID" :population "pop" :job/variable "var" :job/value "val"
                                                         :job/variables {"n" :measurement/count "pct" :measurement/percent} :job/constants {:gene "TP53"} :weights ["pop" "w"]}]
                                         :matrixs [{:name "x" :job.matrix/input-file "dense.tsv" :job.matrix/format :dense :job.matrix/value-type :long
                                                    :job.matrix/column-attribute :matrix/genes :job.matrix/indexed-by {"ID" :matrix/subjects}}]}]}]}}
"""

FILES = {
    "mappings.edn": '{:job/mappings {:enum/sex {:subject.sex/male ["M" "m"] :subject.sex/female "F"} :yes {true ["yes"] false ["no"]}} :job/variables {:subject/sex :enum/sex :subject/smoker :yes}}',
    "genes.csv": "Symbol,Coord\nTP53,c1\n KRAS ,\n",
    "subjects.tsv": "ID\tSex\tAge (years)\tSmokes\tHLA\ns1\tM\t30\tyes\ta;b;b;;\ns2\tF\t41\tno\t\ns3\tm\tNA\tno\tc\n",
    "therapies.tsv": "ID\torder\tarm\ns1\t1\tA\ns1\t2\tB\ns2\t1\tA\n",
    "cells_1.tsv": "ID\tpop\tvar\tval\tw\ns1\tp1\tn\t12\t0.5\ns1\tp1\tpct\t0.25\t0.5\n",
    "cells_2.tsv": "ID\tpop\tvar\tval\tw\ns2\tp2\tn\t7\t1\n",
    "dense.tsv": "ID\tTP53\tKRAS\ns1\t1\t2\ns2\tNA\t3.5\n",
}


@pytest.fixture(scope="session")
def kinds():
    return schema.compile_dsl(edn.read(DSL))


def prepared(spark, folder, kinds, files=None, text=CONFIG, rules=None):
    for name, body in {**FILES, **(files or {})}.items():
        (folder / name).write_text(body)
    (folder / "config.edn").write_text(text)
    tree = configs.read_config(str(folder / "config.edn"))
    mappings = configs.compile_mappings(configs.read_config(str(folder / "mappings.edn")))
    plan = config.plan(tree, kinds, str(folder), lambda where, pattern: delimited.files(spark, where, pattern))
    return prepare.Preparer(spark, kinds, plan, mappings, rules).prepare()


@pytest.fixture(scope="session")
def frames(spark, tmp_path_factory, kinds):
    return {k: f.cache() for k, f in prepared(spark, tmp_path_factory.mktemp("import"), kinds).items()}


def test_dsl_round_trip(kinds):
    assert schema.compile_dsl(schema.infer_dsl(kinds)).kinds == kinds.kinds
    assert kinds.reference_order() == ["coordinate", "gene"]  # a gene may refer to genes
    assert kinds.attributes["subject/sex"].enum == ("subject.sex/male", "subject.sex/female")
    assert schema.metaschema(kinds)["joins"]["measurement/subject"] == "subject"
    found = schema.json_schema(kinds)["definitions"]["subject"]["properties"]
    assert "array" not in str(found["age"]) and "array" in str(found["hla"])
    with pytest.raises(schema.SchemaError):
        schema.compile_dsl({"a": {"id": {"attribute": "x", "scope": "odd"}}})
    assert schema.compatible("1.2.3", "1.2.9") == "upgrade" and schema.compatible("1.2.3", "1.2.3") == "same"
    with pytest.raises(schema.SchemaError):
        schema.compatible("1.2.3", "1.3.0")


def test_tidy_mapped_and_split(frames):
    found = {r.id: r for r in frames["subject"].collect()}
    assert set(found) == {"s1", "s2"}  # s3 lacks its age
    assert found["s1"].hla == ["a", "b"] and found["s2"].hla == [""] and found["s1"].smoker is True
    assert found["s1"].sex == "subject.sex/male" and found["s2"].age == 41
    assert found["s1"]._path == "s1" and found["s1"]._line == 2 and not found["s1"]._errors


def test_reverse_reference_and_long_rows(frames):
    assert sorted(r._path for r in frames["therapy"].collect()) == ["s1|:~1", "s1|:~2", "s2|:~1"]
    found = sorted(frames["measurement"].collect(), key=lambda r: (r._file, r._line))
    assert [r._path for r in found] == ["cyto|:~m1|:~s1-p1"] * 2 + ["cyto|:~m1|:~s2-p2"]
    assert [(r["count"], r.percent) for r in found] == [(12, None), (None, 0.25), (7, None)]
    assert found[0].population == "cyto|:~m1|:~p1" and found[0].subject == "s1" and found[0].gene == "TP53"
    assert found[0].weights[0]["_2"] == 0.5


def test_matrix(frames):
    found = frames["matrix"].first()
    assert found.genes == ["KRAS", "TP53"] and found.subjects == ["s1", "s2"] and found._path == "cyto|:~m1|:~x"
    assert found._errors == ["not a long: 3.5"]


def test_load_resume_query_retract(spark, tmp_path, kinds, frames):
    store = Store(spark, str(tmp_path / "store"), kinds)
    some = {k: f for k, f in frames.items() if k != "matrix"}
    with pytest.raises(StoreError, match="3.5"):
        store.load(frames, "broken")
    first = store.load(some, "i1").count()
    assert first > 0 and store.load(some, "i1").count() == 0
    merged = {r._path: r for r in store.table("measurement").collect()}
    assert merged["cyto|:~m1|:~s1-p1"]["count"] == 12 and merged["cyto|:~m1|:~s1-p1"].percent == 0.25 and len(merged) == 2
    assert store.dangling().count() == 0 and store.invalid_uids().count() == 0
    found = store.q({"find": ["?r", ["count", "?t", "n"]], "where": [["?t", "therapy/regimen", "?r"]]}).collect()
    assert {(r.r, r.n) for r in found} == {("A", 2), ("B", 1)}
    assert store.annotations("measurement").where("key like '%s1-p1'").first().last_line == 3
    assert store.imports().first().import_name == "i1"
    assert store.datoms("gene").where("a = 'gene/symbol'").count() == 2
    assert store.retract("d1") > 0 and store.table("subject").count() == 0 and store.retract("d1") == 0
    assert store.load(some, "i2").count() == first and store.table("subject").count() == 2


def test_dangling_and_crosscheck(spark, tmp_path, kinds, frames):
    store = Store(spark, str(tmp_path / "store"), kinds)
    store.load({k: frames[k] for k in ("gene", "coordinate", "subject", "regimen")}, "i1")
    (tmp_path / "more").mkdir()
    other = prepared(spark, tmp_path / "more", kinds, {"genes.csv": "Symbol,Coord\nTP53,c9\n", "therapies.tsv": "ID\torder\tarm\ns9\t1\tZ\n"})
    assert [tuple(r) for r in store.crosscheck(other).collect()] == [("gene", "TP53", "coordinate", "c1", "c9")]
    store.load({k: other[k] for k in ("therapy",)}, "i2")
    assert [(r.attribute, r.target) for r in store.dangling().collect()] == [("regimen", "Z")]


def test_bad_records(spark, tmp_path, kinds):
    files = {"subjects.tsv": "ID\tSex\tAge (years)\tSmokes\tHLA\ns1\tX\t1.5\tmaybe\ta\ns2\tF\t1\nS\tM\t200\tno\t\n"}
    found = prepared(spark, tmp_path, kinds, files, rules={"subject/age": ("between", 0, 120)})["subject"].orderBy("_line").collect()
    assert len(found[0]._errors) == 3 and "wrong width" in found[1]._errors[0] and found[2]._errors == ["subject/age is not between: 200"]


def test_plans_that_are_refused(spark, tmp_path, kinds):
    for old, new in ((':sex "Sex"', ':sexx "Sex"'), (':job/variable "var"', ""), ("#glob", "#globb"), ('"cells_*', '"no_*'), (":job/import", ":job/other"), (':subject "ID"', ':subject "IDD"')):
        with pytest.raises((ValueError, FileNotFoundError)):
            prepared(spark, tmp_path, kinds, text=CONFIG.replace(old, new, 1))


def test_yaml_is_the_same_tree(tmp_path):
    (tmp_path / "a.edn").write_text('{:job/import {:user "u"} :dataset {:name "d" :samples [{:job/input-tsv-file #glob ["x" "*.t"] :type :s/a :job/variables {"k" :m/v}}]}}')
    (tmp_path / "a.yaml").write_text('job/import: {user: u}\ndataset:\n  name: d\n  samples:\n    - job/input-tsv-file: {glob: [x, "*.t"]}\n      type: ":s/a"\n      job/variables: {k: ":m/v"}\n')
    assert configs.read_config(str(tmp_path / "a.edn")) == configs.read_config(str(tmp_path / "a.yaml"))
    with pytest.raises(ValueError):
        configs.read_config("a.json")


def test_scans_agree(spark, tmp_path):
    path = tmp_path / "q.tsv"
    path.write_text('a\tb\n"x ""y"""\t 1 \n"two\nlines"\t\nshort\nlong\t1\t2\n')
    one = [(r.a, r.b, r._bad is not None) for r in delimited.native(spark, str(path), ["a", "b"]).collect()]
    two = [(r.a or "", r.b or "", r._bad is not None) for r in delimited.numbered(spark, [str(path)], ["a", "b"]).orderBy("_line").collect()]
    assert two[:2] == one[:2] == [('x "y"', "1", False), ("two\nlines", "", False)]
    assert [x[2] for x in one] == [x[2] for x in two] == [False, False, True, True]


def test_reference_parsers(spark, tmp_path):
    (tmp_path / "o.obo").write_text('format-version: 1.2\n\n[Term]\nid: CL:1\nname: cell ! x\ndef: "a \\"b\\" c" [r]\nis_a: CL:0 ! root\n\n[Typedef]\nid: part_of\nname: p\n\n[Term]\nid: GO:2\nname: other\n\n[Term]\nid: CL:9\n')
    terms = parsers.obo_terms(spark, str(tmp_path / "o.obo"))
    assert sorted(r.id for r in terms.collect()) == ["CL:1", "GO:2"]
    cell = parsers.cell_types(terms).first()
    assert (cell.name, cell.is_a) == ("cell", ["CL:0"])
    (tmp_path / "f.txt").write_text("001ASPIRIN  x\n002          \n")
    assert [tuple(r) for r in parsers.fixed_width(spark, str(tmp_path / "f.txt"), {"code": (1, 3), "name": (4, 9)}).collect()] == [("001", "ASPIRIN"), ("002", None)]
    (tmp_path / "d.txt").write_text("1$flu$$\n2$cold\n")
    assert [tuple(r) for r in parsers.dollar(spark, str(tmp_path / "d.txt"), ["id", "name"]).collect()] == [("1", "flu"), ("2", "cold")]
    (tmp_path / "p.xml").write_text("<u><entry><name>A</name></entry><entry><name>B</name></entry></u>")
    assert parsers.xml_entries(spark, str(tmp_path / "p.xml")).count() == 2
    rows = spark.createDataFrame([("1", "+", "5", "9"), ("2", "-", " ", "9")], "contig string, strand string, start string, end string")
    assert [r.id for r in parsers.coordinates(rows, "G38").collect()] == ["G38:1:+:5:9"]


def test_files_that_arrive_later(spark, tmp_path):
    (tmp_path / "in").mkdir()
    seen = []
    for k in range(2):
        (tmp_path / "in" / f"{k}.tsv").write_text(f"id\n{k}\n")
        incremental.available_now(spark, str(tmp_path / "in"), "id string", str(tmp_path / "cp"), lambda df, _: seen.extend(r.id for r in df.collect()))
    assert seen == ["0", "1"]


def test_command_line(tmp_path, capsys):
    from weft import cli

    (tmp_path / "s.edn").write_text(DSL)
    assert cli.main(["compile-schema", "--schema", str(tmp_path / "s.edn"), "--output", str(tmp_path / "s.json")]) == 0
    assert cli.read_schema(str(tmp_path / "s.json")).kinds == cli.read_schema(str(tmp_path / "s.edn")).kinds
    assert cli.main(["infer-metaschema", "--schema", str(tmp_path / "s.json"), "--output", str(tmp_path / "m.json")]) == 0
    assert '"therapy/regimen": "regimen"' in (tmp_path / "m.json").read_text()
    (tmp_path / "w" / "db1").mkdir(parents=True)
    assert cli.main(["list-dbs", "--warehouse", str(tmp_path / "w")]) == 0 and "db1" in capsys.readouterr().out


def test_queries_that_are_refused(spark):
    from weft.operators.datalog import QueryError, Views

    views = Views({"a": (spark.createDataFrame([(1, 2), (2, 3)], "id int, b int"), "id")})
    assert views.scalar({"find": [["count", "?x"]], "where": [["?x", "a/b", "_"]]}) == 2
    assert views.row({"find": ["?x", "?y"], "where": [["?x", "a/b", "?y"], [["=", "?y", 3]]]}) == (2, 3)
    for where in ([["?x", "c/b", "?y"]], [["?x", "a/z", "?y"]], [["?x", "a/b", "?y"], ["?z", "a/b", "?w"]], [[">", "?x", 1]], [["?x", "a/b", "?y"], [["~", "?y", 1]]], []):
        with pytest.raises(QueryError):
            views.q({"find": ["?x"], "where": where})
    rules = [[["up", "?x", "?y"], ["up", "?y", "?x"]]]
    with pytest.raises(QueryError):
        views.q({"find": ["?x"], "in": ["%"], "where": [["up", "?x", "?y"]]}, rules)


def test_largest_and_smallest_values(spark):
    from weft.operators.datalog import QueryError, Views

    views = Views({"a": (spark.createDataFrame([(1, 2, "x"), (2, 3, "x"), (3, 9, "x"), (4, 5, "y")], "id int, b int, c string"), "id")})
    where = [["?e", "a/b", "?b"], ["?e", "a/c", "?c"]]
    found = views.q({"find": ["?c", ["max", 2, "?b"], ["count", "?b", "n"], ["min", 2, "?b", "low"]], "where": where})
    assert found.columns == ["c", "max_b", "n", "low"]
    assert sorted(map(tuple, found.collect())) == [("x", [9, 3], 3, [2, 3]), ("y", [5], 1, [5])]
    assert [tuple(r) for r in views.q({"find": [["max", 1, "?b"]], "where": where}).collect()] == [([9],)]
    with pytest.raises(QueryError):
        views.q({"find": [["max", 0, "?b"]], "where": where})


def test_prepare_resumes(spark, tmp_path, monkeypatch):
    from types import SimpleNamespace

    from weft import cli

    (tmp_path / "s.edn").write_text(DSL)
    args = ["prepare", "--schema", str(tmp_path / "s.edn"), "--config", "c", "--output", str(tmp_path / "out")]

    def run(value, *more):
        monkeypatch.setattr(cli, "planned", lambda *a: SimpleNamespace(prepare=lambda: {k: spark.range(value, value + 1) for k in ("p", "q")}))
        assert cli.main([*args, *more]) == 0
        return [spark.read.parquet(str(tmp_path / "out" / k)).first().id for k in ("p", "q")]

    assert run(1) == [1, 1]
    (tmp_path / "out" / "q" / "_SUCCESS").unlink()
    assert run(2, "--resume") == [1, 2]
    assert run(3) == [3, 3]


def test_scan_numbers_lines_of_split_files(spark, tmp_path):
    """Files cut into many blocks, of several layouts, with quoted cells that span lines."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for k in range(2):
        (tmp_path / f"{k}.tsv").write_text("a\tb\n" + "".join(f"{i}\tx{k}-{i}\n" for i in range(3000)))
    (tmp_path / "2.tsv").write_text('\ufeffb\ta\n"x ""y"""\t 1 \n\nshort\nlong\t1\t2\n')
    (tmp_path / "3.tsv").write_text('a\tb\tc\n"two\nlines"\t\tz\n')
    paths = [str(tmp_path / f"{k}.tsv") for k in range(4)]
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
        found = delimited.scan(spark, paths, "\t", ["a", "b"])
        rows = found.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    own = {k: [r for r in rows if r._file.endswith(f"{k}.tsv")] for k in range(4)}
    for k in range(2):
        assert sorted((int(r.a), r.b, r._line) for r in own[k]) == [(i, f"x{k}-{i}", i + 2) for i in range(3000)]
    assert sorted((r._line, r.a, r.b, r._bad) for r in own[2]) == [(2, "1", 'x "y"', None), (3, None, None, ""), (4, None, None, "short"), (5, None, None, "long\t1\t2")]
    assert [(r.a, r.b, r.c, r._bad) for r in own[3]] == [("two\nlines", "", "z", None)]
    with pytest.raises(ValueError, match="no column"):
        delimited.scan(spark, paths[:1], "\t", ["a", "z"])


def test_large_mappings_are_joined(spark, tmp_path, kinds):
    pairs = " ".join(f'"c{i}" ["raw{i}" "alt{i}"]' for i in range(1200))
    mapping = "{:job/mappings {:big {%s}} :job/variables {:subject/id :big}}" % pairs
    files = {"mappings.edn": mapping, "subjects.tsv": "ID\tSex\tAge (years)\tSmokes\tHLA\nraw7\tsubject.sex/male\t30\ttrue\ta\nalt9\tsubject.sex/male\t30\ttrue\ta\nzz\tsubject.sex/male\t30\ttrue\ta\n"}
    found = {r._line: r for r in prepared(spark, tmp_path, kinds, files)["subject"].collect()}
    assert (found[2].id, found[3].id, found[4].id) == ("c7", "c9", None)
    assert any("no mapping for zz" in e for e in found[4]._errors) and not found[2]._errors


def test_corrected_files_and_reloads(spark, tmp_path, kinds, frames):
    store = Store(spark, str(tmp_path / "store"), kinds)
    some = {k: frames[k] for k in ("gene", "coordinate", "subject")}
    first = store.load(some, "i1", user="me").count()
    assert store.import_entities().collect()[0].asDict() == {"name": "i1", "user": "me"}
    assert store.ledger().where("tx = 0").first().stage == 0  # the import itself comes first
    from pyspark.sql import functions as F

    corrected = {"subject": frames["subject"].withColumn("age", F.when(F.col("id") == "s1", F.lit(31)).otherwise(F.col("age")))}
    assert store.load(corrected, "i1", user="me").count() == 1
    assert {r.id: r.age for r in store.table("subject").collect()} == {"s1": 31, "s2": 41}
    assert store.retract("d1") > 0 and store.table("subject").count() == 0 and not store.import_entities().count()
    assert store.load(some, "i1", user="me").count() == first
    assert {r.id: r.age for r in store.table("subject").collect()} == {"s1": 30, "s2": 41}
    txs = [r.tx for r in store.ledger().where("added").collect()]
    assert len(txs) == len(set(txs))
    assert {r._most_recent for r in store.table("gene").collect()} == {"i1"} and store.brought_by("gene", "i0").count() == 0


def test_transactions_in_queries(spark, tmp_path, kinds, frames):
    store = Store(spark, str(tmp_path / "store"), kinds)
    store.load({"gene": frames["gene"]}, "i1")
    store.load({"subject": frames["subject"]}, "i2")
    last = store.scalar if hasattr(store, "scalar") else store.views().scalar
    start = last({"find": [["max", "?t", "t"]], "where": [["?x", "import-tx/tx", "?t"], ["?x", "import-tx/import", "i1"]]})
    later = store.q({"find": ["?e"], "where": [["?e", "?a", "_", "?tx"], [[">", "?tx", start]]]}).collect()
    assert {r.e for r in later} == {"s1", "s2"}
    both = store.q({"find": ["?e", "?a"], "in": [[["?a", "?v"]]], "where": [["?e", "?a", "?v"]]}, [("subject/hla", "a"), ("gene/symbol", "TP53")]).collect()
    assert {(r.e, r.a) for r in both} == {("s1", "subject/hla"), ("TP53", "gene/symbol")}


def test_blanks_are_not_each_other(spark):
    from weft.operators.datalog import Views

    views = Views({"a": (spark.createDataFrame([(1, "x", None), (2, None, "x")], "id int, b string, c string"), "id")})
    assert [r.v for r in views.q({"find": ["?v"], "where": [["_", "a/b", "?v"], ["_", "a/c", "?v"]]}).collect()] == ["x"]


def test_conflicts_only_for_what_is_brought(spark):
    from weft.operators import joins

    rows = lambda *r: spark.createDataFrame(list(r), "k string, a string, b string")
    found = joins.upsert_conflicts(rows(("1", "x", None), ("2", "new", "z")), rows(("1", "x", "kept"), ("2", "old", "z")), "k", ["a", "b"])
    assert [tuple(r) for r in found.collect()] == [("2", "a", "old", "new")]


def test_rules_of_the_domain(spark):
    from weft.operators import domain, validate

    assert set(validate.AMINO_ACIDS) == set("ARNDCEQGHILKMFPSTWYVBZX")
    row = spark.createDataFrame([("AR*",), ("ARN",)], "s string")
    assert [len(r[0]) for r in row.select(validate.attribute_errors({"s": ("alphabet",)})).collect()] == [1, 0]
    known = set(validate.RULES)
    assert all(rule[0] in known for rule in domain.rules().values())
    shapes = domain.SHAPES
    names = "id string, uid string, sample string, variant string, vaf double, tpm double, alpha string"
    rows = spark.createDataFrame([("1", "u", "s", "v", 0.1, None, None), ("2", "u", "s", None, 0.1, None, None), ("3", "u", "s", None, None, None, None), ("4", "u", None, "v", 0.1, None, None)], names)
    found = [r[0] for r in rows.select(validate.shape_errors(rows, shapes["measurement"], rows.columns)).collect()]
    assert found[0] == [] and found[1][0].startswith("fits none") and found[2] == ["no value"] and found[3][0] == "no sample"
    one_of = spark.createDataFrame([("n", "u", "m", None), ("n", "u", None, None)], "name string, uid string, measurements string, `measurement-matrices` string")
    assert [len(r[0]) for r in one_of.select(validate.shape_errors(one_of, {"required": ["name"], "one_of": [["measurements"], ["measurement-matrices"]]}, ["measurements", "measurement-matrices", "name"])).collect()] == [0, 1]


def test_expected_rows_of_queries(spark):
    from weft.operators import validate
    from weft.operators.datalog import Views

    views = Views({"s": (spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, arm string"), "id")})
    count = {"find": ["?a", ["count", "?s", "n"]], "where": [["?s", "s/arm", "?a"]]}
    rule = {"find": ["?a"], "in": ["%"], "where": [["arms", "?a"]]}
    document = {
        "rules": [[["arms", "?a"], ["?s", "s/arm", "?a"]]],
        "validations": [
            {"name": "right", "query": count, "allowed": [["a", 2], ["b", 1]]}, {"name": "wrong", "query": count, "allowed": [["a", 3], ["b", 1]]},
            {"name": "same", "query": rule, "allowed": {"find": ["?a"], "where": [["_", "s/arm", "?a"]]}}, {"name": "few", "query": rule, "allowed": [["a"]]},
        ],
    }
    found = {f["name"]: f for f in validate.expectations(views.q, document)}
    assert set(found) == {"wrong", "few"} and found["wrong"]["unexpected"] == [("a", 2)] and found["wrong"]["missing"] == [("a", 3)] and found["few"]["unexpected"] == [("b",)]


def test_schema_documents_and_installing(spark, tmp_path, kinds):
    from dataclasses import replace

    from weft import cli

    cli.write_schema(kinds, str(tmp_path / "docs"))
    back = cli.read_schema(str(tmp_path / "docs"))
    assert schema.infer_dsl(back) == schema.infer_dsl(kinds)
    store = Store(spark, str(tmp_path / "store"), kinds)
    assert store.install(kinds) and not store.install(kinds)
    more = schema.compile_dsl({**schema.infer_dsl(kinds), "extra": {"id": {"type": "string", "attribute": "x", "scope": "global"}}})
    assert store.install(more) and store.installed() == more
    with pytest.raises(StoreError, match="change or go"):
        store.install(kinds)
    with pytest.raises(schema.SchemaError):
        store.install(replace(more, version="2.0.0"))


def test_files_that_an_import_leaves(spark, tmp_path):
    from weft.sources import sinks

    rows = spark.createDataFrame([(i, f"v{i}") for i in range(120)], "id long, v string")
    assert sinks.write_entities({"a": rows, "b": rows}, str(tmp_path / "out")) == ["a", "b"]
    assert sinks.write_entities({"a": rows, "b": rows}, str(tmp_path / "out"), resume=True) == []
    (tmp_path / "out" / "b" / "_SUCCESS").unlink()
    assert sinks.write_entities({"a": rows, "b": rows}, str(tmp_path / "out"), resume=True) == ["b"]
    batched = sinks.write_batches(rows, str(tmp_path / "tx"), "i1", ["id"], 50)
    sizes = {r.tx_id: r["count"] for r in batched.groupBy("tx_id").count().collect()}
    assert sorted(sizes.values()) == [20, 50, 50] and all(len(t) == 64 for t in sizes)
    again = sinks.write_batches(rows.repartition(7), str(tmp_path / "tx2"), "i1", ["id"], 50)
    assert {r.tx_id for r in again.collect()} == set(sizes)
    (tmp_path / "m.tsv").write_text("id\tid2\n1\t2\n")
    sinks.write_matrix(spark, str(tmp_path / "m.tsv"), str(tmp_path / "m"), {"id": "kind/id"}, {"batch": 7})
    found = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "m"))
    assert found.columns == ["kind/id", "id2", "batch"] and tuple(found.first()) == ("1", "2", "7")


def test_whole_validation_on_the_command_line(spark, tmp_path, capsys):
    from weft import cli

    for name, body in FILES.items():
        (tmp_path / name).write_text(body)
    (tmp_path / "s.edn").write_text(DSL)
    (tmp_path / "c.edn").write_text(CONFIG.replace(":matrixs [", "#_:matrixs #_[").replace('"A"} {:name "B"}', '"A"}'))
    (tmp_path / "rules.json").write_text(
        '{"rules": {"subject/age": ["between", 0, 35]}, "shapes": {"subject": {"required": ["smoker", "therapies"]}}, '
        '"validations": [{"name": "subjects", "query": {"find": [["count", "?s", "n"]], "where": [["?s", "subject/id", "_"]]}, "allowed": [[3]]}]}'
    )
    common = ["--schema", str(tmp_path / "s.edn"), "--warehouse", str(tmp_path / "w"), "--database", "db"]
    assert cli.main(["create-db", *common]) == 0
    assert cli.main(["load", *common, "--config", str(tmp_path / "c.edn")]) == 0
    capsys.readouterr()
    assert cli.main(["validate", *common, "--rules", str(tmp_path / "rules.json")]) == 1
    said = capsys.readouterr().out
    assert "age is not between 41" in said and "no therapies" in said and "no regimen B" in said and "query\tsubjects" in said


def test_entry_point_without_the_training_operators(tmp_path):
    """With both folders gone and the pipeline left behind, the rest is there."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert set(o) <= set(q) and len(q) > 60 and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": str(copy)})


def test_mapping_files_are_written_in_ranges(spark, tmp_path, monkeypatch):
    from weft.plans import imports
    from weft.sources import scratch

    n = 4000
    spark.range(3).selectExpr("cast(id AS int) AS n_nationkey").write.parquet(f"{tmp_path}/nation.parquet")
    spark.range(60).selectExpr("id AS c_custkey", "cast(id % 3 AS int) AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(n).selectExpr("id * 7 % 4000 AS o_orderkey", "id % 60 AS o_custkey", "CASE WHEN id % 2 = 0 THEN 'F' ELSE 'O' END AS o_orderstatus").repartition(5).write.parquet(f"{tmp_path}/orders.parquet")
    root = tmp_path / "mapping"
    monkeypatch.setattr(scratch, "folder", lambda spark, name: f"file://{root}")
    coalesced = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {r.id: r.value for r in imports.last_in_file(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
    keys = [[int(line.split("\t")[2]) for line in p.read_text().splitlines()] for p in sorted(root.glob("part-*"))]
    assert [k for own in keys for k in own] == list(range(n))  # whole, and in order from file to file
    assert sum(map(bool, keys)) > 1 and max(map(len, keys)) < n / 2  # no task sorted them all
    wanted = {}
    for k in range(0, n, 2):
        wanted[f"n{k % 60 % 3}"] = max(wanted.get(f"n{k % 60 % 3}", 0), k * 7 % 4000)
    assert found == {k: str(v) for k, v in wanted.items()}


def test_bindings_are_made_distinct_only_where_repeats_count(spark):
    from weft.operators.datalog import Views

    subjects = spark.createDataFrame([("s", "a"), ("s", "b"), ("r", "c")], "id string, therapies string")
    therapies = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "id string, order int")
    known = Views({"subject": (subjects, "id"), "therapy": (therapies, "id")}, unique={"subject": ["id", "therapies"], "therapy": ["id"]})
    twice = Views({"subject": (subjects.union(subjects), "id"), "therapy": (therapies.union(therapies), "id")})
    where = [["?s", "subject/therapies", "?t"], ["?t", "therapy/order", "?o"]]
    steps = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [")
    # found, what it must give, aggregates where the columns are known to be unique and where they aren't
    for found, wanted, few, many in (
        (["?s", ["count", "?t", "n"]], {("s", 2), ("r", 1)}, 1, 2),
        (["?s", ["max", "?o", "n"]], {("s", 1), ("r", 2)}, 1, 1),
        (["?s", ["count", "?o", "n"]], {("s", 1), ("r", 1)}, 2, 2),  # several therapies may share an order
        (["?o", ["count", "?s", "n"]], {(1, 1), (2, 1)}, 2, 2),
    ):
        for views, n in ((known, few), (twice, many)):
            rows = views.q({"find": found, "where": where})
            assert {tuple(r) for r in rows.collect()} == wanted and steps(rows) == n, found


def test_therapy_orders_of_odd_lines(spark, tmp_path):
    from weft.plans import imports

    # complete, a gap, begins at two, repeated lines, no number beside an order without a key, one large order
    lines = [(1, 1), (1, 2), (2, 1), (2, 3), (3, 2), (4, 1), (4, 1), (7, None), (7, 1), (None, 7), (8, None), *[(9, k) for k in range(1, 3001)], *[(9, k) for k in range(1, 3001)]]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = imports.therapy_order_rule(spark, str(tmp_path))
    numbers = {}
    for order, number in lines:
        numbers.setdefault(order, set()).update({number} - {None})
    assert [tuple(r) for r in found.collect()] == [("subject-therapies-order", sum(len(n) != max(n) for n in numbers.values() if n))]
    assert "collect_set" not in found._jdf.queryExecution().optimizedPlan().toString()  # no order's therapies in one row
