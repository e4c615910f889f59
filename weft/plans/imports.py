"""Registered queries that go the whole way: tables as delimited files, a configuration, a plan, entities, a store.

The files are written from the tables, so SQL over the tables says what the engine must
make of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import exprs
from weft.operators import domain, entities, validate
from weft.operators.store import Store
from weft.plans import config, prepare, schema
from weft.plans.registry import query, table, text
from weft.sources import configs, delimited, edn, parsers, scratch, sinks

SCHEMA = """
{:dataset {:id {:type :string :attribute :name :scope :global}}
 :subject {:id {:type :string :attribute :id :scope :context} :parent :dataset
           :attributes [[:segment {:enum-of [:automobile :building :furniture :household :machinery]} :cardinality-one ""] [:balance :double :cardinality-one ""]
                        [:rank :long :cardinality-one ""] [:tags :string :cardinality-many ""] [:good :boolean :cardinality-one ""] [:therapies {:ref-to :therapy} :cardinality-many ""]]}
 :therapy {:id {:type :string :attribute :id :scope :context} :parent :subject
           :attributes [[:order :long :cardinality-one ""] [:regimen {:ref-to :regimen} :cardinality-one ""] [:price :double :cardinality-one ""]]}
 :regimen {:id {:type :string :attribute :name :scope :context} :parent :dataset}
 :assay {:id {:type :string :attribute :name :scope :context} :parent :dataset :attributes [[:technology {:enum-of [:nanostring :WES :RNA-seq]} :cardinality-one ""]]}
 :measurement-set {:id {:type :string :attribute :name :scope :context} :parent :assay}
 :measurement {:id {:type :string :attribute :id :scope :context} :parent :measurement-set :synthetic-id [:sample :event]
               :attributes [[:sample :string :cardinality-one ""] [:event :string :cardinality-one ""] [:gene {:ref-to :gene} :cardinality-one ""] [:vaf :double :cardinality-one ""]
                            [:tpm :double :cardinality-one ""] [:read-count :double :cardinality-one ""] [:nanostring-count :double :cardinality-one ""] [:total-reads :double :cardinality-one ""]
                            [:place {:tuple-of [:string :double]} :cardinality-many ""]]}
 :vectors {:id {:type :string :attribute :name :scope :context} :parent :measurement-set
           :attributes [[:samples :string :cardinality-many ""] [:dimensions :string :cardinality-many ""]]}
 :gene {:id {:type :string :attribute :symbol :scope :global} :reference-data true
        :attributes [[:brand :string :cardinality-one ""] [:size :long :cardinality-one ""] [:names :string :cardinality-many ""]]}}
"""
MAPPINGS = """
{:mappings {:enum/segment {:subject.segment/automobile "AUTOMOBILE" :subject.segment/building ["BUILDING" "building"] :subject.segment/furniture "FURNITURE"
                           :subject.segment/household "HOUSEHOLD" :subject.segment/machinery "MACHINERY"}
            :yes {true ["yes" "y"] false "no"}}
 :variables {:subject/segment :enum/segment :subject/good :yes}}
"""
CONFIG = """
{:job/import {:user "me"}
 :gene [{:job/input-csv-file #glob ["genes" "part-*"] :symbol "Symbol" :brand "Brand" :size "Size" :job/na ["-"] :names {:job/many-delimiter " " :job/many-variable "Names"}}]
 :dataset {:name "d1"
           :subjects [{:job/input-tsv-file #glob ["subjects" "part-*"] :job/na ["NA" ""] :job/omit-if-na [:subject/balance]
                       :id "ID" :segment "Segment (raw)" :balance "Balance" :rank "Rank" :good "Good" :tags {:job/many-delimiter ";" :job/many-variable "Tags"}}]
           :regimens [{:name "1-URGENT"} {:name "2-HIGH"} {:name "3-MEDIUM"} {:name "4-NOT SPECIFIED"} {:name "5-LOW"}]
           :therapies [{:job/input-tsv-file #glob ["therapies" "part-*"] :id "order" :order "order" :price "price" :regimen "arm" :job/reverse {:job/rev-variable "ID" :job/rev-attr :subject/therapies}}]
           :assays [{:name "web" :technology :assay.technology/RNA-seq
                     :measurement-sets [{:name "m1"
                                         :measurements [{:job/input-tsv-file #glob ["events" "part-*"] :sample "user" :event "event" :job/variable "kind" :job/value "value"
                                                         :job/variables {"click" :measurement/vaf "view" :measurement/tpm "purchase" :measurement/read-count "signup" :measurement/nanostring-count "error" :measurement/total-reads}
                                                         :job/constants {:gene "G1"} :place ["kind" "value"]}]}]}]}}
"""


def _written(df: DataFrame, folder: str, separator: str, files: int = 3) -> None:
    df.repartition(files).write.option("sep", separator).option("header", True).option("emptyValue", "").csv(folder)


def _files(spark: SparkSession, sf_dir: str, which: tuple[str, ...]) -> str:
    """The input files of an import, under a folder of their own."""
    root = scratch.folder(spark, "import")
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    if "subjects" in which:
        k = F.col("c_custkey")
        _written(
            customers.select(
                F.concat(F.lit(" "), "c_name").alias("ID"), F.col("c_mktsegment").alias("Segment (raw)"), F.when(k % 11 == 0, F.lit("NA")).otherwise(F.col("c_acctbal").cast("string")).alias("Balance"),
                F.when(k % 7 == 0, F.lit("NA")).otherwise((k % 7).cast("string")).alias("Rank"), F.when(k % 2 == 0, F.lit("yes")).otherwise(F.lit("no")).alias("Good"),
                F.concat_ws(";", F.lit("t"), (k % 3).cast("string"), F.lit("t")).alias("Tags"), F.lit("unused").alias("Other column"),
            ), f"{root}/subjects", "\t",
        )
    if "therapies" in which:
        kept = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        _written(kept.select(F.col("c_name").alias("ID"), F.col("o_orderkey").alias("order"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("arm")), f"{root}/therapies", "\t")
    if "events" in which:
        _written(table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id")).alias("user"), F.col("event_id").alias("event"), F.col("event_type").alias("kind"), "value"), f"{root}/events", "\t")
    if "genes" in which:
        part = table(spark, sf_dir, "part")
        _written(part.select(F.concat(F.lit("G"), "p_partkey").alias("Symbol"), F.when(F.col("p_size") % 5 == 0, F.lit("-")).otherwise(F.col("p_brand")).alias("Brand"), F.col("p_size").alias("Size"), F.col("p_type").alias("Names")), f"{root}/genes", ",")
    return root


def _prepared(spark: SparkSession, sf_dir: str, *which: str) -> tuple[schema.Schema, dict[str, DataFrame]]:
    """Frames of the kinds whose files are in ``which`` (and of literals)."""
    kinds = schema.compile_dsl(edn.read(SCHEMA))
    root = _files(spark, sf_dir, which)
    tree = configs.without_files(edn.read(CONFIG), which)
    plan = config.plan(tree, kinds, root, lambda where, pattern: delimited.files(spark, where, pattern))
    mappings = configs.compile_mappings(edn.read(MAPPINGS))
    configs.check_mapping_enums(mappings, kinds.enums)
    return kinds, prepare.Preparer(spark, kinds, plan, mappings, domain.rules()).prepare()


def _store(spark: SparkSession, kinds: schema.Schema) -> Store:
    return Store(spark, scratch.folder(spark, "store"), kinds)


@query("""SELECT c_name AS id, c_name AS path, md5(c_name) AS uid, 'subject.segment/' || lower(c_mktsegment) AS segment, c_acctbal AS balance,
CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey % 7 END AS rank, c_custkey % 2 = 0 AS good, (c_custkey % 3)::VARCHAR || ',t' AS tags, 'd1' AS dataset FROM customer WHERE c_custkey % 11 <> 0""")
def import_tidy(spark, sf_dir):
    """Several files with odd headers, missing markers, mappings, many values; rows without a balance are left out."""
    found = _prepared(spark, sf_dir, "subjects")[1]["subject"]
    return found.where(F.size("_errors") == 0).select("id", F.col("_path").alias("path"), F.col("_uid").alias("uid"), "segment", "balance", "rank", "good", text("tags").alias("tags"), F.col("_dataset").alias("dataset"))


@query("SELECT count(*) AS n, 3::BIGINT AS files, count(*) AS lines, 2::BIGINT AS first_line FROM customer WHERE c_custkey % 11 <> 0")
def import_provenance(spark, sf_dir):
    """Every record has its file and line."""
    found = _prepared(spark, sf_dir, "subjects")[1]["subject"]
    return found.agg(F.count("*").alias("n"), F.count_distinct("_file").alias("files"), F.count_distinct("_file", "_line").alias("lines"), F.min("_line").cast("long").alias("first_line"))


@query("SELECT c_name || '|:~' || o_orderkey AS path, c_name AS parent, o_orderkey AS \"order\", o_totalprice AS price, o_orderpriority AS regimen FROM orders JOIN customer ON o_custkey = c_custkey")
def import_reverse(spark, sf_dir):
    """Children that state their parent: the path is made from the parent's column."""
    found = _prepared(spark, sf_dir, "therapies")[1]["therapy"]
    return found.select(F.col("_path").alias("path"), F.col("_parent").alias("parent"), "order", "price", "regimen")


@query("""SELECT 'web|:~m1|:~u' || user_id || '-' || event_id AS path, CASE WHEN event_type = 'click' THEN value END AS vaf, CASE WHEN event_type = 'view' THEN value END AS tpm,
CASE WHEN event_type = 'purchase' THEN value END AS read_count, 'G1' AS gene, event_type || ':' || value AS place,
CASE WHEN event_type = 'click' AND value > 1 THEN 1 ELSE 0 END AS wrong FROM events""")
def import_long_rows(spark, sf_dir):
    """Long rows with synthetic ids, constants and tuples; attribute rules find shares above one."""
    found = _prepared(spark, sf_dir, "events", "genes")[1]["measurement"]
    place = F.element_at("place", 1)
    return found.select(F.col("_path").alias("path"), "vaf", "tpm", F.col("read-count").alias("read_count"), "gene", F.concat_ws(":", place["_1"], place["_2"].cast("string")).alias("place"), F.size("_errors").alias("wrong"))


@query("SELECT 'G' || p_partkey AS symbol, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_brand END AS brand, p_size::BIGINT AS size, array_to_string(list_sort(list_distinct(string_split(p_type, ' '))), ',') AS names FROM part")
def import_reference(spark, sf_dir):
    """Reference data from comma-separated files: global ids, missing markers, values between spaces."""
    found = _prepared(spark, sf_dir, "genes")[1]["gene"]
    return found.select("symbol", "brand", "size", text("names").alias("names"))


@query("""SELECT 'subject' AS kind, count(*) AS entities, sum(c_acctbal > 0)::BIGINT AS rich FROM customer WHERE c_custkey % 11 <> 0 UNION ALL SELECT 'regimen', 5, 0""")
def store_load(spark, sf_dir):
    """Prepared entities in the store, as its tables give them back."""
    kinds, frames = _prepared(spark, sf_dir, "subjects")
    store = _store(spark, kinds)
    store.load(frames, "i1", user="me")
    subjects = store.table("subject").agg(F.count("*").alias("entities"), F.sum((F.col("balance") > 0).cast("long")).alias("rich")).select(F.lit("subject").alias("kind"), "entities", "rich")
    return subjects.union(store.table("regimen").agg(F.count("*").alias("entities")).select(F.lit("regimen").alias("kind"), "entities", F.lit(0).cast("long").alias("rich")))


@query("""SELECT 0::BIGINT AS again, 1::BIGINT AS changed, (SELECT count(*) FROM customer WHERE c_custkey % 11 <> 0) AS entities, 1::BIGINT AS corrected""")
def store_reload(spark, sf_dir):
    """A second load of the same entities adds no batch; one changed entity brings its batch alone."""
    kinds, frames = _prepared(spark, sf_dir, "subjects")
    frames = {k: f.cache() for k, f in frames.items()}
    store = _store(spark, kinds)
    store.load(frames, "i1")
    again = store.load(frames, "i1").count()
    one = frames["subject"].agg(F.min("_path")).first()[0]
    changed = store.load({"subject": frames["subject"].withColumn("rank", F.when(F.col("_path") == one, F.lit(999)).otherwise(F.col("rank")))}, "i1").count()
    out = store.table("subject").agg(F.count("*").alias("entities"), F.sum((F.col("rank") == 999).cast("long")).alias("corrected"))
    return out.select(F.lit(again).cast("long").alias("again"), F.lit(changed).cast("long").alias("changed"), "entities", "corrected")


@query("""SELECT 'after retract' AS moment, 0::BIGINT AS entities UNION ALL SELECT 'after reload', count(*) FROM customer WHERE c_custkey % 11 <> 0""")
def store_retract(spark, sf_dir):
    """The latest import taken back, and the same import loaded again."""
    kinds, frames = _prepared(spark, sf_dir, "subjects")
    frames = {k: f.cache() for k, f in frames.items()}
    store = _store(spark, kinds)
    store.load(frames, "i1")
    store.retract("d1")
    gone = store.table("subject").count()
    store.load(frames, "i1")
    moment = lambda name, n: n.select(F.lit(name).alias("moment"), F.col("entities").cast("long").alias("entities"))
    return moment("after retract", spark.range(1).select(F.lit(gone).alias("entities"))).union(moment("after reload", store.table("subject").agg(F.count("*").alias("entities"))))


@query("""SELECT 'gene' AS kind, 'G' || p_partkey AS key, 'size' AS attribute, p_size::VARCHAR AS old, (p_size + 1)::VARCHAR AS new FROM part WHERE p_partkey % 10 = 0""")
def store_crosscheck(spark, sf_dir):
    """Reference entities that an import would change; attributes it doesn't bring are no change."""
    kinds, frames = _prepared(spark, sf_dir, "genes")
    store = _store(spark, kinds)
    store.load({"gene": frames["gene"]}, "i1")
    tenth = F.substring("symbol", 2, 99).cast("long") % 10 == 0
    other = frames["gene"].withColumns({"size": F.when(tenth, F.col("size") + 1).otherwise(F.col("size")), "brand": F.lit(None).cast("string")})
    return store.crosscheck({"gene": other})


@query("""SELECT 'gene' AS kind, count(*) AS batches, sum(n)::BIGINT AS n FROM (SELECT count(*) AS n FROM (SELECT (row_number() OVER (ORDER BY p_partkey) - 1) // 100 AS b FROM part) GROUP BY b)""")
def sink_reference(spark, sf_dir):
    """Distinct reference rows in batches of a hundred, written and read back."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    found = sinks.write_reference(rows.union(rows), scratch.folder(spark, "reference"))
    return found.groupBy("batch").agg(F.count("*").alias("n")).agg(F.count("*").alias("batches"), F.sum("n").alias("n")).select(F.lit("gene").alias("kind"), "batches", "n")


@query("""SELECT 's/id' AS first_column, 'batch' AS last_column, count(*) AS rows, round(sum(p_retailprice), 2) AS total FROM part""")
def sink_matrix(spark, sf_dir):
    """A matrix file with columns renamed by exact name and a constant column behind."""
    root = scratch.folder(spark, "matrix")
    table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("id2")).coalesce(1).write.option("sep", "\t").option("header", True).csv(f"{root}/in")
    (source,) = delimited.files(spark, f"{root}/in", "part-*")
    sinks.write_matrix(spark, source, f"{root}/out", {"id": "s/id"}, {"batch": "b7"})
    out = spark.read.option("sep", "\t").option("header", True).csv(f"{root}/out")
    first, last = out.columns[0], out.columns[-1]
    return out.where("batch = 'b7'").agg(F.count("*").alias("rows"), F.round(F.sum(F.col("id2").cast("double")), 2).alias("total")).select(F.lit(first).alias("first_column"), F.lit(last).alias("last_column"), "rows", "total")


@query("""SELECT c_custkey AS id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', instr('0123456789abcdef', substr(h, 17, 1)), 1)
|| substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM (SELECT c_custkey, sha1('ns' || c_name) AS h FROM customer)""")
def name_uuids(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), exprs.name_uuid("ns", F.col("c_name")).alias("uuid"))


@query("""SELECT 'n' || n_nationkey AS id, max(o_orderkey)::VARCHAR AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' GROUP BY n_nationkey""")
def last_in_file(spark, sf_dir):
    """Of a mapping file's several values of an id the last line's counts."""
    root = scratch.folder(spark, "mapping")
    nation, customers, orders = (table(spark, sf_dir, n) for n in ("nation", "customer", "orders"))
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    # ranges of the order, a file each, whose names sort as the ranges do; lines are made after the sort, which moves less
    rows = joined.select("n_nationkey", "o_orderstatus", "o_orderkey").orderBy("o_orderkey")
    line = F.concat_ws("\t", F.concat(F.lit("n"), "n_nationkey"), F.when(F.col("o_orderstatus") == "F", F.lit("Gene_Name")).otherwise(F.lit("Other")), "o_orderkey")
    rows.select(line.alias("value")).write.text(root)
    return parsers.id_mapping(spark, root)


@query("""SELECT m, t, count(*) AS n FROM (SELECT CASE WHEN l_linenumber = 1 THEN 'nanostring' WHEN l_linenumber = 2 THEN 'variant' ELSE 'rnaseq' END AS m,
CASE l_returnflag WHEN 'A' THEN 'assay.technology/WES' WHEN 'N' THEN 'assay.technology/RNA-seq' END AS t FROM lineitem)
WHERE t IS NOT NULL AND NOT (m = 'variant' AND t = 'assay.technology/WES') AND NOT (m = 'rnaseq' AND t = 'assay.technology/RNA-seq') GROUP BY ALL""")
def technology_rules(spark, sf_dir):
    """The domain's seven rules on which technology a measured attribute comes from."""
    n = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(
        F.when(n == 1, F.lit(1.0)).alias("nanostring-count"), F.when(n == 2, F.lit(0.5)).alias("vaf"), F.when(n > 2, F.lit(2.0)).alias("tpm"),
        F.when(F.col("l_returnflag") == "A", F.lit("assay.technology/WES")).when(F.col("l_returnflag") == "N", F.lit("assay.technology/RNA-seq")).alias("technology"),
    )
    found = validate.measured_technologies(rows, domain.TECHNOLOGIES)
    return found.groupBy(F.col("rule").alias("m"), F.col("technology").alias("t")).agg(F.count("*").alias("n"))


@query("""SELECT what, count(*) AS n FROM (
SELECT CASE WHEN l_linenumber = 1 THEN 'no sample' END AS a, CASE WHEN l_returnflag = 'A' THEN 'no value' END AS b,
CASE WHEN l_returnflag = 'A' AND l_linenumber <> 1 OR l_returnflag = 'N' AND l_linenumber <> 1 AND l_linestatus = 'O' THEN NULL WHEN l_linenumber = 1 THEN 'bad' WHEN l_linestatus = 'F' AND l_returnflag = 'N' THEN 'bad' WHEN l_returnflag = 'R' THEN 'bad' END AS c FROM lineitem),
LATERAL (SELECT unnest([a, b, CASE WHEN c = 'bad' THEN 'fits none' END]) AS what) WHERE what IS NOT NULL GROUP BY 1""")
def measurement_shapes(spark, sf_dir):
    """The ten closed shapes of measurements: what is missing, valueless, or mixes targets."""
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    rows = table(spark, sf_dir, "lineitem").select(
        F.lit("m").alias("id"), F.lit("u").alias("uid"), F.when(F.col("l_linenumber") != 1, F.lit("s")).alias("sample"),
        F.when(flag == "N", F.lit("v")).alias("cnv"), F.when(flag == "N", F.lit(0.5)).alias("baf"), F.when((flag == "N") & (status == "F"), F.lit(1.0)).alias("tpm"),
        F.when(flag == "R", F.lit(0.1)).alias("vaf"),
    )
    errors = validate.shape_errors(rows, domain.SHAPES["measurement"], rows.columns)
    found = rows.select(F.explode(errors).alias("what")).select(F.when(F.col("what").startswith("fits none"), F.lit("fits none")).otherwise(F.col("what")).alias("what"))
    return found.groupBy("what").agg(F.count("*").alias("n"))


@query("""SELECT 'subject-therapies-order' AS name, count(*) AS wrong FROM (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n, max(l_linenumber) AS top FROM lineitem GROUP BY 1) WHERE n <> top""")
def therapy_order_rule(spark, sf_dir):
    """The rule on the order of therapies as a query and the query that says what it allows, over lines of orders."""
    from weft.operators.datalog import Views

    # a line without a number has no order; with numbers alone the ids below are unique, whatever the order's key
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("order")).where(F.col("order").isNotNull()).distinct()
    therapies = lines.select(F.concat_ws("/", "l_orderkey", "order").alias("id"), "order", F.col("l_orderkey").alias("subject"))
    # a row for each therapy of a subject, so that no subject's are gathered in a list
    subjects = therapies.select(F.col("subject").alias("id"), F.col("id").alias("therapies"))
    views = Views({"subject": (subjects, "id"), "therapy": (therapies, "id")}, unique={"subject": ["id", "therapies"], "therapy": ["id"]})
    found, allowed = (views.q(domain.THERAPY_ORDER[k]).toDF("s", "n") for k in ("query", "allowed"))
    wrong = found.subtract(allowed)
    return wrong.agg(F.count("*").alias("wrong")).select(F.lit(domain.THERAPY_ORDER["name"]).alias("name"), "wrong")


def _views(spark: SparkSession, sf_dir: str):
    """Nations and regions with a history of two transactions: all names, then regions once more without AFRICA's."""
    from weft.operators.datalog import Views

    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    kinds = {"nation": (nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")), "id"), "region": (region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")), "id")}

    def brought(df: DataFrame, key: str, name: str, kind: str, tx: int, added: bool = True) -> DataFrame:
        return df.select(F.col(key).cast("string").alias("e"), F.lit(f"{kind}/name").alias("a"), F.col(name).alias("v"), F.lit(tx).cast("long").alias("tx"), F.lit(added).alias("added"))

    parts = [brought(nation, "n_nationkey", "n_name", "nation", 1), brought(region, "r_regionkey", "r_name", "region", 2), brought(region.where("r_name = 'AFRICA'"), "r_regionkey", "r_name", "region", 3, False)]
    return Views(kinds, reduce(DataFrame.union, parts))


@query("SELECT r_regionkey AS e, r_name AS v, 2::BIGINT AS tx FROM region")
def datalog_transactions(spark, sf_dir):
    """The transaction that brought a value, by a predicate on it."""
    return _views(spark, sf_dir).q({"find": ["?e", "?v", "?tx"], "where": [["?e", "region/name", "?v", "?tx"], [[">", "?tx", 1]]]})


@query("SELECT 3::BIGINT AS tx, '0' AS e, 'region/name' AS a FROM region WHERE r_name = 'AFRICA'")
def datalog_retractions(spark, sf_dir):
    """What a transaction took back, whatever attribute it is of."""
    return _views(spark, sf_dir).q({"find": ["?tx", "?e", "?a"], "where": [["?e", "?a", "_", "?tx", False]]})


@query("SELECT n_nationkey::VARCHAR AS e, 'nation/name' AS a, n_name AS v FROM nation WHERE n_nationkey < 5 UNION ALL SELECT r_regionkey::VARCHAR, 'region/name', r_name FROM region WHERE r_name = 'ASIA'")
def datalog_attribute_values(spark, sf_dir):
    """Entities that have any of some (attribute, value) pairs, given as a relation."""
    rows = [("nation/name", r.n_name) for r in table(spark, sf_dir, "nation").where("n_nationkey < 5").select("n_name").collect()] + [("region/name", "ASIA")]
    return _views(spark, sf_dir).q({"find": ["?e", "?a", "?v"], "in": [[["?a", "?v"]]], "where": [["?e", "?a", "?v"]]}, rows)


@query("SELECT DISTINCT n_regionkey AS r FROM nation")
def datalog_blanks(spark, sf_dir):
    """Two blanks are two entities: they don't have to be the same."""
    views = _views(spark, sf_dir)
    return views.q({"find": ["?r"], "where": [["_", "nation/region", "?r"], ["_", "nation/name", "?n"], ["?x", "nation/region", "?r"], ["?y", "nation/name", "?n"], ["?y", "nation/region", "?r"]]})


@query("""SELECT o_orderpriority AS p, array_to_string(list_slice(list_sort(list(DISTINCT o_totalprice), 'DESC'), 1, 3), ',') AS best FROM orders GROUP BY 1""")
def datalog_largest(spark, sf_dir):
    """The three largest values of each group."""
    from weft.operators.datalog import Views

    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"))
    found = Views({"order": (orders, "id")}).q({"find": ["?p", ["max", 3, "?x", "best"]], "where": [["?o", "order/priority", "?p"], ["?o", "order/price", "?x"]]})
    return found.select("p", text("best").alias("best"))


@query("SELECT kind, n FROM (VALUES ('stored', (SELECT count(*) FROM part)), ('loaded again', 0)) v(kind, n)")
def seed_install(spark, sf_dir):
    """A seed with an index entry: loaded while fewer are stored than it should bring, and not again."""
    kinds, frames = _prepared(spark, sf_dir, "genes")
    store = _store(spark, kinds)
    wanted = table(spark, sf_dir, "part").count()
    store.install_seed("gene", frames["gene"], wanted, "seed")
    again = store.install_seed("gene", frames["gene"], wanted, "seed")
    stored = store.table("gene").agg(F.count("*").alias("n")).select(F.lit("stored").alias("kind"), "n")
    return stored.union(spark.range(1).select(F.lit("loaded again").alias("kind"), F.lit(int(again)).cast("long").alias("n")))


@query("""SELECT kind, "check", count(*) AS n FROM (
SELECT 'measurement' AS kind, 'rule' AS "check" FROM events WHERE event_type = 'click' AND value > 1
UNION ALL SELECT 'measurement', 'reference' FROM events WHERE (SELECT count(*) FROM part WHERE p_partkey = 1) = 0
UNION ALL SELECT 'measurement', 'technology' FROM events WHERE event_type IN ('click', 'signup')) GROUP BY ALL""")
def store_validate(spark, sf_dir):
    """All checks over a store: shares above one, technologies that don't yield what was measured, references that lead nowhere."""
    kinds, frames = _prepared(spark, sf_dir, "events", "genes")
    frames["measurement"] = frames["measurement"].withColumn("_errors", F.array().cast("array<string>"))  # let the wrong ones in
    store = _store(spark, kinds)
    store.load(frames, "i1")
    return store.validate("i1", domain.rules(), None, domain.TECHNOLOGIES).groupBy("kind", "check").agg(F.count("*").alias("n"))


@query("SELECT (SELECT count(*) FROM part) AS older, (SELECT count(*) FROM part WHERE p_partkey <= 10) AS newest")
def store_most_recent(spark, sf_dir):
    """Reference entities name the import that brought them last."""
    kinds, frames = _prepared(spark, sf_dir, "genes")
    store = _store(spark, kinds)
    store.load({"gene": frames["gene"]}, "i1")
    store.load({"gene": frames["gene"].where(F.substring("symbol", 2, 99).try_cast("long") <= 10)}, "i2")
    own = {n: store.brought_by("gene", n).agg(F.count("*").alias("n")) for n in ("i1", "i2")}
    return own["i1"].select(F.col("n").alias("_a")).join(own["i2"].select(F.col("n").alias("newest")), F.lit(True)).select((F.col("_a") + F.col("newest")).alias("older"), "newest")


@query("SELECT 'i1' AS name, 'me' AS \"user\", ceil(count(*) / 50.0)::BIGINT + 1 AS batches FROM (SELECT 1 FROM part)")
def store_imports(spark, sf_dir):
    """The import is an entity of its own, in the first batch; batches name it."""
    kinds, frames = _prepared(spark, sf_dir, "genes")
    store = _store(spark, kinds)
    one_file = {"gene": frames["gene"].withColumns({"_file": F.lit("f"), "_line": F.substring("symbol", 2, 99).cast("long")})}
    store.load(one_file, "i1", user="me")
    found = {"find": ["?n", "?u", ["count", "?t", "batches"]], "where": [["?i", "import/name", "?n"], ["?i", "import/user", "?u"], ["?t", "import-tx/import", "?n"]]}
    return store.q(found).select(F.col("n").alias("name"), F.col("u").alias("user"), "batches")


@query("SELECT DISTINCT 'dup' AS note, 'L' || l_partkey AS id, l_partkey AS gene FROM lineitem WHERE l_orderkey < 1000 AND l_quantity > 0")
def repaired_symbols(spark, sf_dir):
    """Lists of symbols with some replaced and some dropped; rows whose list empties are left out."""
    rows = table(spark, sf_dir, "lineitem").where("l_orderkey < 1000").select(F.concat_ws(";", F.concat(F.lit("G"), "l_partkey"), F.lit("old"), F.lit("bad")).alias("genes"), "l_partkey").distinct()
    fixed = parsers.corrected(rows, "genes", {"old": None, "bad": None})
    return fixed.where("genes IS NOT NULL").select(F.lit("dup").alias("note"), F.concat(F.lit("L"), F.substring("genes", 2, 99)).alias("id"), F.col("l_partkey").alias("gene"))


@query("SELECT n_name AS symbol, n_nationkey::VARCHAR AS hgnc_id, 'gene.hgnc-locus-group/' || CASE n_regionkey WHEN 0 THEN 'other' ELSE 'pseudogene' END AS locus, 'a,b' AS aliases, DATE '2020-02-03' AS changed FROM nation WHERE n_regionkey <> 1")
def reference_genes(spark, sf_dir):
    """The gene table's parsers: locus groups without withdrawn ones, values between pipes, dates, empty cells."""
    k = F.col("n_regionkey")
    rows = table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("symbol"), F.col("n_nationkey").cast("string").alias("hgnc_id"), F.lit("").alias("name"), F.lit('"a|b"').alias("alias_symbol"),
        *[F.lit("").alias(c) for c in ("alias_name", "prev_symbol", "prev_name", "refseq_accession", "ensembl_gene_id", "date_name_changed")],
        F.when(k == 1, F.lit("withdrawn")).when(k == 0, F.lit("other")).otherwise(F.lit("pseudogene")).alias("locus_group"), F.lit("2020-02-03").alias("date_symbol_changed"),
    )
    return parsers.genes(rows).select("symbol", "hgnc_id", F.col("locus_group").alias("locus"), text("alias_symbol").alias("aliases"), F.col("date_symbol_changed").alias("changed"))


@query("SELECT p_name || CASE WHEN n = 0 THEN '' ELSE '/' || CASE n WHEN 1 THEN 'iso' ELSE 'pS' || p_partkey END END AS id, p_name AS protein FROM (SELECT DISTINCT 'P' || p_partkey AS p_name, p_partkey FROM part WHERE p_partkey <= 50 AND p_partkey % 2 = 0), (VALUES (0), (1), (2)) v(n)")
def reference_epitopes(spark, sf_dir):
    """Human proteins of a markup file to epitopes: themselves, named isoforms, phosphorylated residues."""
    k = F.col("p_partkey")
    organism = F.when(k % 2 == 0, F.lit("Homo sapiens")).otherwise(F.lit("Mus musculus"))
    rows = table(spark, sf_dir, "part").where("p_partkey <= 50").select(
        F.concat(
            F.lit("<entry><accession>A"), k.cast("string"), F.lit("</accession><name>P"), k.cast("string"), F.lit('_HUMAN</name><organism><name type="scientific">'), organism,
            F.lit('</name></organism><comment type="alternative products"><isoform><name evidence="1">iso</name></isoform></comment><feature type="modified residue" description="Phosphoserine; by X"><location><position position="'),
            k.cast("string"), F.lit('"/></location></feature></entry>'),
        ).alias("value")
    )
    root = scratch.folder(spark, "proteins")
    whole = rows.agg(F.concat(F.lit("<entries>"), F.array_join(F.collect_list("value"), ""), F.lit("</entries>")).alias("value"))  # some fifty entries
    whole.write.text(root)
    return parsers.epitopes(parsers.proteins(spark, root))


@query("SELECT l_partkey AS target, array_to_string(list_slice(list_sort(list(DISTINCT l_orderkey)), 1, 3), ',') AS referencing FROM lineitem GROUP BY 1")
def referencing_first(spark, sf_dir):
    """The first three orders of each part, ranked lane by lane."""
    from weft.operators import joins

    return joins.referencing(table(spark, sf_dir, "lineitem"), "l_partkey", "l_orderkey", 3).select("target", text("referencing").alias("referencing"))


@query("SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) // 50 AS batch FROM orders")
def ranked_batches(spark, sf_dir):
    """Batches of fifty in the order of keys, counted range by range."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return entities.batches(orders, ["o_orderkey"], 50, ["o_orderpriority"], "batch", F.floor(F.col("o_orderkey") / 1000)).select("o_orderkey", "batch")
