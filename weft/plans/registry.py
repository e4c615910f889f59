"""The engine's registered queries and their SQL twins.

Each query applies operators of the library to whole tables; arrays and structs leave
as text, since results are compared by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import exprs
from weft.operators import datalog, entities, joins, reshape, validate

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(function: Query) -> Query:
        _QUERIES[function.__name__] = function
        _SQL[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(column: str | Column) -> Column:
    """An array as text."""
    column = F.col(column) if isinstance(column, str) else column
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


def queries() -> dict[str, Query]:
    from weft.plans import imports  # noqa: F401  (registers its queries)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


# ---- keys ----------------------------------------------------------------------


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = (table(spark, sf_dir, "nation"), "c_nationkey", "n_nationkey"), (table(spark, sf_dir, "region"), "n_regionkey", "r_regionkey")
    return joins.hop(table(spark, sf_dir, "customer"), *steps)


def _customer_path() -> Column:
    return exprs.uid_path(F.col("r_name"), F.col("n_name"), F.col("c_name"))


@query("SELECT c_custkey, concat_ws('|:~', r_name, n_name, c_name) AS uid FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def uid_path(spark, sf_dir):
    return _customers(spark, sf_dir).select("c_custkey", _customer_path().alias("uid"))


@query("SELECT c_custkey, md5(concat_ws('|:~', r_name, n_name, c_name)) AS uid FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def uid_md5(spark, sf_dir):
    return _customers(spark, sf_dir).select("c_custkey", exprs.uid_hash(_customer_path()).alias("uid"))


@query("""SELECT n_name, count(DISTINCT md5(concat_ws('|:~', r_name, n_name, c_name))) AS customers, count(*) AS orders, max(o_orderdate) AS latest
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name""")
def flagship(spark, sf_dir):
    """Orders resolved to customers by key, customers to their place in the tree, reported by nation."""
    keyed = _customers(spark, sf_dir).select("c_custkey", "n_name", exprs.uid_hash(_customer_path()).alias("uid"))
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate")
    return joins.hop(orders, (keyed, "o_custkey", "c_custkey")).groupBy("n_name").agg(
        F.count_distinct("uid").alias("customers"), F.count("*").alias("orders"), F.max("o_orderdate").alias("latest")
    )


@query("SELECT count(*) AS n, sum(CASE WHEN n_name = '' OR r_name LIKE '|:~%' OR r_name || '|:~' || n_name LIKE '%|:~|:~%' THEN 1 ELSE 0 END)::BIGINT AS invalid FROM nation JOIN region ON n_regionkey = r_regionkey")
def uid_wellformed(spark, sf_dir):
    nations = joins.hop(table(spark, sf_dir, "nation"), (table(spark, sf_dir, "region"), "n_regionkey", "r_regionkey"))
    bad = exprs.invalid_uid(exprs.uid_path(F.col("r_name"), F.col("n_name")))
    return nations.agg(F.count("*").alias("n"), F.sum(bad.cast("long")).alias("invalid"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, concat_ws('-', l_orderkey::VARCHAR, l_linenumber::VARCHAR, l_partkey::VARCHAR) AS id FROM lineitem")
def synthetic_id(spark, sf_dir):
    parts = "l_orderkey", "l_linenumber", "l_partkey"
    return table(spark, sf_dir, "lineitem").select(*parts, exprs.synthetic_id(*[F.col(p).cast("string") for p in parts]).alias("id"))


@query("SELECT n_nationkey, concat_ws('|:~', r_name, n_name) AS ref FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def scoped_ref(spark, sf_dir):
    """A reference inside a scope that the plan knows: the scope's path is a literal, no join finds it."""
    asia = table(spark, sf_dir, "region").where("r_name = 'ASIA'").select("r_regionkey")
    nations = joins.existing(table(spark, sf_dir, "nation"), "n_regionkey", asia, "r_regionkey")
    return nations.select("n_nationkey", exprs.uid_path(F.lit("ASIA"), F.col("n_name")).alias("ref"))


# ---- projection, mapping, coercion ------------------------------------------------


@query("SELECT o_orderkey::VARCHAR AS id, o_custkey AS customer, o_totalprice AS price, o_orderstatus AS status FROM orders")
def tidy_project(spark, sf_dir):
    return reshape.tidy(table(spark, sf_dir, "orders"), {"id": ("o_orderkey", "string"), "customer": ("o_custkey", "long"), "price": ("o_totalprice", "double"), "status": ("o_orderstatus", "ref")})


@query("SELECT n_name AS id, 'tpch' AS dataset, 1 AS version FROM nation")
def constant_projection(spark, sf_dir):
    return reshape.tidy(table(spark, sf_dir, "nation"), {"id": ("n_name", "string")}, {"dataset": "tpch", "version": 1})


_STATUS = exprs.invert_mapping({"finished": "F", "open": ["O"], "partial": "P"})


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' WHEN 'P' THEN 'partial' END AS status FROM orders")
def enum_mapping(spark, sf_dir):
    found = exprs.resolve(F.col("o_orderstatus"), "ref", lookup=_STATUS, enum=["finished", "open", "partial"])
    return table(spark, sf_dir, "orders").where(found.error.isNull()).select("o_orderkey", found.value.alias("status"))


_URGENCY = exprs.invert_mapping({"high": ["1-URGENT", "2-HIGH"], "low": ["3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]})


@query("SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' ELSE 'low' END AS urgency, count(*) AS n FROM orders GROUP BY 1")
def mapping_multi_raw(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(exprs.map_value(F.col("o_orderpriority"), _URGENCY)[0].alias("urgency")).groupBy("urgency").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, count(*) AS n, 'no mapping for ' || l_returnflag AS error FROM lineitem WHERE l_returnflag NOT IN ('A', 'R') GROUP BY 1")
def unmapped_errors(spark, sf_dir):
    error = exprs.map_value(F.col("l_returnflag"), {"A": "accepted", "R": "returned"})[1]
    return table(spark, sf_dir, "lineitem").withColumn("error", error).where("error IS NOT NULL").groupBy("l_returnflag", "error").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, m.canonical AS brand FROM lineitem JOIN part ON l_partkey = p_partkey JOIN (SELECT DISTINCT p_brand AS raw, lower(p_brand) AS canonical FROM part) m ON p_brand = m.raw")
def mapping_by_table(spark, sf_dir):
    """A mapping too large for the plan is a table."""
    part = table(spark, sf_dir, "part")
    mapping = part.select(F.col("p_brand").alias("raw"), F.lower("p_brand").alias("canonical")).distinct()
    lines = joins.lookup(table(spark, sf_dir, "lineitem"), "l_partkey", part, "p_partkey", ["p_brand"])
    return joins.map_by_table(lines, "p_brand", mapping).where("_error IS NULL").select("l_orderkey", "l_linenumber", "l_partkey", F.col("canonical").alias("brand"))


@query("SELECT event_id, CASE WHEN event_type <> 'error' THEN event_type END AS event_type FROM events")
def na_attr_drop(spark, sf_dir):
    flags = {"event_type": exprs.is_na(F.col("event_type"), ["error"])}
    return reshape.omit_na(table(spark, sf_dir, "events").select("event_id", "event_type"), flags)


@query("SELECT event_id, event_type FROM events WHERE event_type <> 'error'")
def omit_if_na_listed(spark, sf_dir):
    flags = {"event_type": exprs.is_na(F.col("event_type"), ["error"])}
    return reshape.omit_na(table(spark, sf_dir, "events").select("event_id", "event_type"), flags, ["event_type"])


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, l_linestatus FROM lineitem WHERE l_returnflag <> 'N' AND l_linestatus <> 'F'")
def omit_if_na_any(spark, sf_dir):
    flags = {"l_returnflag": exprs.is_na(F.col("l_returnflag"), ["N"]), "l_linestatus": exprs.is_na(F.col("l_linestatus"), ["F"])}
    return reshape.omit_na(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *flags), flags, "*")


@query("""SELECT p_partkey, w, CASE WHEN lower(w) IN ('true', 'false') THEN lower(w) END AS flag
FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'false' WHEN 2 THEN 'yes' ELSE '1' END AS w FROM part)""")
def bool_strict(spark, sf_dir):
    word = F.element_at(F.array(*map(F.lit, ("TRUE", "false", "yes", "1"))), (F.col("p_size") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", word.alias("w")).withColumn("flag", exprs.to_boolean(F.col("w")).cast("string"))


@query("""SELECT w, count(*) AS n, CASE WHEN regexp_full_match(w, '[+-]?[0-9]+') THEN try_cast(w AS BIGINT) END AS number
FROM (SELECT CASE WHEN p_size % 3 = 0 THEN p_size::VARCHAR WHEN p_size % 3 = 1 THEN p_size::VARCHAR || '.5' ELSE 'x' || p_size END AS w FROM part) GROUP BY w""")
def int_strict(spark, sf_dir):
    size = F.col("p_size").cast("string")
    word = F.when(F.col("p_size") % 3 == 0, size).when(F.col("p_size") % 3 == 1, F.concat(size, F.lit(".5"))).otherwise(F.concat(F.lit("x"), size))
    counted = table(spark, sf_dir, "part").select(word.alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return counted.withColumn("number", exprs.to_long(F.col("w")))


@query("SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", exprs.to_long(F.get_json_object("props", "$.k")).alias("k"))


# ---- reshape ------------------------------------------------------------------------

_EVENT_ATTRIBUTES = {k: (f"{k}_value", "double") for k in ("click", "error", "purchase", "signup", "view")}


@query("SELECT event_id, " + ", ".join(f"CASE WHEN event_type = '{k}' THEN value END AS {k}_value" for k in _EVENT_ATTRIBUTES) + " FROM events")
def molten_events(spark, sf_dir):
    long = reshape.molten(table(spark, sf_dir, "events"), ["event_id"], "event_type", "value", _EVENT_ATTRIBUTES)
    return long.where("_error IS NULL").drop("_error")


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY 1")
def molten_unknown(spark, sf_dir):
    known = {k: v for k, v in _EVENT_ATTRIBUTES.items() if k in ("click", "view")}
    long = reshape.molten(table(spark, sf_dir, "events"), ["event_type"], "event_type", "value", known)
    return long.where("_error IS NOT NULL").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, list_aggregate(list_sort(list_distinct(string_split(p_name, ' '))), 'string_agg', ',') AS words FROM part")
def card_many_split(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text(exprs.as_set(exprs.split_many(F.col("p_name"), " "))).alias("words"))


@query("SELECT p_partkey, p_brand AS brands, 1 AS n FROM part")
def card_many_trailing(spark, sf_dir):
    parts = exprs.split_many(F.concat("p_brand", F.lit(";;")), ";")
    return table(spark, sf_dir, "part").select("p_partkey", text(parts).alias("brands"), F.size(parts).alias("n"))


@query("SELECT l_orderkey, l_partkey, l_quantity, l_partkey::VARCHAR || '/' || l_quantity::BIGINT::VARCHAR AS pair FROM lineitem")
def tuple_build(spark, sf_dir):
    pair = exprs.tuple_of(F.col("l_partkey"), F.col("l_quantity"))
    built = table(spark, sf_dir, "lineitem").select("l_orderkey", pair.alias("t"))
    return built.select("l_orderkey", F.col("t._1").alias("l_partkey"), F.col("t._2").alias("l_quantity"), F.concat_ws("/", F.col("t._1").cast("string"), F.col("t._2").cast("long").cast("string")).alias("pair"))


@query("""SELECT l_orderkey, string_agg(p || ':' || q, ',' ORDER BY p, q) AS pairs FROM (SELECT DISTINCT l_orderkey, l_partkey AS p, l_quantity::BIGINT AS q FROM lineitem) GROUP BY 1""")
def tuple_many(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.col("l_quantity").cast("long").alias("q"))
    grouped = reshape.group_tuples(lines, "l_orderkey", ["l_partkey", "q"])
    return grouped.select("l_orderkey", F.array_join(F.transform("tuples", lambda t: F.concat_ws(":", t["_1"].cast("string"), t["_2"].cast("string"))), ",").alias("pairs"))


@query("SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS orders FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders) GROUP BY 1")
def reverse_ref(spark, sf_dir):
    return reshape.reverse_references(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey").select("o_custkey", text("children").alias("orders"))


_DIMENSIONS = 64


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", *[F.col("embedding")[i].alias(f"d{i}") for i in range(_DIMENSIONS)])


@query("SELECT vec_id, 'd' || (i - 1) AS dim, round(embedding[i]::DOUBLE, 6) AS value FROM embeddings, range(1, 65) r(i)")
def matrix_dense(spark, sf_dir):
    cells = reshape.matrix_long(_dense(spark, sf_dir), ["vec_id"], "dim")
    return cells.select("vec_id", "dim", F.round(F.col("value").cast("double"), 6).alias("value"))


@query("SELECT label, vec_id, 'd' || (i - 1) AS dim, round(embedding[i]::DOUBLE, 6) AS value FROM embeddings, range(1, 65) r(i) WHERE abs(embedding[i]) > 0.2")
def matrix_sparse(spark, sf_dir):
    columns = ["label", "vec_id", "dim", "value"]
    value = reshape.check_sparse(columns, ["label", "vec_id", "dim"])
    long = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.posexplode("embedding").alias("i", value))
    return long.where(F.abs(value) > 0.2).select("label", "vec_id", F.concat(F.lit("d"), "i").alias("dim"), F.round(F.col(value).cast("double"), 6).alias("value"))


@query("SELECT label, count(*) * 64 AS n_cells, 64 AS n_dims, string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id) AS vecs FROM embeddings GROUP BY label")
def matrix_dims(spark, sf_dir):
    long = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.posexplode("embedding").alias("dim", "value"))
    built = reshape.matrix_entity(long, "label", ["vec_id", "dim"])
    return built.select("label", "n_cells", F.size("dims").alias("n_dims"), text("vec_ids").alias("vecs"))


@query("SELECT label, count(*) AS n FROM embeddings, range(1, 65) r(i) WHERE NOT embedding[i] BETWEEN -0.3 AND 0.3 GROUP BY 1")
def matrix_cell_errors(spark, sf_dir):
    """How many cells of each matrix break its rule (the report itself is cut to a thousand)."""
    long = table(spark, sf_dir, "embeddings").select("label", F.explode("embedding").alias("value"))
    rules = validate.attribute_errors({"value": ("between", F.lit(-0.3).cast("float"), F.lit(0.3).cast("float"))})
    return long.where(F.size(rules) > 0).groupBy("label").agg(F.count("*").alias("n"))


@query("""SELECT n_nationkey AS e, a, v FROM (SELECT n_nationkey, 'n_name' AS a, n_name AS v FROM nation
UNION ALL SELECT n_nationkey, 'n_regionkey', n_regionkey::VARCHAR FROM nation)""")
def eav_view(spark, sf_dir):
    return reshape.eav(table(spark, sf_dir, "nation"), "n_nationkey", ["n_name", "n_regionkey"])


@query("SELECT n_nationkey AS e, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def eav_pivot_back(spark, sf_dir):
    return reshape.wide(reshape.eav(table(spark, sf_dir, "nation"), "n_nationkey", ["n_name", "n_regionkey"]), ["n_name", "n_regionkey"])


# ---- merging, batching, history -------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, t.b AS l_partkey, t.c AS l_suppkey FROM (
SELECT l_orderkey, l_linenumber, max({'a': l_shipdate, 'b': l_partkey, 'c': l_suppkey}) AS t FROM lineitem GROUP BY 1, 2)""")
def upsert_merge(spark, sf_dir):
    order = ["l_shipdate", "l_partkey", "l_suppkey"]
    return entities.upsert_merge(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"], order=order)


@query("SELECT l_orderkey, l_linenumber, count(DISTINCT l_partkey) AS l_partkey, count(DISTINCT l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_partkey) > 1 OR count(DISTINCT l_suppkey) > 1")
def upsert_conflicts(spark, sf_dir):
    return entities.conflicts(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])


@query("""SELECT user_id, t.e AS event_id, t.y AS event_type FROM (SELECT user_id, max({'t': ts, 'e': event_id, 'y': event_type}) AS t FROM events GROUP BY 1)""")
def last_wins(spark, sf_dir):
    return entities.last_wins(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts"]).select("user_id", "event_id", "event_type")


def _batched_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in batches of fifty; the priority stands for the file they came from."""
    return entities.batches(table(spark, sf_dir, "orders"), ["o_orderkey"], within=["o_orderpriority"])


_BATCH_SQL = "SELECT o_orderkey, o_orderpriority, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) // 50 AS batch FROM orders"


@query(_BATCH_SQL)
def batch_assign(spark, sf_dir):
    return _batched_orders(spark, sf_dir).select("o_orderkey", "o_orderpriority", "batch")


@query(f"SELECT tx_id, count(*) AS n FROM (SELECT sha256(concat_ws('/', 'tpch', o_orderpriority, batch::VARCHAR)) AS tx_id, batch FROM ({_BATCH_SQL})) WHERE batch % 3 <> 0 GROUP BY 1")
def ledger_resume(spark, sf_dir):
    """What is left to load when every third batch is already in the ledger."""
    rows = _batched_orders(spark, sf_dir).withColumn("tx_id", entities.batch_id("tpch", F.col("o_orderpriority"), F.col("batch")))
    ledger = rows.where("batch % 3 = 0").select("tx_id")
    return entities.not_committed(rows, ledger).groupBy("tx_id").agg(F.count("*").alias("n"))


def _event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("e"), F.lit("event/type").alias("a"), F.col("event_type").alias("v"), F.col("event_id").alias("tx"), F.lit(True).alias("added"))


@query("""SELECT e, v FROM (SELECT user_id AS e, event_type AS v, max(event_id) AS last, count(*) FILTER (event_id BETWEEN 1000 AND 4000) AS hit FROM events GROUP BY 1, 2) WHERE hit = 0""")
def retract_view(spark, sf_dir):
    """The current view after a range of transactions is taken back, by a transaction after all others."""
    log = _event_log(spark, sf_dir)
    return entities.current(log.unionByName(entities.retractions(log, 1000, 4000, 1 << 60))).select("e", "v")


@query("SELECT event_type, min(event_id) AS first_line, max(event_id) AS last_line FROM events GROUP BY 1")
def annotations_range(spark, sf_dir):
    notes = table(spark, sf_dir, "events").select("event_type", F.col("event_type").alias("_file"), F.col("event_id").alias("_line"))
    return validate.locations(notes.select("event_type").distinct(), notes, "event_type").select("event_type", "first_line", "last_line")


# ---- joins --------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_partkey, p_type FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size <= 25) ON l_partkey = p_partkey")
def lookup_join(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return joins.lookup(lines, "l_partkey", table(spark, sf_dir, "part").where("p_size <= 25"), "p_partkey", ["p_type"])


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25)")
def lookup_missing(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return joins.dangling(lines, "l_partkey", table(spark, sf_dir, "part").where("p_size <= 25"), "p_partkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def semi_filter(spark, sf_dir):
    return joins.existing(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", table(spark, sf_dir, "orders").where("o_orderstatus = 'P'"), "o_custkey")


@query("SELECT o_orderkey, i FROM orders JOIN (VALUES ('F', 1), ('P', 2)) t(s, i) ON o_orderstatus = s")
def relation_input_join(spark, sf_dir):
    given = joins.relation_input(spark, [("F", 1), ("P", 2)], "s string, i int")
    return table(spark, sf_dir, "orders").join(given, F.col("o_orderstatus") == F.col("s")).select("o_orderkey", "i")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' OR o_totalprice > 400000")
def or_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return joins.any_of(orders.where("o_orderpriority = '1-URGENT'").select("o_custkey"), orders.where("o_totalprice > 400000").select("o_custkey"))


@query("""SELECT r_name, count(DISTINCT l_orderkey) AS orders, sum(l_quantity) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def rule_join_multihop(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    path = [("orders", "l_orderkey", "o_orderkey"), ("customer", "o_custkey", "c_custkey"), ("nation", "c_nationkey", "n_nationkey"), ("region", "n_regionkey", "r_regionkey")]
    joined = joins.hop(lines, *[(table(spark, sf_dir, t), a, b) for t, a, b in path])
    return joined.groupBy("r_name").agg(F.count_distinct("l_orderkey").alias("orders"), F.sum("l_quantity").alias("quantity"))


@query("""SELECT n_name, coalesce(string_agg(s_suppkey || ' ' || s_name, ',' ORDER BY s_suppkey, s_name), '') AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1""")
def pull_nested(spark, sf_dir):
    nested = joins.pull(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey", table(spark, sf_dir, "supplier"), "s_nationkey", ["s_suppkey", "s_name"], "suppliers")
    return nested.select("n_name", F.array_join(F.transform("suppliers", lambda s: F.concat_ws(" ", s["s_suppkey"].cast("string"), s["s_name"])), ",").alias("suppliers"))


@query("SELECT s_nationkey AS target, string_agg(s_suppkey::VARCHAR, ',' ORDER BY s_suppkey) AS referencing FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM supplier) WHERE r <= 10 GROUP BY 1")
def referencing_entities(spark, sf_dir):
    return joins.referencing(table(spark, sf_dir, "supplier"), "s_nationkey", "s_suppkey").select("target", text("referencing").alias("referencing"))


_PERTURBED = "CASE WHEN c_custkey % 7 = 0 THEN c_mktsegment || '!' ELSE c_mktsegment END"


@query(f"SELECT c_custkey::VARCHAR AS key, 'c_mktsegment' AS attribute, c_mktsegment AS old, {_PERTURBED} AS \"new\" FROM customer WHERE c_custkey % 7 = 0")
def upsert_diff(spark, sf_dir):
    stored = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    incoming = stored.withColumn("c_mktsegment", F.expr(_PERTURBED))
    return joins.upsert_conflicts(incoming, stored, "c_custkey", ["c_name", "c_mktsegment"])


@query(f"SELECT c_custkey AS e, 'c_mktsegment' AS a, {_PERTURBED} AS v FROM customer EXCEPT SELECT c_custkey, 'c_mktsegment', c_mktsegment FROM customer")
def except_av(spark, sf_dir):
    stored = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    incoming = stored.withColumn("c_mktsegment", F.expr(_PERTURBED))
    return entities.set_difference(reshape.eav(incoming, "c_custkey", ["c_mktsegment"]), reshape.eav(stored, "c_custkey", ["c_mktsegment"]))


@query("SELECT c_name AS id, c_acctbal AS balance, c_mktsegment AS segment, NULL::BIGINT AS supplier FROM customer UNION ALL SELECT s_name, s_acctbal, NULL, s_suppkey FROM supplier")
def union_kinds(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_name").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("id"), F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("supplier"))
    return entities.union_kinds(customers, suppliers)


# ---- aggregates and order -------------------------------------------------------------------


@query("SELECT count(DISTINCT o_custkey) AS n FROM orders")
def count_distinct_bindings(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.count_distinct("o_custkey").alias("n"))


@query("SELECT count(*) AS n FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders)")
def count_with(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").distinct().agg(F.count("o_custkey").alias("n"))


@query("SELECT r_name, count(DISTINCT n_nationkey) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def group_count(spark, sf_dir):
    return joins.hop(table(spark, sf_dir, "nation"), (table(spark, sf_dir, "region"), "n_regionkey", "r_regionkey")).groupBy("r_name").agg(F.count_distinct("n_nationkey").alias("n"))


@query("SELECT o_custkey, max(o_orderkey) AS latest FROM orders GROUP BY 1")
def max_one(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("latest"))


@query("SELECT o_orderpriority, arg_max(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS latest FROM orders GROUP BY 1")
def arg_max(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def order_latest_first(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(20)


@query("SELECT event_id, ts FROM events WHERE ts > (SELECT min(ts) FROM events WHERE event_type = 'purchase')")
def latest_tx_gt(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    start = events.where("event_type = 'purchase'").agg(F.min("ts").alias("start"))
    return events.join(F.broadcast(start), F.col("ts") > F.col("start")).select("event_id", "ts")  # one row


# ---- validation ---------------------------------------------------------------------------------


@query("SELECT l_orderkey, count(DISTINCT l_linenumber) AS n, max(l_linenumber) AS top, count(DISTINCT l_linenumber) = max(l_linenumber) AS complete FROM lineitem GROUP BY 1")
def order_completeness(spark, sf_dir):
    return validate.order_is_complete(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_linenumber")


@query("""SELECT attribute, rule, count(*) AS n FROM (
SELECT 'l_discount' AS attribute, 'between' AS rule FROM lineitem WHERE NOT l_discount BETWEEN 0 AND 0.05
UNION ALL SELECT 'l_tax', 'zero_to_one' FROM lineitem WHERE NOT l_tax BETWEEN 0 AND 1
UNION ALL SELECT 'l_linenumber', 'one_of' FROM lineitem WHERE l_linenumber NOT IN (1, 2, 3, 4)
UNION ALL SELECT 'l_returnflag', 'alphabet' FROM lineitem WHERE l_returnflag = 'N') GROUP BY ALL""")
def range_rules(spark, sf_dir):
    rules = {"l_discount": ("between", 0, 0.05), "l_tax": ("zero_to_one",), "l_linenumber": ("one_of", 1, 2, 3, 4), "l_returnflag": ("alphabet", "AR")}
    found = validate.checked(table(spark, sf_dir, "lineitem"), rules).select(F.explode("_errors").alias("e")).select("e.attribute", "e.rule")
    return found.groupBy("attribute", "rule").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, count(*) AS n, sum(CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS fits FROM orders GROUP BY 1")
def closed_shape(spark, sf_dir):
    """Orders with a manufactured gap and a manufactured stranger, against a closed shape."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("customer"), F.when(F.col("o_orderkey") % 2 != 0, F.lit(1)).alias("stranger"))
    fits = validate.closed_shape(["o_orderkey", "customer"], ["o_orderstatus"], rows.columns)
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum(fits.cast("long")).alias("fits"))


@query("SELECT count(*) AS n, sum(CASE WHEN l_linenumber = 3 THEN 1 ELSE 0 END)::BIGINT AS broken FROM lineitem")
def composite_id(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("id", F.concat_ws(":", F.col("l_orderkey").cast("string"), F.when(F.col("l_linenumber") == 3, F.lit("x")).otherwise(F.col("l_linenumber").cast("string"))))
    bad = F.size(validate.attribute_errors({"id": ("composite_of", ":", "l_orderkey", "l_linenumber")})) > 0
    return rows.agg(F.count("*").alias("n"), F.sum(bad.cast("long")).alias("broken"))


@query("SELECT c_custkey AS e, 'customer,supplier' AS kinds FROM customer JOIN supplier ON c_custkey = s_suppkey")
def namespace_collision(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("customer/name"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("supplier/name"))
    triples = [df.select(F.col(k).alias("e"), F.lit(a).alias("a"), F.col(f"`{a}`").alias("v")) for df, k, a in ((customers, "c_custkey", "customer/name"), (suppliers, "s_suppkey", "supplier/name"))]
    return validate.namespace_collisions(triples[0].union(triples[1])).select("e", text("kinds").alias("kinds"))


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('purchase', 'click') GROUP BY 1")
def technology_rule(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", "value")
    return validate.technology_errors(rows, {"value": ["purchase", "click"]}, "event_type").groupBy("event_type").agg(F.count("*").alias("n"))


# ---- the query front end ---------------------------------------------------------------------------


def _store(spark: SparkSession, sf_dir: str) -> datalog.Views:
    kinds = {
        "nation": ("nation", {"id": "n_nationkey", "name": "n_name", "region": "n_regionkey"}),
        "region": ("region", {"id": "r_regionkey", "name": "r_name"}),
        "customer": ("customer", {"id": "c_custkey", "name": "c_name", "nation": "c_nationkey", "segment": "c_mktsegment"}),
        "order": ("orders", {"id": "o_orderkey", "customer": "o_custkey", "status": "o_orderstatus", "price": "o_totalprice", "priority": "o_orderpriority"}),
    }
    return datalog.Views({k: (table(spark, sf_dir, t).select(*[F.col(c).alias(a) for a, c in columns.items()]), "id") for k, (t, columns) in kinds.items()})


@query("SELECT r_name AS rn, count(DISTINCT n_nationkey) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def datalog_group_count(spark, sf_dir):
    return _store(spark, sf_dir).q({"find": ["?rn", ["count", "?n", "n"]], "where": [["?n", "nation/region", "?r"], ["?r", "region/name", "?rn"]]})


@query("SELECT DISTINCT c_name AS cn FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'P' AND o_totalprice > 200000")
def datalog_join_predicate(spark, sf_dir):
    return _store(spark, sf_dir).q({"find": ["?cn"], "where": [["?o", "order/customer", "?c"], ["?o", "order/status", "P"], ["?o", "order/price", "?p"], [[">", "?p", 200000]], ["?c", "customer/name", "?cn"]]})


@query("SELECT DISTINCT o_custkey AS c FROM orders WHERE o_orderpriority = '1-URGENT' OR o_totalprice > 400000")
def datalog_or(spark, sf_dir):
    branches = ["or", [["?o", "order/priority", "1-URGENT"]], [["?o", "order/price", "?p"], [[">", "?p", 400000]]]]
    return _store(spark, sf_dir).q({"find": ["?c"], "where": [branches, ["?o", "order/customer", "?c"]]})


@query("SELECT count(*) AS n FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))")
def datalog_with_inputs(spark, sf_dir):
    where = [["?c", "customer/segment", "?s"], ["?o", "order/customer", "?c"]]
    return _store(spark, sf_dir).q({"find": [["count", "?c", "n"]], "with": ["?o"], "in": [["?s", "..."]], "where": where}, ["BUILDING", "MACHINERY"])


@query("SELECT n_name AS nn FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_custkey <= 20)")
def datalog_not(spark, sf_dir):
    where = [["?n", "nation/name", "?nn"], ["not", ["?c", "customer/nation", "?n"], ["?c", "customer/id", "?k"], [["<=", "?k", 20]]]]
    return _store(spark, sf_dir).q({"find": ["?nn"], "where": where})


@query("SELECT r_name AS rn, max(n_name) AS top FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE') GROUP BY 1")
def datalog_rules(spark, sf_dir):
    rules = [[["lies-in", "?n", "?rn"], ["?n", "nation/region", "?r"], ["?r", "region/name", "?rn"]]]
    found = {"find": ["?rn", ["max", "?nn", "top"]], "in": ["%", [["?rn"]]], "where": [["lies-in", "?n", "?rn"], ["?n", "nation/name", "?nn"]]}
    return _store(spark, sf_dir).q(found, rules, [("ASIA",), ("EUROPE",)])


@query("SELECT n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey > 3")
def datalog_pull(spark, sf_dir):
    found = {"find": [["pull", "?n", ["name", {"region": ["name"]}]]], "where": [["?n", "nation/id", "?k"], [[">", "?k", 3]]]}
    return _store(spark, sf_dir).q(found).select("n.name", F.col("n.region.name").alias("region"))


@query("SELECT max(o_orderkey) AS top, min(o_orderkey) AS low, count(DISTINCT o_custkey) AS customers FROM orders WHERE o_orderpriority = '1-URGENT'")
def datalog_aggregates(spark, sf_dir):
    find = [["max", "?k", "top"], ["min", "?k", "low"], ["count-distinct", "?c", "customers"]]
    return _store(spark, sf_dir).q({"find": find, "where": [["?o", "order/id", "?k"], ["?o", "order/customer", "?c"], ["?o", "order/priority", "1-URGENT"]]})


@query("SELECT c_custkey AS id, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS orders, max(o_orderdate) AS last FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def upsert_many(spark, sf_dir):
    """Many-valued attributes gather what all rows of a key bring; single ones keep the last."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.array("o_orderkey").alias("orders"), F.col("o_orderdate").alias("last"))
    return entities.upsert_merge(rows, ["id"], ["last"], ["orders"], ["last"]).select("id", text("orders").alias("orders"), "last")
