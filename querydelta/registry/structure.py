"""Hierarchies, constraints and catalogs derived from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from querydelta.operators import constraints as K
from querydelta.operators import hierarchy as H
from querydelta.registry import query
from querydelta.session import durable, parts_of
from querydelta.sources import catalogs as G

# A part reports to the part with a quarter of its number; part 0 is the root,
# and parts of one price report to a part that does not exist.
_TREE = """tree AS (SELECT p_partkey AS id, CASE WHEN p_partkey = 0 THEN NULL WHEN p_retailprice = 910.5 THEN -p_partkey
                    ELSE p_partkey // 4 END AS parent FROM part)"""


def _tree(t):
    return t.part.select(
        F.col("p_partkey").alias("id"),
        F.expr(
            "case when p_partkey = 0 then null when p_retailprice = 910.5D then -p_partkey else p_partkey div 4 end"
        ).alias("parent"),
    )


@query("hierarchy_paths", f"""WITH {_TREE},
  l AS (SELECT CASE WHEN parent IS NULL THEN 'root' WHEN parent IN (SELECT id FROM tree) THEN 'child' ELSE 'orphan' END AS path
        FROM tree)
SELECT v.path, count(l.path) AS n, count(l.path) > 0 AS satisfied
FROM (VALUES ('root'), ('child'), ('orphan')) v(path) LEFT JOIN l USING (path) GROUP BY 1""")
def hierarchy_paths(t):
    return H.hierarchy_paths(_tree(t), "id", "parent")


_REACH = f"""WITH RECURSIVE {_TREE},
  walk AS (SELECT id, 0 AS depth FROM tree WHERE parent IS NULL
           UNION ALL SELECT tree.id, depth + 1 FROM tree JOIN walk ON tree.parent = walk.id)"""


@query("hierarchy_reach", f"{_REACH} SELECT tree.id, depth FROM tree LEFT JOIN walk ON tree.id = walk.id")
def hierarchy_reach(t):
    return H.hierarchy_reach(_tree(t), "id", "parent", "parent is null")


@query("recursion_effect", f"""{_REACH}, l AS (
  SELECT CASE WHEN depth IS NULL THEN 'unreached' WHEN depth = 0 THEN 'root' WHEN depth = 1 THEN 'one_level'
         ELSE 'recursive_only' END AS path FROM tree LEFT JOIN walk ON tree.id = walk.id)
SELECT v.path, count(l.path) AS n, count(l.path) > 0 AS satisfied
FROM (VALUES ('root'), ('one_level'), ('recursive_only'), ('unreached')) v(path) LEFT JOIN l USING (path) GROUP BY 1""")
def recursion_effect(t):
    return H.recursion_effect(H.hierarchy_reach(_tree(t), "id", "parent", "parent is null"))


@query("path_multiplicity", """WITH RECURSIVE
  e AS (SELECT p_partkey // 4 AS a, p_partkey AS b FROM part WHERE p_partkey > 0
        UNION ALL SELECT p_partkey // 3, p_partkey FROM part WHERE p_partkey > 0),
  walk AS (SELECT 0::BIGINT AS node, 0 AS depth UNION ALL SELECT b, depth + 1 FROM e JOIN walk ON a = node)
SELECT node, count(*)::DECIMAL(38,0) AS n_paths, min(depth) AS first_depth, max(depth) AS last_depth,
       count(*) > 1 AS union_all_differs FROM walk GROUP BY 1""")
def path_multiplicity(t):
    below = t.part.where("p_partkey > 0")
    edges = below.select(F.expr("p_partkey div 4").alias("a"), F.col("p_partkey").alias("b")).unionAll(
        below.select(F.expr("p_partkey div 3").alias("a"), F.col("p_partkey").alias("b"))
    )
    root = t.part.where("p_partkey = 0").select(F.col("p_partkey").alias("a"))
    return H.path_multiplicity(edges, "a", "b", root)


@query("check_constraints", """
WITH s AS (SELECT CASE WHEN l_linenumber = 4 THEN NULL ELSE l_orderkey END AS k, l_linenumber, l_suppkey, l_tax FROM lineitem)
SELECT 'not_null:k' AS "constraint", (count(*) - count(k)) AS n_violations, (count(*) - count(k)) AS n_keys,
       count(*) = count(k) AS satisfied FROM s
UNION ALL SELECT 'not_null:l_tax', 0, 0, true
UNION ALL SELECT 'unique:line', (sum(n) - count(*))::BIGINT, count(*), count(*) = 0 FROM
  (SELECT count(*) AS n FROM s WHERE k IS NOT NULL GROUP BY k, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'foreign_key:order', count(*), count(DISTINCT k), count(*) = 0 FROM s
  WHERE k NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
UNION ALL SELECT 'foreign_key:supplier', 0, 0, true""")
def check_constraints(t):
    rows = t.lineitem.select(
        F.expr("case when l_linenumber = 4 then null else l_orderkey end").alias("k"),
        "l_linenumber", "l_suppkey", "l_tax",
    )
    return K.check_constraints(
        rows, ["k", "l_tax"], {"line": ["k", "l_linenumber"]},
        {
            "order": (["k"], t.orders.where("o_orderstatus <> 'P'"), ["o_orderkey"]),
            "supplier": (["l_suppkey"], t.supplier, ["s_suppkey"]),
        },
    )


# One catalog per customer: the priorities of the customer's orders are tables
# that refer to status tables; expensive orders declare the reference unique.
_FKS = """f AS (SELECT DISTINCT o_custkey AS catalog_id, o_orderpriority AS a, o_orderstatus AS b FROM orders),
  k AS (SELECT DISTINCT o_custkey AS catalog_id, o_orderpriority AS a, o_orderstatus AS b FROM orders WHERE o_totalprice > 350000)"""


def _fks(t):
    # dealt before they are counted, so no task holds more different rows the longer its file is
    named = ["o_custkey", "o_orderpriority", "o_orderstatus"]
    return t.orders.select(*named).repartition(parts_of(t.orders), *named).distinct().select(
        F.col("o_custkey").alias("catalog_id"), F.col("o_orderpriority").alias("from_table"),
        F.array(F.concat(F.lit("ref_"), "o_orderstatus")).alias("from_columns"),
        F.col("o_orderstatus").alias("to_table"), F.array(F.lit("id")).alias("to_columns"),
    )


def _keys(t):
    return t.orders.where("o_totalprice > 350000").select(
        F.col("o_custkey").alias("catalog_id"), F.col("o_orderpriority").alias("table_name"),
        F.array(F.concat(F.lit("ref_"), "o_orderstatus")).alias("columns"),
    ).distinct()


def _requests(t, source, target):
    return t.orders.select(
        F.col("o_custkey").alias("catalog_id"), F.lit(source).alias("source"), F.lit(target).alias("target")
    ).distinct()


@query("declared_cardinality", f"""WITH {_FKS},
  j AS (SELECT f.*, k.b IS NOT NULL AS u FROM f LEFT JOIN k USING (catalog_id, a, b))
SELECT catalog_id, a AS left_table, b AS right_table, CASE WHEN u THEN 'ONE_TO_ONE' ELSE 'MANY_TO_ONE' END AS cardinality,
       false AS may_fan_out FROM j
UNION ALL SELECT catalog_id, b, a, CASE WHEN u THEN 'ONE_TO_ONE' ELSE 'ONE_TO_MANY' END, NOT u FROM j""")
def declared_cardinality(t):
    return K.declared_cardinality(_fks(t), _keys(t))


# Every priority against every status and a status that no customer has; not all pairs are declared, not all tables exist.
_PAIRS = """c AS (SELECT DISTINCT o_custkey AS catalog_id FROM orders),
  p AS (SELECT DISTINCT o_orderpriority AS a FROM orders), s AS (SELECT DISTINCT o_orderstatus AS b FROM orders UNION ALL SELECT 'X'),
  asked AS (SELECT catalog_id, a, b FROM c, p, s)"""


_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def _pairs(t):
    customers = t.orders.select(F.col("o_custkey").alias("catalog_id")).distinct()
    named = customers.select("catalog_id", F.explode(F.array(*map(F.lit, _PRIORITIES))).alias("a"))
    return named.select("catalog_id", "a", F.explode(F.array(*map(F.lit, ("F", "O", "P", "X")))).alias("b"))


@query("requested_cardinality", f"""WITH {_FKS}, {_PAIRS},
  j AS (SELECT asked.*, f.b IS NOT NULL AS declared, k.b IS NOT NULL AS u FROM asked LEFT JOIN f USING (catalog_id, a, b)
        LEFT JOIN k USING (catalog_id, a, b))
SELECT catalog_id, b AS left_table, a AS right_table,
       CASE WHEN NOT declared THEN 'UNKNOWN' WHEN u THEN 'ONE_TO_ONE' ELSE 'ONE_TO_MANY' END AS cardinality,
       CASE WHEN declared THEN NOT u END AS may_fan_out FROM j""")
def requested_cardinality(t):
    asked = _pairs(t).select("catalog_id", F.col("b").alias("left_table"), F.col("a").alias("right_table"))
    fks = _fks(t)
    tables = fks.select("catalog_id", F.col("from_table").alias("table_name")).unionAll(fks.select("catalog_id", "to_table"))
    return K.requested_cardinality(asked, tables, fks, _keys(t))


# A priority table joined by its reference and another column, and the status table by what the reference names.
@query("join_fan_out", f"""WITH {_FKS},
  t AS (SELECT catalog_id, a, count(*) AS n FROM k GROUP BY ALL)
SELECT f.catalog_id, f.a || '>' || f.b AS join_id, CASE WHEN k.b IS NOT NULL THEN true WHEN t.n > 0 THEN false END AS at_most_one
FROM f LEFT JOIN k USING (catalog_id, a, b) LEFT JOIN t USING (catalog_id, a)
UNION ALL SELECT catalog_id, b || '<' || a, true FROM f""")
def join_fan_out(t):
    fks = durable(_fks(t))
    down = fks.select(
        "catalog_id", F.concat("from_table", F.lit(">"), "to_table").alias("join_id"), F.col("to_table").alias("left_table"),
        F.array(F.lit("id"), F.lit("n")).alias("left_columns"), F.col("from_table").alias("right_table"),
        F.array(F.col("from_columns")[0], F.lit("n")).alias("right_columns"),
    )
    up = fks.select(
        "catalog_id", F.concat("to_table", F.lit("<"), "from_table"), F.col("from_table"), "from_columns", F.col("to_table"), "to_columns"
    )
    return K.join_fan_out(down.unionAll(up), fks, durable(_keys(t)))


@query("uniquely_identified", f"""WITH {_FKS},
  r AS (SELECT catalog_id, a, list_sort(list(b)) AS bs FROM f GROUP BY ALL),
  x AS (SELECT r.*, k.b AS kb FROM r LEFT JOIN k USING (catalog_id, a))
SELECT catalog_id, a AS table_name, len(bs) AS n_columns, bool_or(CASE WHEN kb IS NOT NULL THEN list_contains(bs, kb) END) AS identifies
FROM x GROUP BY catalog_id, a, bs""")
def uniquely_identified(t):
    refs = _fks(t).select("catalog_id", F.col("from_table").alias("table_name"), F.col("from_columns")[0].alias("c"))
    # at most one reference per order status
    grouped = refs.groupBy("catalog_id", "table_name").agg(F.sort_array(F.collect_set("c")).alias("columns"))
    return K.uniquely_identified(grouped, _keys(t)).select(
        "catalog_id", "table_name", F.size("columns").cast("bigint").alias("n_columns"), "identifies"
    )


@query("bridge_tables", f"""WITH {_FKS}
SELECT x.catalog_id, 'F' AS source, 'O' AS target, x.a AS bridge
FROM f x JOIN f y ON x.catalog_id = y.catalog_id AND x.a = y.a WHERE x.b = 'F' AND y.b = 'O'""")
def bridge_tables(t):
    return K.bridge_tables(_fks(t), _requests(t, "F", "O"))


@query("join_paths", f"""WITH RECURSIVE {_FKS},
  r AS (SELECT DISTINCT catalog_id FROM f),
  e AS (SELECT catalog_id, a, b FROM f UNION SELECT catalog_id, b, a FROM f),
  walk AS (
    SELECT catalog_id, ['1-URGENT'] AS path, '1-URGENT' AS place FROM r
    UNION ALL SELECT walk.catalog_id, list_append(path, e.b), e.b FROM walk JOIN e ON e.catalog_id = walk.catalog_id AND e.a = place
    WHERE place <> '5-LOW' AND NOT list_contains(path, e.b)),
  best AS (SELECT * FROM walk WHERE place = '5-LOW'
           QUALIFY row_number() OVER (PARTITION BY catalog_id ORDER BY len(path), path) = 1)
SELECT r.catalog_id, '1-URGENT' AS source, '5-LOW' AS target, array_to_string(path, '>') AS path,
       (len(path) - 1)::BIGINT AS hops
FROM r LEFT JOIN best USING (catalog_id)""")
def join_paths(t):
    return K.join_paths(_fks(t), _requests(t, "1-URGENT", "5-LOW"))


@query("unresolved_references", """
WITH cols AS (SELECT DISTINCT c_nationkey::VARCHAR AS table_name, o_orderpriority AS column_name
              FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 490000),
  sc AS (SELECT o_orderkey AS scope_id, 'c' AS alias, c_nationkey::VARCHAR AS table_name FROM orders JOIN customer ON o_custkey = c_custkey
         UNION ALL SELECT l_orderkey, 's' || l_linenumber, s_nationkey::VARCHAR FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
  rf AS (SELECT o_orderkey AS scope_id, o_orderkey AS ref_id, o_orderpriority AS column_name,
                CASE o_orderstatus WHEN 'F' THEN 'c' WHEN 'P' THEN 's3' END AS qualifier FROM orders),
  j AS (SELECT rf.*, (SELECT count(DISTINCT sc.table_name) FROM sc JOIN cols USING (table_name)
                      WHERE sc.scope_id = rf.scope_id AND cols.column_name = rf.column_name) AS n,
               EXISTS (SELECT 1 FROM sc WHERE sc.scope_id = rf.scope_id AND sc.alias = rf.qualifier) AS known,
               EXISTS (SELECT 1 FROM sc JOIN cols USING (table_name) WHERE sc.scope_id = rf.scope_id
                       AND sc.alias = rf.qualifier AND cols.column_name = rf.column_name) AS has FROM rf),
  v AS (SELECT scope_id, ref_id, qualifier, column_name,
    CASE WHEN qualifier IS NOT NULL AND NOT known THEN 'unknown_qualifier' WHEN qualifier IS NOT NULL AND NOT has THEN 'missing'
         WHEN qualifier IS NULL AND n = 0 THEN 'missing' WHEN qualifier IS NULL AND n > 1 THEN 'ambiguous' END AS status FROM j)
SELECT * FROM v WHERE status IS NOT NULL""")
def unresolved_references(t):
    columns = (
        t.customer.join(t.orders.where("o_totalprice > 490000"), F.col("c_custkey") == F.col("o_custkey"))
        .select(F.col("c_nationkey").cast("string").alias("table_name"), F.col("o_orderpriority").alias("column_name"))
    )
    by_customer = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("scope_id"), F.lit("c").alias("alias"),
        F.col("c_nationkey").cast("string").alias("table_name"),
    )
    by_supplier = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_orderkey").alias("scope_id"), F.concat(F.lit("s"), "l_linenumber").alias("alias"),
        F.col("s_nationkey").cast("string").alias("table_name"),
    )
    refs = t.orders.select(
        F.col("o_orderkey").alias("scope_id"), F.col("o_orderkey").alias("ref_id"),
        F.expr("case o_orderstatus when 'F' then 'c' when 'P' then 's3' end").alias("qualifier"),
        F.col("o_orderpriority").alias("column_name"),
    )
    return K.unresolved_references(refs, by_customer.unionAll(by_supplier), columns)


# One JSON catalog per part; its type decides the form, its size the facts.
_LIST = """{"tables": [
 {"name": "item", "columns": [{"name": "Id", "type": "integer", "primary_key": true},
   {"name": "price", "data_type": "<TYPE>", "nullable": <NULLABLE>}, {"name": "owner", "unique": <UNIQUE>}],
  "foreign_keys": [{"column": "owner", "references_table": "Person", "references_column": "<TARGET>"}]},
 {"name": "Person", "columns": ["id", "label"]}]}"""
_MAPPING = '{"item": ["id", "price", "<SECOND>"], "person": ["id"]}'
_INDEX = """{"table_names_original": ["item", "person"], "column_names_original":
 [[-1, "*"], [0, "id"], [0, "price"], [0, "owner"], [1, "id"]], "column_types": ["text", "number", "<TYPE>", "text", "number"],
 "primary_keys": [1, 4], "foreign_keys": [[3, 4]]}"""


def _catalogs(t):
    def fill(text, **values):
        column = F.lit(text)
        for name, value in values.items():
            column = F.replace(column, F.lit(f"<{name}>"), value)
        return column

    declared = F.expr("case when p_size < 10 then 'money' when p_size < 30 then 'decimal(10, 2)' else 'REAL' end")
    return t.part.select(
        F.col("p_partkey").alias("doc_id"),
        F.when(
            F.col("p_type").isin("ECONOMY", "STANDARD"),
            fill(
                _LIST, TYPE=declared, NULLABLE=F.expr("case when p_size > 25 then 'true' else 'false' end"),
                UNIQUE=F.expr("case when p_size > 40 then 'true' else 'false' end"),
                TARGET=F.expr("case when p_size = 50 then 'nowhere' else 'ID' end"),
            ),
        ).when(
            F.col("p_type").isin("PROMO", "MEDIUM"),
            fill(_MAPPING, SECOND=F.expr("case when p_size = 7 then 'PRICE' else 'owner' end")),
        ).when(F.col("p_type") == "LARGE", fill(_INDEX, TYPE=declared))
        .otherwise("{broken").alias("json"),
    )


_FORM = """d AS (SELECT p_partkey AS doc_id, p_size AS z, CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN 'list'
     WHEN p_type IN ('PROMO', 'MEDIUM') THEN 'mapping' WHEN p_type = 'LARGE' THEN 'index' ELSE 'broken' END AS form,
     CASE WHEN p_size < 10 THEN NULL WHEN p_size < 30 THEN 'DECIMAL(10, 2)' ELSE 'REAL' END AS ty FROM part)"""


@query("catalog_columns", f"""WITH {_FORM}
SELECT doc_id, 'item' AS table_name, 'Id' AS column_name, 'INTEGER' AS data_type, false AS nullable, true AS primary_key FROM d WHERE form = 'list'
UNION ALL SELECT doc_id, 'item', 'price', ty, z > 25, false FROM d WHERE form = 'list'
UNION ALL SELECT doc_id, 'item', 'owner', NULL, NULL, false FROM d WHERE form = 'list'
UNION ALL SELECT doc_id, 'Person', unnest(['id', 'label']), NULL, NULL, false FROM d WHERE form = 'list'
UNION ALL SELECT doc_id, 'item', unnest(['id', 'price', 'owner']), NULL, NULL, false FROM d WHERE form = 'mapping' AND z <> 7
UNION ALL SELECT doc_id, 'person', 'id', NULL, NULL, false FROM d WHERE form = 'mapping'
UNION ALL SELECT doc_id, 'item', 'id', 'NUMBER', false, true FROM d WHERE form = 'index'
UNION ALL SELECT doc_id, 'item', 'price', ty, NULL, false FROM d WHERE form = 'index'
UNION ALL SELECT doc_id, 'item', 'owner', 'TEXT', NULL, false FROM d WHERE form = 'index'
UNION ALL SELECT doc_id, 'person', 'id', 'NUMBER', false, true FROM d WHERE form = 'index'""")
def catalog_columns(t):
    return G.catalog_columns(_catalogs(t))


@query("catalog_keys", f"""WITH {_FORM}
SELECT doc_id, 'item' AS table_name, 'primary' AS kind, 'id' AS columns FROM d WHERE form IN ('list', 'index')
UNION ALL SELECT doc_id, 'person', 'primary', 'id' FROM d WHERE form = 'index'
UNION ALL SELECT doc_id, 'item', 'unique', 'owner' FROM d WHERE form = 'list' AND z > 40""")
def catalog_keys(t):
    return G.catalog_keys(_catalogs(t)).withColumn("columns", F.array_join("columns", ","))


@query("catalog_foreign_keys", f"""WITH {_FORM}
SELECT doc_id, 'item' AS from_table, 'owner' AS from_columns, 'Person' AS to_table, 'id' AS to_columns
FROM d WHERE form = 'list' AND z <> 50
UNION ALL SELECT doc_id, 'item', 'owner', 'person', 'id' FROM d WHERE form = 'index'""")
def catalog_foreign_keys(t):
    return G.catalog_foreign_keys(_catalogs(t)).withColumns(
        {name: F.array_join(name, ",") for name in ("from_columns", "to_columns")}
    )


@query("catalog_tables", f"""WITH {_FORM}
SELECT doc_id, 'item' AS table_name, 3::BIGINT AS n_columns,
       CASE WHEN form = 'mapping' THEN 'STRUCTURE_ONLY' ELSE 'DECLARED' END AS confidence
FROM d WHERE form <> 'broken' AND NOT (form = 'mapping' AND z = 7)
UNION ALL SELECT doc_id, CASE form WHEN 'list' THEN 'Person' ELSE 'person' END, CASE form WHEN 'list' THEN 2 ELSE 1 END,
       CASE WHEN form = 'index' THEN 'DECLARED' ELSE 'STRUCTURE_ONLY' END FROM d WHERE form <> 'broken'""")
def catalog_tables(t):
    return G.catalog_tables(_catalogs(t))


@query("catalog_rejects", f"""WITH {_FORM}
SELECT doc_id, 'catalog' AS level, NULL::VARCHAR AS item, 'SCHEMA_JSON_INVALID' AS code FROM d WHERE form = 'broken'
UNION ALL SELECT doc_id, 'column', 'item.price', 'INVALID_COLUMN_TYPE_DROPPED' FROM d WHERE form IN ('list', 'index') AND z < 10
UNION ALL SELECT doc_id, 'table', 'item', 'INVALID_OR_DUPLICATE_COLUMN' FROM d WHERE form = 'mapping' AND z = 7
UNION ALL SELECT doc_id, 'foreign_key', 'item.owner', 'UNRESOLVED_FOREIGN_KEY_DROPPED' FROM d WHERE form = 'list' AND z = 50""")
def catalog_rejects(t):
    return G.catalog_rejects(_catalogs(t))


@query("catalog_limitations", f"""WITH {_FORM}
SELECT doc_id, 'SCHEMA_JSON_INVALID' AS limitation FROM d WHERE form = 'broken'
UNION ALL SELECT doc_id, 'INVALID_COLUMN_TYPE_DROPPED' FROM d WHERE form IN ('list', 'index') AND z < 10
UNION ALL SELECT doc_id, 'INVALID_OR_DUPLICATE_COLUMN' FROM d WHERE form = 'mapping' AND z = 7
UNION ALL SELECT doc_id, 'CONSTRAINTS_AND_TYPES_UNKNOWN' FROM d WHERE form = 'mapping'
UNION ALL SELECT doc_id, 'UNRESOLVED_FOREIGN_KEY_DROPPED' FROM d WHERE form = 'list' AND z = 50""")
def catalog_limitations(t):
    return G.catalog_limitations(_catalogs(t))
