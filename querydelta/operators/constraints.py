"""Declared keys, foreign keys and columns: checks on data and on catalog tables.

Catalog tables are DataFrames keyed by ``catalog_id``, so one job handles any
number of catalogs:

* ``fks``: catalog_id, from_table, from_columns (array), to_table, to_columns (array)
* ``keys``: catalog_id, table_name, columns (array)
* ``columns``: catalog_id, table_name, column_name
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querydelta.session import durable, parts_of

ForeignKey = tuple[Sequence[str], DataFrame, Sequence[str]]


def check_constraints(
    df: DataFrame, not_null: Sequence[str] = (), unique: Mapping[str, Sequence[str]] | None = None,
    foreign_keys: Mapping[str, ForeignKey] | None = None,
) -> DataFrame:
    """Violating rows (and keys) per declared constraint.

    A unique key ignores rows with a NULL in it; a foreign key ignores them too. Each table is read once: a row becomes
    one (constraint, key) pair per constraint, referenced keys join the same counts, and one aggregate per pair and one
    per constraint give the report.
    """
    unique, foreign_keys = dict(unique or {}), dict(foreign_keys or {})
    names = [*(f"not_null:{name}" for name in not_null), *(f"unique:{name}" for name in unique), *(f"foreign_key:{name}" for name in foreign_keys)]
    if not names:
        raise ValueError("no constraint given")
    place = {name: index for index, name in enumerate(names)}
    own = [F.when(F.col(name).isNull(), _pair(place[f"not_null:{name}"], F.lit(""))) for name in not_null]
    own += [_key_pair(place[f"unique:{name}"], [F.col(column) for column in columns]) for name, columns in unique.items()]
    parents: dict[int, tuple[DataFrame, list[Column]]] = {}
    for name, (columns, parent, parent_columns) in foreign_keys.items():
        # either side in the type in which the two compare
        kinds = [(df.schema[a].dataType, parent.schema[b].dataType) for a, b in zip(columns, parent_columns, strict=True)]
        child = [F.coalesce(F.col(column), F.lit(None).cast(kind)) for column, (_, kind) in zip(columns, kinds, strict=True)]
        known = [F.coalesce(F.col(column), F.lit(None).cast(kind)) for column, (kind, _) in zip(parent_columns, kinds, strict=True)]
        own.append(_key_pair(place[f"foreign_key:{name}"], child))
        parents.setdefault(id(parent), (parent, []))[1].append(_key_pair(place[f"foreign_key:{name}"], known))

    def pairs(table: DataFrame, entries: Sequence[Column], rows: int) -> DataFrame:
        spread = table.select(F.explode(F.array_compact(F.array(*entries))).alias("pair"))
        return spread.select("pair.*", F.lit(rows).cast("bigint").alias("n"))

    every = pairs(df, own, 1)
    for parent, entries in parents.values():
        every = every.unionAll(pairs(parent, entries, 0))
    counted = every.groupBy("index", "key").agg(F.sum("n").alias("n"), F.count_if(F.col("n") == 0).alias("known"))
    named = df.sparkSession.createDataFrame(list(enumerate(names)), "index int, constraint string").select(
        "index", F.lit(None).cast("string").alias("key"), F.lit(0).cast("bigint").alias("n"), F.lit(1).cast("bigint").alias("known"), "constraint"
    )
    first_key = len(not_null) + len(unique)
    index, n = F.col("index"), F.col("n")
    wrong = (
        F.when(index < len(not_null), n).when(index < first_key, n - 1).when((F.col("known") == 0) & (n > 0), n).otherwise(0)
    )
    keys = F.when(index < len(not_null), n).when(wrong > 0, 1).otherwise(0)
    judged = counted.withColumn("constraint", F.lit(None).cast("string")).select(*named.columns)
    real = F.col("key").isNotNull()
    return judged.unionAll(named).groupBy("index").agg(
        F.max("constraint").alias("constraint"), F.sum(F.when(real, wrong).otherwise(0)).cast("bigint").alias("n_violations"),
        F.sum(F.when(real, keys).otherwise(0)).cast("bigint").alias("n_keys"),
    ).select("constraint", "n_violations", "n_keys", (F.col("n_violations") == 0).alias("satisfied"))


def _pair(index: int, key: Column) -> Column:
    return F.struct(F.lit(index).alias("index"), key.alias("key"))


def _key_pair(index: int, columns: Sequence[Column]) -> Column:
    """NULL for a key with a NULL in it."""
    whole = reduce(lambda a, b: a & b, [column.isNotNull() for column in columns])
    return F.when(whole, _pair(index, F.to_json(F.array(*[column.cast("string") for column in columns]))))


def uniquely_identified(refs: DataFrame, keys: DataFrame) -> DataFrame:
    """Do the given columns contain a declared key? TRUE, FALSE, or NULL without any key.

    ``refs``: catalog_id, table_name, columns (array).
    """
    marked = refs.withColumn("ref__", F.xxhash64("catalog_id", "table_name", "columns"))
    known = keys.select("catalog_id", "table_name", F.col("columns").alias("key__"))
    matched = marked.join(known, ["catalog_id", "table_name"], "left")
    inside = F.when(
        F.col("key__").isNotNull(), F.size(F.array_except("key__", "columns")) == 0
    )
    return matched.groupBy("catalog_id", "table_name", "columns").agg(
        F.bool_or(inside).alias("identifies")
    )


def declared_cardinality(fks: DataFrame, keys: DataFrame) -> DataFrame:
    """Declared cardinality per table pair, from the left table's point of view.

    A foreign key whose columns hold a key of their own table is 1:1.
    """
    known = keys.select("catalog_id", F.col("table_name").alias("from_table"), F.col("columns").alias("key__"))
    judged = (
        fks.select("catalog_id", "from_table", "from_columns", "to_table")
        .join(known, ["catalog_id", "from_table"], "left")
        .groupBy("catalog_id", "from_table", "to_table")
        .agg(
            F.coalesce(
                F.bool_or(F.size(F.array_except("key__", "from_columns")) == 0), F.lit(False)
            ).alias("unique__")
        )
    )
    forward = judged.select(
        "catalog_id", F.col("from_table").alias("left_table"), F.col("to_table").alias("right_table"),
        F.lit(1).alias("rank__"),
        F.when(F.col("unique__"), "ONE_TO_ONE").otherwise("MANY_TO_ONE").alias("cardinality"),
    )
    reverse = judged.where("from_table <> to_table").select(
        "catalog_id", F.col("to_table").alias("left_table"), F.col("from_table").alias("right_table"),
        F.lit(2).alias("rank__"),
        F.when(F.col("unique__"), "ONE_TO_ONE").otherwise("ONE_TO_MANY").alias("cardinality"),
    )
    # a foreign key of the left table itself speaks before one of the right table
    return forward.unionAll(reverse).groupBy("catalog_id", "left_table", "right_table").agg(
        F.min_by("cardinality", "rank__").alias("cardinality")
    ).withColumn("may_fan_out", F.col("cardinality").isin("ONE_TO_MANY", "MANY_TO_MANY"))


def requested_cardinality(requests: DataFrame, tables: DataFrame, fks: DataFrame, keys: DataFrame) -> DataFrame:
    """``cardinality`` and ``may_fan_out`` of each requested pair ``catalog_id, left_table, right_table``.

    ``tables``: catalog_id, table_name. A pair with an unknown table, or without a foreign key between its tables,
    is ``UNKNOWN``, and whether joining it multiplies rows is then NULL, not FALSE.
    """
    known = tables.select("catalog_id", "table_name").distinct()
    pairs = requests.select("catalog_id", "left_table", "right_table").distinct()
    there = pairs.join(known.withColumnRenamed("table_name", "left_table"), ["catalog_id", "left_table"], "left_semi").join(
        known.withColumnRenamed("table_name", "right_table"), ["catalog_id", "right_table"], "left_semi"
    )
    names = ["catalog_id", "left_table", "right_table"]
    found = there.join(declared_cardinality(fks, keys), names)
    return pairs.join(found, names, "left").select(*names, F.coalesce("cardinality", F.lit("UNKNOWN")).alias("cardinality"), "may_fan_out")


def join_fan_out(joins: DataFrame, fks: DataFrame, keys: DataFrame) -> DataFrame:
    """``at_most_one``: does a row of the left side meet at most one row of the joined table? TRUE, FALSE or NULL.

    ``joins``: catalog_id, join_id, left_table, left_columns, right_table, right_columns (arrays in step). It does if the join columns of
    the joined table hold one of its keys. Columns that a foreign key takes from the left side bind the whole key that
    it refers to, so a foreign key of the left table into the joined one counts as well; without any declared key the answer is NULL.

    Rows are dealt into as many parts as the longest of the three tables asks for, so a task's share does not grow with them;
    ``fks`` and ``keys`` are read twice.
    """
    asked = durable(joins.select("catalog_id", "join_id", "left_table", "left_columns", "right_table", "right_columns"))
    parts = max(map(parts_of, (asked, fks, keys)))
    table, pair = ["catalog_id", "right_table"], ["catalog_id", "left_table", "right_table"]
    own = keys.select("catalog_id", F.col("table_name").alias("right_table"), F.col("columns").alias("key__"))
    by_key = asked.repartition(parts, *table).join(own.repartition(parts, *table), table, "left").select(
        "catalog_id", "join_id",
        F.when(F.col("key__").isNotNull(), F.size(F.array_except("key__", "right_columns")) == 0).alias("bound"),
    )
    references = fks.select(
        "catalog_id", F.col("from_table").alias("left_table"), F.col("to_table").alias("right_table"),
        F.arrays_zip("from_columns", "to_columns").alias("reference__"),
    )
    joined_on = F.arrays_zip(F.col("left_columns").alias("from_columns"), F.col("right_columns").alias("to_columns"))
    by_reference = asked.repartition(parts, *pair).join(references.repartition(parts, *pair), pair).select(
        "catalog_id", "join_id", F.when(F.forall("reference__", lambda pair: F.array_contains(joined_on, pair)), True).alias("bound")
    )
    judged = by_key.unionAll(by_reference).repartition(parts, "catalog_id", "join_id")
    return judged.groupBy("catalog_id", "join_id").agg(F.bool_or("bound").alias("at_most_one"))


def bridge_tables(fks: DataFrame, requests: DataFrame) -> DataFrame:
    """Tables with foreign keys to both ends of a requested pair.

    ``requests``: catalog_id, source, target.
    """
    edges = fks.select("catalog_id", F.col("from_table").alias("bridge"), "to_table").distinct()
    to_source = edges.withColumnRenamed("to_table", "source")
    to_target = edges.withColumnRenamed("to_table", "target")
    return (
        requests.join(to_source, ["catalog_id", "source"])
        .join(to_target, ["catalog_id", "target", "bridge"])
        .where("bridge <> source and bridge <> target")
        .select("catalog_id", "source", "target", "bridge")
    )


def join_paths(fks: DataFrame, requests: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Shortest undirected foreign-key path per requested pair, first in name order.

    ``requests``: catalog_id, source, target. The path is NULL if there is none, or
    if the ends are more than a given ``max_hops`` apart. Every round keeps one path
    per newly reached table: a prefix of the first shortest path is itself the first
    shortest path. Rounds go on until no open pair reaches a new table.
    """
    one_way = fks.select("catalog_id", F.col("from_table").alias("a"), F.col("to_table").alias("b"))
    edges = durable(
        one_way.unionAll(one_way.select("catalog_id", F.col("b").alias("a"), F.col("a").alias("b")))
        .where("a <> b").distinct()
    )
    pair = ["catalog_id", "source", "target"]
    level = requests.select(*pair).distinct().select(
        *pair, F.col("source").alias("at"), F.array("source").alias("path")
    )
    found = level.where("at = target").select(*pair, "path")
    level = level.where("at <> target")
    seen, hops = level.select(*pair, "at"), 0
    while max_hops is None or hops < max_hops:
        hops += 1
        step = (
            level.join(edges.withColumnRenamed("a", "at"), ["catalog_id", "at"])
            .groupBy(*pair, F.col("b").alias("at"))
            .agg(F.min(F.concat("path", F.array("b"))).alias("path"))
            .join(seen, [*pair, "at"], "left_anti")
        )
        newest = durable(step)
        if newest.isEmpty():
            break
        ended = newest.where("at = target").select(*pair, "path")
        found, seen = found.unionAll(ended), seen.unionAll(newest.select(*pair, "at"))
        level = newest.join(ended.select(*pair), pair, "left_anti")
        if hops % 8 == 0:
            found, seen = durable(found), durable(seen)
    best = found.groupBy(*pair).agg(F.min(F.struct(F.size("path").alias("n"), "path")).alias("best"))
    return requests.select(*pair).distinct().join(best, pair, "left").select(
        *pair, F.array_join("best.path", ">").alias("path"), (F.col("best.n") - 1).cast("bigint").alias("hops")
    )


def unresolved_references(refs: DataFrame, scopes: DataFrame, columns: DataFrame) -> DataFrame:
    """Column references that no table in scope provides, or that several do.

    * ``refs``: scope_id, ref_id, qualifier (NULL if unqualified), column_name
    * ``scopes``: scope_id, alias, table_name
    * ``columns``: table_name, column_name

    Only the columns a scope asks for are looked up, once each, and counted per
    (scope, column) before the references meet them. The different columns are written first: a small table of them is
    then broadcast, instead of all scopes being dealt by a few names of tables and columns.
    """
    columns = durable(columns.select("table_name", "column_name").distinct())
    asked = refs.select("scope_id", "column_name").distinct()
    provided = scopes.join(asked, "scope_id").join(columns, ["table_name", "column_name"], "left_semi")
    by_alias = provided.select("scope_id", F.col("alias").alias("qualifier"), "column_name").distinct() \
        .withColumn("has_column", F.lit(True))
    aliases = scopes.select("scope_id", F.col("alias").alias("qualifier")).distinct() \
        .withColumn("has_alias", F.lit(True))
    by_name = provided.select("scope_id", "column_name", "table_name").distinct() \
        .groupBy("scope_id", "column_name").agg(F.count(F.lit(1)).alias("candidates"))
    judged = (
        refs.join(by_alias, ["scope_id", "qualifier", "column_name"], "left")
        .join(aliases, ["scope_id", "qualifier"], "left")
        .join(by_name, ["scope_id", "column_name"], "left")
    )
    candidates = F.coalesce("candidates", F.lit(0))
    status = (
        F.when(F.col("qualifier").isNotNull() & F.col("has_alias").isNull(), "unknown_qualifier")
        .when(F.col("qualifier").isNotNull() & F.col("has_column").isNull(), "missing")
        .when(F.col("qualifier").isNull() & (candidates == 0), "missing")
        .when(F.col("qualifier").isNull() & (candidates > 1), "ambiguous")
    )
    return judged.select("scope_id", "ref_id", "qualifier", "column_name", status.alias("status")).where(
        "status is not null"
    )
