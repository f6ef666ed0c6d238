"""Test tables, boundary values, perturbations and witness samples.

Rows come from an ``id`` column (``spark.range`` or the key of an existing
table) and column expressions, so tables of any size are built on the executors.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, NumericType, StructField, StructType

from querydelta.functions.keys import plain_digits
from querydelta.functions.logic import as_column
from querydelta.functions.sorting import SortKey, names
from querydelta.operators.positions import first_rows, null_safe_lookup, running
from querydelta.session import durable

# The categories that seeded text columns cycle through, by a part of the column's name; the first counts.
CATEGORIES = {
    "semester": ["Fall", "Spring", "Summer", "Winter"],
    "grade": ["A", "B", "C", None],
    "country": ["USA", "UK", "Germany", "Canada"],
    "title": ["Sales Manager", "Marketing Lead", "Engineer", "Analyst"],
    "dept": ["Comp. Sci.", "Math", "Physics", "History"],
    "name": ["Alice", "Bob", "Carol", "Dave"],
}

_NUMERIC = ("INT", "REAL", "NUM", "DEC", "DOUB", "FLOA", "LONG", "SHORT")


def _cycle(values: Sequence[str | None], row: Column) -> Column:
    place = (F.pmod(row, F.lit(len(values))) + 1).cast("int")
    return F.element_at(F.array(*[F.lit(value).cast("string") for value in values]), place)


def seed_value(name: str, declared: str, row: Column) -> Column:
    """A deterministic value by declared type and column name.

    Numbers rise with the row, dates repeat every nine days, categories cycle,
    any other text is unique.
    """
    kind = declared.upper()
    lowered = name.lower()
    if kind in {"DATE", "DATETIME", "TIMESTAMP"} or "date" in lowered:
        return F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(row, F.lit(9)).cast("int"))
    if any(token in kind for token in _NUMERIC):
        whole = "INT" in kind or "LONG" in kind or "SHORT" in kind
        return (row + 1).cast("bigint" if whole else "double")
    if lowered == "location":
        return F.format_string("POINT(%d %d)", row, row)
    for token, values in CATEGORIES.items():
        if token in lowered:
            return _cycle(values, row)
    return F.concat(F.lit(f"{name}_"), (row + 1).cast("string"))


def seed_table(
    ids: DataFrame, columns: Mapping[str, str], foreign_keys: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """One typed row per ``id``; ``columns`` maps names to declared types.

    A foreign key column cycles through 1..rows of its parent table, whose key
    is seeded over the same range: a join to the parent is never empty.
    """
    row = F.col("id").cast("bigint")
    selected = []
    for name, declared in columns.items():
        parent = (foreign_keys or {}).get(name)
        if parent is None:
            selected.append(seed_value(name, declared, row).alias(name))
        else:
            size = parent.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n")).scalar()
            selected.append((F.pmod(row, size) + 1).cast("bigint").alias(name))
    return ids.select(*selected)


def _number(value: Column) -> Column:
    return plain_digits(value.cast("decimal(38,10)").cast("string"))


def boundary_rows(specs: DataFrame) -> DataFrame:
    """Probe values around the literal of each predicate.

    ``specs``: table_name, column_name, op (``=``, ``<>``, ``<``, ``<=``, ``>``,
    ``>=``, ``IN``, ``BETWEEN``, ``LIKE``, ``IS NULL``), value, high and
    members (array), all text. Labels: ``literal``, ``below``, ``above``,
    ``match``, ``miss`` and ``null``.
    """
    op, text = F.upper("op"), F.col("value")
    number = text.try_cast("decimal(38,10)")
    high = F.col("high").try_cast("decimal(38,10)")
    is_number = number.isNotNull()
    first = F.get("members", F.lit(0))
    largest = F.array_max(F.transform("members", lambda m: m.try_cast("decimal(38,10)")))
    other = F.concat(F.lit("not_"), text)
    below = F.when(is_number, _number(number - 1)).otherwise(F.concat(text, F.lit("__below")))
    above = F.when(is_number, _number(number + 1)).otherwise(F.concat(text, F.lit("__above")))
    literal = F.when(is_number, _number(number)).otherwise(text)
    match = (
        F.when(op == "IN", first)
        .when(op == "LIKE", F.translate(text, "%_", "aa"))
        .when(op == "IS NULL", F.lit(None))
        .when(op.isin("=", "<=", ">=", "BETWEEN"), literal)
        .when(op == ">", above).when(op == "<", below)
        .when(op == "<>", F.when(is_number, above).otherwise(other))
    )
    miss = (
        F.when(op == "IN", F.when(largest.isNotNull(), _number(largest + 1)).otherwise(F.concat(F.lit("not_"), first)))
        .when(op == "LIKE", F.concat(F.lit("not_"), F.regexp_replace(text, "[%_]", "")))
        .when(op == "IS NULL", F.lit("not_null"))
        .when(op == "BETWEEN", F.when(high.isNotNull(), _number(high + 1)).otherwise(below))
        .when(op.isin(">", "<", "<>"), literal)
        .when(op == ">=", below).when(op == "<=", above)
        .when(op == "=", F.when(is_number, above).otherwise(other))
    )
    bounded = op.isin("=", "<>", "<", "<=", ">", ">=", "BETWEEN")
    probes = [("literal", literal, bounded), ("below", below, bounded), ("above", above, bounded),
              ("match", match, F.lit(True)), ("miss", miss, F.lit(True)),
              ("null", F.lit(None).cast("string"), F.lit(True))]
    entries = F.filter(
        F.array(*[F.struct(F.lit(label).alias("label"), value.alias("probe"), use.alias("use"))
                  for label, value, use in probes]),
        lambda entry: entry["use"],
    )
    return specs.select(*specs.columns, F.explode(entries).alias("entry")).select(
        "table_name", "column_name", "op", "value", "entry.label", "entry.probe"
    )


def override_conflicts(overrides: DataFrame) -> DataFrame:
    """Cells claimed by locked writers that cannot both be right.

    ``overrides``: row_slot, column_name, relation, value (text), priority,
    owner, locked. Equal claims agree; so do claims of one relation of which
    one leaves the value open.
    """
    claims = overrides.where("locked").groupBy("row_slot", "column_name").agg(
        F.min("relation").alias("r1"), F.max("relation").alias("r2"),
        F.min("value").alias("v1"), F.max("value").alias("v2"), F.count(F.lit(1)).alias("n_claims"),
    )
    return claims.where("r1 <> r2 or v1 <> v2").select("row_slot", "column_name", "n_claims")


def _strongest() -> Column:
    """Orders the claims on one cell: the highest priority first, then the first owner by name."""
    return F.struct((-F.col("priority")).alias("p"), F.col("owner"))


def _blank(dtype: DataType) -> Column:
    """The value that stands for "not NULL" in a column of this type; NULL where there is none."""
    blanks = {"string": F.lit(""), "date": F.lit("1970-01-01"), "timestamp": F.lit("1970-01-01"), "timestamp_ntz": F.lit("1970-01-01")}
    if dtype.simpleString() in blanks:
        return blanks[dtype.simpleString()].cast(dtype)
    return F.lit(0).cast(dtype) if isinstance(dtype, (NumericType, BooleanType)) else F.lit(None).cast(dtype)


def _override(field: StructField, schema: StructType, claim: Column) -> tuple[Column, Column]:
    """The cell after a claim, and why the claim fails (NULL: it holds)."""
    cell, relation, value = F.col(field.name), claim["relation"], claim["value"]
    literal, blank = value.try_cast(field.dataType), _blank(field.dataType)
    other, known = F.lit(None).cast(field.dataType), F.lit(False)
    for column in schema:
        if column.dataType == field.dataType and column.name != field.name:
            other = F.when(value == column.name, F.col(column.name)).otherwise(other)
            known = known | F.coalesce(value == column.name, F.lit(False))
    bad = value.isNotNull() & literal.isNull()
    to_column = relation.isin("equals_column", "not_equals_column")
    after = (
        F.when((relation == "equals") & ~bad, literal)
        .when(relation == "is_null", F.lit(None).cast(field.dataType))
        .when(relation == "not_null", F.coalesce(cell, blank))
        .when((relation == "equals_column") & known, other)
        .otherwise(cell)
    )
    failure = (
        F.when((relation == "equals") & bad, "bad_literal")
        .when(to_column & ~known, "unknown_operand")
        .when((relation == "not_equals_column") & cell.eqNullSafe(other), "not_satisfied")
        .when((relation == "not_null") & F.coalesce(cell, blank).isNull(), "not_satisfied")
        .when(~F.coalesce(relation.isin("equals", "is_null", "not_null") | to_column, F.lit(False)), "unknown_relation")
    )
    return after, failure


def apply_overrides(df: DataFrame, slot: str, overrides: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with the strongest override of each cell applied.

    Relations: ``equals``, ``is_null``, ``not_null`` (0, false, an empty text or
    1970-01-01 where the cell is NULL), ``equals_column`` and
    ``not_equals_column`` (checked only). The highest priority wins, then the first owner by name.
    ``columns`` are the columns that may be overridden. A claim that cannot hold
    leaves its cell as it is; ``unapplied_overrides`` lists those.
    """
    wide = overrides.groupBy(F.col("row_slot").alias("slot__")).agg(
        *[
            F.min_by(
                F.when(F.col("column_name") == name, F.struct("relation", "value")),
                F.when(F.col("column_name") == name, _strongest()),
            ).alias(f"{name}__claim")
            for name in columns
        ]
    )
    joined = df.join(wide, df[slot] == F.col("slot__"), "left")
    return joined.select(
        *[
            _override(field, df.schema, F.col(f"{field.name}__claim"))[0].alias(field.name)
            if field.name in columns else F.col(field.name)
            for field in df.schema
        ]
    )


def unapplied_overrides(df: DataFrame, slot: str, overrides: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The winning claims that ``apply_overrides`` cannot make true, with a ``reason``.

    Reasons: ``unknown_column``, ``unknown_row``, ``unknown_operand``,
    ``unknown_relation``, ``bad_literal`` and ``not_satisfied``.
    """
    winning = overrides.groupBy(F.col("row_slot").alias("slot__"), F.col("column_name").alias("column__")).agg(
        F.min_by(F.struct("relation", "value"), _strongest()).alias("claim__")
    )
    joined = winning.join(df.withColumn("found__", F.lit(True)), F.col("slot__") == F.col(slot), "left")
    allowed = [field for field in df.schema if field.name in columns]
    reason = F.when(~F.coalesce(F.col("column__").isin([field.name for field in allowed]), F.lit(False)), "unknown_column")
    reason = reason.when(F.col("found__").isNull(), "unknown_row")
    for field in allowed:
        reason = reason.when(F.col("column__") == field.name, _override(field, df.schema, F.col("claim__"))[1])
    return joined.select(
        F.col("slot__").alias("row_slot"), F.col("column__").alias("column_name"), "claim__.relation", "claim__.value",
        reason.alias("reason"),
    ).where("reason is not null")


def witness_sample(
    divergent: DataFrame, path: str, keys: Sequence[str], n_rows: int = 6,
    diff: str | None = None, n_cases: int = 2, total: str | None = None,
) -> DataFrame:
    """The first ``n_rows`` rows per path by key, of the first ``n_cases`` paths per diff.

    The row limit is applied before the shuffle (window group limit), so a path
    with very many rows sends a handful from each input partition. ``total``
    names a column with the number of all rows of the path, counted before the
    shuffle as well, so a reader sees how many the sample leaves out.
    """
    groups = [path] if diff is None else [diff, path]
    rows = divergent
    if diff is not None:
        cases = divergent.select(diff, path).distinct()
        cases = running(cases, [diff], [path], position="case__").where(F.col("case__") <= n_cases)
        rows = rows.join(cases.drop("case__"), groups, "left_semi")
    sample = first_rows(rows, groups, list(keys), [], n_rows)
    if total is None:
        return sample
    return null_safe_lookup(sample, divergent.groupBy(*groups).agg(F.count(F.lit(1)).alias(total)), groups)


def witness_availability(cases: DataFrame, effects: DataFrame, worlds: DataFrame, claims: DataFrame) -> DataFrame:
    """What may be shown for each case: its ``availability``, the world and diff behind it, and why not more.

    ``cases``: case_id, has_primary, incorrect. ``effects``, the outcomes of the
    primary finding: case_id, diff_id, world_id, causal, distinguished,
    constraints_satisfied (NULL: not known to fail), n_baseline, n_candidate.
    ``worlds``: case_id and the selected world_id. ``claims``, the rows those
    outcomes rest on: case_id, table_name, row_index, n_rows (of the table).

    The effect chosen is a causal one before a distinguished one before any
    other, then the first by diff_id (of equal ones the smallest row). Rows are shown only if it comes from the
    selected world and a claim names a row that exists: ``CAUSAL_VERIFIED`` or
    ``PAIR_DISTINGUISHED``. Without claims the latter remains for a
    distinguished effect whose constraints do not fail; all else is
    ``OUTPUT_ONLY``. A case without a primary finding has NULL unless its
    result is incorrect. ``reason``: ``no_primary``, ``other_world``,
    ``no_claims`` or ``no_such_row``. All four inputs meet in one aggregate per
    case, so a case with very many effects is reduced before the shuffle.
    """
    rank = F.when(F.col("causal"), 0).when(F.col("distinguished"), 1).otherwise(2)
    best = F.struct(
        rank.alias("rank"), F.coalesce("diff_id", F.lit("")).alias("diff_id"), "world_id", "causal", "distinguished",
        F.coalesce("constraints_satisfied", F.lit(True)).alias("holds"), "n_baseline", "n_candidate",
    )
    linked = (F.col("row_index") >= 0) & (F.col("row_index") < F.col("n_rows")) & F.col("table_name").isNotNull()
    parts = [
        cases.select("case_id", F.struct("has_primary", "incorrect").alias("case")),
        effects.select("case_id", best.alias("effect")),
        worlds.select("case_id", F.col("world_id").alias("selected")),
        claims.select("case_id", F.when(linked, F.struct("table_name", "row_index")).alias("row"), F.lit(1).alias("claim")),
    ]
    tagged = parts[0]
    for part in parts[1:]:
        tagged = tagged.unionByName(part, allowMissingColumns=True)
    met = tagged.groupBy("case_id").agg(
        F.max("case").alias("case"), F.min("effect").alias("effect"), F.min("selected").alias("selected"),
        F.count("claim").alias("n_claims"), F.count("row").alias("n_linked"),
    ).where("case is not null")
    primary = F.coalesce("case.has_primary", F.lit(False))
    world, selected = F.nullif("effect.world_id", F.lit("")), F.nullif("selected", F.lit(""))
    causal, distinguished = F.coalesce("effect.causal", F.lit(False)), F.coalesce("effect.distinguished", F.lit(False))
    reason = (
        F.when(~primary, "no_primary").when(world != selected, "other_world").when(F.col("n_claims") == 0, "no_claims")
        .when(F.col("n_linked") == 0, "no_such_row")
    )
    shown = F.when(causal, "CAUSAL_VERIFIED").otherwise("PAIR_DISTINGUISHED")
    availability = (
        F.when(~primary, F.when(F.col("case.incorrect"), "OUTPUT_ONLY"))
        .when(F.col("reason").isNull(), shown)
        .when((F.col("reason") == "no_claims") & distinguished & F.col("effect.holds"), "PAIR_DISTINGUISHED")
        .otherwise("OUTPUT_ONLY")
    )
    told = F.col("reason").isNull()
    return met.withColumn("reason", reason).select(
        "case_id", availability.alias("availability"), "reason",
        F.when(told, F.coalesce(selected, world)).alias("world_id"),
        F.when(primary, F.nullif("effect.diff_id", F.lit(""))).alias("diff_id"),
        F.when(told, F.col("n_linked")).otherwise(0).alias("n_linked"),
        F.when(primary, F.col("effect.n_baseline")).alias("n_baseline"),
        F.when(primary, F.col("effect.n_candidate")).alias("n_candidate"),
    )


def witness_cells(sample: DataFrame, path: str, keys: Sequence[str], n_cells: int = 8) -> DataFrame:
    """The cells of a ``witness_sample`` as text, keys first, ``n_cells`` per path."""
    columns = [*keys, *[name for name in sample.columns if name not in {*keys, path, "rank"}]]
    width = len(columns)
    cells = F.array(
        *[
            F.struct(
                ((F.col("rank") - 1) * width + place + 1).alias("cell"), F.lit(name).alias("column"),
                F.col(name).cast("string").alias("value"),
            )
            for place, name in enumerate(columns)
        ]
    )
    return sample.select(path, "rank", F.explode(cells).alias("c")).select(
        path, "rank", "c.cell", "c.column", "c.value"
    ).where(F.col("cell") <= n_cells)


def witness_delta(divergent: DataFrame, path: str) -> DataFrame:
    """The rows per path: all that may be shown when no keys identify them."""
    return divergent.groupBy(path).agg(F.count(F.lit(1)).alias("n"))


def repair_duplicate_keys(
    df: DataFrame, key: str, order: Sequence[str | SortKey]
) -> tuple[DataFrame, DataFrame]:
    """Give every later duplicate of an integer key a fresh value above the maximum.

    ``order`` must tell the copies apart. Returns the repaired table and the
    mapping (old key, order columns, ``new_key``) for child tables.
    """
    numbered = durable(running(df, [key], order, position="copy__"))
    top = df.agg(F.coalesce(F.max(key), F.lit(0)).alias("top")).scalar()
    later = running(numbered.where("copy__ > 1"), [], [key, *order], position="place__")
    fresh = later.withColumn("new_key", F.col("place__") + top)
    kept = numbered.where("copy__ = 1").withColumn("new_key", F.col(key).cast("bigint"))
    columns = df.columns
    repaired = kept.select(*columns, "new_key").unionAll(fresh.select(*columns, "new_key"))
    mapping = fresh.select(key, *[name for name in names(order) if name != key], "new_key")
    return repaired, mapping


def hash_share(columns: Sequence[str], modulus: int) -> Column:
    """A predicate that picks about one row in ``modulus``, always the same ones."""
    return F.pmod(F.xxhash64(*columns), F.lit(modulus)) == 0


def append_duplicates(df: DataFrame, chosen: Column | str) -> DataFrame:
    """The table with a second copy of every chosen row: makes a lost DISTINCT visible."""
    return df.unionAll(df.where(as_column(chosen)))


def add_dangling(df: DataFrame, key: str, chosen: Column | str) -> DataFrame:
    """The table plus, per chosen row, a copy whose key lies beyond the largest key.

    The new keys match no other table, which makes outer joins visible.
    """
    top = df.agg((F.max(key) + 1).alias("top")).scalar()
    moved = df.where(as_column(chosen)).withColumn(key, (F.col(key) + top).cast(df.schema[key].dataType))
    return df.unionAll(moved.select(*df.columns))


def inject_nulls(df: DataFrame, column: str, chosen: Column | str) -> DataFrame:
    """The table with NULL in ``column`` of every chosen row."""
    return df.withColumn(column, F.when(~F.coalesce(as_column(chosen), F.lit(False)), F.col(column)))
