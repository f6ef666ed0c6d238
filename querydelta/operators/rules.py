"""Which rule a diff falls under: marks read off its clause texts, and a table of rules per diff type.

Clause texts are cut into words once. Every observation about a diff becomes a mark, and the first rule of its
type (``vocabulary.RULES_BY_MARKS``) whose marks are all there names it; some types name their rule alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querydelta.functions import vocabulary as V
from querydelta.session import durable

_WORD = r"[A-Z_][A-Z0-9_$]*|[(*)]"
_SIDES = ("LEFT", "RIGHT", "FULL", "CROSS", "INNER")
_OUTER = _SIDES[:3]
_MEMBER, _COMPARE = ("IN", "ANY", "ALL"), ("EQ", "NEQ", "GT", "GTE", "LT", "LTE")


def _text(diffs: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in diffs.columns else F.lit("")


def _flag(diffs: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False)) if name in diffs.columns else F.lit(False)


def _phrase(words: str, *phrase: str) -> Column:
    """Whether the words of column ``words`` hold ``phrase`` side by side."""
    def here(word: Column, at: Column) -> Column:
        return reduce(lambda a, b: a & b, [F.coalesce(F.get(words, at + k) == part, F.lit(False)) for k, part in enumerate(phrase)])

    return F.exists(F.transform(words, here), lambda found: found)


def _side(words: str, declared: Column) -> Column:
    """The declared side, or that of the first join with one; a plain JOIN is INNER."""
    def before(word: Column, at: Column) -> Column:
        one, two = F.get(words, at - 1), F.get(words, at - 2)
        return F.when((word == "JOIN") & (at > 0), F.when((one == "OUTER") & (at > 1), two).otherwise(one))

    named = F.get(F.filter(F.transform(words, before), lambda side: side.isin(*_SIDES)), F.lit(0))
    plain = F.when(F.array_contains(words, "JOIN"), "INNER").otherwise("")
    return F.when(declared != "", F.upper(declared)).otherwise(F.coalesce(named, plain))


def _marks(diffs: DataFrame) -> dict[str, Column]:
    """The observations a rule may need, over the columns that ``classify_rule`` prepares."""
    ops = F.col("ops__")

    def one_of(names: tuple[str, ...]) -> Column:
        return F.arrays_overlap(ops, F.array(*map(F.lit, names)))

    def said(word: str) -> Column:
        return F.col("upper_before__").contains(word) | F.col("upper_after__").contains(word)

    def both_are(a: str, b: str) -> Column:
        return F.array_contains(ops, a) & F.array_contains(ops, b)

    kinds = F.array(_text(diffs, "baseline_value_kind"), _text(diffs, "candidate_value_kind"))
    stage = F.col("logical_stage")
    star = ("COUNT", "(", "*", ")")
    return {
        "in ROW_FILTER": stage == "ROW_FILTER",
        "in GROUP_FILTER": stage == "GROUP_FILTER",
        "advanced stage": stage.isin("SET_OP", "WINDOW", "CTE_PRODUCER"),
        "at the root": F.col("scope_kind") == "ROOT",
        "removed": (F.col("upper_before__") != "") & (F.col("upper_after__") == ""),
        "became a cross join": (F.col("side_after__") == "CROSS") & (F.col("side_before__") != "CROSS"),
        "an outer join": F.col("side_before__").isin(*_OUTER) | F.col("side_after__").isin(*_OUTER),
        "reads a subquery": said("SELECT") | F.array_contains(kinds, "expression"),
        "membership against comparison": one_of(_MEMBER) & one_of(_COMPARE),
        "end point opened or closed": both_are("GT", "GTE") | both_are("LT", "LTE"),
        "null test before": _phrase("words_before__", "IS", "NULL") | _phrase("words_before__", "IS", "NOT", "NULL"),
        "case expression": said("CASE") | (F.upper(_text(diffs, "function_name")) == "CASE"),
        "distinct before": F.col("upper_before__").isin("TRUE", "DISTINCT"),
        "counts": said("COUNT"),
        "distinct count lost": _phrase("words_before__", "COUNT", "(", "DISTINCT") & ~_phrase("words_after__", "COUNT", "(", "DISTINCT"),
        "count of rows flipped": _phrase("words_before__", *star) != _phrase("words_after__", *star),
        "nullable column": F.col("nullable__"),
        "offset": F.col("upper_before__").startswith("OFFSET") | F.col("upper_after__").startswith("OFFSET"),
        "union": said("UNION"),
        "bridge missing": _flag(diffs, "missing_bridge_signal"),
        "rows multiplied": _flag(diffs, "fanout_signal"),
        "slice of the order": _flag(diffs, "topn_signal"),
    }


#: All that a rule reads of a diff.
_SHAPE = (
    "diff_type", "logical_stage", "scope_kind", "baseline_sql", "candidate_sql", "baseline_op", "candidate_op",
    "baseline_side", "candidate_side", "baseline_value_kind", "candidate_value_kind", "function_name",
    "missing_bridge_signal", "fanout_signal", "topn_signal",
)


def classify_rule(diffs: DataFrame, nullable_columns: DataFrame, parts: int | None = None) -> DataFrame:
    """Add ``rule_id``: one of the twenty rules, a generic mismatch or unclassified.

    Needs ``logical_stage``. Reads, where there are such columns, the signals ``missing_bridge_signal``
    (see ``bridge_tables``), ``fanout_signal`` (see ``fanout_inflation``) and ``topn_signal``, the declared join sides
    ``baseline_side`` and ``candidate_side``, the operand kinds ``baseline_value_kind`` and ``candidate_value_kind``
    (``expression`` reads like a subquery), and ``function_name``. ``nullable_columns``: table_name, column_name
    declared nullable. Only texts of types with a table of rules are cut into words.

    The diffs are written once. Rules are found for the different shapes of a diff (all that a rule reads), with and
    without a nullable column; only diffs whose rule depends on that, and that have a target, are moved to meet the
    declarations. With ``parts``, the diffs are a table dealt by case_id into so many parts: it is not written again, and
    the result is dealt alike.
    """
    written = durable(diffs, keep_dealt=True) if parts is None else diffs
    shape = [name for name in _SHAPE if name in diffs.columns]
    shapes = written.select(*shape).distinct()
    # all that follows meets a small table, or joins by size
    ruled = durable(
        _ruled(_ruled(shapes, F.lit(True)).withColumnRenamed("rule_id", "nullable_rule__"), F.lit(False))
        .withColumnsRenamed({name: f"{name}__" for name in shape})
    )
    same = reduce(lambda a, b: a & b, [F.col(name).eqNullSafe(F.col(f"{name}__")) for name in shape])
    known = written.drop("rule_id").join(ruled, same).drop(*[f"{name}__" for name in shape])
    asks = (
        (F.col("nullable_rule__") != F.col("rule_id")) & F.col("target_table").isNotNull()
        & F.col("target_column").isNotNull()
    )
    facts = nullable_columns.select(
        F.concat_ws(".", F.lower("table_name"), F.lower("column_name")).alias("fact__")
    ).distinct().withColumn("nullable_fact__", F.lit(True))
    target = F.concat_ws(".", F.lower("target_table"), F.lower("target_column"))
    met = known.where(asks).withColumn("fact__", target).join(facts, "fact__", "left").withColumn(
        "rule_id", F.when(F.col("nullable_fact__"), F.col("nullable_rule__")).otherwise(F.col("rule_id"))
    )
    out = [*[name for name in diffs.columns if name != "rule_id"], "rule_id"]
    met = met.select(*out) if parts is None else met.select(*out).repartition(parts, "case_id")
    return known.where(~asks).select(*out).unionAll(met)


def _ruled(diffs: DataFrame, nullable: Column) -> DataFrame:
    """Add ``rule_id`` row by row."""
    kind = F.lower("diff_type")
    alone = F.create_map(*[F.lit(part) for entry in V.RULE_OF_TYPE.items() for part in entry])
    entry = "array<struct<needs: array<string>, rule: string>>"
    table = F.create_map(*[
        part for name, rules in V.RULES_BY_MARKS.items()
        for part in (F.lit(name), F.array(*[
            F.struct(F.array(*map(F.lit, needs)).cast("array<string>").alias("needs"), F.lit(rule).alias("rule")) for needs, rule in rules
        ]).cast(entry))
    ])
    no_words = F.array().cast("array<string>")
    known = diffs.withColumns({
        "table__": F.element_at(table, kind), "nullable__": nullable,
        "upper_before__": F.upper(_text(diffs, "baseline_sql")), "upper_after__": F.upper(_text(diffs, "candidate_sql")),
        "ops__": F.array(F.upper(_text(diffs, "baseline_op")), F.upper(_text(diffs, "candidate_op"))),
    })

    def words(text: str) -> Column:
        return F.when(F.col("table__").isNotNull(), F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))).otherwise(no_words)

    cut = known.withColumns({"words_before__": words("upper_before__"), "words_after__": words("upper_after__")})
    sided = cut.withColumns({
        "side_before__": _side("words_before__", _text(diffs, "baseline_side")),
        "side_after__": _side("words_after__", _text(diffs, "candidate_side")),
    })
    marked = sided.withColumn("marks__", F.array_compact(F.array(*[F.when(seen, mark) for mark, seen in _marks(diffs).items()])))
    fitting = F.filter("table__", lambda rule: F.size(F.array_except(rule["needs"], "marks__")) == 0)
    chosen = F.coalesce(F.element_at(alone, kind), F.get(fitting, F.lit(0))["rule"], F.lit(V.UNCLASSIFIED))
    return marked.select(*diffs.columns, chosen.alias("rule_id"))
