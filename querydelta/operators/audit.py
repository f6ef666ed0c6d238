"""Leak audits of published payloads and roll-ups of evaluation runs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from querydelta.functions import payload as P
from querydelta.functions import vocabulary as V
from querydelta.functions.logic import long_form
from querydelta.functions.octets import SIEVE_BITS, SIZES, runs_of_texts
from querydelta.functions.text import MIN_SECRET_CHARS, collapse, normalized_secret
from querydelta.session import durable

REDACTED = "[redacted reference content]"


def _secrets(secrets: DataFrame) -> DataFrame:
    """Distinct normalised secrets per case that are long enough to search for."""
    return secrets.select("case_id", normalized_secret(F.col("secret")).alias("secret__")).where(
        F.length("secret__") >= MIN_SECRET_CHARS
    ).distinct()


def redact_payload(
    payloads: DataFrame, secrets: DataFrame, forbidden_keys: Sequence[str] = P.FORBIDDEN_KEYS,
    max_chars: int | None = None,
) -> DataFrame:
    """Payloads without forbidden keys, with leaking string values replaced.

    ``payloads``: payload_id, case_id, payload (JSON). ``secrets``: case_id,
    secret. Only with ``max_chars`` are longer strings cut, and ``n_cut`` counts
    them; a string is checked in full before it is cut. Keys are never renamed. A case of many strings and secrets is
    searched by anchors (see ``corpus_leaks``) and so spread over tasks.
    """
    pruned = payloads.withColumn("payload", P.prune_keys(F.col("payload"), forbidden_keys))
    strings = pruned.select(
        "payload_id", "case_id", F.explode(F.array_distinct(P.json_values(F.col("payload")))).alias("token")
    )
    checked = strings.withColumn("text__", normalized_secret(P.unescape(F.col("token"))))
    changed = (
        checked.join(_leaking(checked, secrets), ["case_id", "text__"], "left_semi")
        .select("payload_id", "token", F.lit(REDACTED).alias("shown"))
    )
    if max_chars is not None:
        # cutting must not split an escape, so the cut text is written anew
        plain = P.unescape(F.col("token"))
        cut = F.to_json(F.array(F.substring(plain, 1, max_chars)))
        changed = changed.unionAll(
            strings.where(F.length(plain) > max_chars).withColumn("cut__", cut)
            .select("payload_id", "token", F.expr("substring(cut__, 3, length(cut__) - 4)").alias("shown"))
        )
    leaks = F.col("shown") == REDACTED
    changes = (
        changed.groupBy("payload_id", "token").agg(F.max_by("shown", F.when(leaks, 1).otherwise(0)).alias("shown"))
        .groupBy("payload_id").agg(
            F.map_from_entries(F.collect_list(F.struct("token", "shown"))).alias("changes"), F.count_if(~leaks).alias("n_cut")
        )
    )  # at most as many changes as the payload has strings
    applied = P.replace_values(F.col("payload"), F.col("changes"))
    return (
        pruned.join(changes, "payload_id", "left")
        .withColumn("payload", F.when(F.col("changes").isNull(), F.col("payload")).otherwise(applied))
        .withColumn("n_changes", F.coalesce(F.size("changes"), F.lit(0)))
        .withColumn("n_cut", F.coalesce("n_cut", F.lit(0)))
        .drop("changes")
    )


def audit_leaks(
    payloads: DataFrame, secrets: DataFrame, forbidden_keys: Sequence[str] = P.FORBIDDEN_KEYS
) -> DataFrame:
    """One row per problem of a published payload.

    ``payloads``: payload_id, case_id, level, payload, has_witness. Problems:
    ``forbidden_keys`` with the keys, ``full_reference``, and ``witness_slot``
    when a witness is shown at another level than 2 or missing there. Each string
    value is searched on its own.
    """
    texts = F.transform(P.json_values(F.col("payload")), lambda value: normalized_secret(P.unescape(value)))
    parsed = payloads.select(
        "payload_id", "case_id", "level", "has_witness",
        P.json_keys(F.col("payload")).alias("keys"), texts.alias("texts"),
    )
    unwanted = F.expr(f"array({', '.join(repr(key) for key in forbidden_keys)})")
    leaked = F.array_sort(F.array_intersect("keys", unwanted))
    own = parsed.withColumn(
        "issue",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.size(leaked) > 0, F.concat(F.lit("forbidden_keys:"), F.array_join(leaked, ","))),
                    F.when(
                        F.array_contains("keys", "witness") != ((F.col("level") == 2) & F.col("has_witness")),
                        F.lit("witness_slot"),
                    ),
                )
            )
        ),
    ).select("payload_id", "case_id", "level", "issue")
    texts = parsed.select("payload_id", "case_id", "level", F.explode(F.array_distinct("texts")).alias("text__"))
    quoted = (
        texts.join(_leaking(texts, secrets), ["case_id", "text__"], "left_semi")
        .select("payload_id", "case_id", "level", F.lit("full_reference").alias("issue")).distinct()
    )
    return own.unionAll(quoted)


def _runs(table: DataFrame, key: str, sizes: Sequence[int], of_ref: bool, sieve=None) -> DataFrame:
    """``key, run`` of the column ``text``; a salt keeps the parts apart. References have runs of their own ``size`` only."""
    schema = StructType([table.schema[key], StructField("run", LongType())])

    def find(batches):
        for batch in batches:
            salts, own = (batch.column(at).to_numpy() for at in (2, 3))
            numbers, runs = runs_of_texts(
                batch.column(1), sizes, salts.view(np.uint64), own if of_ref else None, None if sieve is None else sieve.value
            )
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(numbers)), pa.array(runs.view(np.int64))], names=[key, "run"])

    return table.select(key, "text", "salt", F.col("size") if of_ref else F.lit(0).alias("size")).mapInArrow(find, schema)


def _sieve(runs: DataFrame):
    """A broadcast bitmap of the first bits of ``runs``: 2 MB, however many there are."""
    place = F.shiftrightunsigned("run", 64 - SIEVE_BITS) + 1
    marks = runs.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("marks")
    )
    sieve = np.zeros((1 << SIEVE_BITS) // 8, np.uint8)
    for row in marks.collect():
        own = np.frombuffer(row.marks, np.uint8)
        sieve[(row.bucket - 1) * len(own) : row.bucket * len(own)] = own
    return runs.sparkSession.sparkContext.broadcast(sieve)


#: Parts into which the documents that hold one anchor are dealt.
_SALTS = 16
#: Bytes that a word counts for.
_WORD_BYTES = 12


def corpus_leaks(docs: DataFrame, refs: DataFrame, width: int = 6, part: str | None = None) -> DataFrame:
    """Which documents contain which reference passages, as ``(doc_id, item_id)``.

    Both texts are compared case-folded with white space collapsed. ``docs``:
    doc_id, text; ``refs``: item_id, text. With ``part``, a column of both, only passages of a document's own part count.
    Runs of bytes are sought within stretches of at most ``width`` words of 12 bytes.

    A document that holds a passage shares all runs of the passage (see ``byte_runs``), so a run is a sure sign.
    Of all runs of a passage the one fewest documents (of its part) hold is its anchor; only
    documents with the anchor are searched. Nothing is capped, and a passage
    with a run no document holds drops out at once. Runs are cut from bytes in numpy, and those whose first bits no passage has
    leave no row. Rows meet by anchor, so a part of any size is spread over tasks, and
    the documents of one anchor are dealt into salted parts.
    """
    parts = [part] if part else []
    salt = (F.xxhash64(part) if part else F.lit(0).cast("bigint")).alias("salt")
    documents = docs.select("doc_id", *parts, collapse(F.col("text")).alias("text"))
    reached = [F.when(F.octet_length("text") >= size, size) for size in SIZES if size <= max(SIZES[0], width * _WORD_BYTES)]
    passages = durable(
        refs.select("item_id", *parts, normalized_secret(F.col("text")).alias("text"))
        .where(F.length("text") >= MIN_SECRET_CHARS)
        .withColumn("size", F.coalesce(*reversed(reached)))
    )
    sizes = sorted(row[0] for row in passages.select("size").distinct().collect())  # at most as many as SIZES
    if not sizes:
        none = F.lit(None).cast(passages.schema["item_id"].dataType)
        return documents.limit(0).select("doc_id", none.alias("item_id"))
    signs = durable(_runs(passages.select("*", salt), "item_id", sizes, True))
    held = durable(
        _runs(documents.select("*", salt), "doc_id", sizes, False, _sieve(signs))
        .join(signs.select("run").distinct(), "run", "left_semi")
    )
    spread = held.groupBy("run").agg(F.count(F.lit(1)).alias("n_docs"))
    rated = signs.join(spread, "run", "left").groupBy("item_id").agg(
        F.min(F.struct(F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "run")).alias("anchor")
    )
    anchors = rated.where("anchor.n_docs > 0").select(
        "item_id", F.col("anchor.run").alias("run"), F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt")
    )
    dealt = held.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS)).cast("int"))
    candidates = dealt.join(anchors, ["run", "salt"]).select("doc_id", "item_id")
    named = passages.select("item_id", *[F.col(name).alias("part__") for name in parts], F.col("text").alias("passage"))
    inside = F.col("text").contains(F.col("passage"))
    return (
        candidates.distinct().join(named, "item_id").join(documents, "doc_id")
        .where(inside & (F.col(part) == F.col("part__")) if part else inside).select("doc_id", "item_id")
    )


def _leaking(texts: DataFrame, secrets: DataFrame) -> DataFrame:
    """``case_id, text__`` of the distinct texts that contain a secret of their case."""
    named = _secrets(secrets).select("case_id", F.col("secret__").alias("text"), F.sha2("secret__", 256).alias("item_id"))
    named = named.withColumn("item_id", F.concat_ws(":", F.col("case_id").cast("string"), "item_id"))
    digest = F.concat_ws(":", F.col("case_id").cast("string"), F.sha2("text__", 256))
    distinct = durable(texts.select("case_id", "text__").distinct().withColumn("doc_id", digest))
    found = corpus_leaks(distinct.withColumnRenamed("text__", "text"), named, part="case_id").select("doc_id").distinct()
    return distinct.join(found, "doc_id", "left_semi").select("case_id", "text__")


def dedupe_cases(cases: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Cases that are equal once white space and case are ignored: the first key and the copies.

    Texts are compared by their SHA-256, so the shuffle does not carry them.
    """
    same = F.sha2(F.to_json(F.struct(*[collapse(F.col(name)).alias(name) for name in columns])), 256)
    return cases.groupBy(same.alias("content")).agg(
        F.min(key).alias(key), F.count(F.lit(1)).alias("copies")
    ).select(key, "copies")


def declared_counts(cases: DataFrame, declared: DataFrame, suite: str) -> DataFrame:
    """Suites whose declared number of cases is not the actual one.

    ``declared``: the suite column and ``declared``.
    """
    actual = cases.groupBy(suite).agg(F.count(F.lit(1)).alias("actual"))
    return actual.join(declared, suite, "full").select(
        suite, F.coalesce("declared", F.lit(0)).alias("declared"), F.coalesce("actual", F.lit(0)).alias("actual")
    ).where("declared <> actual")


def check_expectations(
    results: DataFrame, expectations: DataFrame, max_table_rows: int | None = None, candidates: DataFrame | None = None
) -> DataFrame:
    """One row per broken expectation.

    ``results``: id, status, conclusion, verdict, primary_rule, primary_grade,
    repair_fixed, hint_safe, executed, replay_ok, has_evidence, table_rows, and
    for require_witness has_database and distinguished. ``expectations``: id, and
    any of status, conclusion, verdict (exact), allowed_statuses,
    allowed_conclusions, allowed_verdicts (arrays), forbid_conclusion,
    require_primary, primary_rule, candidate_rule, minimum_primary_grade,
    require_witness, require_evidence, require_repair, require_safe_hints. NULL
    expects nothing. ``candidates``: id and rule_id of all findings of a case,
    among which candidate_rule must be; without it none is found. Tables may
    have any size unless ``max_table_rows`` is given.
    """
    wanted = expectations.select("id", F.struct(*[name for name in expectations.columns if name != "id"]).alias("e"))
    names = set(expectations.columns)
    joined = results.join(wanted, "id")
    found = F.lit(False)
    if candidates is not None and "candidate_rule" in names:
        rules = candidates.select("id", F.col("rule_id").alias("found__")).distinct()
        joined = joined.withColumn("found__", F.col("e.candidate_rule")).join(
            rules.withColumn("is_found__", F.lit(True)), ["id", "found__"], "left"
        )
        found = F.coalesce("is_found__", F.lit(False))

    def e(name: str, dtype: str = "string") -> Column:
        return F.col(f"e.{name}") if name in names else F.lit(None).cast(dtype)

    def text(value: Column) -> Column:
        return F.coalesce(value.cast("string"), F.lit("None"))

    def grade(value: Column) -> Column:
        return F.array_position(F.expr(f"array({', '.join(repr(g) for g in V.GRADES)})"), value)

    failures = []
    for name in ("status", "conclusion", "verdict"):
        failures.append(
            F.when(
                e(name).isNotNull() & ~F.col(name).eqNullSafe(e(name)),
                F.concat(F.lit(f"{name}:expected="), e(name), F.lit(":actual="), text(F.col(name))),
            )
        )
    for name, actual in (("allowed_statuses", "status"), ("allowed_conclusions", "conclusion"), ("allowed_verdicts", "verdict")):
        listed = e(name, "array<string>")
        failures.append(
            F.when(
                listed.isNotNull() & ~F.coalesce(F.array_contains(listed, F.col(actual)), F.lit(False)),
                F.concat(F.lit(f"{name}:actual="), text(F.col(actual))),
            )
        )
    failures += [
        F.when(
            e("candidate_rule").isNotNull() & ~found, F.concat(F.lit("candidate_rule_missing:"), e("candidate_rule"))
        ),
        F.when(
            F.col("conclusion") == e("forbid_conclusion"),
            F.concat(F.lit("forbidden_conclusion:"), e("forbid_conclusion")),
        ),
        F.when(e("require_primary", "boolean") & F.col("primary_rule").isNull(), F.lit("primary_missing")),
        F.when(
            ~e("require_primary", "boolean") & F.col("primary_rule").isNotNull(),
            F.concat(F.lit("unexpected_primary:"), F.col("primary_rule")),
        ),
        F.when(
            e("primary_rule").isNotNull() & ~F.col("primary_rule").eqNullSafe(e("primary_rule")),
            F.concat(F.lit("primary_rule:expected="), e("primary_rule"), F.lit(":actual="), text(F.col("primary_rule"))),
        ),
        F.when(
            e("minimum_primary_grade").isNotNull()
            & (F.coalesce(grade(F.col("primary_grade")), F.lit(0)) < grade(e("minimum_primary_grade"))),
            F.concat(
                F.lit("primary_grade:minimum="), e("minimum_primary_grade"), F.lit(":actual="),
                text(F.col("primary_grade")),
            ),
        ),
        F.when(e("require_evidence", "boolean") & ~F.coalesce("has_evidence", F.lit(False)), F.lit("evidence_missing")),
        F.when(
            e("require_repair", "boolean") & (F.coalesce("repair_fixed", F.lit(0)) <= 0), F.lit("repair_not_verified")
        ),
        F.when(
            e("require_safe_hints", "boolean") & ~F.coalesce("hint_safe", F.lit(False)), F.lit("hint_audit_failed")
        ),
        F.when(F.col("executed") & ~F.coalesce("replay_ok", F.lit(False)), F.lit("independent_replay_failed")),
    ]
    if "require_witness" in names:
        for column, failure in (("has_database", "witness_database_missing"), ("distinguished", "witness_not_distinguished")):
            failures.append(F.when(e("require_witness", "boolean") & ~F.coalesce(column, F.lit(False)), F.lit(failure)))
    if max_table_rows is not None:
        failures.append(
            F.when(
                F.col("executed") & (F.col("table_rows") > max_table_rows),
                F.concat(F.lit("table_row_limit_exceeded:"), F.col("table_rows").cast("string")),
            )
        )
    return joined.select("id", F.explode(F.array_compact(F.array(*failures))).alias("failure"))


def replay_agreement(
    recorded: DataFrame, replayed: DataFrame, case: str, errors: DataFrame | None = None
) -> DataFrame:
    """Per case: does a second execution return the recorded rows?

    Rows are compared as bags; add a position column to compare sequences.
    ``errors``: the case column, ``recorded_error`` and ``replayed_error``.
    """
    columns = recorded.columns
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    both = recorded.select(*columns, one.alias("a__"), none.alias("b__")).unionAll(
        replayed.select(*columns, none.alias("a__"), one.alias("b__"))
    )
    rows = both.groupBy(*columns).agg(F.sum("a__").alias("a__"), F.sum("b__").alias("b__"))
    cases = rows.groupBy(case).agg(
        F.sum("a__").alias("n_recorded"), F.sum("b__").alias("n_replayed"),
        F.sum(F.abs(F.col("a__") - F.col("b__"))).alias("n_different"),
    )
    if errors is None:
        return cases.withColumn("agrees", F.col("n_different") == 0)
    joined = cases.join(errors, case, "full")
    same_state = F.coalesce("recorded_error", F.lit(False)) == F.coalesce("replayed_error", F.lit(False))
    counts = {name: F.coalesce(name, F.lit(0)) for name in ("n_recorded", "n_replayed", "n_different")}
    return joined.withColumns(counts).select(
        case, *counts, same_state.alias("same_error_state"),
        (same_state & (F.col("n_different") == 0)).alias("agrees"),
    )


def run_determinism(runs: DataFrame) -> DataFrame:
    """Cases whose digest in a later repeat differs from the first run.

    ``runs``: repeat, id, digest.
    """
    first = runs.where("repeat = 1").select("id", F.col("digest").alias("expected"))
    return runs.where("repeat > 1").join(first, "id").where("not (digest <=> expected)").select(
        "repeat", "id", "expected", F.col("digest").alias("actual")
    )


def suite_report(results: DataFrame) -> DataFrame:
    """Long-form report: totals, suites, distributions and maxima in one pass.

    ``results``: suite, passed, executed, status, conclusion, verdict,
    primary_rule, repair_fixed, hint_safe, distinguished, replay_ok, availability,
    table_rows. Columns: metric, name, value.
    """
    def counted(metric: str, name: Column, value: Column | None = None) -> Column:
        amount = F.lit(1).cast("bigint") if value is None else value.cast("bigint")
        return F.struct(F.lit(metric).alias("metric"), name.cast("string").alias("name"), amount.alias("value"))

    everything = F.lit("all")
    flags = {
        "passed": F.col("passed"), "failed": ~F.col("passed"), "repair_verified_cases": F.col("repair_fixed") > 0,
        "hint_safe_cases": F.col("hint_safe"), "distinguished_cases": F.col("distinguished"),
        "replay_cases": F.col("executed"), "replay_passed": F.col("executed") & F.col("replay_ok"),
    }
    entries = [counted("cases", everything)]
    entries += [
        counted(name, everything, F.coalesce(flag, F.lit(False)).cast("int")) for name, flag in flags.items()
    ]
    entries += [
        counted("suite_total", F.col("suite")), counted("suite_passed", F.col("suite"), F.col("passed").cast("int")),
        counted("status", F.col("status")), counted("conclusion", F.col("conclusion")),
        counted("verdict", F.col("verdict")), counted("primary_rule", F.col("primary_rule")),
        counted("witness_availability", F.coalesce("availability", F.lit("NONE"))),
    ]
    sums = (
        results.select(F.explode(F.array(*entries)).alias("entry")).select("entry.*")
        .where("name is not null").groupBy("metric", "name").agg(F.sum("value").alias("value"))
    )
    largest = long_form(
        results.agg(F.max("table_rows").cast("bigint").alias("m")), "metric",
        {"max_table_rows": {"name": F.lit("all"), "value": F.col("m")}},
    )
    return sums.unionAll(largest)
