"""Type, business-rule and statistical checks with short circuit, in one narrow stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.functions import ids, parsing, rules
from driftloom.functions.let import let
from driftloom.operators import stats
from driftloom.operators.once import with_once
from driftloom.operators.sized import join_small

CHECK = "struct<check_type:string,passed:boolean,failure_reason:string>"


def rules_by_field(rule_table: DataFrame) -> DataFrame:
    """One row per field with its rules in order. A group is configuration, never data."""
    rule = F.struct("position", F.lower("op").alias("op"), "value", "values", "context", "description")
    return rule_table.groupBy(F.col("field").alias("field_name")).agg(
        F.array_sort(F.collect_list(rule), lambda a, b: a["position"] - b["position"]).alias("_rules")
    )


def _check(kind: str, passed: Column, reason: Column) -> Column:
    return F.struct(F.lit(kind).alias("check_type"), passed.alias("passed"), reason.alias("failure_reason")).cast(CHECK)


def business_checks(rule_list: Column, value: Column, context: Column) -> Column:
    """Verdict array of the applicable rules; no applicable rule gives an empty array."""
    applicable = F.filter(rule_list, lambda r: rules.context_matches(r["context"], context))

    def judged(r: Column) -> Column:
        reason = F.concat_ws(" ", r["op"], F.coalesce(r["value"], F.array_join(r["values"], ",")))
        ok = rules.rule_check(r["op"], value, r["value"], r["values"])
        return let(ok, lambda passed: _check("business_rule", passed, F.when(~passed, reason)))

    return F.coalesce(F.transform(applicable, judged), F.array().cast(f"array<{CHECK}>"))


def check_values(extractions: DataFrame, rule_table: DataFrame, stored_stats: DataFrame | None = None) -> DataFrame:
    """One row per value with its ``checks`` array and ``all_passed``.

    Input: field_name, value, field_type, required, volatility, context map; with
    ``stored_stats`` also domain and item_key. Business rules run only on values of the right
    type, the statistical check only on numbers that passed every rule.
    """
    rows = extractions
    if stored_stats is not None:
        # The one shuffle carries the values as they came, before rules and verdicts widen them.
        totals = stored_stats.select(
            *stats.KEYS, F.col("value_count").alias("_n"), F.col("value_sum").alias("_s"), F.col("value_sum_sq").alias("_ss")
        )
        rows = rows.join(totals, stats.KEYS, "left")
    # As an attribute of its own: a field name that is a constant would leave no key to join on.
    named = rules_by_field(rule_table).withColumnRenamed("field_name", "_field")
    rows = join_small(with_once(rows, "_field", F.col("field_name")), named, ["_field"], "left").drop("_field")
    value, nothing = F.col("value"), F.array().cast(f"array<{CHECK}>")
    reason = parsing.type_failure(value, F.col("field_type"), F.col("required"))
    typed = rows.withColumn("_type", let(reason, lambda r: _check("type", r.isNull(), r)))
    business = F.when(F.col("_type.passed"), business_checks(F.col("_rules"), value, F.col("context")))
    judged = typed.withColumn("_business", F.coalesce(business, nothing))
    so_far = F.col("_type.passed") & F.forall("_business", lambda c: c["passed"])
    statistical = nothing
    if stored_stats is not None:
        statistical = F.when(so_far & F.col("field_type").isin("float", "int"), _statistical(value))
    checks = F.concat(F.array("_type"), F.col("_business"), F.coalesce(statistical, nothing))
    return (
        judged.withColumn("checks", checks)
        .withColumn("all_passed", F.forall("checks", lambda c: c["passed"]))
        .drop("_type", "_business", "_rules", "_n", "_s", "_ss")
    )


def _statistical(value: Column) -> Column:
    """Verdict on a number; none when the value is not a plain number."""
    limit = ids.sigma(F.col("volatility"))

    def judged(x: Column) -> Column:
        z = stats.zscore(x, F.coalesce("_n", F.lit(0)), F.col("_s"), F.col("_ss"))
        verdict = let(
            F.coalesce(z <= limit, F.lit(True)), lambda ok: _check("statistical", ok, F.when(~ok, F.lit("beyond_sigma")))
        )
        return F.when(x.isNotNull(), F.array(verdict))

    return let(parsing.numeric_for_stats(value), judged)


def explode_checks(checked: DataFrame, keys: list[str]) -> DataFrame:
    """Long validation table: keys and one row per verdict."""
    return checked.select(*keys, F.inline_outer("checks"))


def accepted_stats(checked: DataFrame) -> DataFrame:
    """Totals of the fully valid numbers, ready for ``merge_stats``. Needs ts and id columns."""
    number = parsing.numeric_for_stats(F.col("value"))
    numeric = checked.where("all_passed and field_type in ('float', 'int')").withColumn("value", number)
    return stats.field_stats(numeric)
