"""Guards shared by the operators: required columns, unique keys, joins of checked
cardinality, and rule tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` as it is; ValueError names the columns that it lacks."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with an assertion in its plan that no key occurs twice: the check runs with
    the query, as an aggregate on the keys alone that is joined back as one row."""
    worst = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n").alias("__worst"))
    checked = worst.select(F.assert_true(F.coalesce("__worst", F.lit(0)) <= 1, F.lit(f"duplicate key: {', '.join(keys)}")).alias("__ok"))
    return df.crossJoin(F.broadcast(checked)).where(F.col("__ok").isNull()).drop("__ok")


def validated_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", validate: str = "many_to_one") -> DataFrame:
    """A join that fails where the keys of a "one" side are not unique."""
    if validate not in ("one_to_one", "many_to_one", "one_to_many"):
        raise ValueError(f"unknown cardinality {validate}")
    left = require_unique(left, on) if validate.startswith("one") else left
    right = require_unique(right, on) if validate.endswith("one") else right
    return left.join(right, list(on), how)


def exactly_one(asked: DataFrame, table: DataFrame, on: Sequence[str]) -> DataFrame:
    """Each row of ``asked`` with its one row of ``table``; fails where there is none or more."""
    rest = [c for c in table.columns if c not in on]
    one = table.groupBy(*on).agg(F.count("*").alias("__n"), *[F.any_value(c).alias(c) for c in rest])
    # The outcome is a column of its own: a filter that fails on nulls would make the join an inner one.
    fine = F.when(F.coalesce("__n", F.lit(0)) == 1, F.lit(True)).otherwise(F.raise_error(F.lit(f"not exactly one row: {', '.join(on)}")).cast("boolean"))
    found = asked.join(one, list(on), "left").withColumn("__fine", fine)
    return found.where("__fine").drop("__n", "__fine")


def violations(df: DataFrame, rule: str, severity: str, key: Column, bad: Column, details: Column | None = None) -> DataFrame:
    """(rule_id, severity, key, details) of the rows that break a rule; an unknown outcome
    breaks it too."""
    return df.where(~F.coalesce(~bad, F.lit(False))).select(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), key.cast("string").alias("key"), (details if details is not None else F.lit("")).cast("string").alias("details"))


class Rule(NamedTuple):
    """A rule on rows: what breaks it; an unknown outcome does, too."""

    name: str
    bad: Column
    severity: str = "error"
    details: Column | None = None


class Unique(NamedTuple):
    """The rule that no two rows have the same ``keys``."""

    name: str
    keys: tuple[str, ...]


def inspected(df: DataFrame, key: Column, rules: Sequence[Rule], unique: Sequence[Unique] = ()) -> DataFrame:
    """(rule_id, severity, key, details) of all that break a rule, in one scan of ``df``: each
    row tells the rules that it breaks and its keys, and all keys are counted in one
    aggregate, whichever rule they are for."""
    text = F.lit(None).cast("array<string>")
    told = [
        F.when(
            ~F.coalesce(~r.bad, F.lit(False)),
            F.struct(F.lit(r.name).alias("rule_id"), F.lit(r.severity).alias("severity"), key.cast("string").alias("key"), (r.details if r.details is not None else F.lit("")).cast("string").alias("details"), text.alias("parts")),
        )
        for r in rules
    ]
    none = F.lit(None).cast("string")
    told += [F.struct(F.lit(u.name).alias("rule_id"), F.lit("error").alias("severity"), none.alias("key"), none.alias("details"), F.array(*[F.col(k).cast("string") for k in u.keys]).alias("parts")) for u in unique]
    facts = df.select(F.explode(F.array_compact(F.array(*told))).alias("f"))
    counted = facts.groupBy("f").agg(F.count("*").alias("n")).where(F.col("f.parts").isNull() | (F.col("n") > 1))
    # A key is one finding, with its count; rows that break a rule alike are one each.
    each = F.explode(F.when(F.col("f.parts").isNull(), F.sequence(F.lit(1).cast("long"), F.col("n"))).otherwise(F.array(F.lit(1).cast("long"))))
    is_key = F.col("f.parts").isNotNull()
    return counted.select("f", "n", each.alias("i")).select(
        "f.rule_id", "f.severity", F.when(is_key, F.array_join("f.parts", "/")).otherwise(F.col("f.key")).alias("key"), F.when(is_key, F.col("n").cast("string")).otherwise(F.col("f.details")).alias("details")
    )


def observed(found: DataFrame, rules: Sequence[str], name: str = "violations") -> tuple[DataFrame, Observation]:
    """``found`` with counts by rule that are taken while it is used (written, say): the
    observation has them afterwards, without another pass."""
    seen = Observation(name)
    return found.observe(seen, F.count(F.lit(1)).alias("all"), *[F.count_if(F.col("rule_id") == r).alias(r) for r in rules]), seen


def report(rules: Sequence[DataFrame]) -> DataFrame:
    """All violations as one table."""
    return reduce(DataFrame.unionByName, rules)


def exit_code(found: DataFrame) -> int:
    """0 without errors (warnings are allowed), else 1."""
    return int(not found.where("severity = 'error'").isEmpty())
