"""Scalar functions: rounding, guarded arithmetic, clocks, names and array helpers, all as
Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dashes that names may hold, and reference suffixes that are dropped.
DASHES = "‐–—−"
SUFFIXES = ("REF", "LE")


def guarded_ratio(num: Column, den: Column, empty: Column | None = None) -> Column:
    """num / den where den is positive, else ``empty`` (null)."""
    return F.when(den > 0, num / den).otherwise(F.lit(None).cast("double") if empty is None else empty)


def percent(part: Column) -> Column:
    """A fraction in per cent, to two decimals."""
    return F.round(part * 100, 2)


def nan_to_null(x: Column) -> Column:
    return F.when(F.isnan(x), None).otherwise(x)


def seconds_to_samples(seconds: Column, rate: Column) -> Column:
    """Decimal product, halves away from zero."""
    return F.round(seconds.cast("decimal(20,9)") * rate.cast("decimal(12,6)"), 0).cast("bigint")


def round_half_even(x: Column) -> Column:
    return F.bround(x, 0).cast("bigint")


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("bigint")


def onset_sample(seconds: Column, rate: Column) -> Column:
    return F.floor(seconds * rate).cast("bigint")


def offset_sample(seconds: Column, rate: Column) -> Column:
    return F.ceil(seconds * rate).cast("bigint")


def close(a: Column, b: Column, rtol: float = 0.0, atol: float = 1e-12) -> Column:
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def clip(x: Column, low: float | Column, high: float | Column) -> Column:
    """Within [low, high]; null stays null."""
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.when(x.isNotNull(), F.greatest(low, F.least(x, high)))


def fold_seed(outer: Column, inner: Column, base: int = 42, step: int = 100) -> Column:
    return F.lit(base) + step * outer + inner


def all_finite(values: Column) -> Column:
    return ~F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def normalize_channel_name(name: Column) -> Column:
    """Trimmed, upper case, plain dashes without blanks around them, without a leading
    ``EEG`` and a final reference suffix, in this order."""
    x = F.upper(F.regexp_replace(name, r"(?U)^\s+|\s+$", ""))
    x = F.translate(x, DASHES, "-" * len(DASHES))
    x = F.regexp_replace(x, r"(?U)\s+", " ")
    x = F.regexp_replace(x, " ?- ?", "-")
    x = F.regexp_replace(x, "^EEG ", "")
    return F.regexp_replace(x, f"-(?:{'|'.join(SUFFIXES)})$", "")


def remove_duplicate_suffix(name: Column) -> Column:
    """Without a final ``-<digits>``."""
    return F.regexp_replace(name, r"-\d+$", "")


def case_id(path: Column) -> Column:
    """``chbNN`` of the parent folder, else of the file's stem; null if there is none."""
    parts = F.split(path, "/")
    parent, stem = F.coalesce(F.get(parts, F.size(parts) - 2), F.lit("")), path_stem(path)
    return F.coalesce(F.nullif(F.regexp_extract(F.lower(parent), r"chb\d{2}", 0), F.lit("")), F.nullif(F.regexp_extract(F.lower(stem), r"chb\d{2}", 0), F.lit("")))


def valid_case_id(x: Column) -> Column:
    """Trimmed, lower case; null unless ``chbNN``."""
    low = F.lower(F.trim(x))
    return F.when(low.rlike(r"^chb\d{2}$"), low)


def default_subject(case: Column) -> Column:
    return F.concat(F.lit("subject_"), case)


def path_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def path_stem(path: Column) -> Column:
    return F.regexp_replace(path_name(path), r"\.[^.]+$", "")


def padded(index: Column, width: int) -> Column:
    """With zeros to ``width`` digits; longer numbers stay whole."""
    digits = index.cast("string")
    return F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0"))


def seizure_id(case: Column, recording: Column, index: Column) -> Column:
    return F.concat_ws("__", case, recording, F.concat(F.lit("sz"), padded(index, 2)))


def window_id(case: Column, recording: Column, index: Column) -> Column:
    return F.concat_ws("__", case, recording, F.concat(F.lit("w"), padded(index, 6)))


def chunk_id(recording: Column, index: Column) -> Column:
    return F.concat_ws("__", recording, F.concat(F.lit("chunk"), padded(index, 5)))


def clock_seconds(text: Column) -> Column:
    """``H+:MM:SS`` as seconds; the hour may exceed 23; null for anything else."""
    shape = F.trim(text).rlike(r"^\d{1,3}:[0-5]?\d:[0-5]?\d$")
    part = F.split(F.trim(text), ":")
    return F.when(shape, part[0].cast("bigint") * 3600 + part[1].cast("bigint") * 60 + part[2].cast("bigint"))


def clock_duration(start: Column, end: Column) -> Column:
    """Struct (duration_seconds, crosses_midnight, valid).  An end before the start means
    the next day, if the end's hour is a plain one; nulls give nulls."""
    a, b = clock_seconds(start), clock_seconds(end)
    next_day = (b < a) & (b < 24 * 3600)
    return F.struct(
        F.when(b >= a, b - a).when(next_day, b + 86_400 - a).alias("duration_seconds"),
        F.when(b >= a, False).when(next_day, True).alias("crosses_midnight"),
        F.when(start.isNull() | end.isNull(), True).otherwise(F.coalesce((b >= a) | next_day, F.lit(False))).alias("valid"),
    )


def reasons(*checks: tuple[Column, str], none: str = "included") -> Column:
    """The names of the failed checks, joined by a bar, else ``none``."""
    return F.coalesce(F.nullif(F.concat_ws("|", *[F.when(bad, F.lit(name)) for bad, name in checks]), F.lit("")), F.lit(none))


def z_score(values: Column, mean: Column, scale: Column, unit: float = 1e6, limit: float | None = None) -> Column:
    """(x * unit - mean) / scale of each sample, optionally clipped."""
    scored = F.transform(values, lambda x: (x * unit - mean) / scale)
    return scored if limit is None else F.transform(scored, lambda x: clip(x, -limit, limit))


def longest_true_run(flags: Column) -> Column:
    """Length of the longest run of true in an array of booleans."""
    first = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when(x, acc["run"] + 1).otherwise(0)
        return F.struct(run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(flags, first, step)["best"]


def array_diff(values: Column) -> Column:
    """x[i + 1] - x[i]."""
    n = F.size(values)
    return F.when(n > 1, F.zip_with(F.slice(values, 2, F.greatest(n - 1, F.lit(0))), F.slice(values, 1, F.greatest(n - 1, F.lit(0))), lambda a, b: a - b)).otherwise(F.filter(values, lambda x: F.lit(False)))


def repeated_names(names: Column) -> Column:
    """The names that occur more than once in an array, sorted."""
    return F.array_sort(F.filter(F.array_distinct(names), lambda x: F.size(F.filter(names, lambda y: y == x)) > 1))
