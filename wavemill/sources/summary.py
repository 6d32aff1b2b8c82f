"""Annotation summaries: text files with a channel section and one block a recording.

The words before a line's colon tell its kind; a running count of ``File Name`` lines numbers
the blocks, and starts and ends of seizures are numbered within a block and paired.  Any
error fails the whole file, which then is in the problems table only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import case_id, clock_duration, path_stem

#: What stands before the colon of a line, in any case, and the units after a
#: seizure's time.
FILE_NAME, START_CLOCK, END_CLOCK, COUNT = "file name", "file start time", "file end time", "number of seizures in file"
CHANNEL, SEIZURE, SEIZURE_START, SEIZURE_END = "channel", "seizure", "start time", "end time"
UNITS = ("seconds", "second")
SPACE = " \t\x0b\x0c"


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of all files whose name holds ``summary``; bytes that are not UTF-8 are
    replaced by U+FFFD."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*[sS][uU][mM][mM][aA][rR][yY]*.[tT][xX][tT]").load(path)
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def whole(text: Column) -> Column:
    """A whole number, null where there is another character than a digit."""
    return F.when(F.length(text) > 0, F.when(F.translate(text, "0123456789", "") == "", text.try_cast("int")))


def seconds(value: Column) -> Column:
    """The number before the unit; null without either."""
    amount = F.lit(None).cast("string")
    for unit in UNITS:
        amount = F.coalesce(amount, F.when(F.endswith(F.lower(value), F.lit(unit)), F.rtrim(F.left(value, F.length(value) - len(unit)), F.lit(SPACE))))
    parts = F.split(amount, r"\.")
    fine = (F.size(parts) <= 2) & F.forall(parts, lambda p: (F.length(p) > 0) & (F.translate(p, "0123456789", "") == ""))
    return F.when(fine, amount.try_cast("double"))


def numbered(key: Column, first: str, last: str) -> tuple[Column, Column]:
    """Whether a key is ``first``, perhaps a number, and ``last``; and the number."""
    inner = F.when(F.startswith(key, F.lit(first)) & F.endswith(key, F.lit(last)), F.substr(key, F.lit(len(first) + 1), F.length(key) - len(first) - len(last)))
    number = F.trim(inner, F.lit(SPACE))
    # Blanks stand on either side of what is between the words.
    apart = (F.length(F.ltrim(inner, F.lit(SPACE))) < F.length(inner)) & ((F.length(number) == 0) | (F.lit(not last)) | (F.length(F.rtrim(inner, F.lit(SPACE))) < F.length(inner)))
    return F.coalesce(apart & ((F.length(number) == 0) | whole(number).isNotNull()), F.lit(False)), whole(number)


def told(line: Column) -> dict[str, Column]:
    """What a line says: the words before its first colon tell its kind, the rest its value."""
    colon = F.instr(line, ":")
    key = F.when(colon > 0, F.lower(F.ltrim(F.left(line, colon - 1), F.lit(SPACE))))
    value = F.trim(F.substr(line, colon + 1), F.lit(SPACE))
    word = F.when((F.length(value) > 0) & (F.translate(value, SPACE, "") == value), value)
    starts, start_index = numbered(key, SEIZURE, SEIZURE_START)
    ends, end_index = numbered(key, SEIZURE, SEIZURE_END)
    is_channel, channel = numbered(key, CHANNEL, "")
    return {
        "file_name": F.when((key == FILE_NAME) & F.endswith(F.lower(value), F.lit(".edf")) & (F.length(value) > 4), value),
        "start_clock": F.when(key == START_CLOCK, word), "end_clock": F.when(key == END_CLOCK, word), "declared": F.when(key == COUNT, whole(value)),
        "start_index": F.when(starts & seconds(value).isNotNull(), start_index), "start_at": F.when(starts, seconds(value)), "end_index": F.when(ends & seconds(value).isNotNull(), end_index), "end_at": F.when(ends, seconds(value)),
        "channel_number": F.when(is_channel & (F.length(value) > 0), channel), "channel_name": F.when(is_channel & (F.length(value) > 0), value),
    }


def parse_summaries(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(channels, recordings, seizures, problems) of texts with columns path and text."""
    lines = texts.select("path", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("n", "line"))
    order = W.partitionBy("path").orderBy("n")
    typed = lines.withColumns(told(F.col("line"))).withColumn("block", F.sum(F.col("file_name").isNotNull().cast("int")).over(order))
    channels = typed.where("block = 0 AND channel_number IS NOT NULL").select("path", "channel_number", "channel_name")
    inside = typed.where("block > 0")
    starts, ends = F.count("start_at"), F.count("end_at")
    blocks = inside.groupBy("path", "block").agg(F.max("file_name").alias("edf_filename"), F.max("start_clock").alias("start_clock"), F.max("end_clock").alias("end_clock"), F.max("declared").alias("declared"), starts.alias("n_starts"), ends.alias("n_ends"))
    by = W.partitionBy("path", "block").orderBy("n")
    first = inside.where("start_at IS NOT NULL").select("path", "block", F.row_number().over(by).alias("position"), "start_index", "start_at")
    second = inside.where("end_at IS NOT NULL").select("path", "block", F.row_number().over(by).alias("position"), "end_index", "end_at")
    pairs = first.join(second, ["path", "block", "position"]).withColumn("seizure_index", F.coalesce("start_index", "end_index", "position"))

    def problem(df: DataFrame, kind: str, message: Column) -> DataFrame:
        return df.select("path", F.lit(kind).alias("error_type"), message.cast("string").alias("error_message"))

    clock = clock_duration(F.col("start_clock"), F.col("end_clock"))
    problems = problem(texts.join(blocks.select("path").distinct(), "path", "left_anti"), "no_recordings", F.lit("no recording block"))
    problems = problems.unionByName(problem(blocks.where("n_starts <> n_ends"), "seizure_count", F.concat_ws(" ", "edf_filename", "n_starts", "n_ends")))
    problems = problems.unionByName(problem(pairs.where("start_index <> end_index"), "index_mismatch", F.concat_ws(" ", "start_index", "end_index")))
    twice = pairs.groupBy("path", "block", "seizure_index").agg(F.count("*").alias("c")).where("c > 1")
    problems = problems.unionByName(problem(twice, "duplicate_index", F.col("seizure_index"))).unionByName(problem(blocks.where(~clock["valid"]), "invalid_clock", F.concat_ws(" ", "start_clock", "end_clock")))
    bad = problems.select("path").distinct()
    good = blocks.join(bad, "path", "left_anti").withColumn("case_id", case_id(F.col("path"))).withColumn("recording_id", path_stem(F.col("edf_filename")))
    recordings = good.select("path", "case_id", "recording_id", "edf_filename", "start_clock", "end_clock", clock["duration_seconds"].alias("duration_seconds"), clock["crosses_midnight"].alias("crosses_midnight"), F.coalesce("declared", "n_starts").cast("int").alias("n_seizures"))
    seizures = good.join(pairs, ["path", "block"]).select("case_id", "recording_id", "edf_filename", "seizure_index", F.col("start_at").alias("onset_seconds"), F.col("end_at").alias("offset_seconds"), (F.col("end_at") - F.col("start_at")).alias("duration_seconds"))
    return channels.join(bad, "path", "left_anti"), recordings, seizures, problems
