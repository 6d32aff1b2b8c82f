from pyspark.sql import functions as F

from wavemill.functions import scalars as sc


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_channel_names(spark):
    cases = {" EEG FP1 - F7-REF ": "FP1-F7", "eeg t8–p8-le": "T8-P8", "F7 -  T7": "F7-T7", "FP1-F7": "FP1-F7"}
    for raw, want in cases.items():
        assert one(spark, sc.normalize_channel_name(F.lit(raw))) == want
    assert one(spark, sc.remove_duplicate_suffix(F.lit("T8-P8-0"))) == "T8-P8"


def test_clocks(spark):
    assert one(spark, sc.clock_seconds(F.lit("26:52:35"))) == 96_755
    assert one(spark, sc.clock_seconds(F.lit("1:99:00"))) is None
    d = one(spark, sc.clock_duration(F.lit("23:30:00"), F.lit("00:30:00")))
    assert (d.duration_seconds, d.crosses_midnight, d.valid) == (3600, True, True)
    assert one(spark, sc.clock_duration(F.lit("22:52:35"), F.lit("26:52:35"))).duration_seconds == 4 * 3600
    assert not one(spark, sc.clock_duration(F.lit("27:00:00"), F.lit("26:00:00"))).valid
    assert one(spark, sc.clock_duration(F.lit(None).cast("string"), F.lit("1:00:00"))).valid


def test_rounding(spark):
    assert one(spark, sc.round_half_even(F.lit(2.5))) == 2
    assert one(spark, sc.round_half_up(F.lit(2.5))) == 3
    assert one(spark, sc.seconds_to_samples(F.lit(0.001953125 * 3), F.lit(256.0))) == 2
    assert one(spark, sc.guarded_ratio(F.lit(1), F.lit(0))) is None


def test_ids_and_reasons(spark):
    assert one(spark, sc.window_id(F.lit("chb01"), F.lit("chb01_03"), F.lit(7))) == "chb01__chb01_03__w000007"
    assert one(spark, sc.case_id(F.lit("/raw/chb07/x.edf"))) == "chb07"
    assert one(spark, sc.reasons((F.lit(False), "a"), (F.lit(True), "b"), (F.lit(None).cast("boolean"), "c"))) == "b"
    assert one(spark, sc.reasons((F.lit(False), "a"))) == "included"


def test_runs(spark):
    assert one(spark, sc.longest_true_run(F.array(*[F.lit(x) for x in (True, False, True, True, True, False)]))) == 3


def test_ids_are_never_cut(spark):
    assert one(spark, sc.seizure_id(F.lit("c"), F.lit("r"), F.lit(123))) == "c__r__sz123"
    assert one(spark, sc.window_id(F.lit("c"), F.lit("r"), F.lit(1_234_567))) == "c__r__w1234567"
    assert one(spark, sc.chunk_id(F.lit("r"), F.lit(123_456))) == "r__chunk123456"
    assert [one(spark, sc.seizure_id(F.lit("c"), F.lit("r"), F.lit(x).cast(t))) for x, t in ((7, "bigint"), (None, "int"))] == ["c__r__sz07", "c__r"]
