import numpy as np
import pytest

from wavemill import schemas
from wavemill.sources import edf, summary, tables


def write(tmp_path, name, data):
    p = tmp_path / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(data)


def test_edf_round_trip(spark, tmp_path):
    rng = np.random.default_rng(5)
    a, b = rng.normal(0, 50, 64 * 10), rng.normal(0, 50, 64 * 10)
    write(tmp_path, "chb01/chb01_01.edf", edf.encode(["FP1-F7", "T8-P8", "T8-P8"], [a, b, a], 64))
    write(tmp_path, "chb01/broken.edf", b"not a header")
    inventory, channels, failures = edf.read_headers(spark, str(tmp_path))
    row = inventory.first()
    assert (row.patient_id, row.recording_id, row.sampling_rate_hz, row.n_times, row.n_channels) == ("chb01", "chb01_01", 64.0, 640, 3)
    assert [r.original_name for r in channels.orderBy("channel_index").collect()] == ["FP1-F7", "T8-P8-0", "T8-P8-1"]
    assert {r.base_name for r in channels.collect()} == {"FP1-F7", "T8-P8"}
    assert failures.count() == 1
    blocks, broken = edf.read_signals(spark, str(tmp_path), 4)
    got = blocks.where("channel_index = 0").orderBy("block_index").collect()
    assert [len(r.samples) for r in got] == [256, 256, 128]
    assert np.abs(np.concatenate([r.samples for r in got]) - a).max() < 0.06
    assert [(r.item.split("/")[-1], r.error_type) for r in broken.collect()] == [("broken.edf", "ValueError")]
    # The data source: parts of a file, a URI, and filters that are pushed down.
    write(tmp_path, "chb02/chb02_07.edf", edf.encode(["FP1-F7"], [b], 64))
    (tmp_path / "chb01/broken.edf").unlink()
    spark.dataSource.register(edf.EdfDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    load = spark.read.format("edf").option("blockSeconds", 2).option("partBytes", 1000)
    source = load.load(str(tmp_path)).where("recording_id = 'chb01_01' AND channel_index = 1").orderBy("start_sample").collect()
    assert [r.start_sample for r in source] == [0, 128, 256, 384, 512] and [r.block_index for r in source] == [0, 1, 2, 3, 4]
    assert np.abs(np.concatenate([r.samples for r in source]) - b).max() < 0.06
    late = load.load(f"file://{tmp_path}").where("start_sample >= 256 AND start_sample < 500 AND recording_id IN ('chb01_01', 'chb02_07')").collect()
    assert sorted((r.recording_id, r.channel_index, r.start_sample) for r in late) == [("chb01_01", c, s) for c in range(3) for s in (256, 384)] + [("chb02_07", 0, s) for s in (256, 384)]


def test_pushed_filters(tmp_path):
    write(tmp_path, "chb01/chb01_01.edf", edf.encode(["A", "B"], [np.zeros(640)] * 2, 64))
    write(tmp_path, "chb02/chb02_07.edf", edf.encode(["A", "B"], [np.zeros(640)] * 2, 64))
    reader = edf.EdfReader(str(tmp_path), 2.0, 1000)
    filters = [edf.EqualTo(("recording_id",), "chb02_07"), edf.In(("channel_name",), ("B", "C")), edf.GreaterThanOrEqual(("start_sample",), 256)]
    assert list(reader.pushFilters(filters)) == filters
    parts = reader.partitions()
    assert len(parts) > 1 and {p.path.split("/")[-1] for p in parts} == {"chb02_07.edf"}
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert [(r["channel_name"], r["start_sample"]) for r in rows] == [("B", 256), ("B", 384), ("B", 512)]


GOOD = "Channel 1: FP1-F7\nChannel 2: F7-T7\n\nFile Name: chb01_03.edf\nFile Start Time: 13:43:04\nFile End Time: 14:43:04\nNumber of Seizures in File: 1\nSeizure Start Time: 2996 seconds\nSeizure End Time: 3036 seconds\n\nFile Name: chb01_04.edf\nFile Start Time: 23:30:00\nFile End Time: 00:30:00\nNumber of Seizures in File: 0\n"
BAD = "File Name: chb09_01.edf\nFile Start Time: 10:00:00\nFile End Time: 11:00:00\nSeizure 1 Start Time: 5 seconds\nSeizure 2 End Time: 9 seconds\n"


def test_summaries(spark, tmp_path):
    write(tmp_path, "chb01/chb01-summary.txt", GOOD.encode())
    write(tmp_path, "chb09/chb09-summary.txt", BAD.encode())
    write(tmp_path, "chb10/chb10-summary.txt", b"nothing here\n")
    channels, recordings, seizures, problems = summary.parse_summaries(summary.read_summaries(spark, str(tmp_path)))
    assert channels.count() == 2
    got = {r.recording_id: (r.case_id, r.duration_seconds, r.crosses_midnight, r.n_seizures) for r in recordings.collect()}
    assert got == {"chb01_03": ("chb01", 3600, False, 1), "chb01_04": ("chb01", 3600, True, 0)}
    s = seizures.collect()
    assert [(r.recording_id, r.seizure_index, r.onset_seconds, r.duration_seconds) for r in s] == [("chb01_03", 1, 2996.0, 40.0)]
    assert {r.error_type for r in problems.collect()} == {"index_mismatch", "no_recordings"}


def test_summary_lines(spark):
    """Case and outer blanks don't matter; units, inner words and single values do."""
    lines = {
        "File Name: chb01_03.edf": ("file_name", "chb01_03.edf"), "  FILE NAME:chb01_03.EDF\t": ("file_name", "chb01_03.EDF"), "File Name: .edf": None, "File Name: chb01.txt": None, "File Name : a.edf": None,
        "File Start Time: 13:43:04": ("start_clock", "13:43:04"), "File Start Time: 13:43 04": None, "file end time: 24:00:00": ("end_clock", "24:00:00"), "Number of Seizures in File: 2": ("declared", 2), "Number of Seizures in File: two": None,
        "Seizure Start Time: 12 seconds": ("start_at", 12.0), "Seizure 3 Start Time: 12.5 second": ("start_at", 12.5), "seizure\t10  End Time: 7seconds": ("end_at", 7.0), "Seizure Start Time: 12": None, "Seizure Start Time: 12 secs": None, "Seizure x Start Time: 1 seconds": None,
        "Seizure 3Start Time: 12 seconds": None, "Seizure End Time: 1.2.3 seconds": None, "SeizureEnd Time: 1 seconds": None, "Channel 12: FP1-F7 ": ("channel_name", "FP1-F7"), "Channel: X": None, "Channels in EDF Files:": None, "Channel 5:": None, "": None,
    }
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    for r in df.select("line", *[c.alias(n) for n, c in summary.told(df["line"]).items()]).collect():
        found = {k: v for k, v in r.asDict().items() if k != "line" and v is not None and not k.endswith(("_index", "_number"))}
        assert found == (dict([lines[r.line]]) if lines[r.line] else {}), r.line
    index = df.select(summary.told(df["line"])["start_index"].alias("i")).where("i IS NOT NULL").collect()
    assert [r.i for r in index] == [3]


def test_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_upsert(spark, path, spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), ["k"])
    tables.write_upsert(spark, path, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    part = str(tmp_path / "p")
    tables.write_partitions(spark.createDataFrame([(0, 1), (1, 1)], "f int, v int"), part, "f")
    tables.write_partitions(spark.createDataFrame([(1, 9)], "f int, v int"), part, "f")
    assert sorted((r.f, r.v) for r in spark.read.parquet(part).collect()) == [(0, 1), (1, 9)]
    assert tables.file_inventory(spark, path).count() > 0
    # A run that ended between the two renames loses nothing.
    (tmp_path / "t").rename(tmp_path / "t.old")
    tables.write_upsert(spark, path, spark.createDataFrame([(4, "e")], "k int, v string"), ["k"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "c"), (3, "d"), (4, "e")] and not (tmp_path / "t.old").exists()
    tables.write_sorted(spark.read.parquet(path), str(tmp_path / "s"), ["k"])
    assert [r.k for r in spark.read.parquet(str(tmp_path / "s")).sort("k").collect()] == [1, 2, 3, 4]
    blocks = spark.createDataFrame([("r", 0, "c", 0, 0, 8.0, [1.0])], schemas.SIGNAL_BLOCKS)
    written = tables.write_signals(spark, blocks, str(tmp_path / "b")).collect()
    assert len(written) == 1 and written[0].length > 0 and len(written[0].sha256) == 64
    assert [r.k for r in tables.first_files(spark.createDataFrame([("b", 2), ("a", 1), ("c", 3)], "path string, k int"), 2).collect()] == [1, 2]


def test_bad_bytes_are_replaced(spark, tmp_path):
    write(tmp_path, "chb01/chb01-summary.txt", GOOD.replace("Channel 2: F7-T7", "Channel 2: F7\xff").encode("latin-1"))
    texts = summary.read_summaries(spark, str(tmp_path))
    assert "F7\ufffd" in texts.first().text
    channels, recordings, *_ = summary.parse_summaries(texts)
    assert recordings.count() == 2 and {r.channel_name for r in channels.collect()} == {"FP1-F7", "F7\ufffd"}
    write(tmp_path, "chb02/chb02-summary.txt", GOOD.replace("chb01_03.edf", "chb02 03.edf").encode())
    assert {r.recording_id for r in summary.parse_summaries(summary.read_summaries(spark, str(tmp_path / "chb02")))[1].collect()} == {"chb02 03", "chb01_04"}


class Counted:
    """An open file that counts what is read."""

    def __init__(self, data):
        self.data, self.at, self.n = data, 0, 0

    def seek(self, at):
        self.at = at

    def read(self, n):
        out = self.data[self.at : self.at + n]
        self.at += len(out)
        self.n += len(out)
        return out


def test_bytes_fall_with_the_channels():
    rng = np.random.default_rng(3)
    names = [f"C{i}" for i in range(20)]
    data = edf.encode(names, [rng.normal(0, 50, 64 * 8) for _ in names], 64)
    counts = {}
    for wanted in ([3], [3, 4], [0, 19], list(range(20))):
        h = Counted(data)
        head = edf.parse_header(edf.read_head(h))
        assert h.n == head["header_bytes"]
        picked = [i in wanted for i in range(20)]
        body = edf.read_records(h, head, 2, 6, picked)
        counts[len(wanted)] = h.n - head["header_bytes"]
        rows = {r["channel_index"]: r["samples"] for r in edf.block_rows("r", data[: head["header_bytes"]] + body, 60)}
        whole = {r["channel_index"]: r["samples"] for r in edf.block_rows("r", data, 60, 2, 6)}
        assert all(np.array_equal(rows[i], whole[i]) for i in wanted)
    record = 4 * 20 * 64 * 2
    assert counts == {1: record // 20, 2: record // 10, 20: record}


def test_headers_alone(spark, tmp_path):
    many = edf.encode([f"C{i}" for i in range(600)], [np.zeros(8)] * 600, 4)
    write(tmp_path, "chb01/chb01_01.edf", edf.encode(["A", "B"], [np.zeros(640)] * 2, 64))
    write(tmp_path, "chb02/chb02_01.edf", many)
    write(tmp_path, "chb03/chb03_01.edf", b"no header")
    for read in (edf.read_headers, edf.scan_headers):
        inventory, channels, failures = read(spark, str(tmp_path))
        assert {(r.recording_id, r.n_channels, r.n_times) for r in inventory.collect()} == {("chb01_01", 2, 640), ("chb02_01", 600, 8)}
        assert channels.count() == 602 and [r.error_type for r in failures.collect()] == ["ValueError"]
    assert {r.sha256 for r in edf.scan_headers(spark, str(tmp_path))[0].collect()} == {None}
    spark.dataSource.register(edf.EdfDataSource)
    load = spark.read.format("edf")
    assert load.option("onError", "skip").load(str(tmp_path)).groupBy("recording_id").count().count() == 2
    with pytest.raises(Exception, match="not an EDF header"):
        load.option("onError", "fail").load(str(tmp_path)).count()
