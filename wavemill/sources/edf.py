"""EDF files: decoder, writer, and a Spark data source.

``read_signals`` and ``read_headers`` list and open files through Hadoop's ``binaryFile``
scan, which reads any store that Spark reads.  ``spark.dataSource.register(EdfDataSource)``
makes ``spark.read.format("edf")`` available: it reads ranges of records, takes filters on
recording, channel and time, and opens paths and URIs through Arrow's file systems.  The
driver only lists files; headers are read in tasks.
"""

from __future__ import annotations

import posixpath
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition, LessThan

from .. import schemas
from ..functions.scalars import case_id, normalize_channel_name, path_stem, remove_duplicate_suffix

#: Widths of the fields of a signal's header, in file order.
SIGNAL_FIELDS = [("label", 16), ("transducer", 80), ("dimension", 8), ("physical_min", 8), ("physical_max", 8), ("digital_min", 8), ("digital_max", 8), ("prefilter", 80), ("samples", 8), ("reserved", 32)]
ANNOTATIONS = "EDF Annotations"


def parse_header(data: bytes) -> dict:
    """Header of an EDF file from its first bytes; ValueError if it is none."""
    if len(data) < 256 or data[:8].strip() != b"0":
        raise ValueError("not an EDF header")
    n = int(data[252:256])
    head = {"start_date": data[168:176].decode("ascii").strip(), "start_time": data[176:184].decode("ascii").strip(), "header_bytes": int(data[184:192]), "records": int(data[236:244]), "record_seconds": float(data[244:252])}
    if n < 1 or len(data) < 256 * (n + 1):
        raise ValueError("truncated EDF header")
    at, columns = 256, {}
    for name, width in SIGNAL_FIELDS:
        columns[name] = [data[at + i * width : at + (i + 1) * width].decode("latin-1").strip() for i in range(n)]
        at += n * width
    offset, signals = 0, []
    for i in range(n):
        s = {"label": columns["label"][i], "dimension": columns["dimension"][i], "samples": int(columns["samples"][i]), "offset": offset}
        s |= {k: float(columns[k][i]) for k in ("physical_min", "physical_max", "digital_min", "digital_max")}
        offset += s["samples"]
        signals.append(s)
    if head["record_seconds"] <= 0 or any(s["digital_max"] <= s["digital_min"] for s in signals):
        raise ValueError("invalid EDF scaling")
    seen: Counter = Counter()
    total = Counter(s["label"] for s in signals)
    for s in signals:
        # A label that repeats gets a running number, from 0.
        s["name"] = f"{s['label']}-{seen[s['label']]}" if total[s["label"]] > 1 else s["label"]
        seen[s["label"]] += 1
        s["rate"] = s["samples"] / head["record_seconds"]
    return head | {"signals": signals, "record_samples": offset}


def decode(data: bytes, first: int = 0, last: int | None = None) -> tuple[dict, list[np.ndarray]]:
    """Header and the physical samples of each signal in data records [first, last)."""
    head = parse_header(data)
    size = 2 * head["record_samples"]
    stored = max(0, (len(data) - head["header_bytes"]) // size)
    count = stored if head["records"] < 0 else min(stored, head["records"])
    last = count if last is None else min(last, count)
    raw = np.frombuffer(data, dtype="<i2", offset=head["header_bytes"] + first * size, count=max(0, last - first) * head["record_samples"]).reshape(-1, head["record_samples"])
    out = []
    for s in head["signals"]:
        gain = (s["physical_max"] - s["physical_min"]) / (s["digital_max"] - s["digital_min"])
        digital = raw[:, s["offset"] : s["offset"] + s["samples"]].ravel().astype(np.float64)
        out.append((digital - s["digital_min"]) * gain + s["physical_min"])
    return head | {"count": count}, out


def encode(names: list[str], signals: list[np.ndarray], rate: int, record_seconds: int = 1, physical: float = 3276.7) -> bytes:
    """A minimal EDF file; whole records only."""
    n, per = len(names), rate * record_seconds
    records = min(len(s) for s in signals) // per

    def field(x: object, width: int) -> bytes:
        return str(x)[:width].ljust(width).encode("latin-1")

    head = field(0, 8) + field("X", 80) + field("X", 80) + field("01.01.00", 8) + field("00.00.00", 8) + field(256 * (n + 1), 8) + field("", 44) + field(records, 8) + field(record_seconds, 8) + field(n, 4)
    values = {"label": names, "transducer": [""] * n, "dimension": ["uV"] * n, "physical_min": [-physical] * n, "physical_max": [physical] * n, "digital_min": [-32767] * n, "digital_max": [32767] * n, "prefilter": [""] * n, "samples": [per] * n, "reserved": [""] * n}
    head += b"".join(field(v, w) for name, w in SIGNAL_FIELDS for v in values[name])
    digital = [np.clip(np.round(np.asarray(s[: records * per]) / physical * 32767), -32767, 32767).astype("<i2").reshape(records, per) for s in signals]
    return head + np.concatenate(digital, axis=1).tobytes()


def binary_files(spark: SparkSession, path: str, pattern: str = "*.edf") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)


HEADER = "ok boolean, error_type string, error_message string, path string, file_size bigint, sha256 string, sampling_rate_hz double, n_times bigint, names array<string>"
HEADER_SCHEMA = pa.schema([("ok", pa.bool_()), ("error_type", pa.string()), ("error_message", pa.string()), ("path", pa.string()), ("file_size", pa.int64()), ("sha256", pa.string()), ("sampling_rate_hz", pa.float64()), ("n_times", pa.int64()), ("names", pa.list_(pa.string()))])


def header_row(path: str, size: int, sha256: str | None, head: bytes) -> dict:
    """One row of HEADER: what a file's first bytes say, or why they can't be read."""
    known = {"path": path, "file_size": size, "sha256": sha256}
    try:
        parsed = parse_header(head)
    except (ValueError, UnicodeDecodeError) as e:
        return known | failed(e)
    own = [s for s in parsed["signals"] if s["label"] != ANNOTATIONS]
    top = max(own, key=lambda s: s["rate"]) if own else None
    return known | {"ok": True, "sampling_rate_hz": top["rate"] if top else None, "n_times": parsed["records"] * top["samples"] if top else 0, "names": [s["name"] for s in own]}


def failed(e: Exception) -> dict:
    return {"ok": False, "error_type": type(e).__name__, "error_message": str(e)}


def headers_of(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(file inventory, channel rows, failures) of files with columns path and content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pylist([header_row(r["path"], r["length"], r["sha256"], r["head"]) for r in b.to_pylist()], schema=HEADER_SCHEMA)

    # One scan; only the header goes to Python: 256 bytes for the file and as many for each signal.
    signals = F.coalesce(F.expr("try_cast(trim(CAST(substring(content, 253, 4) AS STRING)) AS INT)"), F.lit(0))
    head = F.expr("substring(content, 1, n)")
    sized = files.select("path", "content", (256 * (F.greatest(signals, F.lit(0)) + 1)).alias("n"))
    found = sized.select("path", F.octet_length("content").cast("bigint").alias("length"), F.sha2("content", 256).alias("sha256"), head.alias("head")).mapInArrow(run, HEADER)
    return header_tables(found)


def header_tables(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(file inventory, channel rows, failures) from rows of HEADER."""
    good = found.where("ok").withColumn("recording_id", path_stem(F.col("path")))
    base = F.transform("names", lambda x: normalize_channel_name(x))
    inventory = good.select(
        F.col("path").alias("relative_path"), case_id(F.col("path")).alias("patient_id"), "recording_id", "sampling_rate_hz", "n_times", (F.col("n_times") / F.col("sampling_rate_hz")).alias("duration_seconds"), F.size("names").alias("n_channels"),
        F.array_join(base, "|").alias("ordered_signature"), F.array_join(F.array_sort(F.array_distinct(base)), "|").alias("unordered_signature"), "file_size", "sha256",
    )
    rows = good.select(F.col("path").alias("relative_path"), "recording_id", F.posexplode("names").alias("channel_index", "original_name"))
    channels = rows.withColumn("normalized_name", normalize_channel_name(F.col("original_name"))).withColumn("base_name", remove_duplicate_suffix(F.col("normalized_name")))
    failures = found.where("NOT ok").select(F.col("path").alias("item"), "error_type", "error_message")
    return inventory, channels, failures


def read_headers(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(file inventory, channel rows, failures) of all EDF files below ``path``."""
    return headers_of(binary_files(spark, path))


def scan_headers(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As ``read_headers``, but only the headers' bytes are read, on stores that Arrow opens; the
    hashes of the files are null."""
    spark.dataSource.register(EdfDataSource)
    return header_tables(spark.read.format("edf").option("path", path).option("rows", "headers").load())


def block_rows(recording: str, data: bytes, seconds: float, first: int = 0, last: int | None = None) -> Iterator[dict]:
    """Block rows of a file: ``seconds`` of one channel each, the tail included."""
    head, signals = decode(data, first, last)
    for i, (s, x) in enumerate(zip(head["signals"], signals)):
        if s["label"] == ANNOTATIONS:
            continue
        size, start = max(1, round(seconds * s["rate"])), first * s["samples"]
        for at in range(0, len(x), size):
            yield {"recording_id": recording, "channel_index": i, "channel_name": s["name"], "block_index": (start + at) // size, "start_sample": start + at, "sampling_rate_hz": s["rate"], "samples": x[at : at + size].astype(np.float32)}


BLOCK_SCHEMA = pa.schema([("recording_id", pa.string()), ("channel_index", pa.int32()), ("channel_name", pa.string()), ("block_index", pa.int64()), ("start_sample", pa.int64()), ("sampling_rate_hz", pa.float64()), ("samples", pa.list_(pa.float32()))])


def stem(path: str) -> str:
    return posixpath.splitext(posixpath.basename(path))[0]


def signals_of(files: DataFrame, block_seconds: float = 60.0) -> tuple[DataFrame, DataFrame]:
    """(block table, failures) of files with columns path and content, one file at a time."""
    schema = pa.schema([*BLOCK_SCHEMA, ("item", pa.string()), ("error_type", pa.string()), ("error_message", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                held: list[dict] = []
                try:
                    for row in block_rows(stem(r["path"]), r["content"], block_seconds):
                        held.append(row)
                        if len(held) == 256:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held = []
                except (ValueError, UnicodeDecodeError) as e:
                    held.append({"item": r["path"], "error_type": type(e).__name__, "error_message": str(e)})
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    out = files.select("path", "content").mapInArrow(run, f"{schemas.SIGNAL_BLOCKS}, {schemas.FAILURES}")
    return out.where("item IS NULL").drop("item", "error_type", "error_message"), out.where("item IS NOT NULL").select("item", "error_type", "error_message")


def read_signals(spark: SparkSession, path: str, block_seconds: float = 60.0) -> tuple[DataFrame, DataFrame]:
    """(block table, failures) of all EDF files below ``path``."""
    return signals_of(binary_files(spark, path), block_seconds)


class FilePart(InputPartition):
    """Part ``part`` of the ``parts`` equal ranges of data records of one file."""

    def __init__(self, path: str, part: int, parts: int):
        self.path, self.part, self.parts = path, part, parts


class FileList(InputPartition):
    """Files (path, size) whose headers one task reads."""

    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


def read_head(h) -> bytes:
    """The header of an open file, and not a byte more."""
    head = h.read(256)
    n = int(head[252:256]) if head[252:256].strip().isdigit() else 0
    return head + h.read(256 * n)


def record_ranges(head: dict, picked: list[bool]) -> list[tuple[int, int]]:
    """(offset, length) in bytes of the picked signals within a record; neighbours are one."""
    out: list[list[int]] = []
    for s, fine in zip(head["signals"], picked):
        if fine and out and sum(out[-1]) == 2 * s["offset"]:
            out[-1][1] += 2 * s["samples"]
        elif fine:
            out.append([2 * s["offset"], 2 * s["samples"]])
    return [(a, n) for a, n in out]


def read_records(h, head: dict, first: int, last: int, picked: list[bool]) -> bytes:
    """The data of records [first, last), with zeros for signals that are not picked; if most
    of a record is not, only what is picked is read."""
    size, ranges = 2 * head["record_samples"], record_ranges(head, picked)
    if 2 * sum(n for _, n in ranges) >= size:
        h.seek(head["header_bytes"] + first * size)
        return h.read((last - first) * size)
    body = bytearray((last - first) * size)
    for i in range(last - first):
        for offset, n in ranges:
            h.seek(head["header_bytes"] + (first + i) * size + offset)
            body[i * size + offset : i * size + offset + n] = h.read(n)
    return bytes(body)


class EdfReader(DataSourceReader):
    """Takes these filters: equality with, or membership in, recordings and channels, and
    bounds of ``start_sample``.  Other recordings are not opened, other records not read,
    and of the records only the wanted channels, if these are less than half of them.  Spark
    applies all filters again.  A file that can't be read ends the job, or, with ``skip``, has
    no rows."""

    def __init__(self, path: str, block_seconds: float, part_bytes: int, skip: bool = False):
        self.path, self.block_seconds, self.part_bytes, self.skip = path, block_seconds, part_bytes, skip
        self.wanted: dict[str, set] = {}
        self.first, self.end = 0, None

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, (EqualTo, In)) and name in ("recording_id", "channel_index", "channel_name"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[name] = self.wanted.get(name, values) & values
            elif isinstance(f, GreaterThanOrEqual) and name == "start_sample":
                self.first = max(self.first, f.value)
            elif isinstance(f, LessThan) and name == "start_sample":
                self.end = f.value if self.end is None else min(self.end, f.value)
            yield f

    def keeps(self, name: str, value: object) -> bool:
        return name not in self.wanted or value in self.wanted[name]

    def store(self) -> tuple:
        """Arrow's file system for the path, and the path in it."""
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def files(self) -> list[tuple[str, int]]:
        from pyarrow import fs

        store, root = self.store()
        info = store.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(".edf") and self.keeps("recording_id", stem(f.path)))

    def partitions(self) -> list[FilePart]:
        return [FilePart(p, i, parts) for p, size in self.files() for parts in [max(1, -(-size // self.part_bytes))] for i in range(parts)]

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        try:
            yield from self.blocks(partition)
        except (ValueError, UnicodeDecodeError):
            if not self.skip:
                raise

    def blocks(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        store, _ = self.store()
        with store.open_input_file(partition.path) as h:
            start = read_head(h)
            head = parse_header(start)
            picked = [s["label"] != ANNOTATIONS and self.keeps("channel_index", i) and self.keeps("channel_name", s["name"]) for i, s in enumerate(head["signals"])]
            if not any(picked):
                return
            size = 2 * head["record_samples"]
            stored = max(0, h.size() - head["header_bytes"]) // size
            count = stored if head["records"] < 0 else min(stored, head["records"])
            # Parts begin where blocks do.
            whole = max(1, round(self.block_seconds / head["record_seconds"]))
            blocks = -(-count // whole)
            first, last = (min(count, blocks * j // partition.parts * whole) for j in (partition.part, partition.part + 1))
            rates = [s["rate"] for s in head["signals"]]
            if self.first:
                first = max(first, min(last, int(self.first / max(rates) / head["record_seconds"]) // whole * whole))
            if self.end is not None:
                last = min(last, max(first, -(-(int(self.end / min(rates) / head["record_seconds"]) + 1) // whole) * whole))
            # A block of rows a read, so that a task holds no more.
            for at in range(first, last, whole):
                body = read_records(h, head, at, min(last, at + whole), picked)
                rows = [r for r in block_rows(stem(partition.path), start[: head["header_bytes"]] + body, self.block_seconds) if picked[r["channel_index"]]]
                for r in rows:
                    r["start_sample"] += round(at * head["record_seconds"] * r["sampling_rate_hz"])
                    r["block_index"] = r["start_sample"] // max(1, round(self.block_seconds * r["sampling_rate_hz"]))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=BLOCK_SCHEMA)


class HeaderReader(EdfReader):
    """A row of HEADER for each file, from its header's bytes alone; a file that can't be read
    is a row that says why."""

    def partitions(self) -> list[FileList]:
        files = self.files()
        return [FileList(files[i : i + 256]) for i in range(0, len(files), 256)]

    def read(self, partition: FileList) -> Iterator[pa.RecordBatch]:
        store, _ = self.store()
        rows = []
        for path, size in partition.files:
            try:
                with store.open_input_file(path) as h:
                    rows.append(header_row(path, size, None, read_head(h)))
            except OSError as e:
                rows.append({"path": path, "file_size": size} | failed(e))
        yield pa.RecordBatch.from_pylist(rows, schema=HEADER_SCHEMA)


class EdfDataSource(DataSource):
    """Options: ``path`` (or a URI), ``blockSeconds`` (60) and ``partBytes`` (64 MB) a
    partition, ``onError`` (fail, or skip files that can't be read), ``rows`` (blocks, or
    headers).  Filters are pushed down if ``spark.sql.python.filterPushdown.enabled``."""

    @classmethod
    def name(cls) -> str:
        return "edf"

    def headers(self) -> bool:
        return self.options.get("rows", "blocks") == "headers"

    def schema(self):
        return HEADER if self.headers() else schemas.SIGNAL_BLOCKS

    def reader(self, schema) -> EdfReader:
        kind = HeaderReader if self.headers() else EdfReader
        return kind(self.options["path"], float(self.options.get("blockSeconds", 60)), int(self.options.get("partBytes", 64 << 20)), self.options.get("onError", "fail") == "skip")
