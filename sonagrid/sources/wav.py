"""WAV files as a Spark data source, both ways, and PCM sample formats.

Reading: spark.read.format("binaryFile") finds and splits the files among
tasks, so any store works that Spark reads; each file becomes blocks of
samples. Files too long for a row go in ranges (read_ranges). Writing: register(spark) adds a data source "wav" whose tasks write
one file for each channel group they hold, under a temporary name first.
"""

from __future__ import annotations

import io
import struct
import uuid
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

BLOCKS = "path string, rate_hz int, ch long, block long, n0 long, samples array<double>"
_NAMES = ["path", "rate_hz", "ch", "block", "n0", "samples"]
_TYPES = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64())]


def header(f, size: int) -> tuple[int, int, int, int, int, int]:
    """(kind, channels, rate, bits, first byte of the data, its bytes) of an open WAV or RF64 file
    of ``size`` bytes. Data whose length is not known, or longer than the file, end with it."""
    start = f.read(12)
    if start[:4] not in (b"RIFF", b"RF64") or start[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, long = 12, None, None
    while at + 8 <= size:
        f.seek(at)
        name, length = struct.unpack("<4sI", f.read(8))
        if name == b"data":
            if form is None:
                raise ValueError("no format chunk")
            length = long if long is not None and length == 0xFFFFFFFF else length
            return (*form, at + 8, min(length, size - at - 8) if length != 0xFFFFFFFF else size - at - 8)
        if name == b"ds64":
            long = struct.unpack("<QQ", f.read(16))[1]
        elif name == b"fmt ":
            body = f.read(min(length, 40))
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            form = (struct.unpack("<H", body[24:26])[0] if kind == 0xFFFE else kind, channels, rate, bits)
        at += 8 + length + length % 2
    if form is None:
        raise ValueError("no format chunk")
    return (*form, size, 0)


def values(data: bytes, kind: int, bits: int, channels: int) -> np.ndarray:
    """(samples x channels) in [-1, 1) of the bytes of whole or cut data."""
    data = data[: len(data) // (bits // 8) * (bits // 8)]
    if kind == 3:
        x = np.frombuffer(data, dtype="<f4" if bits == 32 else "<f8").astype(float)
    elif bits == 8:
        x = (np.frombuffer(data, dtype=np.uint8).astype(float) - 128) / 128
    elif bits == 24:
        x = from_24_bits(data) / float(1 << 23)
    else:
        x = np.frombuffer(data, dtype=f"<i{bits // 8}").astype(float) / float(1 << (bits - 1))
    return x[: len(x) // channels * channels].reshape(-1, channels)


def decode(raw: bytes) -> tuple[int, np.ndarray]:
    """(rate, samples x channels in [-1, 1)) of a PCM or float WAV file."""
    kind, channels, rate, bits, first, length = header(io.BytesIO(raw), len(raw))
    return rate, values(raw[first : first + length], kind, bits, channels)


def encode(rate: int, samples: np.ndarray, bits: int = 16) -> bytes:
    """A PCM WAV file of 8 to 32 bits; samples beyond [-1, 1) are clipped."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(samples.shape[1])
        f.setsampwidth(bits // 8)
        f.setframerate(rate)
        top = float(1 << (bits - 1))
        q = np.clip(np.round(samples * top), -top, top - 1).astype(np.int64).ravel()
        f.writeframes({8: lambda: (q + 128).astype(np.uint8).tobytes(), 24: lambda: to_24_bits(q)}.get(bits, lambda: q.astype(f"<i{bits // 8}").tobytes())())
    return out.getvalue()


def from_24_bits(data: bytes) -> np.ndarray:
    b = np.frombuffer(data[: len(data) // 3 * 3], dtype=np.uint8).reshape(-1, 3).astype(np.int32)
    x = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
    return np.where(x >= 1 << 23, x - (1 << 24), x)


def to_24_bits(x: np.ndarray) -> bytes:
    return (np.asarray(x).astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()


def read(spark: SparkSession, path: str, block: int = 65536) -> DataFrame:
    """(path, rate_hz, ch, block, n0, samples) of all .wav files under path."""

    def run(it):
        for batch in it:
            for name, content in zip(batch.column("path"), batch.column("content")):
                rate, x = decode(content.as_py())
                rows = [(name.as_py(), rate, c, k, k * block, x[k * block : (k + 1) * block, c].tolist()) for c in range(x.shape[1]) for k in range(-(-len(x) // block))]
                columns = list(zip(*rows)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=_NAMES)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, BLOCKS)


def samples(blocks: DataFrame) -> DataFrame:
    """(path, rate_hz, ch, n, re) of blocks."""
    rows = blocks.select("path", "rate_hz", "ch", "n0", F.posexplode("samples").alias("i", "re"))
    return rows.select("path", "rate_hz", "ch", (F.col("n0") + F.col("i")).alias("n"), "re")


class _Range(InputPartition):
    def __init__(self, path: str, size: int, begin: int, end: int):
        self.path, self.size, self.begin, self.end = path, size, begin, end


class _RangeReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.block = options["path"], int(options.get("block", 65536))
        self.bytes = int(options.get("range_bytes", 64 << 20))
        if self.block < 1 or self.bytes < 1:
            raise ValueError("block and range_bytes are positive")

    def partitions(self):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.folder)
        info = store.get_file_info(root)
        files = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        files = [f for f in files if f.type == fs.FileType.File and f.path.endswith(".wav")]
        return [_Range(f.path, f.size, at, min(at + self.bytes, f.size)) for f in files for at in range(0, f.size, self.bytes)]

    def read(self, partition):
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.folder)
        with store.open_input_file(partition.path) as f:
            kind, channels, rate, bits, first, length = header(f, partition.size)
            frame = bits // 8 * channels
            step = self.block * frame
            # the blocks whose first byte is in this range
            k = max(0, -(-(partition.begin - first) // step))
            while first + k * step < partition.end and k * step < length // frame * frame:
                f.seek(first + k * step)
                x = values(f.read(min(step, length - k * step)), kind, bits, channels)
                columns = [[partition.path] * channels, [rate] * channels, range(channels), [k] * channels, [k * self.block] * channels, list(x.T)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=_NAMES)
                k += 1


class WavBlocks(DataSource):
    """Source "wav_blocks": blocks of the .wav files of a folder, read in ranges of bytes."""

    @classmethod
    def name(cls):
        return "wav_blocks"

    def schema(self):
        return BLOCKS

    def reader(self, schema):
        return _RangeReader(self.options)


def read_ranges(spark: SparkSession, path: str, block: int = 65536, range_bytes: int = 64 << 20) -> DataFrame:
    """What read gives, for files of any length (RF64 too): a task reads the header and a
    range of bytes, a block at a time, and has the blocks that begin in it. The
    driver lists the files only. The folder must be one that pyarrow reaches; paths are without their scheme."""
    spark.dataSource.register(WavBlocks)
    return spark.read.format("wav_blocks").option("block", block).option("range_bytes", range_bytes).load(path)


class _WavWriter(DataSourceWriter):
    def __init__(self, options):
        self.folder, self.bits = options["path"], int(options.get("bits", 16))

    def write(self, iterator):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.folder)
        store.create_dir(root, recursive=True)
        names = []
        for row in iterator:
            data = encode(row.rate_hz, np.asarray(row.samples, dtype=float).T, self.bits)
            temporary = f"{root}/_tmp-{uuid.uuid4().hex}"
            with store.open_output_stream(temporary) as out:
                out.write(data)
            store.move(temporary, f"{root}/{row.name}.wav")
            names.append(row.name)
        return WriterCommitMessage()

    def commit(self, messages):
        pass

    def abort(self, messages):
        pass


class WavSource(DataSource):
    """Sink "wav": rows (name string, rate_hz int, samples array<array<double>> by channel)."""

    @classmethod
    def name(cls):
        return "wav"

    def schema(self):
        return "name string, rate_hz int, samples array<array<double>>"

    def writer(self, schema, overwrite):
        return _WavWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WavSource)


def write(signal: DataFrame, path: str, rate_hz: int, by: str, bits: int = 16) -> None:
    """One file for each value of ``by`` from (by, ch, n, re)."""
    channels = signal.groupBy(by, "ch").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "re"))), lambda s: s.re).alias("x"))
    files = channels.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("ch", "x"))), lambda s: s.x).alias("samples"))
    register(signal.sparkSession)
    files.select(F.col(by).cast("string").alias("name"), F.lit(rate_hz).alias("rate_hz"), "samples").write.format("wav").option("bits", bits).mode("append").save(path)


# --- sample formats as columns --------------------------------------------------

#: name: (bits, signed)
FORMATS = {"i8": (8, True), "i16": (16, True), "i24": (24, True), "i32": (32, True), "u8": (8, False), "u16": (16, False), "u24": (24, False), "u32": (32, False)}


def to_format(x: Column, name: str) -> Column:
    """Sample in [-1, 1] as an integer of a format, clipped; floats stay."""
    if name in ("f32", "f64"):
        return x.cast("float" if name == "f32" else "double")
    bits, signed = FORMATS[name]
    top = float(1 << (bits - 1))
    q = F.greatest(F.lit(-top), F.least(F.lit(top - 1), F.floor(x * top + 0.5)))
    return (q if signed else q + top).cast("long")


def from_format(x: Column, name: str) -> Column:
    if name in ("f32", "f64"):
        return x.cast("double")
    bits, signed = FORMATS[name]
    top = float(1 << (bits - 1))
    return ((x if signed else x - top) / top).cast("double")


def microphone_positions(spark: SparkSession, path: str) -> DataFrame:
    """(pid, x, y, z) of an XML list of pos elements with attributes Name, x, y, z."""
    rows = spark.read.format("xml").option("rowTag", "pos").option("attributePrefix", "").load(path)
    return rows.select(F.col("Name").cast("string").alias("name"), *[F.col(a).cast("double").alias(a) for a in "xyz"])
