"""Files of length-delimited messages, batch and streaming."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions.wire import host_varint
from ..operators.decode import DecodeError, pb_decode, read_varint
from ..schema import MessageSchema

FRAMES = ("varint", "u32le")


def frames(raw: bytes, frame: str = "varint"):
    """(offset, message) of each frame; a frame that does not fit raises DecodeError."""
    at, end = 0, len(raw)
    while at < end:
        start = at
        if frame == "varint":
            n, at = read_varint(raw, at, end)
        elif end - at < 4:
            raise DecodeError("buffer underflow")
        else:
            n, at = int.from_bytes(raw[at : at + 4], "little"), at + 4
        if n > end - at:
            raise DecodeError("buffer underflow")
        yield start, raw[at : at + n]
        at += n


def split_frames(files: DataFrame, frame: str = "varint") -> DataFrame:
    """(path, offset, raw, frame_error) from rows with path and content. A bad frame ends its file with one row that has the error."""
    if frame not in FRAMES:
        raise ValueError(f"unknown frame {frame}")

    def run(batches):
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out: list[list] = [[], [], [], []]
                try:
                    for at, m in frames(raw or b"", frame):
                        for c, v in zip(out, (path, at, m, None), strict=True):
                            c.append(v)
                        if len(out[0]) >= 10_000:
                            yield _batch(out)
                            out = [[], [], [], []]
                except DecodeError as e:
                    for c, v in zip(out, (path, None, None, str(e)), strict=True):
                        c.append(v)
                if out[0]:
                    yield _batch(out)

    return files.select("path", "content").mapInArrow(run, "path string, offset long, raw binary, frame_error string")


def _batch(out: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.string())], names=["path", "offset", "raw", "frame_error"])


def read_delimited(spark: SparkSession, path: str, m: MessageSchema | None = None, frame: str = "varint", mode: str = "PERMISSIVE", fields: list[str] | None = None) -> DataFrame:
    """Messages of all files under path, any file system that Spark reads. A file is one task's work: frames have no marks to split at."""
    rows = split_frames(spark.read.format("binaryFile").load(path), frame)
    return rows if m is None else pb_decode(rows, "raw", m, mode=mode, fields=fields)


def scratch(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; a new local one where it is unset on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return root.rstrip("/") if root else "file://" + tempfile.mkdtemp(prefix="sparkwire-")


def write_delimited(df: DataFrame, col: str, path: str, frame: str = "varint") -> None:
    """One file for each partition, of the column's messages end to end; null messages are left out."""
    df.sparkSession.dataSource.register(DelimitedSource)
    df.select(F.col(col).cast("binary").alias("raw")).write.format("pbdelimited").option("frame", frame).mode("append").save(path)


class DelimitedSource(DataSource):
    """Sink "pbdelimited": option frame = varint or u32le."""

    @classmethod
    def name(cls) -> str:
        return "pbdelimited"

    def schema(self) -> str:
        return "raw binary"

    def writer(self, schema, overwrite: bool):
        return DelimitedWriter(self.options["path"], self.options.get("frame", "varint"))


class DelimitedWriter(DataSourceArrowWriter):
    """Each task writes a file under a hidden name and commits by renaming, so a task that is run twice leaves one file."""

    def __init__(self, path: str, frame: str):
        if frame not in FRAMES:
            raise ValueError(f"unknown frame {frame}")
        self.path, self.frame = path, frame

    def _fs(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")

    def write(self, iterator):
        store, base = self._fs()
        store.create_dir(base, recursive=True)
        name = uuid.uuid4().hex
        with store.open_output_stream(f"{base}/_{name}.tmp") as out:
            for batch in iterator:
                for raw in batch.column(0).to_pylist():
                    if raw is not None:
                        out.write(host_varint(len(raw)) if self.frame == "varint" else len(raw).to_bytes(4, "little"))
                        out.write(raw)
        message = WriterCommitMessage()
        message.file = name
        return message

    def commit(self, messages) -> None:
        store, base = self._fs()
        for m in messages:
            if m is not None:
                store.move(f"{base}/_{m.file}.tmp", f"{base}/{m.file}.pb")

    def abort(self, messages) -> None:
        store, base = self._fs()
        for m in messages:
            if m is not None:
                store.delete_file(f"{base}/_{m.file}.tmp")
