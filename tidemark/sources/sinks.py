"""Ordered byte streams written out: as files by key in one transaction, as a table by key, or poured into one stream in order."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage


def write_ordered(chunks: DataFrame, path: str, key: str, order: list[str]) -> None:
    """Parquet by key, each file a range of the order, so that a hot key is many files and reading them in order gives its bytes."""
    chunks.repartitionByRange(key, *order).sortWithinPartitions(key, *order).write.partitionBy(key).parquet(path)


def pour(chunks: DataFrame, order: list[str], out: BinaryIO, body: str = "body") -> tuple[int, int]:
    """Writes the bodies to out in order; (bytes, chunks) written. The driver holds one partition at a time. Nulls are skipped."""
    total = n = 0
    for row in chunks.where(f"{body} is not null").orderBy(*order).select(body).toLocalIterator():
        out.write(row[0])
        total, n = total + len(row[0]), n + 1
    out.flush()
    return total, n


#: What the sink takes: the file, what orders its chunks, the chunk (null: none) and how many seconds of media it holds.
CHUNKS = "file string, place array<bigint>, body binary, seconds double"


@dataclass
class Written(WriterCommitMessage):
    """The pieces of a task: (file, place of the first chunk, staged name, bytes, seconds, chunks)."""

    pieces: list[tuple]


class _Files:
    """Pieces are staged under a name of this job; a commit moves them to their files and then writes a list of them, which is what counts."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.job = uuid.uuid4().hex

    def _at(self, name: str) -> tuple[fs.FileSystem, str]:
        system, base = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        return system, f"{base}/{name}"

    @property
    def _staging(self) -> str:
        return f"_staging/{self.job}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        pieces, out, now = [], None, None
        task = TaskContext.get()
        tag = f"{task.partitionId()}-{task.taskAttemptId()}" if task else uuid.uuid4().hex

        def close() -> None:
            if out is not None:
                out.close()

        try:
            for batch in batches:
                for file, place, body, seconds in zip(*(batch.column(c).to_pylist() for c in ("file", "place", "body", "seconds")), strict=True):
                    if now is None or now[0] != file:
                        close()
                        name = f"{self._staging}/{tag}-{len(pieces)}"
                        system, where = self._at(name)
                        system.create_dir(where.rpartition("/")[0], recursive=True)
                        out, now = system.open_output_stream(where), [file, place, name, 0, 0.0, 0]
                        pieces.append(now)
                    if body:
                        out.write(body)
                        now[3] += len(body)
                        now[5] += 1
                    now[4] += seconds or 0.0
        finally:
            close()
        return Written([tuple(p) for p in pieces])

    def _done(self, messages: list[Written | None], batch: int | None) -> None:
        told = f"_written/{self.job if batch is None else f'batch-{batch:09d}'}.json"
        system, where = self._at(told)
        if batch is not None and system.get_file_info(where).type != fs.FileType.NotFound:
            # The batch is there: what a repetition wrote goes.
            self._drop()
            return
        files: dict[str, list] = {}
        for piece in sorted((p for m in messages if m for p in m.pieces), key=lambda p: (p[0] or "", [(x is not None, x or 0) for x in p[1]])):
            files.setdefault(piece[0], []).append(piece)
        said = {}
        for file, pieces in files.items():
            folder = re.sub(r"[^A-Za-z0-9._-]", lambda m: f"%{ord(m[0]):02X}", file or "") or "%"
            prefix = "" if batch is None else f"{batch:09d}-"
            parts = []
            for i, (_, _, name, size, _, _) in enumerate(pieces):
                if size:
                    part = f"{folder}/{prefix}{i:06d}"
                    target, to = self._at(part)
                    target.create_dir(to.rpartition("/")[0], recursive=True)
                    target.move(self._at(name)[1], to)
                    parts.append(part)
            said[file or ""] = {"parts": parts, "bytes": sum(p[3] for p in pieces), "seconds": sum(p[4] for p in pieces), "chunks": sum(p[5] for p in pieces)}
        system.create_dir(where.rpartition("/")[0], recursive=True)
        with system.open_output_stream(where) as out:
            out.write(json.dumps(said).encode())
        self._drop()

    def _drop(self) -> None:
        system, where = self._at(self._staging)
        if system.get_file_info(where).type != fs.FileType.NotFound:
            system.delete_dir(where)


class Writer(_Files, DataSourceArrowWriter):
    def commit(self, messages: list[Written | None]) -> None:
        self._done(messages, None)

    def abort(self, messages: list[Written | None]) -> None:
        self._drop()


class StreamWriter(_Files, DataSourceStreamArrowWriter):
    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        self._done(messages, batchId)

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        self._drop()


class MediaFiles(DataSource):
    """Format media_files, a sink of CHUNKS. Option path: a folder that all executors write to."""

    @classmethod
    def name(cls) -> str:
        return "media_files"

    def schema(self) -> str:
        return CHUNKS

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options)

    def streamWriter(self, schema, overwrite: bool) -> StreamWriter:
        return StreamWriter(self.options)


def write_files(chunks: DataFrame, path: str, file: str, order: list[str], body: str = "body", seconds: str | None = None, tasks: int | None = None) -> dict[str, dict]:
    """Chunks as one file for each value of `file`, in order (whole numbers), in one transaction: (bytes, seconds, chunks, parts) of each.

    A file is a folder of numbered parts, each a range of the order, so a large file is written by many tasks and nothing passes the
    driver. Until the list of the parts is written, which is the last step, readers see none of them; a job that fails leaves none.
    A chunk that is null or empty adds its seconds only. tasks: how many write (else as many as the size asks for).
    """
    chunks.sparkSession.dataSource.register(MediaFiles)
    rows = chunks.select(F.col(file).cast("string").alias("file"), F.array(*(F.col(c).cast("bigint") for c in order)).alias("place"), F.col(body).alias("body"), (F.col(seconds).cast("double") if seconds else F.lit(0.0)).alias("seconds"))
    before = set(lists(path))
    rows.repartitionByRange(*([tasks] if tasks else []), "file", "place").sortWithinPartitions("file", "place").write.format("media_files").option("path", path).mode("append").save()
    (new,) = set(lists(path)) - before
    return totals(path, [new])


def lists(path: str) -> list[str]:
    system, where = _Files({"path": path})._at("_written")
    found = system.get_file_info(fs.FileSelector(where, allow_not_found=True))
    return sorted(x.base_name for x in found)


def totals(path: str, names: list[str] | None = None) -> dict[str, dict]:
    """What the lists of a sink say of each file, all batches together: parts in order, bytes, seconds, chunks."""
    out: dict[str, dict] = {}
    files = _Files({"path": path})
    for name in lists(path) if names is None else names:
        system, where = files._at(f"_written/{name}")
        with system.open_input_stream(where) as stream:
            for file, own in json.loads(stream.read()).items():
                sums = out.setdefault(file, {"parts": [], "bytes": 0, "seconds": 0.0, "chunks": 0})
                for k, v in own.items():
                    sums[k] += v
    return out
