"""A sink of size-capped batches, as an index service takes them: all of a job's batches become visible, or none.

A task writes its rows in their order as JSON documents, into files of at most so many rows and bytes with
the envelope. Files of a task that fails, or of an attempt that another one overtook, are never named by
anyone: when all tasks are done, the driver writes one manifest that names the files of those that count,
and readers read what manifests name. An aborted job's files are deleted, but for those of tasks that were
still at work then.

Rows are checked before they are sent: a null id, one that a task sends twice, a vector of another length
than the first or without direction fails the job, and a row that is too long for a batch by itself too.
"""

from __future__ import annotations

import json
import math
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

MOST_ROWS = 500
MOST_BYTES = 12 << 20
HEAD, TAIL, BETWEEN = b'{"value":[', b"]}", b","


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def batches(documents: Iterator[bytes], most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> Iterator[list[bytes]]:
    """Documents in order, as lists whose envelope fits; one that fits no envelope is an error."""
    held: list[bytes] = []
    size = len(HEAD) + len(TAIL)
    for d in documents:
        if len(HEAD) + len(d) + len(TAIL) > most_bytes:
            raise ValueError(f"a document of {len(d)} bytes fits no batch")
        more = len(d) + (len(BETWEEN) if held else 0)
        if held and (len(held) == most_rows or size + more > most_bytes):
            yield held
            held, size, more = [], len(HEAD) + len(TAIL), len(d)
        held.append(d)
        size += more
    if held:
        yield held


@dataclass
class Written(WriterCommitMessage):
    files: list[dict] = field(default_factory=list)


class BatchWriter(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType):
        self.folder, self.id = options["path"], options.get("id", schema.names[0])
        self.vector, self.names = options.get("vector"), schema.names
        self.rows, self.bytes = int(options.get("rows", MOST_ROWS)), int(options.get("bytes", MOST_BYTES))
        self.job = uuid.uuid4().hex

    def _documents(self, rows: Iterator[Row]) -> Iterator[bytes]:
        seen, dim = set(), None
        for row in rows:
            r = dict(zip(self.names, row, strict=True))
            if r[self.id] is None or r[self.id] in seen:
                raise ValueError("a row without id" if r[self.id] is None else f"id {r[self.id]} is sent twice")
            seen.add(r[self.id])
            if self.vector:
                v = r[self.vector]
                dim = len(v) if dim is None and v else dim
                if not v or len(v) != dim or not all(x is not None and math.isfinite(x) for x in v) or not any(v):
                    raise ValueError(f"the vector of id {r[self.id]} can't be searched")
            yield json.dumps(r, ensure_ascii=False, separators=(",", ":"), default=str).encode()

    def write(self, iterator: Iterator[Row]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"{self.job}-{task.partitionId():06d}-{task.taskAttemptId()}"
        files, path = _fs(posixpath.join(self.folder, "data"))
        files.create_dir(path, recursive=True)
        out = Written()
        for n, docs in enumerate(batches(self._documents(iterator), self.rows, self.bytes)):
            data = HEAD + BETWEEN.join(docs) + TAIL
            with files.open_output_stream(f"{path}/{name}-{n:06d}.json") as f:
                f.write(data)
            out.files.append({"name": f"{name}-{n:06d}.json", "rows": len(docs), "bytes": len(data), "part": task.partitionId(), "place": n})
        return out

    def commit(self, messages: list[Written | None]) -> None:
        files, path = _fs(posixpath.join(self.folder, "manifests"))
        files.create_dir(path, recursive=True)
        named = [f for m in messages if m is not None for f in m.files]
        with files.open_output_stream(f"{path}/.{self.job}") as f:
            f.write("\n".join(json.dumps(x) for x in named).encode())
        files.move(f"{path}/.{self.job}", f"{path}/{self.job}.json")  # the rename makes all of them visible

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        files, path = _fs(posixpath.join(self.folder, "data"))
        for info in files.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            if info.base_name.startswith(self.job):
                files.delete_file(info.path)


class BatchSink(DataSource):
    """spark.dataSource.register(BatchSink), then df.write.format("capped_batches").option("id", ...).mode("append").save(folder)."""

    @classmethod
    def name(cls) -> str:
        return "capped_batches"

    def writer(self, schema: StructType, overwrite: bool) -> BatchWriter:
        if overwrite:
            raise ValueError("batches are only appended")
        return BatchWriter(self.options, schema)


def sent(spark: SparkSession, folder: str) -> DataFrame:
    """(name, rows, bytes, part, place) of every batch that is visible."""
    kind = "name string, rows int, bytes long, part int, place int"
    files, path = _fs(posixpath.join(folder, "manifests"))
    if files.get_file_info(path).type.name == "NotFound":
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).json(posixpath.join(folder, "manifests"))


def documents(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The documents of all visible batches, as rows with their batch's name; a batch is read by one task."""
    from pyspark.sql import functions as F

    texts = spark.read.option("wholetext", True).text(posixpath.join(folder, "data")).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"), "value")
    parsed = F.from_json("value", f"value array<struct<{StructType.fromDDL(schema).simpleString()[7:-1]}>>")
    return texts.join(sent(spark, folder).select("name"), "name", "left_semi").select("name", F.explode(parsed["value"]).alias("d")).select("name", "d.*")
