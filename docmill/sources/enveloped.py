"""One JSON file of records behind their metadata, written by all tasks: a Spark data source.

Every task writes its records to a part beside the target; the commit joins the parts behind the
metadata by streams, a few megabytes at a time, and moves the file to its place, so that a reader sees the old
file or the whole new one.  Failed attempts leave parts that no commit names; a commit and an abort
remove all of them.

Defined cases: no records give an empty list; records stand in the order of partitions and rows; values without a
JSON form are written as their text; the target is replaced.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

COPIED = 4 << 20


@dataclass
class Part(WriterCommitMessage):
    number: int
    path: str
    records: int


def _at(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class Enveloped(DataSource):
    """Options: path, source, processed_at."""

    @classmethod
    def name(cls) -> str:
        return "enveloped_json"

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(dict(self.options))


class Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.staging = options["path"], f"{options['path']}._parts-{uuid.uuid4().hex}"
        self.facts = {"processed_at": options["processed_at"], "source": options["source"]}

    def write(self, rows: Iterator) -> Part:
        fs, folder = _at(self.staging)
        fs.create_dir(folder)
        task = TaskContext.get()
        path, n = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}", 0
        with fs.open_output_stream(path) as out:
            for row in rows:
                text = json.dumps(row.asDict(recursive=True), ensure_ascii=False, indent=2, default=str)
                out.write((",\n" * bool(n) + "\n".join("    " + line for line in text.split("\n"))).encode())
                n += 1
        return Part(task.partitionId(), path, n)

    def commit(self, messages: list[Part | None]) -> None:
        fs, target = _at(self.path)
        parts = sorted((m for m in messages if m is not None and m.records), key=lambda m: m.number)
        facts = {"total_records": sum(m.records for m in parts), **self.facts}
        head = json.dumps({"metadata": facts}, ensure_ascii=False, indent=2)[:-2]
        whole = f"{target}._{uuid.uuid4().hex}"
        with fs.open_output_stream(whole) as out:
            out.write(f'{head},\n  "records": ['.encode())
            for i, part in enumerate(parts):
                out.write(b",\n" if i else b"\n")
                with fs.open_input_stream(part.path) as got:
                    while block := got.read(COPIED):
                        out.write(block)
            out.write(b"\n  ]\n}" if parts else b"]\n}")
        fs.move(whole, target)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        from pyarrow.fs import FileType

        fs, folder = _at(self.staging)
        if fs.get_file_info(folder).type != FileType.NotFound:
            fs.delete_dir(folder)


def write_enveloped(df: DataFrame, path: str, source: str, processed_at: str) -> None:
    """df as one JSON file at path, an address that all machines reach."""
    df.sparkSession.dataSource.register(Enveloped)
    df.write.format("enveloped_json").mode("append").option("source", source).option("processed_at", processed_at).save(path)
