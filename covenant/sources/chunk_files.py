"""One JSON-lines file for each document, as a data source: rows.write.format("chunk_files").mode("append").save(folder).

Rows are stem, position and line. A file replaces the document's earlier one as a whole: tasks write beside the final
names, and only when all of them are done are the files moved into place; a failed job leaves nothing behind. write()
brings a document's rows to one task, in order, and streams them, so a document of any length takes no memory.
The folder must be one that driver and executors share.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class ChunkFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chunk_files"

    def schema(self) -> str:
        return "stem string, position bigint, line string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ChunkFilesWriter(dict(self.options)["path"])


class ChunkFilesWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.job = path if "://" in path else f"file://{path}", uuid.uuid4().hex

    def _at(self) -> tuple[fs.FileSystem, str]:
        files, root = fs.FileSystem.from_uri(self.path)
        return files, root.rstrip("/")

    @property
    def _staging(self) -> str:
        return f"{self._at()[1]}/_staging-{self.job}"

    def write(self, rows: Iterator) -> Written:
        files, root = self._at()
        files.create_dir(self._staging, recursive=True)
        done: list[tuple[str, str]] = []
        stem = out = None
        try:
            for row in rows:
                if row.stem != stem:
                    if out:
                        out.close()
                    stem, part = row.stem, f"{self._staging}/{uuid.uuid4().hex}"
                    done.append((part, f"{root}/{stem}.jsonl"))
                    out = files.open_output_stream(part)
                out.write((row.line + "\n").encode())
        finally:
            if out:
                out.close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        files, _ = self._at()
        for message in messages:
            for part, name in message.files if message else []:
                if files.get_file_info(name).type != fs.FileType.NotFound and files.type_name != "local":
                    files.delete_file(name)
                files.move(part, name)
        self._clear(files)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(self._at()[0])

    def _clear(self, files: fs.FileSystem) -> None:
        if files.get_file_info(self._staging).type == fs.FileType.Directory:
            files.delete_dir(self._staging)


def write(chunks: DataFrame, folder: str, position: Column) -> None:
    """chunks (doc_id, id, content, metadata as JSON) as <doc_id>.jsonl each, in order of position; NUL characters go."""
    spark = chunks.sparkSession
    spark.dataSource.register(ChunkFiles)
    text = F.replace(F.coalesce("content", F.lit("")), F.lit("\0"), F.lit(""))
    head = F.to_json(F.struct("id", text.alias("content")))
    line = F.concat(F.substring(head, 1, 10**9).substr(F.lit(1), F.length(head) - 1), F.lit(',"metadata":'), F.coalesce("metadata", F.lit("{}")), F.lit("}"))
    rows = chunks.select(F.col("doc_id").cast("string").alias("stem"), position.cast("bigint").alias("position"), line.alias("line"))
    rows.repartition("stem").sortWithinPartitions("stem", "position").write.format("chunk_files").mode("append").save(folder)
