"""A sink of named files: every row (path, raw) becomes the file of that path, as stores of memories, sessions and edited texts need it.

A task writes a file beside its path under a name of its own and then moves it into place, so readers see the old text or the new one, and a task that runs twice writes the same text twice. Only a count returns to the driver. What is atomic is the file, not the job. Rows of one path should be one; else any of them stays. Null paths raise, null texts are empty. Paths may be URIs of a file system that pyarrow knows; where moving isn't atomic (object stores), the file is written in place, which is atomic there.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from gneiss.session import ship


@dataclass
class Written(WriterCommitMessage):
    files: int


class _Writer(DataSourceWriter):
    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        from pyarrow import fs

        n = 0
        for row in iterator:
            if not row["path"]:
                raise ValueError("a file needs a path")
            system, path = fs.FileSystem.from_uri(row["path"]) if "://" in row["path"] else (fs.LocalFileSystem(), row["path"].removeprefix("file:"))
            folder, _, name = path.rpartition("/")
            if folder:
                system.create_dir(folder, recursive=True)
            in_place = system.type_name in ("s3", "gcs", "abfs")
            to = path if in_place else f"{folder}/.{name}.{uuid.uuid4().hex}.tmp"
            with system.open_output_stream(to) as out:
                out.write((row["raw"] or "").encode("utf-8"))
            if not in_place:
                system.move(to, path)
            n += 1
        return Written(n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        pass

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        pass


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "path string, raw string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer()


def register(spark: SparkSession) -> None:
    """Makes ``df.write.format("named_files").mode("append").save()`` known to a session."""
    ship(spark)
    spark.dataSource.register(NamedFiles)


def write_files(files: DataFrame) -> None:
    """Writes rows (path, raw); other columns are left out."""
    register(files.sparkSession)
    files.select("path", "raw").write.format("named_files").mode("append").save()
