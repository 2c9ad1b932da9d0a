"""A sink that writes sorted text lines as one report, over as many files as there are tasks.

Rows are ``(line string, item boolean)`` in order (``orderBy`` first). A task writes its lines into one
file of a folder of its own write; nothing is visible until the commit on the driver, which knows every
task's first and last line. It puts what must stand once - a header, a comma between two items that
meet at the end of a task - into files of their own and moves all into place, so the files read in name
order are the report. A failed task or an aborted write leaves no file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from millrace.session import ship_package

FORMAT = "millrace_report"


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: its place, its file, its lines, and whether its first and last are items."""
    part: int
    file: str
    lines: int
    first: bool
    last: bool


class ReportWriter(DataSourceWriter):
    """``header`` stands before everything, ``skip_if_empty`` writes no report without lines."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path = options["path"].rstrip("/")
        self.header, self.skip = options.get("header", ""), options.get("skip_if_empty") == "true"
        self.overwrite = overwrite
        self.own = f"_write-{uuid.uuid4().hex}"

    def _folder(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")

    def write(self, iterator: Iterator[Row]) -> Written:
        fs, path = self._folder()
        task = TaskContext.get()
        part, file = task.partitionId(), f"{path}/{self.own}/{task.partitionId():05d}-{task.taskAttemptId()}"
        fs.create_dir(f"{path}/{self.own}", recursive=True)
        n, first, last = 0, False, False
        with fs.open_output_stream(file) as out:
            for line, item in iterator:
                item = bool(item)
                if n == 0:
                    first = item
                out.write(f"{',' if n and item and last else ''}{line}\n".encode())
                n, last = n + 1, item
        return Written(part, file, n, first, last)

    def commit(self, messages: list[Written | None]) -> None:
        fs, path = self._folder()
        done = sorted((m for m in messages if m and m.lines), key=lambda m: m.part)
        files, item = [], False
        if self.header and not (self.skip and not done):
            files.append(("part-00000-0", self.header))
        for m in done:
            if item and m.first:
                files.append((f"part-{m.part:05d}-1", ","))
            files.append((f"part-{m.part:05d}-2", m))
            item = m.last
        fs.create_dir(f"{path}/{self.own}", recursive=True)
        if self.overwrite:
            for old in fs.get_file_info(pafs.FileSelector(path)):
                if not old.base_name.startswith("_write-") and old.type == pafs.FileType.File:
                    fs.delete_file(old.path)
        for name, what in files:
            if isinstance(what, Written):
                fs.move(what.file, f"{path}/{name}")
            else:
                with fs.open_output_stream(f"{path}/{name}") as out:
                    out.write(what.encode())
        self._leave(fs, path, empty=not files)

    def abort(self, messages: list[Written | None]) -> None:
        fs, path = self._folder()
        self._leave(fs, path, empty=False)

    def _leave(self, fs: pafs.FileSystem, path: str, empty: bool) -> None:
        """Remove this write's own folder, and the report's where nothing is in it."""
        if fs.get_file_info(f"{path}/{self.own}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{path}/{self.own}")
        if fs.get_file_info(path).type == pafs.FileType.Directory and not fs.get_file_info(pafs.FileSelector(path)):
            fs.delete_dir(path)


class ReportSource(DataSource):
    """The sink's name for ``df.write.format``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "line string, item boolean"

    def writer(self, schema: StructType, overwrite: bool) -> ReportWriter:
        return ReportWriter(dict(self.options), overwrite)


def write_report(lines: DataFrame, path: str, header: str = "", skip_if_empty: bool = False) -> bool:
    """Write sorted ``lines(line, item)`` in place of what ``path`` holds; whether there is a report."""
    spark: SparkSession = lines.sparkSession
    ship_package(spark)
    spark.dataSource.register(ReportSource)
    lines.select("line", "item").write.format(FORMAT).mode("overwrite").option("header", header) \
        .option("skip_if_empty", str(skip_if_empty).lower()).save(path)
    fs, folder = ReportWriter({"path": path}, False)._folder()
    return fs.get_file_info(folder).type == pafs.FileType.Directory
