"""A data source that writes one text file a row, all or none, and leaves files alone whose content is the same."""

from __future__ import annotations

import glob
import os
import sys
import uuid
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "text_files"


@dataclass
class Written(WriterCommitMessage):
    """Temporary files of a task and what they become; how many files were the same already."""

    files: list[tuple[str, str]]
    same: int


class FileWriter(DataSourceWriter):
    """Each task writes its changed files beside their places under a name of this job; the commit moves them there. While the job's
    mark stands it is open; a task that ends after that takes its files away itself."""

    def __init__(self, folder: str, suffix: str, overwrite: bool) -> None:
        self.folder, self.suffix, self.overwrite = folder, suffix, overwrite
        self.job = uuid.uuid4().hex
        os.makedirs(folder, exist_ok=True)
        self.mark = os.path.join(folder, f".{self.job}-open")
        with open(self.mark, "wb"):
            pass

    def write(self, iterator: Iterator[Row]) -> Written:
        written = Written([], 0)
        try:
            for row in iterator:
                self._put(str(row["name"]), row["content"].encode(), written)
        finally:
            if sys.exc_info()[0] or not os.path.exists(self.mark):
                for beside, _ in written.files:
                    _remove(beside)
        return written

    def _put(self, name: str, content: bytes, written: Written) -> None:
        if not name or name.startswith(".") or "/" in name or os.sep in name or "\0" in name:
            raise ValueError(f"not a file's name: {name!r}")
        target = os.path.join(self.folder, name + self.suffix)
        if os.path.exists(target):
            with open(target, "rb") as f:
                if f.read() == content:
                    written.same += 1
                    return
            if not self.overwrite:
                raise FileExistsError(target)
        beside = os.path.join(self.folder, f".{self.job}-{uuid.uuid4().hex}")
        written.files.append((beside, target))
        with open(beside, "wb") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())

    def commit(self, messages: list[Written | None]) -> None:
        targets = [t for m in messages if m for _, t in m.files]
        if len(set(targets)) < len(targets):
            self.abort(messages)
            raise ValueError("two rows have one name")
        for m in messages:
            for beside, target in m.files if m else ():
                os.replace(beside, target)
        self.abort([])  # what attempts that died have left

    def abort(self, messages: list[Written | None]) -> None:
        _remove(self.mark)
        for path in glob.glob(os.path.join(glob.escape(self.folder), f".{self.job}-*")):
            _remove(path)


def _remove(path: str) -> None:
    with suppress(FileNotFoundError):
        os.remove(path)


class TextFiles(DataSource):
    """Writes rows (name, content) as ``path``/name + ``suffix``, UTF-8 without a mark. The folder must be one that all executors
    and the driver see. Mode append refuses to change a file, overwrite writes over those that differ; neither touches a
    file whose content is the same, or one that no row names."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        if schema.fieldNames() != ["name", "content"]:
            raise ValueError("rows must be (name, content)")
        return FileWriter(self.options["path"], self.options.get("suffix", ""), overwrite)


def write_files(rows: DataFrame, folder: str, suffix: str = "", mode: str = "overwrite") -> None:
    """Writes ``rows`` (name, content), whose contents must not be null, as files of ``folder``."""
    rows.sparkSession.dataSource.register(TextFiles)
    named = rows.select(rows["name"].cast("string").alias("name"), "content")
    named.write.format(NAME).mode(mode).option("suffix", suffix).save(folder)


def read_files(spark: SparkSession, folder: str, suffix: str = "") -> DataFrame:
    """(name, content) of the files of ``folder`` that end in ``suffix``; the reader leaves out empty ones."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder)
    base = F.substring_index("path", "/", -1)
    return files.select(F.substr(base, F.lit(1), F.length(base) - len(suffix)).alias("name"), F.decode("content", "UTF-8").alias("content"))
