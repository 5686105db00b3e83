"""Records as files, one for each: a Spark data source whose files appear when the whole job has succeeded, or not at all."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def _place(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path) if ":/" in path else (arrow_fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """Names of the files that a task has put into the job's own folder."""

    names: list[str]


class NamedFilesWriter(DataSourceWriter):
    """Tasks write into a folder of the job; commit moves their files to the path, abort deletes the folder.

    With overwrite, files that lie at the path and that this job doesn't write are deleted on commit."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path, overwrite, f".job-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        system, top = _place(self.path)
        folder = posixpath.join(top, self.job, uuid.uuid4().hex)  # another try of this task has another folder
        system.create_dir(folder, recursive=True)
        names = []
        for row in iterator:
            with system.open_output_stream(posixpath.join(folder, row["name"])) as out:
                out.write((row["text"] or "").encode("utf-8", "replace"))
            names.append(posixpath.join(posixpath.basename(folder), row["name"]))
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, top = _place(self.path)
        new = {posixpath.basename(n): n for m in messages if m for n in m.names}
        if self.overwrite:
            for info in system.get_file_info(arrow_fs.FileSelector(top, allow_not_found=True)):
                if info.type == arrow_fs.FileType.File and info.base_name not in new:
                    system.delete_file(info.path)
        for name, at in new.items():
            system.move(posixpath.join(top, self.job, at), posixpath.join(top, name))
        self._clear(system, top)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_place(self.path))

    def _clear(self, system: arrow_fs.FileSystem, top: str) -> None:
        folder = posixpath.join(top, self.job)
        if system.get_file_info(folder).type != arrow_fs.FileType.NotFound:
            system.delete_dir(folder)


class NamedFiles(DataSource):
    """df.write.format("named_files").mode("overwrite").save(path) of rows (name, text), on a path that all executors share."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema: StructType, overwrite: bool) -> NamedFilesWriter:
        return NamedFilesWriter(self.options["path"], overwrite)


def file_names(df: DataFrame, id_: str, suffix: str, *ties: str) -> DataFrame:
    """df with name: the id with anything but letters, digits, dots, hyphens and underscores as an underscore, and from the second row
    of a name on (in the order of ids and ties) with _2, _3 and so on. An id that ends in such a number is followed by ~, so no two names
    are equal. A row without an id is unnamed."""
    safe = F.coalesce(F.nullif(F.trim(F.regexp_replace(F.coalesce(F.col(id_).cast("string"), F.lit("")), "[^\\p{L}\\p{N}._-]+", "_"), F.lit("._")), F.lit("")), F.lit("unnamed"))
    n = F.row_number().over(Window.partitionBy("_safe").orderBy(F.col(id_).asc_nulls_last(), *ties))
    numbered = df.withColumn("_safe", safe).withColumn("_n", n)
    first = F.when(F.col("_safe").rlike("_[0-9]+\\z"), F.concat("_safe", F.lit("~"))).otherwise(F.col("_safe"))
    return numbered.withColumn("name", F.concat(first, F.when(F.col("_n") > 1, F.concat(F.lit("_"), F.col("_n").cast("string"))).otherwise(""), F.lit(suffix))).drop("_safe", "_n")


def write_problems(spark: SparkSession, problems: DataFrame, path: str, id_: str = "task_id") -> None:
    """Markdown files of problems (id, topic, difficulty, prompt, solution), one for each that has a prompt; a second run replaces the first.

    A null part is left out. Nothing is to be seen at the path until all files are there to be moved."""
    part = lambda title, c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(f"## {title}\n\n"), F.trim(c), F.lit("\n")))
    line = lambda title, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"- {title}: "), c, F.lit("\n")))
    head = F.concat(F.lit("# "), F.coalesce(F.col(id_).cast("string"), F.lit("unnamed")), F.lit("\n"))
    facts = F.concat_ws("", line("Topic", F.col("topic")), line("Difficulty", F.col("difficulty")))
    code = F.when(F.trim(F.coalesce("solution", F.lit(""))) != "", F.concat(F.lit("```c\n"), F.trim("solution"), F.lit("\n```")))
    text = F.concat_ws("\n", head, F.nullif(facts, F.lit("")), part("Problem", F.col("prompt")), part("Solution", code))
    rows = file_names(problems.where(F.trim(F.coalesce("prompt", F.lit(""))) != ""), id_, ".md", "prompt")
    spark.dataSource.register(NamedFiles)
    rows.select("name", text.alias("text")).write.format(NamedFiles.name()).mode("overwrite").save(path)
