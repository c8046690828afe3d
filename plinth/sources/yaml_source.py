"""YAML files as a data source: spark.read.format("plinth_yaml"), a row for each file, with its error where it can't be read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, StringEndsWith, StringStartsWith

SCHEMA = "file string, data string, error string"


def folder(path: str):
    """(file system, path in it) of a local path or of what Arrow can open."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "", 1) if path.startswith("file:/") else _absolute(path))


def _absolute(path: str) -> str:
    import os

    return os.path.abspath(path)


class YamlSource(DataSource):
    """Options: path, a folder or a file; pattern, of names ('*.yaml' by default, which takes .yml too)."""

    @classmethod
    def name(cls) -> str:
        return "plinth_yaml"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> YamlReader:
        return YamlReader(self.options.get("path"), self.options.get("pattern"))


class YamlReader(DataSourceReader):
    """A partition for each file. Filters on file are judged before any file is opened."""

    def __init__(self, path: str | None, pattern: str | None):
        if not path:
            raise ValueError("no path")
        self.path, self.pattern, self.tests = path, pattern, []

    def pushFilters(self, filters):
        for f in filters:
            if getattr(f, "attribute", None) == ("file",) and isinstance(f, EqualTo | In | StringStartsWith | StringEndsWith):
                self.tests.append(f)
            else:
                yield f

    def _wanted(self, name: str) -> bool:
        judge = {EqualTo: lambda f: name == f.value, In: lambda f: name in f.value, StringStartsWith: lambda f: name.startswith(f.value), StringEndsWith: lambda f: name.endswith(f.value)}
        return all(judge[type(f)](f) for f in self.tests)

    def partitions(self) -> list[InputPartition]:
        from fnmatch import fnmatch

        from pyarrow import fs

        system, at = folder(self.path)
        info = system.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File]
        fits = lambda n: fnmatch(n, self.pattern) if self.pattern else n.endswith((".yaml", ".yml"))
        names = sorted(f.path for f in files if (info.type == fs.FileType.File or fits(f.base_name)) and self._wanted(f.path))
        return [InputPartition(n) for n in names]

    def read(self, partition: InputPartition):
        import json

        import yaml

        from ..operators.evaluation import plain

        system, _ = folder(self.path)
        try:
            with system.open_input_stream(partition.value) as f:
                data = yaml.safe_load(f.read().decode())
            yield partition.value, json.dumps(plain(data)), None
        except Exception as e:  # a broken file is a row, so that the others can be read
            yield partition.value, None, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"


def yaml_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """SCHEMA of the files at path: data is the document as JSON, null with an error where it can't be read. One document a file."""
    from ..shipping import ship

    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # else a reader that takes filters is refused
    spark.dataSource.register(YamlSource)
    reader = spark.read.format("plinth_yaml").option("path", path)
    return (reader.option("pattern", pattern) if pattern else reader).load()


def plans_of(files: DataFrame) -> DataFrame:
    """Plans (degree.PLAN) of yaml_files: plan_id or the file's name, what was taken (term_idx -1), terms. Files with an error or without terms give no rows."""
    stem = F.regexp_extract("file", "([^/.]+)[^/]*$", 1)
    read = F.from_json("data", "plan_id string, taken array<string>, terms array<struct<term:string,courses:array<string>>>")
    rows = files.where("data is not null").select(stem.alias("stem"), read.alias("d")).select(F.coalesce("d.plan_id", "stem").alias("plan"), "d.taken", "d.terms")
    terms = rows.select("plan", F.posexplode("terms").alias("term_idx", "t")).select("plan", "term_idx", "t.term", F.posexplode("t.courses").alias("pos", "course"))
    before = rows.select("plan", F.lit(-1).alias("term_idx"), F.lit(None).cast("string").alias("term"), F.posexplode("taken").alias("pos", "course"))
    return before.unionByName(terms)


def questions_of(files: DataFrame) -> DataFrame:
    """Query sets of yaml_files (a list of id, type, text, course, term, plan_id) -> (file, id, type, text, course, term, plan)."""
    read = F.from_json("data", "array<struct<id:string,type:string,text:string,course:string,term:string,plan_id:string>>")
    return files.where("data is not null").select("file", F.inline(read)).withColumnRenamed("plan_id", "plan")
