"""Sources and sinks: data sets with column roles, ground truth, images, result tables and journals.

Everything is read and written through Spark, so any store that Spark reaches will do.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import TableRoles
from .backends import encoded_image


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file as a whole."""
    return spark.read.text(path, wholetext=True).first()[0]


def parse_yaml(text: str) -> Any:
    try:
        import yaml
    except ImportError:  # JSON is YAML, too
        return json.loads(text)
    return yaml.safe_load(text)


def roles_of(config: dict[str, Any]) -> TableRoles:
    named = lambda key: tuple(config.get(key) or ())
    return TableRoles(named("base_features"), named("id_features"), named("foreign_keys"))


def read_table(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A Parquet, JSON-lines or CSV table, by its suffix; CSV has a header and may span lines. A schema saves a pass."""
    reader = spark.read.schema(schema) if schema else spark.read
    if path.endswith(".csv"):
        return reader.csv(path, header=True, inferSchema=schema is None, multiLine=True, escape='"')
    return reader.json(path) if path.endswith((".json", ".jsonl")) else reader.parquet(path)


def load_dataset(spark: SparkSession, folder: str, file: str = "data_full.csv", schema: str | T.StructType | None = None) -> tuple[DataFrame, TableRoles]:
    """A data set's table and the roles of its columns, from ``config.yaml`` beside it; roles go to column metadata."""
    roles = roles_of(parse_yaml(read_text(spark, f"{folder}/config.yaml")))
    return with_roles(read_table(spark, f"{folder}/{file}", schema), roles), roles


def with_roles(df: DataFrame, roles: TableRoles) -> DataFrame:
    """Roles as column metadata, so that they survive projection."""
    role = {c: r for r, cs in (("base", roles.base), ("id", roles.ids), ("payload", roles.payload)) for c in cs}
    return df.select(*[F.col(f"`{c}`").alias(c, metadata={"role": role.get(c, "external")}) for c in df.columns])


def roles_from(df: DataFrame) -> TableRoles:
    by = lambda role: tuple(f.name for f in df.schema if (f.metadata or {}).get("role") == role)
    return TableRoles(by("base"), by("id"), by("payload"))


def filled(df: DataFrame) -> DataFrame:
    """Missing texts as empty ones; numbers stay missing, as predicates know how to treat them."""
    return df.na.fill("")


def ground_truth(spark: SparkSession, folder: str, name: str, selected: list[str]) -> DataFrame:
    """Distinct keys of a query's true rows; other columns are ignored."""
    return read_table(spark, f"{folder}/ground_truth/{name}.csv").select(*selected).distinct()


def scan_images(spark: SparkSession, folder: str, pattern: str = "*.jpg") -> DataFrame:
    """path, content of image files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "content")


def data_urls(content: str | Column = "content") -> Column:
    """Images as data URLs, shrunk where they are large."""

    @F.pandas_udf("string")
    def each(raw):
        return raw.map(lambda b: encoded_image(bytes(b)) if b is not None else None)

    return each(content)


def existing_files(df: DataFrame, column: str, files: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose file is there."""
    return df.join(files.select(F.col(path).alias(column)).distinct(), column, "left_semi")


def flat_structs(df: DataFrame, field: str = "typeName") -> DataFrame:
    """Struct columns as their ``field``, or as JSON where they have none; arrays and maps as JSON."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StructType):
            c = c.getField(field) if field in f.dataType.names else F.to_json(c)
        elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
            c = F.to_json(c)
        out.append(c.alias(f.name))
    return df.select(*out)


# -- sinks --------------------------------------------------------------------------------------------------------


def result_table(spark: SparkSession, rows: Iterable[dict[str, Any]]) -> DataFrame:
    """Rows with any fields as one table of strings: the union of the fields in order, structures as JSON."""
    rows = list(rows)
    names = list(dict.fromkeys(k for r in rows for k in r))
    cell = lambda v: None if v is None else v if isinstance(v, str) else json.dumps(v, sort_keys=True, default=str)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names] or [T.StructField("empty", T.StringType())])
    return spark.createDataFrame([tuple(cell(r.get(n)) for n in names) for r in rows] if names else [], schema)


def save_csv(df: DataFrame, path: str) -> None:
    """A CSV with header; structures as JSON."""
    cells = [F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else F.col(f"`{f.name}`") for f in df.schema]
    df.select(*cells).write.mode("overwrite").csv(path, header=True, escape='"')


def append_journal(spark: SparkSession, path: str, rows: Iterable[dict[str, Any]]) -> None:
    """Rows as JSON lines, added to a journal."""
    spark.createDataFrame([(json.dumps(r, sort_keys=True, default=str),) for r in rows], "value string").coalesce(1).write.mode("append").text(path)


class StateStore:
    """Small JSON values by key below a folder: proposals, prefilters, certificates. Off: reads find nothing."""

    def __init__(self, spark: SparkSession, root: str, enabled: bool = True):
        self.spark, self.root, self.enabled = spark, root.rstrip("/"), enabled

    def _path(self, key: str) -> str:
        import hashlib

        return f"{self.root}/{hashlib.sha1(key.encode()).hexdigest()}"

    def get(self, key: str, valid=lambda value: True) -> Any:
        """The value, or None if there is none or it is no longer valid."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(key))
        if not self.enabled or not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        value = json.loads(self.spark.read.text(self._path(key)).first()[0])
        return value if valid(value) else None

    def put(self, key: str, value: Any) -> None:
        if self.enabled:
            self.spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(self._path(key))


def run_path(root: str, group: str, scenario: str, settings: dict[str, Any], steps: Iterable[float]) -> str:
    """Where a run keeps its files: group/scenario/k=v/.../steps."""
    parts = [f"{k}={settings[k]}" for k in sorted(settings)]
    return "/".join([root.rstrip("/"), group, scenario, *parts, "steps=" + "-".join(f"{s:g}" for s in steps)])


