"""Features of queries: budgets, ranking, materialisation through a backend, and the feature cache."""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import FeatureSpec, SemCQ, SemPredicate, semantic_feature


def predicate_budgets(predicates: int, total: int) -> list[int]:
    """An even split; the first predicates get what is left over."""
    share, rest = divmod(total, predicates) if predicates else (0, 0)
    return [share + (i < rest) for i in range(predicates)]


def with_mandatory(query: SemCQ, proposed: list[FeatureSpec]) -> list[FeatureSpec]:
    """The query's semantic predicates as features, each once, then the proposed ones that are new."""
    out: dict[tuple, FeatureSpec] = {}
    for spec in [*map(semantic_feature, query.semantics), *proposed]:
        out.setdefault(spec.key, spec)
    return list(out.values())


def accepted(proposed: list[FeatureSpec], p: SemPredicate, columns: list[str], taken: set[str], budget: int) -> list[FeatureSpec]:
    """Proposals for one predicate that read its column, have a type, a free name and a prompt of their own; one place of
    the budget belongs to the predicate itself."""
    out: list[FeatureSpec] = []
    for spec in proposed:
        new = spec.target.isidentifier() and spec.target not in taken and spec.target not in columns and all(spec.key != o.key for o in out)
        if spec.source == p.field and spec.kind.value != "undefined" and spec.prompt.strip() and new and not spec.mandatory and len(out) < max(0, budget - 1):
            out.append(spec)
            taken.add(spec.target)
    return out


def rank_features(specs: list[FeatureSpec], importance: dict[str, float], budget: int) -> list[FeatureSpec]:
    """The features of the first ``budget`` keys: mandatory ones as they come, then by falling importance.

    Importances of specs with the same key are added up.
    """
    groups: dict[tuple, list[FeatureSpec]] = {}
    for s in specs:
        groups.setdefault(s.budget_key, []).append(s)
    required = [k for k in groups if k[0] == "semantic"]
    if budget < len(required):
        raise ValueError(f"a budget of {budget} features doesn't hold {len(required)} semantic predicates")
    weight = lambda k: math.fsum(importance.get(s.target, 0.0) for s in groups[k])
    optional = sorted((k for k in groups if k[0] != "semantic"), key=lambda k: -weight(k))
    return [s for k in [*required, *optional][:budget] for s in groups[k]]


def expected_columns(columns: list[str], specs: list[FeatureSpec]) -> set[str]:
    return {*columns, *(s.target for s in specs)}


def sync_columns(df: DataFrame, specs: list[FeatureSpec], earlier: list[FeatureSpec]) -> tuple[DataFrame, list[FeatureSpec]]:
    """``df`` without features no longer asked for, and the specs it still lacks."""
    wanted = {s.target for s in specs}
    return df.drop(*[s.target for s in earlier if s.target not in wanted]), [s for s in specs if s.target not in df.columns]


def active_columns(columns: list[str], base: list[str], active: list[str]) -> list[str]:
    """Base and chosen features; an unknown one is an error."""
    missing = [c for c in active if c not in columns]
    if missing:
        raise ValueError(f"features not materialised: {missing}")
    return [*[c for c in base if c in columns], *sorted(active)]


# -- cache --------------------------------------------------------------------------------------------------------


def context_key(specs: list[FeatureSpec], backend: str) -> str:
    """What values depend on, besides the rows: the specs and the backend that answers them."""
    body = sorted([s.source, s.modality.value, s.target, s.prompt, s.kind.value] for s in specs)
    return hashlib.sha1(json.dumps([backend, body]).encode()).hexdigest()[:16]


def row_hash(columns: list[str]) -> Column:
    """A row's identity by its values; nulls and empty strings differ from a missing column, types don't matter."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])


def table_fingerprint(df: DataFrame, columns: list[str]) -> str:
    """One digest of a table's values, whatever the order of its rows."""
    r = df.select(row_hash(columns).alias("h")).agg(F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).first()
    return hashlib.sha1(f"{r['x']}:{r['s']}:{r['n']}".encode()).hexdigest()


class FeatureCache:
    """Feature values as Parquet below one folder, a table for each feature and backend, keyed by the source value.

    Hits are joined, by a hash and the value itself; only source values not there yet go to the backend, each distinct one
    once. Values that the backend can't answer are not kept, so that a later run asks again.
    """

    def __init__(self, root: str, enabled: bool = True):
        self.root, self.enabled = root.rstrip("/"), enabled

    def path(self, spec: FeatureSpec, backend: str) -> str:
        return f"{self.root}/{context_key([spec], backend)}"

    def read(self, spark, spec: FeatureSpec, backend: str) -> DataFrame | None:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(self.path(spec, backend))
        if not self.enabled or not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            return None
        fields = [T.StructField("_k", T.LongType()), T.StructField("_v", T.StringType()), T.StructField(spec.target, T._parse_datatype_string(spec.kind.sql))]
        return spark.read.schema(T.StructType(fields)).parquet(self.path(spec, backend))

    def materialise(self, df: DataFrame, spec: FeatureSpec, backend) -> DataFrame:
        """``df`` with the feature's column."""
        if not self.enabled:
            return backend.extract(df, [spec])
        spark = df.sparkSession
        key, text = row_hash([spec.source]), _as_text(df, spec.source)
        values = df.select(key.alias("_k"), text.alias("_v"), F.col(spec.source)).dropDuplicates(["_k", "_v"])
        known = self.read(spark, spec, backend.name)
        same = lambda o: (F.col("_k") == F.col("_ok")) & F.col("_v").eqNullSafe(F.col("_ov"))
        renamed = lambda o: o.withColumnsRenamed({"_k": "_ok", "_v": "_ov"})
        missing = values if known is None else values.join(renamed(known.select("_k", "_v")), same(known), "left_anti")
        answered = backend.extract(missing, [spec]).select("_k", "_v", spec.target).filter(F.col(spec.target).isNotNull())
        answered.write.mode("append").parquet(self.path(spec, backend.name))
        table = renamed(self.read(spark, spec, backend.name).dropDuplicates(["_k", "_v"]))
        return df.withColumn("_k", key).withColumn("_v", text).join(table, same(table), "left").drop("_k", "_v", "_ok", "_ov")


def _as_text(df: DataFrame, column: str) -> Column:
    """The value as text; binary values (images) by a digest."""
    return F.sha2(F.col(column), 256) if isinstance(df.schema[column].dataType, T.BinaryType) else F.col(column).cast("string")


class PseudoLabelCache:
    """Pseudo-labels of a query's candidates as Parquet below one folder.

    The key is of the predicates, the backend, and the values of the columns these read, whatever the order of rows: a
    changed text gives another key.
    """

    def __init__(self, root: str, enabled: bool = True):
        self.root, self.enabled = root.rstrip("/"), enabled

    def path(self, rows: DataFrame, row_id: str, specs: list[FeatureSpec], backend: str) -> str:
        columns = [row_id, *sorted({s.source for s in specs})]
        return f"{self.root}/pseudo-{context_key(specs, backend)}-{table_fingerprint(rows, columns)[:16]}"

    def labelled(self, rows: DataFrame, row_id: str, specs: list[FeatureSpec], backend: str, make) -> DataFrame:
        """``rows`` with ``proxy``; ``make(rows)`` adds it where the folder lacks it."""
        if not self.enabled:
            return make(rows)
        spark, path = rows.sparkSession, self.path(rows, row_id, specs, backend)
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            make(rows).select(row_id, "proxy").write.mode("overwrite").parquet(path)
        held = spark.read.parquet(path).withColumnRenamed(row_id, "_p_id")
        return rows.join(held, F.col(row_id) == F.col("_p_id"), "left").withColumn("proxy", F.coalesce("proxy", F.lit(False))).drop("_p_id")
