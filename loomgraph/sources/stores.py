"""Graphs, scans and metadata as JSON below a folder, and the configuration of a project."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as K


def save_json(df: DataFrame, root: str, name: str) -> None:
    """A collection as one JSON object per row in ``root/name``, replacing what was there; nulls are left out."""
    df.write.mode("overwrite").json(f"{root}/{name}")


def exists(spark: SparkSession, root: str, name: str) -> bool:
    """Whether a collection has been saved."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def load_json(spark: SparkSession, root: str, name: str, schema: K.StructType) -> DataFrame:
    """A collection as saved.

    A missing one is empty, missing fields are null, unknown fields are passed
    over, and a line that is no object gives a row of nulls rather than an end.
    """
    if not exists(spark, root, name):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(f"{root}/{name}")


def save_graph(collections: Mapping[str, DataFrame], root: str) -> None:
    """Every collection of a graph under its name."""
    for name, df in collections.items():
        save_json(df, root, name)


def load_graph(spark: SparkSession, root: str, schemas: Mapping[str, K.StructType]) -> dict[str, DataFrame]:
    """Every collection of a graph; those not saved are empty."""
    return {name: load_json(spark, root, name, schema) for name, schema in schemas.items()}


def cleared(collections: Mapping[str, DataFrame], keep: set[str]) -> dict[str, DataFrame]:
    """The collections with those not in ``keep`` emptied, their columns as before."""
    return {name: df if name in keep else df.where(F.lit(False)) for name, df in collections.items()}


def set_metadata(stored: DataFrame, entries: Mapping[str, str]) -> DataFrame:
    """``key, value`` with the entries in the place of those of equal key."""
    rows = stored.sparkSession.createDataFrame(list(entries.items()), "key string, value string")
    return stored.select("key", "value").join(F.broadcast(rows.select("key")), "key", "left_anti").unionByName(rows)


def agent_export(collections: Mapping[str, DataFrame]) -> DataFrame:
    """``collection, fact`` with every fact as JSON, to be written as lines; never gathered into one document."""
    out = None
    for name, df in collections.items():
        part = df.select(F.lit(name).alias("collection"), F.to_json(F.struct(*df.columns)).alias("fact"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("nothing to export")
    return out


@dataclass(frozen=True)
class Config:
    """Settings of a project."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    max_file_bytes: int = 10 * 1024 * 1024
    context_tokens: int = 12_000
    impact_depth: int = 3
    least_confidence: float = 70.0
    search_limit: int = 20
    least_score: float = 0.2

    @classmethod
    def load(cls, text: str | None = None, env: Mapping[str, str] | None = None, prefix: str = "LOOMGRAPH_", **given: Any) -> Config:
        """Defaults, then the YAML ``text``, then variables of the environment, then ``given``; null and unknown entries are passed over."""
        import yaml

        known = {f.name for f in fields(cls)}
        file = yaml.safe_load(text) if text else {}
        if not isinstance(file, dict):
            raise ValueError("a configuration is a mapping")
        env = os.environ if env is None else env
        named = {k.removeprefix(prefix).lower(): v for k, v in env.items() if k.startswith(prefix)}
        out = cls()
        for source in (file, named, given):
            some = {k: out._as(k, v) for k, v in source.items() if k in known and v is not None}
            out = replace(out, **some)
        return out

    def _as(self, name: str, value: Any) -> Any:
        """``value`` in the type of the setting; lists may be comma-separated text."""
        now = getattr(self, name)
        if isinstance(now, tuple):
            parts = value.split(",") if isinstance(value, str) else value
            return tuple(str(x).strip() for x in parts if str(x).strip())
        return type(now)(value)
