"""Exports: graphs for drawing, delimited text, JSON and a page."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import markup_free

MAX_NODES, MAX_LINKS = 10_000, 50_000


def links(edges: DataFrame) -> DataFrame:
    """Distinct ``source, target, label``, free of markup characters."""
    return edges.select(markup_free(F.col("from_id")).alias("source"), markup_free(F.col("to_id")).alias("target"), F.col("edge_type").alias("label")).distinct()


def node_type(name: Column) -> Column:
    return F.when(F.startswith(name, F.lit("doc:")), "doc").when(F.startswith(name, F.lit("tag:")), "tag").when(F.startswith(name, F.lit("heading:")), "heading").otherwise("code")


def nodes(drawn: DataFrame) -> DataFrame:
    """The ends of links: ``id, node_type``."""
    ends = drawn.select(F.col("source").alias("id")).unionByName(drawn.select(F.col("target").alias("id"))).distinct()
    return ends.select("id", node_type(F.col("id")).alias("node_type"))


def page(drawn: DataFrame, title: str) -> str:
    """A page with a graph as JSON, at most as many nodes and links as a browser draws, in order of their names."""
    some = drawn.orderBy("source", "target", "label").limit(MAX_LINKS).collect()
    ids = sorted({x for r in some for x in (r.source, r.target)})[:MAX_NODES]
    kept = set(ids)
    data = {"nodes": [{"id": x} for x in ids], "links": [r.asDict() for r in some if r.source in kept and r.target in kept]}
    return f"<!doctype html><title>{html.escape(title)}</title><script type='application/json' id='graph'>{json.dumps(data).replace('</', '<' + chr(92) + '/')}</script>"


def csv_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """One unquoted line of comma-separated values per row; nulls are empty."""
    return df.select(F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("line"))


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON object per row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("line"))


def markdown_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row of a Markdown table per row."""
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |")).alias("line"))
