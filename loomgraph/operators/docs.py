"""Document graph and its bridge to code."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions import text as T

FRONT = r"(?s)\A---\r?\n+(.*?)\r?\n+---"
EXACT_PATH, PATH_MENTION, NAME_MENTION, STEM_MATCH = 85.0, 65.0, 40.0, 40.0


def frontmatter(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, title, tags, fields`` of the YAML block between ``---``; null where there is none or it is no mapping.

    ``fields`` maps every key to its JSON.  Only the block goes to Python.
    """
    kind = dict(docs.dtypes)[key]

    def run(batches):
        import json

        import yaml

        for pdf in batches:
            rows = []
            for k, block in zip(pdf[key], pdf["block"], strict=True):
                try:
                    got = yaml.safe_load(block) if block else None
                except yaml.YAMLError:
                    got = None
                got = got if isinstance(got, dict) else None
                tags = got.get("tags") if got else None
                tags = [tags] if isinstance(tags, str) else tags
                title = got.get("title") if got else None
                rows.append((k, None if title is None else str(title), [str(x) for x in tags] if isinstance(tags, list) else None, {str(a): json.dumps(b, default=str, ensure_ascii=False) for a, b in got.items()} if got else None))
            yield pd.DataFrame(rows, columns=[key, "title", "tags", "fields"])

    block = F.regexp_extract(F.coalesce(text, F.lit("")), FRONT, 1)
    return docs.select(key, block.alias("block")).mapInPandas(run, f"{key} {kind}, title string, tags array<string>, fields map<string,string>")


def nodes(docs: DataFrame, front: DataFrame) -> DataFrame:
    """``path, title, tags, headings, wiki_links``: the title of the frontmatter, else the first heading, else the file's stem; tags of the frontmatter if there is one, else those in the text."""
    joined = docs.select("path", F.coalesce("text", F.lit("")).alias("text")).join(front.select("path", F.col("title").alias("ft"), F.col("tags").alias("fg"), "fields"), "path", "left")
    heads = T.headings(F.col("text"))
    first = F.get(heads, F.lit(0))["text"]
    has = F.col("fields").isNotNull()
    none = F.array().cast("array<string>")
    return joined.select("path", F.coalesce("ft", first, paths.stem(F.col("path"))).alias("title"), F.when(has, F.coalesce("fg", none)).otherwise(T.hash_tags(F.col("text"))).alias("tags"), heads.alias("headings"), T.wiki_links(F.col("text")).alias("wiki_links"))


def edges(doc_nodes: DataFrame) -> DataFrame:
    """Distinct ``from_id, to_id, edge_type``: links, tags and headings of each document."""
    start = F.concat(F.lit("doc:"), "path").alias("from_id")
    links = doc_nodes.select(start, F.explode("wiki_links.target").alias("t")).select("from_id", F.concat(F.lit("doc:"), "t").alias("to_id"), F.lit("LINKS_TO").alias("edge_type"))
    tags = doc_nodes.select(start, F.explode("tags").alias("t")).select("from_id", F.concat(F.lit("tag:"), "t").alias("to_id"), F.lit("HAS_TAG").alias("edge_type"))
    heads = doc_nodes.select(start, "path", F.explode("headings.text").alias("t")).select("from_id", F.concat(F.lit("heading:"), "path", F.lit(":"), "t").alias("to_id"), F.lit("HAS_HEADING").alias("edge_type"))
    return reduce(DataFrame.unionByName, [links, tags, heads]).distinct()


def backlinks(doc_edges: DataFrame, doc_nodes: DataFrame) -> DataFrame:
    """``target, source, source_title``: for every link, the document linked to and where from; the final ``.md`` may be lacking on either side."""
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, "^doc:", ""), r"\.md$", "")
    links = doc_edges.where("edge_type = 'LINKS_TO'").select(bare("to_id").alias("target"), bare("from_id").alias("source")).distinct()
    names = doc_nodes.select(bare("path").alias("source"), F.col("title").alias("source_title"))
    return links.join(names, "source").select("target", "source", "source_title").distinct()


def bridge(doc_nodes: DataFrame, front: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """``from_id, to_id, edge_type, score`` from documents to code, each pair and kind once with its best score.

    Related code named in the frontmatter describes a file or may be stale,
    names of symbols in it refer to every symbol of that name;
    paths in headings and links that exist are mentioned; names of symbols in
    titles and headings, and headings that are a file's stem, with or without
    underscores, refer to it.  A null or an empty text links to nothing.
    """
    have = files.select(F.col("path").alias("p")).distinct()
    names = symbols.select("name", F.concat("file", F.lit("::"), "name").alias("key")).distinct()
    start = F.concat(F.lit("doc:"), "path")
    related = front.where("fields is not null").select(start.alias("from_id"), F.explode(F.from_json(F.col("fields")["related_code"], "array<string>")).alias("p"))
    found = related.join(have.withColumn("there", F.lit(True)), "p", "left").select("from_id", F.col("p").alias("to_id"), F.when(F.col("there"), "DOC_DESCRIBES_CODE").otherwise("DOC_MAY_BE_STALE").alias("edge_type"), F.lit(EXACT_PATH).alias("score"))
    told = front.where("fields is not null").select(start.alias("from_id"), F.explode(F.from_json(F.col("fields")["symbols"], "array<string>")).alias("name")).join(names, "name").select("from_id", F.col("key").alias("to_id"), F.lit("DOC_REFERENCES_SYMBOL").alias("edge_type"), F.lit(EXACT_PATH).alias("score"))
    words = doc_nodes.select(start.alias("from_id"), F.explode(F.concat("headings.text", "wiki_links.target")).alias("w"))
    mentioned = words.select("from_id", F.explode(F.regexp_extract_all("w", F.lit(r"[\w./-]+\.[A-Za-z]{1,5}"), F.lit(0))).alias("p")).distinct().join(have, "p", "left_semi")
    mentions = mentioned.select("from_id", F.col("p").alias("to_id"), F.lit("DOC_MENTIONS_PATH").alias("edge_type"), F.lit(PATH_MENTION).alias("score"))
    said = doc_nodes.select(start.alias("from_id"), F.explode(F.concat(F.array("title"), "headings.text")).alias("w")).select("from_id", F.explode(T.words(F.col("w"))).alias("name")).where("length(name) > 2").distinct()
    refers = said.join(names, "name").select("from_id", F.col("key").alias("to_id"), F.lit("DOC_REFERENCES_SYMBOL").alias("edge_type"), F.lit(NAME_MENTION).alias("score"))
    flat = lambda c: F.replace(F.lower(c), F.lit("_"), F.lit(""))
    stems = have.select(F.col("p").alias("to_id"), flat(paths.stem(F.col("p"))).alias("k"))
    heads = doc_nodes.select(start.alias("from_id"), F.explode("headings.text").alias("w")).select("from_id", flat(F.translate("w", "` ", "")).alias("k")).where("k <> ''").distinct()
    same = heads.join(stems, "k").select("from_id", "to_id", F.lit("DOC_DESCRIBES_CODE").alias("edge_type"), F.lit(STEM_MATCH).alias("score"))
    return reduce(DataFrame.unionByName, [found, told, mentions, refers, same]).groupBy("from_id", "to_id", "edge_type").agg(F.max("score").alias("score"))


def stale(bridge_edges: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Bridge edges whose target is neither a file nor a symbol."""
    have = files.select(F.col("path").alias("to_id")).unionByName(symbols.select(F.concat("file", F.lit("::"), "name").alias("to_id"))).distinct()
    return bridge_edges.join(have, "to_id", "left_anti")


def docs_for(bridge_edges: DataFrame, path: str) -> DataFrame:
    """Documents that refer to a file or to a symbol in it."""
    return bridge_edges.where((F.col("to_id") == path) | F.startswith("to_id", F.lit(path + "::")))
