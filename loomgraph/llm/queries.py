"""Queries of the training-data operators, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.problems import sql_path
from ..sources.tables import table
from ..session import materialise
from . import mixing, packing, parse_reports, subjects, tokens, tree_labels


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """``file``: files whose latest report says that the text breaks its language's rules."""
    return parse_reports.judge(table(spark, d, "parser_results"), table(spark, d, "files")).where("damage is not null").select("file")


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    """Damaged files per repository and language."""
    return parse_reports.damage_rates(table(spark, d, "parser_results"), table(spark, d, "files"))


def p2_backends(spark: SparkSession, d: str) -> DataFrame:
    """Damaged files per backend that was used."""
    return parse_reports.damage_by_backend(table(spark, d, "parser_results"), table(spark, d, "files"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """``path``: files in any run that were not written by hand."""
    return tree_labels.label_files(table(spark, d, "files")).where("p_handwritten < 0.5").select("path")


def p6_labels(spark: SparkSession, d: str) -> DataFrame:
    """Files per repository and label."""
    labelled = tree_labels.label_files(table(spark, d, "files"))
    return labelled.groupBy(F.element_at(F.split("path", "/"), 1).alias("repo"), "label").agg(F.count(F.lit(1)).alias("n_files"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """``doc_id, subject``: the subjects each document deals with."""
    documents = table(spark, d, "documents")
    rules = subjects.fit(documents, table(spark, d, "doc_labels"))
    return subjects.classify(documents, rules).select("doc_id", F.explode("subjects").alias("subject"))


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents and characters per subject; texts of several subjects count for each, ``(none)`` for no subject."""
    documents = table(spark, d, "documents")
    rules = subjects.fit(documents, table(spark, d, "doc_labels"))
    found = subjects.classify(documents, rules, ["n_chars"]).select("n_chars", F.explode(F.when(F.size("subjects") > 0, F.col("subjects")).otherwise(F.array(F.lit("(none)")))).alias("subject"))
    return found.groupBy("subject").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"))


def p9_quality(spark: SparkSession, d: str) -> DataFrame:
    """Labels met by rules that have not seen the labelled document, for each subject; a few labels are wrong."""
    rules = subjects.fit(table(spark, d, "documents"), table(spark, d, "doc_labels"))
    rows = spark.createDataFrame(subjects.quality(rules), "subject string, n_labelled long, n_found long, n_both long")
    return rows.withColumns({"recall": F.round(F.try_divide("n_both", "n_labelled"), 6), "precision": F.round(F.try_divide("n_both", "n_found"), 6)})


def _packed(spark: SparkSession, d: str) -> tuple[DataFrame, dict[int, packing.Plan], DataFrame]:
    """All pieces for all capacities by one pass, the plans, and the fixed small table of names of capacities."""
    sized = materialise(tokens.with_tokens(table(spark, d, "documents"), "text", ["doc_id"]))
    limits = table(spark, d, "pack_limits").where("capacity_tokens > 0").select("limit_name", F.col("capacity_tokens").alias("capacity"))
    return *packing.pack_all(sized, [r.capacity for r in limits.select("capacity").distinct().collect()]), limits


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every document with its container, for each capacity."""
    packed, _, limits = _packed(spark, d)
    return packed.join(F.broadcast(limits), "capacity").select("limit_name", "doc_id", "piece_no", "token_start", "n_tokens", "container_id")


def p7_usage(spark: SparkSession, d: str) -> DataFrame:
    """Containers, room used, the least number possible by volume and by the program, that of greedy filling, and the items placed by the program, for each capacity."""
    packed, plans, limits = _packed(spark, d)
    packed = materialise(packed)
    made = spark.createDataFrame([(c, p.containers, p.bound, p.greedy, p.by_program, p.passes) for c, p in plans.items()], "capacity int, n_filled long, bound long, greedy long, by_program long, passes int")
    used = reduce(DataFrame.unionByName, [packing.usage(packed.where(F.col("capacity") == c), c).withColumn("capacity", F.lit(c)) for c in plans])
    return limits.join(F.broadcast(used), "capacity").join(F.broadcast(made), "capacity").withColumnRenamed("capacity", "capacity_tokens")


def _measured(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents of wanted sources with their topics and tokens, by one pass over the texts, and the wanted shares."""
    documents = table(spark, d, "documents").withColumns({"source": mixing.canonical_source(F.col("source")), "language": mixing.canonical_language(F.col("lang"))})
    targets = table(spark, d, "mix_targets")
    wanted = documents.join(F.broadcast(targets.select(mixing.canonical_source(F.col("source")).alias("source")).distinct()), "source", "left_semi")
    rules = subjects.fit(documents, table(spark, d, "doc_labels"))
    measured = subjects.classify(wanted, rules, ["source", "language"], ("n_tokens", "long", tokens.count))
    return materialise(measured.withColumnRenamed("subjects", "topics")), targets


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mix and how often each is used."""
    return mixing.mix(*_measured(spark, d))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Wanted and reached share of each source."""
    sized, targets = _measured(spark, d)
    return mixing.shares(materialise(mixing.mix(sized, targets)), targets)


def p8_margins(spark: SparkSession, d: str) -> DataFrame:
    """Wanted and reached share of each source, language and topic."""
    return mixing.margins(*_measured(spark, d))


QUERIES = {f.__name__: f for f in (p2_found, p2_rates, p2_backends, p6_found, p6_labels, p7_packing, p7_usage, p8_mix, p8_shares, p8_margins, p9_found, p9_composition, p9_quality)}

# written from the statement of the problem: diagnostics by the severity of their code; reasons and strings without code by whether they tell of text broken off, merged or of another language
_CODED = """regexp_extract_all(d, '"code"\\s*:\\s*"([^"]*)"', 1)"""
_LOOSE = """list_concat([r], regexp_extract_all(d, '"[0-9]+:[0-9]+: ([^"\\\\]*(\\\\.[^"\\\\]*)*)', 1))"""
_BROKEN = (
    "inside a (string|block)|end of input|no more input|premature|is cut|cut off|stops|terminated|no end before|remain open|very end|rest of the file"
    "|stray|no tokens|start of line|was expected|continue after|unmerged|unresolved merge|same function|one hunk|breaks the grammar|without operands"
    "|disagree|no [a-z]+ grammar|( 0 of [0-9]+ lines accepted|lines rejected)|not accepted|under an? [a-z]+ suffix|reads like|begin a module|declarations are|no rule|no token|not a translation|another interpreter|unexpected .(def|[|])"
)
ORACLE = {
    "p2_found": f"""
        with runs as (select {sql_path("file")} as file, parsed_at, loaded_at, lower(coalesce(fallback_reason, '')) as r, lower(coalesce(diagnostics_json, '')) as d from parser_results),
        last as (select * from (select *, row_number() over (partition by file order by parsed_at desc, loaded_at desc, r desc, d desc) as k from runs) where k = 1)
        select distinct file from last
        where len(list_filter({_CODED}, lambda c: c not in ('hint', 'note', 'style', 'limit', 'deprecated', 'unsupported', 'unusedimport'))) > 0
           or len(list_filter({_LOOSE}, lambda x: regexp_matches(x, '{_BROKEN}') and not regexp_matches(x, 'not rejected|not recorded'))) > 0""",
}
