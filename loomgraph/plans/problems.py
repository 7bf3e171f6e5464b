"""Queries for heavy keys, orphan references, snapshot changes and hierarchies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import hierarchy as tree
from ..operators import references, skew, snapshots
from ..sources.tables import table

HEAVY_SHARE = 0.015


def filled(c: str) -> Column:
    return F.col(c).isNotNull() & (F.trim(c) != "")


# 1 -- a few keys hold most rows


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """``field_name, key_text``: keys with at least 1.5 % of their table's ids."""
    parts = [
        skew.heavy_keys(table(spark, d, t), key, "id", HEAVY_SHARE).select(F.lit(f"{t}.{key}").alias("field_name"), "key_text")
        for t, key in (("calls", "callee_text"), ("imports", "source"))
    ]
    return parts[0].unionByName(parts[1])


def _profile(spark: SparkSession, d: str, t: str, key: str, target: str) -> DataFrame:
    return skew.key_profile(table(spark, d, t), key, "id", "file", "repo", filled(target)).select(F.lit(f"{t}.{key}").alias("field_name"), "*")


def p1_profile(spark: SparkSession, d: str) -> DataFrame:
    """Ids, files, repositories and resolution rate of every callee and source."""
    return _profile(spark, d, "calls", "callee_text", "resolved_symbol").unionByName(_profile(spark, d, "imports", "source", "resolved_file"))


def p1_definitions(spark: SparkSession, d: str) -> DataFrame:
    """Calls per callee and run that have a symbol of that name: the matching side is replicated to the shards only."""
    calls = table(spark, d, "calls").select("id", "callee_text", "snapshot_no").distinct()
    names = table(spark, d, "symbols").groupBy("name").agg(F.count_distinct("file").alias("n_defining_files"))
    joined = skew.balanced_join(calls, names, "callee_text", "name", ["id"])
    return joined.groupBy("callee_text", "snapshot_no", "n_defining_files").agg(F.count(F.lit(1)).alias("n_calls"))


# 3 -- references to records that do not exist


def reference_rows(spark: SparkSession, d: str) -> DataFrame:
    """All references as ``src_table, src_id, run, kind, key``; kinds are file, symbol and doc."""

    def rows(t: str, target: str, kind: Column, key: Column, keep: Column) -> DataFrame:
        return table(spark, d, t).where(filled(target) & keep).select(F.lit(t).alias("src_table"), F.col("id").alias("src_id"), F.col("snapshot_no").alias("run"), kind.alias("kind"), key.alias("key"))

    is_symbol = F.instr("to_id", "::") > 0
    is_doc = F.col("to_id").startswith("doc:")
    return (
        rows("imports", "resolved_file", F.lit("file"), paths.shortest(F.col("resolved_file")), F.lit(True))
        .unionByName(rows("calls", "resolved_symbol", F.lit("symbol"), paths.symbol_key(F.col("resolved_symbol")), F.lit(True)))
        .unionByName(rows("doc_edges", "to_id", F.lit("doc"), doc_key(F.expr("substring(to_id, 5)")), is_doc & (F.trim(F.expr("substring(to_id, 5)")) != "")))
        .unionByName(rows("bridge_edges", "to_id", F.when(is_symbol, "symbol").otherwise("file"), paths.symbol_key(F.col("to_id")), ~is_doc))
    )


def doc_key(path: Column) -> Column:
    """A document's path without the final ``.md``, which references may lack."""
    return F.regexp_replace(paths.shortest(path), r"\.md$", "")


def parent_rows(spark: SparkSession, d: str) -> DataFrame:
    """All parents as ``kind, key, first_run, end_run``; a file is there in just the runs that list it."""
    files = table(spark, d, "files").select(F.lit("file").alias("kind"), paths.shortest(F.col("path")).alias("key"), F.col("snapshot_no").alias("first_run"), (F.col("snapshot_no") + 1).alias("end_run"))
    symbols = table(spark, d, "symbols").select(F.lit("symbol").alias("kind"), F.concat(paths.shortest(F.col("file")), F.lit("::"), "name").alias("key"), F.col("snapshot_no").alias("first_run"), F.col("removed_in").alias("end_run"))
    docs = table(spark, d, "documents").select(F.lit("doc").alias("kind"), doc_key(F.col("path")).alias("key"), F.col("snapshot_no").alias("first_run"), F.col("removed_in").alias("end_run"))
    return files.unionByName(symbols).unionByName(docs)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """``src_table, src_id`` of every reference whose target is not there in its run."""
    return references.orphans(reference_rows(spark, d), parent_rows(spark, d)).select("src_table", "src_id").distinct()


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """References and orphans per table and run, each id once."""
    refs = reference_rows(spark, d)
    gone = references.orphans(refs, parent_rows(spark, d)).groupBy("src_table", "run").agg(F.count_distinct("src_id").alias("n_orphans"))
    all_ = refs.where("run is not null").groupBy("src_table", "run").agg(F.count_distinct("src_id").alias("n_references"))
    n = F.coalesce("n_orphans", F.lit(0))
    return all_.join(gone, ["src_table", "run"], "left").select("src_table", F.col("run").alias("snapshot_no"), "n_references", n.alias("n_orphans"), F.round(n / F.col("n_references"), 6).alias("orphan_share"))


# 4 -- what changed between full snapshots


def _changes(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "files").select("snapshot_no", "path", "hash")
    return snapshots.snapshot_changes(files, "snapshot_no", paths.shortest(F.col("path")), F.lower(F.trim("hash")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """``snapshot_no, path, change_kind`` between consecutive delivered runs."""
    return _changes(spark, d).select("snapshot_no", F.col("key").alias("path"), "change_kind")


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    """Paths added, removed and changed per run."""
    return _changes(spark, d).groupBy("snapshot_no", "change_kind").agg(F.count(F.lit(1)).alias("n_paths"))


# 5 -- hierarchies


def bare(name: Column) -> Column:
    """A type's name without type arguments and qualifier."""
    return F.element_at(F.split(F.trim(F.regexp_replace(name, r"(?s)<.*$", "")), r"::|\.|/|#|\\"), -1)


def type_links(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "type_impls").where("kind is null or kind <> 'derive'")
    return rows.select(bare(F.col("implementing_type")).alias("child"), bare(F.col("trait_or_interface")).alias("parent"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """``type_name, root_name, depth`` of every type in the hierarchy."""
    return tree.hierarchy(type_links(spark, d)).select(F.col("name").alias("type_name"), F.col("root").alias("root_name"), "depth")


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    """As p5_found, with the path from the root and the number of descendants."""
    from ..session import materialise

    full = materialise(tree.hierarchy(type_links(spark, d), with_path=True))
    below = tree.descendants(full).groupBy(F.col("ancestor").alias("name")).agg(F.count(F.lit(1)).alias("n_descendants"))
    joined = full.join(below, "name", "left")
    return joined.select(F.col("name").alias("type_name"), F.col("root").alias("root_name"), "depth", F.array_join("path", " > ").alias("full_path"), F.coalesce("n_descendants", F.lit(0)).alias("n_descendants"))


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of a type and one of its descendants."""
    return tree.descendants(tree.hierarchy(type_links(spark, d), with_path=True))


def p5_other_parents(spark: SparkSession, d: str) -> DataFrame:
    """Links to further parents of a type, which its one path does not follow."""
    return tree.other_parents(type_links(spark, d)).select(F.col("child").alias("type_name"), F.col("parent").alias("other_parent"), "kept_parent")


QUERIES = {f.__name__: f for f in (p1_found, p1_profile, p1_definitions, p3_found, p3_counts, p4_found, p4_counts, p5_found, p5_paths, p5_descendants, p5_other_parents)}


def sql_path(x: str) -> str:
    """The shortest spelling in SQL; enough for up to three ``..`` in a row."""
    out = f"regexp_replace(regexp_replace(replace({x}, '\\', '/'), '/(\\./|/)+', '/', 'g'), '^(\\./|/)+', '')"
    for _ in range(3):
        out = f"regexp_replace({out}, '(^|/)[^/.][^/]*/\\.\\./', '\\1', 'g')"
    return out


def sql_key(x: str) -> str:
    return f"case when {x} like '%::%' then {sql_path(f'split_part({x}, $$::$$, 1)')} || substr({x}, strpos({x}, '::')) else {sql_path(x)} end".replace("$$", "'")


def sql_doc(x: str) -> str:
    return f"regexp_replace({sql_path(x)}, '\\.md$', '')"


SQL_REFS = f"""
refs as (
  select 'imports' as src_table, id as src_id, snapshot_no as run, 'file' as kind, {sql_path("resolved_file")} as key from imports where trim(resolved_file) <> ''
  union all select 'calls', id, snapshot_no, 'symbol', {sql_key("resolved_symbol")} from calls where trim(resolved_symbol) <> ''
  union all select 'doc_edges', id, snapshot_no, 'doc', {sql_doc("substr(to_id, 5)")} from doc_edges where to_id like 'doc:%' and trim(substr(to_id, 5)) <> ''
  union all select 'bridge_edges', id, snapshot_no, case when to_id like '%::%' then 'symbol' else 'file' end, {sql_key("to_id")} from bridge_edges where trim(to_id) <> '' and to_id not like 'doc:%'),
there as (
  select distinct 'file' as kind, {sql_path("path")} as key, snapshot_no as a, snapshot_no + 1 as b from files
  union all select distinct 'symbol', {sql_path("file")} || '::' || name, snapshot_no, coalesce(removed_in, 2147483647) from symbols
  union all select distinct 'doc', {sql_doc("path")}, snapshot_no, coalesce(removed_in, 2147483647) from documents),
gone as (select * from refs r where not exists (select 1 from there t where t.kind = r.kind and t.key = r.key and t.a <= r.run and r.run < t.b))
"""

SQL_STATE = f"with state as (select distinct snapshot_no, {sql_path('path')} as path, lower(hash) as h from files), runs as (select s, lag(s) over (order by s) as was from (select distinct snapshot_no as s from files)),"
SQL_CHANGES = """
now as (select snapshot_no, path, h from state where snapshot_no <> (select min(s) from runs)),
before as (select s as snapshot_no, path, h from state join runs on was = snapshot_no),
changes as (select coalesce(n.snapshot_no, b.snapshot_no) as snapshot_no, coalesce(n.path, b.path) as path,
  case when b.h is null then 'added' when n.h is null then 'removed' else 'changed' end as change_kind
  from now n full join before b on n.snapshot_no = b.snapshot_no and n.path = b.path where n.h is distinct from b.h)
"""


def sql_bare(x: str) -> str:
    return f"regexp_extract(regexp_replace({x}, '<.*$', ''), '([A-Za-z0-9_]+)\\s*$', 1)"


SQL_TREE = f"""
with recursive rel as (select distinct {sql_bare("implementing_type")} as c, {sql_bare("trait_or_interface")} as p from type_impls where kind <> 'derive'),
names as (select c as n from rel union select p from rel),
walk(n, root, depth, path) as (
  select n, n, 0, n from names where n not in (select c from rel)
  union all select rel.c, walk.root, walk.depth + 1, walk.path || ' > ' || rel.c from walk join rel on rel.p = walk.n)
"""

ORACLE = {
    "p1_found": """
        select 'calls.callee_text' as field_name, callee_text as key_text from calls where callee_text is not null group by callee_text
        having count(distinct id) >= 0.015 * (select count(distinct id) from calls)
        union all select 'imports.source', source from imports where source is not null group by source
        having count(distinct id) >= 0.015 * (select count(distinct id) from imports)""",
    "p1_profile": """
        select field_name, key_text, count(*) as n_ids, count(distinct file) as n_files, count(distinct repo) as n_repos, sum(ok)::bigint as n_resolved, round(sum(ok) / count(*), 6) as resolved_share from (
          select 'calls.callee_text' as field_name, callee_text as key_text, id, any_value(file) as file, any_value(repo) as repo, max(coalesce(trim(resolved_symbol) <> '', false)::int) as ok from calls group by callee_text, id
          union all select 'imports.source', source, id, any_value(file), any_value(repo), max(coalesce(trim(resolved_file) <> '', false)::int) from imports group by source, id)
        where key_text is not null group by field_name, key_text""",
    "p1_definitions": """
        select callee_text, snapshot_no, n_defining_files, count(*) as n_calls from (select distinct id, callee_text, snapshot_no from calls)
        join (select name, count(distinct file) as n_defining_files from symbols group by name) on name = callee_text group by all""",
    "p3_found": f"with {SQL_REFS} select distinct src_table, src_id from gone",
    "p3_counts": f"""with {SQL_REFS}, o as (select src_table, run, count(distinct src_id) as n from gone group by all)
        select r.src_table, r.run as snapshot_no, count(distinct src_id) as n_references, coalesce(any_value(n), 0) as n_orphans, round(coalesce(any_value(n), 0) / count(distinct src_id), 6) as orphan_share
        from refs r left join o on o.src_table = r.src_table and o.run = r.run group by r.src_table, r.run""",
    "p4_found": f"{SQL_STATE} {SQL_CHANGES} select snapshot_no, path, change_kind from changes",
    "p4_counts": f"{SQL_STATE} {SQL_CHANGES} select snapshot_no, change_kind, count(*) as n_paths from changes group by all",
    "p5_found": f"{SQL_TREE} select names.n as type_name, coalesce(root, '(cycle)') as root_name, coalesce(depth, -1)::int as depth from names left join walk using (n)",
    "p5_paths": f"""{SQL_TREE} select names.n as type_name, coalesce(w.root, '(cycle)') as root_name, coalesce(w.depth, -1)::int as depth, w.path as full_path,
        (select count(*) from walk v where v.depth > w.depth and list_contains(string_split(v.path, ' > '), w.n)) as n_descendants from names left join walk w using (n)""",
    "p5_descendants": f"""{SQL_TREE} select ancestor, n as descendant, (depth + 1 - place)::int as distance from (
        select n, depth, unnest(string_split(path, ' > ')) as ancestor, unnest(range(1, depth + 2)) as place from walk) where place <= depth""",
    "p5_other_parents": f"""with rel as (select distinct {sql_bare("implementing_type")} as c, {sql_bare("trait_or_interface")} as p from type_impls where kind is null or kind <> 'derive')
        select c as type_name, p as other_parent, kept as kept_parent from rel join (select c, min(p) as kept from rel where c <> '' and p <> '' group by c) using (c) where p <> kept and p <> '' and c <> ''""",
}
