"""Counts, filters, resolution and graph queries over the code facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..functions import text as T
from ..operators import budget, graph, resolve
from ..sources.tables import last_runs, table
from .book import Book

book = Book()
q = book.query


def there(c: str):
    return F.col(c).isNotNull() & (F.trim(c) != "")


# Counts


@q("""select name, file, n_calls from (select callee_text, count(distinct id) as n_calls from calls group by callee_text)
      join (select distinct name, file from symbols) on name = callee_text order by n_calls desc, name, file limit 25""")
def hotspots(spark: SparkSession, d: str) -> DataFrame:
    """The most called names with the files that define them; homonyms share their count."""
    ids = table(spark, d, "calls").select("callee_text", "id").distinct()
    counts = ids.groupBy("callee_text").agg(F.count(F.lit(1)).alias("n_calls"))
    defined = table(spark, d, "symbols").select("name", "file").distinct()
    return counts.join(defined, F.col("callee_text") == F.col("name")).select("name", "file", "n_calls").orderBy(F.desc("n_calls"), "name", "file").limit(25)


@q("select tag, count(*) as n_docs from (select unnest(tags) as tag from documents) group by tag having count(*) >= 5")
def tag_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n_docs")).where("n_docs >= 5")


@q("select distinct unnest(tags) as tag from documents")
def all_tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.explode("tags").alias("tag")).distinct()


@q("select language, count(*) as n_files from files group by language")
def language_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").groupBy("language").agg(F.count(F.lit(1)).alias("n_files"))


@q("select snapshot_no, round(100.0 * count_if(coalesce(trim(resolved_file) <> '', false)) / count(*), 4)::double as percent from imports group by snapshot_no")
def resolution_rate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "imports").groupBy("snapshot_no").agg(F.round(100.0 * F.count_if(there("resolved_file")) / F.count(F.lit(1)), 4).alias("percent"))


@q("select requested_backend, count_if(used_backend = 'ripex')::bigint as first_backend, count_if(used_backend = 'tree-sitter')::bigint as second_backend, count_if(coalesce(trim(fallback_reason) <> '', false))::bigint as fallbacks from parser_results group by requested_backend")
def backend_mix(spark: SparkSession, d: str) -> DataFrame:
    used = F.col("used_backend")
    return table(spark, d, "parser_results").groupBy("requested_backend").agg(F.count_if(used == "ripex").alias("first_backend"), F.count_if(used == "tree-sitter").alias("second_backend"), F.count_if(there("fallback_reason")).alias("fallbacks"))


COUNTED = ("files", "symbols", "imports", "calls", "type_impls", "documents", "doc_edges", "bridge_edges", "parser_results")


@q(" union all ".join(f"select '{t}' as table_name, count(*) as n_rows from {t}" for t in COUNTED))
def table_counts(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for t in COUNTED:
        one = table(spark, d, t).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


@q("select source, sum(ceil(length(text) / 4.0)::bigint)::bigint as tokens, round(sum(ceil(length(text) / 4.0)::bigint) * case when source = 'readme' then 0.000003 when source = 'wiki' then 0.000001 else 0.000002 end, 6)::double as cost from documents group by source")
def cost_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Token cost by a small price table; names without a price take the default."""
    prices = spark.createDataFrame([("readme", 3e-6), ("wiki", 1e-6)], "name string, price double")
    sums = table(spark, d, "documents").groupBy("source").agg(F.sum(T.estimated_tokens(F.col("text"))).alias("tokens"))
    return sums.join(F.broadcast(prices), F.col("source") == F.col("name"), "left").select("source", "tokens", F.round(F.col("tokens") * F.coalesce("price", F.lit(2e-6)), 6).alias("cost"))


@q("select repo, snapshot_no, sum(size)::bigint as bytes, max(modified_at) as newest from files group by repo, snapshot_no")
def repo_sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").groupBy("repo", "snapshot_no").agg(F.sum("size").alias("bytes"), F.max("modified_at").alias("newest"))


@q("select repo, max(modified_at) > timestamp '2025-04-10' as stale from files group by repo")
def index_freshness(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").groupBy("repo").agg((F.max("modified_at") > F.lit("2025-04-10").cast("timestamp_ntz")).alias("stale"))


@q("""select case when p.h is null then 'new' when p.h = n.h then 'unchanged' else 'updated' end as status, count(*) as n from
      (select path, max(lower(hash)) as h from files where snapshot_no = 107 group by path) n left join (select path, max(lower(hash)) as h from files where snapshot_no = 105 group by path) p on p.path = n.path group by 1""")
def plan_status(spark: SparkSession, d: str) -> DataFrame:
    """Items of a run against a cache by content hash: new, updated or unchanged."""
    files = table(spark, d, "files").select("snapshot_no", "path", F.lower("hash").alias("h"))
    before, last = last_runs(spark, d)
    now = files.where(F.col("snapshot_no") == last).groupBy("path").agg(F.max("h").alias("h"))
    old = files.where(F.col("snapshot_no") == before).groupBy("path").agg(F.max("h").alias("old"))
    status = F.when(F.col("old").isNull(), "new").when(F.col("old") == F.col("h"), "unchanged").otherwise("updated")
    return now.join(old, "path", "left").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@q("select confidence.method as method, case when s >= 95 then 'exact' when s >= 80 then 'high' when s >= 60 then 'medium' when s >= 35 then 'low' when s >= 1 then 'weak' else 'unresolved' end as band, count(*) as n from (select confidence, case when confidence.score::varchar = 'nan' then 0 else floor(least(greatest(confidence.score, 0), 100)) end as s from calls) group by 1, 2")
def confidence_bands(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "calls").groupBy(F.col("confidence.method").alias("method"), T.confidence_label(F.col("confidence.score")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@q("select name, count(*) as n from (select callee_text as name from calls union all select string_split(callee_text, '::')[-1] from calls where callee_text like '%::%' union all select string_split(resolved_symbol, '::')[-1] from calls where resolved_symbol like '%::%') group by name")
def used_names(spark: SparkSession, d: str) -> DataFrame:
    return _used(spark, d).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def _used(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "calls")
    tail = lambda c: calls.where(F.contains(c, F.lit("::"))).select(F.element_at(F.split(c, "::"), -1).alias("name"))
    return calls.select(F.col("callee_text").alias("name")).unionByName(tail("callee_text")).unionByName(tail("resolved_symbol"))


MENTIONS = "select object_text as name, file, line from calls where object_text is not null union all select trait_or_interface, file, line from type_impls union all select imported_name, file, line from imports where imported_name is not null"


@q(f"""with used as (select callee_text as name from calls union select string_split(callee_text, '::')[-1] from calls where callee_text like '%::%' union select string_split(resolved_symbol, '::')[-1] from calls where resolved_symbol like '%::%'),
       m as ({MENTIONS}) select id, file, name, line_start, case when exported then 75 else 90 end as confidence from symbols s
       where not is_test and lower(name) not in ('main', 'init', 'setup', 'teardown', '__init__', 'new', 'default') and name not in (select name from used where name is not null)
       and not exists (select 1 from m where m.name = s.name and (m.file <> s.file or m.line <> s.line_start))""")
def dead_symbols(spark: SparkSession, d: str) -> DataFrame:
    mentions = (
        table(spark, d, "calls").where("object_text is not null").select(F.col("object_text").alias("name"), "file", "line")
        .unionByName(table(spark, d, "type_impls").select(F.col("trait_or_interface").alias("name"), "file", "line"))
        .unionByName(table(spark, d, "imports").where("imported_name is not null").select(F.col("imported_name").alias("name"), "file", "line"))
    )
    return graph.dead_symbols(table(spark, d, "symbols"), _used(spark, d), mentions)


# Filters and point reads


@q("select id, name, file from symbols where (contains(lower(file), 'src/') or contains(lower(name), 'parse')) and lower(kind) = 'function' and lower(language) = 'rust' and exported and not is_test order by id limit 100")
def symbol_filter(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "symbols")
    keep = (F.contains(F.lower("file"), F.lit("src/")) | F.contains(F.lower("name"), F.lit("parse"))) & (F.lower("kind") == "function") & (F.lower("language") == "rust") & F.col("exported") & ~F.col("is_test")
    return s.where(keep).select("id", "name", "file").orderBy("id").limit(100)


@q("select id, file, source, confidence.score as score from imports where contains(file, '/src/') and trim(resolved_file) <> '' and confidence.score >= 90")
def file_imports(spark: SparkSession, d: str) -> DataFrame:
    keep = F.contains("file", F.lit("/src/")) & there("resolved_file") & (F.col("confidence.score") >= 90)
    return table(spark, d, "imports").where(keep).select("id", "file", "source", F.col("confidence.score").alias("score"))


@q("""select * from (select id, file, source, case when confidence.score::varchar in ('nan', 'inf', '-inf') then 0.0 else least(greatest(confidence.score, 0.0), 100.0) end as score from imports
      where contains(file, '/src/') and trim(resolved_file) <> '') where score >= 90""")
def file_imports_normal(spark: SparkSession, d: str) -> DataFrame:
    """As ``file_imports``, with scores brought within 0 to 100; what is no finite number counts as 0 and is not let through."""
    rows = table(spark, d, "imports").where(F.contains("file", F.lit("/src/")) & there("resolved_file"))
    return rows.select("id", "file", "source", T.normal_score(F.col("confidence.score")).alias("score")).where("score >= 90")


@q("select distinct * from (select 'out' as direction, id from calls where contains(caller_symbol, 'parse') union all select 'in', id from calls where callee_text = 'get')")
def calls_from_to(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "calls")
    out = c.where(F.contains("caller_symbol", F.lit("parse"))).select(F.lit("out").alias("direction"), "id")
    return out.unionByName(c.where("callee_text = 'get'").select(F.lit("in").alias("direction"), "id")).distinct()


@q("select distinct file from imports where contains(source, 'quill')")
def direct_importers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "imports").where(F.contains("source", F.lit("quill"))).select("file").distinct()


@q("select id from type_impls where contains(implementing_type, 'Vault') or contains(trait_or_interface, 'Vault')")
def types_by_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "type_impls").where(F.contains("implementing_type", F.lit("Vault")) | F.contains("trait_or_interface", F.lit("Vault"))).select("id")


@q("select doc_id, path from documents where list_contains(tags, 'music')")
def docs_by_tag(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.array_contains("tags", "music")).select("doc_id", "path")


@q("select file, name, kind, line_start from symbols where file = (select min(file) from symbols) order by line_start")
def symbols_of_file(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "symbols")
    return s.where(F.col("file") == s.agg(F.min("file")).scalar()).select("file", "name", "kind", "line_start").orderBy("line_start")


@q("select id, name from symbols where lower(name) like '%key\\_%' escape '\\'")
def like_search(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "symbols").where(F.contains(F.lower("name"), F.lit("key_"))).select("id", "name")


@q("select s.id as symbol_id, count(distinct c.id) as n_calls from symbols s join calls c on c.resolved_symbol = s.file || '::' || s.name group by s.id")
def calls_to_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Calls that resolve to a symbol's id or to its key: two equi joins instead of an or."""
    s = table(spark, d, "symbols").select(F.col("id").alias("symbol_id"), F.concat("file", F.lit("::"), "name").alias("key")).distinct()
    c = table(spark, d, "calls").select("id", "resolved_symbol").where("resolved_symbol is not null").distinct()
    by_key = c.join(s, F.col("resolved_symbol") == F.col("key")).select("symbol_id", "id")
    by_id = c.join(s, F.col("resolved_symbol") == F.col("symbol_id")).select("symbol_id", "id")
    return by_key.unionByName(by_id).distinct().groupBy("symbol_id").agg(F.count(F.lit(1)).alias("n_calls"))


@q("select path, snapshot_no from files where regexp_matches(path, '/src/.*\\.(rs|py)$') and not regexp_matches(path, '(^|/)(vendor|third_party)/') and lower(language) in ('rust', 'python')")
def file_filter(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.scan import glob_regex

    keep = F.col("path").rlike(glob_regex(["**/src/**/*.rs", "**/src/**/*.py", "**/src/*.rs", "**/src/*.py"])) & ~F.col("path").rlike(glob_regex(["**/vendor/**", "**/third_party/**"])) & F.lower("language").isin("rust", "python")
    return table(spark, d, "files").where(keep).select("path", "snapshot_no")


@q("select id, name, file, line_start from (select *, row_number() over (partition by file order by line_start, id) as k, count(*) over (partition by file) as n from (select distinct id, name, file, line_start from symbols)) where k <= 3")
def symbols_capped(spark: SparkSession, d: str) -> DataFrame:
    """At most three symbols per file, in order: a cap that is the feature."""
    s = table(spark, d, "symbols").select("id", "name", "file", "line_start").distinct()
    return s.selectExpr("*", "row_number() over (partition by file order by line_start, id) as k").where("k <= 3").drop("k")


# Resolution

FIRST = "row_number() over (partition by {0} order by {1}) = 1"


@q("""with here as (select distinct file, name, file || '::' || name as key from symbols), any_ as (select name, min(file || '::' || name) as key from symbols group by name),
      b as (select * from imports where local_name is not null and trim(resolved_file) <> '' qualify row_number() over (partition by file, local_name order by line, id) = 1),
      one as (select distinct id, file, callee_text, object_text from calls)
      select c.id, coalesce(h.key, i2.key, a.key, o2.key, l.key) as target, case when h.key is not null then 98.0 when i2.key is not null then 95.0 when a.key is not null then 40.0 when o2.key is not null then 95.0 when l.key is not null then 98.0 else 0.0 end::double as score
      from one c left join here h on h.file = c.file and h.name = c.callee_text left join b i on i.file = c.file and i.local_name = c.callee_text
      left join here i2 on i2.file = i.resolved_file and i2.name = coalesce(i.imported_name, i.local_name) left join any_ a on a.name = c.callee_text
      left join b o on o.file = c.file and o.local_name = c.object_text left join here o2 on o2.file = o.resolved_file and o2.name = c.callee_text
      left join here l on l.file = c.file and l.name = c.object_text""")
def call_cascade(spark: SparkSession, d: str) -> DataFrame:
    return resolve.call_targets(table(spark, d, "calls"), table(spark, d, "imports"), table(spark, d, "symbols"))


def _enclosing_sql(order: str) -> str:
    return f"""with one as (select id, any_value(file) as file, any_value(line) as line from calls group by id), hit as (select c.id, s.file || '::' || s.name as e, s.line_start, s.line_end, s.id as sid from one c join symbols s on s.file = c.file and c.line between s.line_start and s.line_end)
      select one.id, h.e as enclosing from one left join (select * from hit qualify row_number() over (partition by id order by {order}) = 1) h on h.id = one.id"""


@q(_enclosing_sql("line_start, sid, e"))
def enclosing_symbol(spark: SparkSession, d: str) -> DataFrame:
    return resolve.enclosing(table(spark, d, "calls"), table(spark, d, "symbols"))


@q(_enclosing_sql("line_end - line_start, line_start, sid, e"))
def innermost_symbol(spark: SparkSession, d: str) -> DataFrame:
    return resolve.enclosing(table(spark, d, "calls"), table(spark, d, "symbols"), innermost=True)


@q("""with f as (select distinct name, file from symbols), u as (select name, min(file) as file from f group by name having count(*) = 1)
      select c.id, coalesce(o.file, u.file) as handler_file from (select distinct id, file, callee_text from calls) c left join f o on o.name = c.callee_text and o.file = c.file left join u on u.name = c.callee_text""")
def route_handlers(spark: SparkSession, d: str) -> DataFrame:
    """Handlers to files, with calls in the part of routes."""
    routes = table(spark, d, "calls").select("id", "file", F.col("callee_text").alias("handler")).distinct()
    return resolve.unique_handlers(routes, table(spark, d, "symbols"))


KINDS = "list_position(['implements', 'trait_impl', 'derive', 'extends', 'c_sharp_inheritance', 'cpp_inheritance'], kind)"


@q(f"select file, implementing_type, trait_or_interface, kind, line, id from type_impls qualify row_number() over (partition by file, implementing_type, trait_or_interface order by {KINDS} desc, line, id) = 1")
def type_relations(spark: SparkSession, d: str) -> DataFrame:
    return resolve.distinct_relations(table(spark, d, "type_impls"))


@q("select trait_or_interface, implementing_type, file, line, id from type_impls qualify row_number() over (partition by trait_or_interface, implementing_type order by file, line, id) = 1")
def di_bindings(spark: SparkSession, d: str) -> DataFrame:
    """First binding of contract and implementation, with type relations in the part of bindings."""
    rows = table(spark, d, "type_impls").select("trait_or_interface", "implementing_type", "file", "line", "id")
    return resolve.distinct_bindings(rows, ["trait_or_interface", "implementing_type"])


EDGES = """select file as from_id, resolved_file as to_id, 'IMPORTS' as edge_type from imports where trim(resolved_file) <> '' and resolved_file in (select path from files)
      union select file || '::' || name, file, 'DEFINED_IN' from symbols union select file, resolved_symbol, 'CALLS' from calls where trim(resolved_symbol) <> ''
      union select implementing_type, trait_or_interface, case when kind = 'extends' then 'EXTENDS' else 'IMPLEMENTS' end from type_impls"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return resolve.code_edges(*[table(spark, d, t) for t in ("imports", "symbols", "calls", "type_impls", "files")])


@q(EDGES)
def code_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)


@q(f"with e as ({EDGES}), n as (select path as x from files where snapshot_no = 107) select e.* from e where from_id in (select x from n) and to_id in (select x from n)")
def edges_retained(spark: SparkSession, d: str) -> DataFrame:
    """Edges with both ends among the files of the last run."""
    kept = table(spark, d, "files").where(F.col("snapshot_no") == last_runs(spark, d)[1]).select(F.col("path").alias("x")).distinct()
    e = _edges(spark, d)
    return e.join(kept, e.from_id == kept.x, "left_semi").join(kept, e.to_id == kept.x, "left_semi")


@q()
def import_targets(spark: SparkSession, d: str) -> DataFrame:
    return resolve.import_targets(table(spark, d, "imports"), table(spark, d, "files"))


# Graph

CALL_EDGES = "select distinct caller_symbol as src, resolved_symbol as dst from calls where caller_symbol is not null and trim(resolved_symbol) <> ''"


@q(CALL_EDGES)
def call_graph(spark: SparkSession, d: str) -> DataFrame:
    return graph.call_edges(table(spark, d, "calls"))


def _bfs(src: str, dst: str, start: str, depth: int) -> str:
    return f"""with recursive e as ({CALL_EDGES}), s as ({start}), w(node, depth) as (select node, 0 from s union select e.{dst}, w.depth + 1 from w join e on e.{src} = w.node where w.depth < {depth})
      select node, min(depth)::int as depth from w where node not in (select node from s) group by node"""


START = "select distinct resolved_symbol as node from calls where contains(resolved_symbol, '::parse')"


@q(_bfs("dst", "src", START, 3))
def bfs_callers(spark: SparkSession, d: str) -> DataFrame:
    """Transitive callers, three steps, of all resolved symbols whose name begins with parse."""
    calls = table(spark, d, "calls")
    start = calls.where(F.contains("resolved_symbol", F.lit("::parse"))).select(F.col("resolved_symbol").alias("node"))
    return graph.reach(graph.reverse(graph.call_edges(calls)), start, 3)


@q(_bfs("src", "dst", START, 3))
def bfs_callees(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "calls")
    start = calls.where(F.contains("resolved_symbol", F.lit("::parse"))).select(F.col("resolved_symbol").alias("node"))
    return graph.reach(graph.call_edges(calls), start, 3)


@q(f"select node from ({_bfs('dst', 'src', START, 3)})")
def blast_radius(spark: SparkSession, d: str) -> DataFrame:
    return bfs_callers(spark, d).select("node").distinct()


TYPE_REACH = """with recursive e as (select distinct implementing_type as src, trait_or_interface as dst from type_impls where kind <> 'derive'),
      r(a, b) as (select src, dst from e union select r.a, e.dst from r join e on r.b = e.src), c as (select a from r where a = b)"""


@q(f"{TYPE_REACH} select a as node from c union select x.b from r x join r y on x.b = y.a where x.a in (select a from c) and y.b in (select a from c)")
def cycle_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Types on circles and on ways from one circle to another."""
    links = table(spark, d, "type_impls").where("kind <> 'derive'").select(F.col("implementing_type").alias("src"), F.col("trait_or_interface").alias("dst"))
    return graph.on_cycles(links)


@q(f"{TYPE_REACH} select max(x.b) as circle, x.a as node from r x join r y on x.a = y.b and x.b = y.a group by x.a")
def cycle_list(spark: SparkSession, d: str) -> DataFrame:
    """The circles of types, each under its greatest name, with the types on it."""
    links = table(spark, d, "type_impls").where("kind <> 'derive'").select(F.col("implementing_type").alias("src"), F.col("trait_or_interface").alias("dst"))
    return graph.circles(links)


@q("""with recursive k as (select distinct file || '::' || name as key, file as sf from symbols), h as (select distinct resolved_symbol as src, file as cf from calls where trim(resolved_symbol) <> ''),
      e as (select distinct src, key as dst from h join k on cf = sf), s as (select key as node from k where contains(sf, '/token/')),
      w(node, depth) as (select node, 0 from s union select e.dst, w.depth + 1 from w join e on e.src = w.node where w.depth < 3)
      select node, min(depth)::int as depth from w where node not in (select node from s) group by node""")
def file_impact(spark: SparkSession, d: str) -> DataFrame:
    return graph.impact(table(spark, d, "calls"), table(spark, d, "symbols"), "/token/", 3)


@q("select distinct file, resolved_file from imports where contains(resolved_file, '/token/')")
def impact_importers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "imports").where(F.contains("resolved_file", F.lit("/token/"))).select("file", "resolved_file").distinct()


# Positions


@q("""with one as (select id, any_value(file) as file, any_value(line) as line, any_value(callee_text) as callee_text, any_value(resolved_symbol) as r from calls group by id)
      select one.id, min(s.signature) as hover, min(s.line_start) as definition_line from one left join symbols s on s.file || '::' || s.name = one.r group by one.id""")
def call_definitions(spark: SparkSession, d: str) -> DataFrame:
    """What an editor shows at a call: signature and line of the definition that it resolves to."""
    one = table(spark, d, "calls").select("id", "resolved_symbol").distinct()
    s = table(spark, d, "symbols").groupBy(F.concat("file", F.lit("::"), "name").alias("key")).agg(F.min("signature").alias("hover"), F.min("line_start").alias("definition_line"))
    return one.join(s, F.col("resolved_symbol") == F.col("key"), "left").select("id", "hover", "definition_line")


# Files


@q("select path, lower(regexp_extract(path, '[^/\\\\]\\.([^./\\\\]+)$', 1)) as extension, sha256(text) as hash, strlen(text) as bytes from documents")
def scan_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("path", paths.extension(F.col("path")).alias("extension"), F.sha2("text", 256).alias("hash"), F.octet_length("text").cast("long").alias("bytes"))


@q("""select coalesce(n.path, o.path) as path, case when o.h is null then 'added' when n.h is null then 'deleted' else 'modified' end as status from
      (select path, max(hash) as h from files where snapshot_no = 107 group by path) n full join (select path, max(hash) as h from files where snapshot_no = 105 group by path) o on o.path = n.path where o.h is distinct from n.h""")
def file_diff(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.incremental import file_changes

    f = table(spark, d, "files")
    before, last = last_runs(spark, d)
    return file_changes(f.where(F.col("snapshot_no") == before), f.where(F.col("snapshot_no") == last))


@q("select symbol_id, m from (select id as symbol_id, count(*) as m from symbols group by id) where m > 1")
def repeated_symbols(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "symbols").groupBy(F.col("id").alias("symbol_id")).agg(F.count(F.lit(1)).alias("m")).where("m > 1")


@q("""with recursive items as (select source as g, doc_id, ceil(length(text) / 4.0)::bigint as t, row_number() over (partition by source order by (title is null)::int, ceil(length(text) / 4.0), doc_id) as k from documents where source is not null and text <> ''),
      w(g, k, used, doc_id, t, took) as (select g, 0::bigint, 0::bigint, null::bigint, 0::bigint, false from (select distinct g from items)
        union all select i.g, i.k, case when w.used + i.t <= 2000 then w.used + i.t else w.used end, i.doc_id, i.t, w.used + i.t <= 2000 from w join items i on i.g = w.g and i.k = w.k + 1)
      select g as source, doc_id, t as tokens from w where took union all select source, doc_id, 0 from documents where text = '' and source is not null""")
def context_bounded(spark: SparkSession, d: str) -> DataFrame:
    """For each source, the documents that a budget of 2,000 tokens takes in: titled first, then short."""
    docs = table(spark, d, "documents").withColumn("tokens", T.estimated_tokens(F.col("text")))
    order = [F.col("title").isNull().cast("int"), F.col("tokens"), F.col("doc_id")]
    return budget.greedy_fill(docs, "source", order, "tokens", "doc_id", F.lit(2000))


QUERIES, ORACLE = book.QUERIES, book.ORACLE
