"""Document graph, bridge, contexts and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import context, docs, export
from ..sources.tables import last_runs, table
from .book import Book

book = Book()
q = book.query


def _nodes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    documents = table(spark, d, "documents").select("path", "text")
    front = docs.frontmatter(documents, "path", "text")
    return docs.nodes(documents, front), front


LINES = "unnest(string_split(regexp_replace(regexp_replace(text, '\\r?\\n$', ''), '\\r\\n', chr(10), 'g'), chr(10)))"


@q("select doc_id, trim(string_split(x, '|')[1]) as target, case when contains(x, '|') then trim(string_split(x, '|')[-1]) end as alias from (select doc_id, unnest(regexp_extract_all(text, '(?s)\\[\\[(.*?)\\]\\]', 1)) as x from documents)")
def wiki_links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.explode(T.wiki_links(F.col("text"))).alias("x")).select("doc_id", "x.target", "x.alias")


@q("select doc_id, t as tag from (select doc_id, regexp_replace(unnest(regexp_extract_all(text, '(?:^|\\s)#([^\\s#]\\S*)', 1)), '[^\\p{L}\\p{N}_/-]+$', '') as t from documents) where t <> ''")
def inline_tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.explode(T.hash_tags(F.col("text"))).alias("tag"))


@q(f"""select doc_id, length(regexp_extract(x, '^\\s*(#{{1,6}})[^#]', 1))::int as level, trim(regexp_replace(x, '^\\s*#{{1,6}}', ''), ' ') as text from (select doc_id, {LINES} as x from documents)
      where regexp_matches(x, '^\\s*#{{1,6}}[^#]') and trim(regexp_replace(x, '^\\s*#{{1,6}}', ''), ' ') <> ''""")
def headings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.explode(T.headings(F.col("text"))).alias("x")).select("doc_id", "x.level", "x.text")


# runs of brackets become a mark that no link may hold, as a link's opening is not preceded by another
@q("""select doc_id, regexp_extract(x, '^\\[([^\\]]*)\\]', 1) as text, replace(regexp_extract(x, '\\((.*)\\)$', 1), chr(2), '[[') as url
      from (select doc_id, unnest(regexp_extract_all(regexp_replace(text, '\\[{2,}', chr(2), 'g'), '\\[[^\\[\\]\\x02]*\\]\\([^()\\s]+\\)', 0)) as x from documents)""")
def markdown_links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.explode(T.markdown_links(F.col("text"))).alias("x")).select("doc_id", "x.text", "x.url")


@q()
def doc_frontmatter(spark: SparkSession, d: str) -> DataFrame:
    return docs.frontmatter(table(spark, d, "documents"), "path", "text").where("fields is not null").select("path", "title", "tags")


@q()
def doc_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes, _ = _nodes(spark, d)
    return nodes.select("path", "title", "tags", F.size("headings").alias("n_headings"), F.size("wiki_links").alias("n_links"))


@q()
def doc_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return docs.edges(_nodes(spark, d)[0])


BARE = "regexp_replace(regexp_replace({0}, '^doc:', ''), '\\.md$', '')"


@q(f"select distinct {BARE.format('to_id')} as target, {BARE.format('from_id')} as source, title as source_title from doc_edges join documents on {BARE.format('path')} = {BARE.format('from_id')} where edge_type = 'LINKS_TO'")
def backlinks(spark: SparkSession, d: str) -> DataFrame:
    return docs.backlinks(table(spark, d, "doc_edges"), table(spark, d, "documents"))


@q()
def bridge_built(spark: SparkSession, d: str) -> DataFrame:
    """The bridge built anew from the documents, the last run's files and all symbols."""
    nodes, front = _nodes(spark, d)
    _, last = last_runs(spark, d)
    return docs.bridge(nodes, front, table(spark, d, "files").where(F.col("snapshot_no") == last), table(spark, d, "symbols"))


@q("select id, from_id, to_id, edge_type from bridge_edges where to_id not in (select path from files) and to_id not in (select file || '::' || name from symbols)")
def stale_docs(spark: SparkSession, d: str) -> DataFrame:
    return docs.stale(table(spark, d, "bridge_edges"), table(spark, d, "files"), table(spark, d, "symbols")).select("id", "from_id", "to_id", "edge_type")


@q("select id, from_id from bridge_edges where to_id = (select min(to_id) from bridge_edges where to_id like '%.rs') or starts_with(to_id, (select min(to_id) from bridge_edges where to_id like '%.rs') || '::')")
def docs_for_code(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "bridge_edges")
    path = b.where("to_id like '%.rs'").agg(F.min("to_id")).first()[0]
    return docs.docs_for(b, path).select("id", "from_id")


CHANGED = "select path as file from (select path, max(hash) filter (snapshot_no = 105) as a, max(hash) filter (snapshot_no = 107) as b from files group by path) where a is distinct from b and b is not null"


@q(f"""with f as ({CHANGED}), s as (select distinct file || '::' || name as key from symbols where file in (select file from f))
      select 'symbol' as kind, key as item from s union select 'caller', coalesce(caller_symbol, file || ':' || line) from calls where resolved_symbol in (select key from s)
      union select 'import', id from imports where resolved_file in (select file from f) union select 'doc', from_id from bridge_edges where string_split(to_id, '::')[1] in (select file from f)""")
def diff_context(spark: SparkSession, d: str) -> DataFrame:
    """What the changes of the last run affect."""
    from ..operators.incremental import file_changes

    f = table(spark, d, "files")
    before, last = last_runs(spark, d)
    changed = file_changes(f.where(F.col("snapshot_no") == before), f.where(F.col("snapshot_no") == last)).where("status <> 'deleted'")
    return context.affected(changed, *[table(spark, d, t) for t in ("symbols", "calls", "imports", "bridge_edges")])


def _facts(spark: SparkSession, d: str) -> dict:
    return {
        "symbol": (table(spark, d, "symbols"), "id", ["name", "file"]),
        "doc": (table(spark, d, "documents"), "node_id", ["title", "path"]),
        "file": (table(spark, d, "files").select("path", "language").distinct(), "path", ["path"]),
        "type_impl": (table(spark, d, "type_impls"), "id", ["implementing_type", "trait_or_interface"]),
    }


def _hit(kind: str, t: str, key: str, fields: list[str]) -> str:
    rank = lambda f: f"coalesce(case when lower({f}) = 'vault' then 4 when starts_with(lower({f}), 'vault') then 3 when contains(lower({f}), 'vault') then 2 end, -1)"
    text = f"concat_ws(' ', {', '.join(fields)})"
    return f"select '{kind}' as kind, {key} as item, max(greatest(-1, {', '.join(map(rank, fields))})) as priority, min(ceil(length({text}) / 4.0)::bigint) as tokens from {t} group by {key} having max(greatest(-1, {', '.join(map(rank, fields))})) >= 0"


HITS = " union all ".join([_hit("symbol", "symbols", "id", ["name", "file"]), _hit("doc", "documents", "node_id", ["title", "path"]), _hit("file", "files", "path", ["path"]), _hit("type_impl", "type_impls", "id", ["implementing_type", "trait_or_interface"])])


@q(f"select kind, item, priority, tokens from ({HITS})")
def context_candidates(spark: SparkSession, d: str) -> DataFrame:
    return context.candidates(_facts(spark, d), "vault")


@q(f"""with recursive c as (select kind || '|' || item as item, tokens, row_number() over (order by -priority, tokens, kind || '|' || item) as k from ({HITS}) where tokens > 0),
      w(k, used, item, tokens, took) as (select 0::bigint, 0::bigint, ''::varchar, 0::bigint, false union all select c.k, case when used + c.tokens <= 1200 then used + c.tokens else used end, c.item, c.tokens, used + c.tokens <= 1200 from w join c on c.k = w.k + 1)
      select item, tokens from w where took""")
def context_query(spark: SparkSession, d: str) -> DataFrame:
    """The best matches of a question within a budget of 1,200 tokens."""
    return context.bounded(context.candidates(_facts(spark, d), "vault"), 1200)


def _facts_all(spark: SparkSession, d: str) -> dict:
    documents = table(spark, d, "documents").withColumn("tags", F.array_join("tags", "\n"))
    return _facts(spark, d) | {
        "doc": (documents, "node_id", ["title", "path", "tags"]),
        "type_impl": (table(spark, d, "type_impls"), "id", ["implementing_type", "trait_or_interface", "file", "language"]),
        "bridge": (table(spark, d, "bridge_edges"), "id", ["from_id", "to_id"]),
    }


def _code(spark: SparkSession, d: str) -> dict:
    return {"import": (table(spark, d, "imports"), "id", "source", F.lit(0)), "call": (table(spark, d, "calls"), "id", "callee_text", F.col("column_no"))}


def _hit_all(kind: str, t: str, key: str, fields: list[str], most: dict[str, int] | None = None) -> str:
    rank = lambda f: f"case when contains(lower({f}), 'vault') then least({(most or {}).get(f, 4)}, case when lower({f}) = 'vault' then 4 when starts_with(lower({f}), 'vault') then 3 else 2 end) else -1 end"
    return f"select * from (select '{kind}' as kind, {key} as item, max(greatest({', '.join(map(rank, fields))})) as priority, min(ceil(length(concat_ws(' ', {', '.join(fields)})) / 4.0)::bigint) as tokens from {t} group by {key} having max(greatest({', '.join(map(rank, fields))})) >= 0)"


TAGS = "array_to_string(tags, chr(10))"
HITS_ALL = " union all ".join([
    _hit_all("symbol", "symbols", "id", ["name", "file"]), _hit_all("doc", "documents", "node_id", ["title", "path", TAGS], {TAGS: 2}), _hit_all("file", "files", "path", ["path"]),
    _hit_all("type_impl", "type_impls", "id", ["implementing_type", "trait_or_interface", "file", "language"]), _hit_all("bridge", "bridge_edges", "id", ["from_id", "to_id"], {"from_id": 1, "to_id": 1}),
])


def _code_sql(files: str) -> str:
    one = "select {0} as turn, '{1}' as kind, id as item, 0 as priority, min(ceil(length(coalesce({2}, '')) / 4.0)::bigint) as tokens, min(file) as file, min(line) as line, min({3}) as col from {1}s where file in ({4}) group by id"
    return one.format(0, "import", "source", "0", files) + " union all " + one.format(1, "call", "callee_text", "column_no", files)


@q(f"select kind, item, priority, tokens from ({HITS_ALL}) union all select kind, item, priority, tokens from ({_code_sql("select file from symbols where contains(lower(name), 'vault')")})")
def context_candidates_all(spark: SparkSession, d: str) -> DataFrame:
    """All that a question concerns: also bridge edges, tags, and imports and calls in the files of symbols named so."""
    named = table(spark, d, "symbols").where(context.best_match(["name"], "vault") >= 0)
    code = context.of_files(named, _code(spark, d)).select("kind", "item", "priority", "tokens")
    return context.candidates(_facts_all(spark, d), "vault").unionByName(code)


@q(f"""with recursive h as (select kind || '|' || item as item, priority, tokens from ({HITS_ALL})), c as (select item, tokens, row_number() over (order by -priority, tokens, item) as k from h where tokens > 0),
      w(k, used, item, tokens, took) as (select 0::bigint, 0::bigint, ''::varchar, 0::bigint, false union all select c.k, case when used + c.tokens <= 1200 then used + c.tokens else used end, c.item, c.tokens, used + c.tokens <= 1200 from w join c on c.k = w.k + 1),
      one as (select item, tokens from w where took union all select item, tokens from h where tokens = 0), b as (select 1200 - coalesce(sum(tokens), 0)::bigint as n from one),
      r as (select kind || '|' || item as item, tokens, turn, file, line, col from ({_code_sql("select file from symbols where contains(lower(name), 'vault') and 'symbol|' || id in (select item from one)")})),
      e as (select item, tokens, n, row_number() over (order by turn, file, line, col, item) as k from r, b where tokens > 0 and tokens <= n),
      v(k, used, item, tokens, took) as (select 0::bigint, 0::bigint, ''::varchar, 0::bigint, false union all select e.k, case when used + e.tokens <= n then used + e.tokens else used end, e.item, e.tokens, used + e.tokens <= n from v join e on e.k = v.k + 1)
      select item, tokens from one union all select item, tokens from v where took union all select item, tokens from r where tokens = 0""")
def context_query_all(spark: SparkSession, d: str) -> DataFrame:
    """Of all candidates, what 1,200 tokens take in; imports and calls last, of the symbols taken, in source order."""
    return context.bounded_with_code(context.candidates(_facts_all(spark, d), "vault"), table(spark, d, "symbols"), _code(spark, d), "vault", 1200)


def _first(df: DataFrame, key: str) -> DataFrame:
    """Each id once, with the least of its rows, so that every run takes the same."""
    return df.groupBy(key).agg(F.min(F.struct(*df.columns)).alias("__row")).select("__row.*")


@q()
def export_bounded(spark: SparkSession, d: str) -> DataFrame:
    facts = {"symbol": ("symbols", "id"), "import": ("imports", "id"), "call": ("calls", "id"), "type_impl": ("type_impls", "id"), "bridge": ("bridge_edges", "id"), "doc_edge": ("doc_edges", "id")}
    once = {k: (_first(table(spark, d, t), key), key) for k, (t, key) in facts.items()}
    return context.export_bounded(once, 12_000, "collection")


@q("select distinct string_split(to_id, '::')[1] as path from bridge_edges where from_id in (select 'doc:' || path from documents where contains(lower(title), 'beacon') or contains(lower(path), 'beacon'))")
def topic_files(spark: SparkSession, d: str) -> DataFrame:
    return context.topic_files(table(spark, d, "documents"), table(spark, d, "bridge_edges"), "beacon")


SAFE = "translate({0}, '<>&\"''', '')"


@q(f"select distinct {SAFE.format('from_id')} as source, {SAFE.format('to_id')} as target, edge_type as label from doc_edges")
def graph_links(spark: SparkSession, d: str) -> DataFrame:
    return export.links(table(spark, d, "doc_edges"))


@q("select n as id, case when n like 'doc:%' then 'doc' when n like 'tag:%' then 'tag' when n like 'heading:%' then 'heading' else 'code' end as node_type from (select translate(from_id, '<>&\"''', '') as n from doc_edges union select translate(to_id, '<>&\"''', '') from doc_edges)")
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return export.nodes(export.links(table(spark, d, "doc_edges")))


@q("select file || ',' || name || ',' || kind || ',' || line_start as line from symbols")
def export_csv(spark: SparkSession, d: str) -> DataFrame:
    return export.csv_lines(table(spark, d, "symbols"), ["file", "name", "kind", "line_start"])


@q("select user_id, count(*) as n_sessions, max(n) as longest from (select user_id, s, count(*) as n from (select user_id, sum(new_) over (partition by user_id order by ts, event_id rows unbounded preceding) as s from (select user_id, ts, event_id, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 30 minute then 0 else 1 end as new_ from events)) group by user_id, s) group by user_id")
def session_debounce(spark: SparkSession, d: str) -> DataFrame:
    """Events of each user in sessions parted by half an hour of quiet."""
    from ..streaming.watch import sessions

    return sessions(table(spark, d, "events"), "ts", "user_id", "30 minutes").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.max("n_events").alias("longest"))


STILL = "list_filter(w.recent, lambda x: e.t - x < 3600)"


@q(f"""with recursive e as (select user_id, event_id, epoch_us(ts) / 1e6 as t, row_number() over (partition by user_id order by ts, event_id) as k from events where ts is not null and user_id is not null),
      w(user_id, k, event_id, recent, admitted) as (select distinct user_id, 0::bigint, event_id, []::double[], false from e where k = 1
        union all select e.user_id, e.k, e.event_id, case when len({STILL}) < 5 then list_append({STILL}, e.t) else {STILL} end, len({STILL}) < 5 from w join e on e.user_id = w.user_id and e.k = w.k + 1)
      select user_id, event_id, admitted from w where k > 0""")
def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    """Admitted and refused events of each user at five an hour; refused ones do not count."""
    from ..streaming.watch import admit

    return admit(table(spark, d, "events"), "ts", "user_id", "event_id", 5, 3600.0)


QUERIES, ORACLE = book.QUERIES, book.ORACLE
