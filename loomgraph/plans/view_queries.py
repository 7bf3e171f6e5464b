"""Kinds of files, stores, updates, contexts of a file or symbol, search views, and extraction from small texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import incremental, views
from ..operators import search as S
from ..session import new_folder
from ..sources import extract, manifests, scan, stores
from ..sources.tables import last_runs, table
from .book import Book
from .search_queries import sql_score

book = Book()
q = book.query

LANGUAGE_ROWS = ", ".join(f"('{x}', '{g}')" for x, g in scan.LANGUAGES.items())
BINARY_LIST = ", ".join(f"'{x}'" for x in scan.BINARY)
KIND = "case when g is null then 'unknown' when g = 'markdown' then 'docs' when g in ('json', 'yaml', 'toml') then 'config' else 'code' end"
DETECTED = f"select path, x, {KIND} as kind, coalesce(g, 'unknown') as language from (select distinct path, lower(regexp_extract(path, '[^/]\\.([^./]+)$', 1)) as x from files) left join (values {LANGUAGE_ROWS}) m(e, g) on x = e"


def _detected(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return table(spark, d, "files").select("path").distinct().select("path", scan.file_kind(p).alias("kind"), scan.detected_language(p).alias("language"), scan.is_binary(p).alias("is_binary"))


@q(f"select path, kind, language, x in ({BINARY_LIST}) as is_binary from ({DETECTED})")
def file_types(spark: SparkSession, d: str) -> DataFrame:
    """Kind and language of every path by its extension."""
    return _detected(spark, d)


@q(f"select kind, count(*) as n_files from ({DETECTED}) where kind <> 'unknown' group by kind")
def files_by_kind(spark: SparkSession, d: str) -> DataFrame:
    """Documents, code and configuration; unknown files are in none."""
    parts = scan.by_kind(_detected(spark, d))
    return parts["docs"].unionByName(parts["code"]).unionByName(parts["config"]).groupBy("kind").agg(F.count(F.lit(1)).alias("n_files"))


@q("select path, not (regexp_matches(path, '(^|/)\\.git(/|$)') or ends_with(path, '.lock') or starts_with(string_split(path, '/')[-1], '.env') or regexp_matches(path, '^/|(^|/)\\.\\.(/|$)') or size > 10485760) as may_edit from (select path, max(size) as size from files group by path)")
def edit_safety(spark: SparkSession, d: str) -> DataFrame:
    """Whether each file may be read and changed."""
    return table(spark, d, "files").groupBy("path").agg(F.max("size").alias("size")).select("path", views.may_edit(F.col("path"), F.col("size")).alias("may_edit"))


IGNORE = "# built\n\nvendor/\n*.min.js\n/harbor-monorepo/dist\n!keep.min.js\n"


@q("select distinct path, case when regexp_matches(path, '(^|/)keep\\.min\\.js(/|$)') then false else regexp_matches(path, '^harbor-monorepo/dist(/|$)|(^|/)[^/]*\\.min\\.js(/|$)|(^|/)vendor/') end as is_ignored from files")
def ignored_files(spark: SparkSession, d: str) -> DataFrame:
    """Which paths the rules of an ignore file leave out."""
    return table(spark, d, "files").select("path").distinct().select("path", scan.ignored(F.col("path"), IGNORE).alias("is_ignored"))


OWNED = "select distinct path, string_split(path, '/') as p from files"


@q(f"select path, case when len(p) > 2 and p[2] in ('pkg', 'src') then p[1] || '/' || p[2] when len(p) > 1 then p[1] end as root from ({OWNED})")
def project_owners(spark: SparkSession, d: str) -> DataFrame:
    """The innermost project of each path: repositories, and ``pkg`` and ``src`` directly below them."""
    files = table(spark, d, "files").select("path").distinct()
    return manifests.owners(files, _projects(files))


def _projects(files: DataFrame) -> DataFrame:
    p = F.split("path", "/")
    repos = files.where(F.size(p) > 1).select(p[0].alias("root"))
    return repos.unionByName(files.where((F.size(p) > 2) & p[1].isin("pkg", "src")).select(F.concat(p[0], F.lit("/"), p[1]).alias("root"))).distinct()


@q(f"select root, n_languages from (select case when len(p) > 2 and p[2] in ('pkg', 'src') then p[1] || '/' || p[2] when len(p) > 1 then p[1] end as root, count(distinct language) as n_languages from (select distinct path, string_split(path, '/') as p, language from files) group by 1) where root is not null")
def project_languages(spark: SparkSession, d: str) -> DataFrame:
    """Languages of each project's files."""
    files = table(spark, d, "files").select("path", "language").distinct()
    return manifests.languages_by_project(files, _projects(files.select("path"))).select("root", F.size("languages").cast("long").alias("n_languages"))


# Updates and stores; the runs come from the data

LAST = "(select max(snapshot_no) from files)"
BEFORE = f"(select max(snapshot_no) from files where snapshot_no < {LAST})"


@q(f"select id from symbols where snapshot_no < {LAST} and (file || '::' || name) not in (select file || '::' || name from symbols where snapshot_no = {LAST}) union all select id from symbols where snapshot_no = {LAST}")
def symbols_upserted(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of earlier runs, those of the last run in the place of equal keys."""
    _, last = last_runs(spark, d)
    s = table(spark, d, "symbols").select("id", "file", "name", "snapshot_no")
    return incremental.upsert(s.where(F.col("snapshot_no") < last), s.where(F.col("snapshot_no") == last), ["file", "name"]).select("id")


GONE = f"select path from files where snapshot_no = {BEFORE} except select path from files where snapshot_no = {LAST}"


@q(f"select id from symbols where file not in ({GONE})")
def symbols_kept(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of files that the last run has not lost."""
    before, last = last_runs(spark, d)
    f = table(spark, d, "files")
    gone = incremental.file_changes(f.where(F.col("snapshot_no") == before), f.where(F.col("snapshot_no") == last)).where("status = 'deleted'")
    return incremental.without_files(table(spark, d, "symbols"), gone).select("id")


HASHES = f"select path, max(hash) filter (snapshot_no = {BEFORE}) as a, max(hash) filter (snapshot_no = {LAST}) as b from files where snapshot_no in ({BEFORE}, {LAST}) group by path"


@q(f"with c as (select path, b from ({HASHES}) where a is distinct from b) select id from symbols where snapshot_no < {LAST} and file not in (select path from c) union all select id from symbols where file in (select path from c where b is not null)")
def facts_merged(spark: SparkSession, d: str) -> DataFrame:
    """Symbols after an update: those of changed and deleted files go, those of changed and added ones come anew."""
    before, last = last_runs(spark, d)
    f = table(spark, d, "files")
    changes = incremental.file_changes(f.where(F.col("snapshot_no") == before), f.where(F.col("snapshot_no") == last))
    s = table(spark, d, "symbols").select("id", "file", "snapshot_no")
    return incremental.merge_facts(s.where(F.col("snapshot_no") < last), s, changes).select("id")


@q(f"select doc_id from documents where snapshot_no < {LAST} and path not in (select path from documents where snapshot_no = {LAST}) union all select doc_id from documents where snapshot_no = {LAST}")
def documents_merged(spark: SparkSession, d: str) -> DataFrame:
    """Documents of earlier runs, those of the last run in the place of equal paths; backlinks are left as they are."""
    _, last = last_runs(spark, d)
    docs = table(spark, d, "documents").select("doc_id", "path", "snapshot_no")
    return incremental.upsert(docs.where(F.col("snapshot_no") < last), docs.where(F.col("snapshot_no") == last), ["path"]).select("doc_id")


@q("select snapshot_no, count(*) as n_rows, count(distinct path) as n_paths from files group by snapshot_no")
def run_history(spark: SparkSession, d: str) -> DataFrame:
    """Delivered runs, newest first."""
    return views.history(table(spark, d, "files"))


@q("select edge_type, count(*) as n, count(distinct from_id) as n_from from doc_edges group by edge_type")
def snapshot_restored(spark: SparkSession, d: str) -> DataFrame:
    """Edges of documents after a version was written and read with its checksums."""
    folder = new_folder(spark)
    incremental.write_snapshot(table(spark, d, "doc_edges"), folder, "v1")
    return incremental.read_snapshot(spark, folder, "v1").groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("from_id").alias("n_from"))


@q("select 'type_impls' as collection, kind, count(*) as n, count(distinct id) as n_ids from type_impls group by kind union all select 'symbols', kind, count(*), count(distinct id) from symbols group by kind")
def graph_reloaded(spark: SparkSession, d: str) -> DataFrame:
    """A graph saved as JSON and loaded again; a collection never saved is empty."""
    folder = new_folder(spark)
    parts = {t: table(spark, d, t) for t in ("type_impls", "symbols")}
    stores.save_graph(parts, folder)
    schemas = {t: df.schema for t, df in parts.items()} | {"routes": parts["symbols"].schema}
    got = [df.select(F.lit(t).alias("collection"), "kind", "id") for t, df in stores.load_graph(spark, folder, schemas).items()]
    return got[0].unionByName(got[1]).unionByName(got[2]).groupBy("collection", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_ids"))


@q("select * from (values ('schema', '2'), ('tool', 'y'), ('last_run', '107')) t(key, value)")
def metadata_set(spark: SparkSession, d: str) -> DataFrame:
    """Keys and values after two updates of a small store."""
    stored = stores.set_metadata(views.empty_like(spark, "key string, value string"), {"schema": "1", "tool": "x"})
    return stores.set_metadata(stored, {"schema": "2", "tool": "y", "last_run": "107"})


@q("select (select count(*) from documents) as documents, 0::bigint as symbols, 0::bigint as imports")
def code_cleared(spark: SparkSession, d: str) -> DataFrame:
    """Rows left after all facts about code are taken out, documents kept."""
    kept = stores.cleared({t: table(spark, d, t) for t in ("documents", "symbols", "imports")}, {"documents"})
    rows = [df.agg(F.count(F.lit(1)).alias(t)) for t, df in kept.items()]
    return rows[0].crossJoin(rows[1]).crossJoin(rows[2])


COUNTED = {"symbols": "symbols", "imports": "imports", "calls": "calls", "type_impls": "type_impls", "doc_edges": "doc_edges", "bridge_edges": "bridge_edges"}


@q("select " + ", ".join(f"(select count(distinct id) from {t}) as {n}" for n, t in COUNTED.items()))
def export_stats(spark: SparkSession, d: str) -> DataFrame:
    """How many facts of each kind an export holds, each id once."""
    return views.counted({n: table(spark, d, t).select("id") for n, t in COUNTED.items()})


@q(f"select (select count(distinct path) from files where snapshot_no = {LAST}) as files, (select count(distinct id) from symbols where removed_in is null) as symbols, (select count(distinct node_id) from documents where removed_in is null) as documents")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    """What is there after the last run."""
    _, last = last_runs(spark, d)
    there = {
        "files": table(spark, d, "files").where(F.col("snapshot_no") == last).select(F.col("path").alias("id")),
        "symbols": table(spark, d, "symbols").where("removed_in is null").select("id"),
        "documents": table(spark, d, "documents").where("removed_in is null").select(F.col("node_id").alias("id")),
    }
    return views.counted(there)


@q("select collection, count(*) as n, count(distinct fact) as n_different from (select 'type_impls' as collection, to_json(t) as fact from type_impls t union all select 'doc_labels', to_json(l) from doc_labels l) group by collection")
def agent_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of an export as JSON, counted."""
    facts = stores.agent_export({"type_impls": table(spark, d, "type_impls"), "doc_labels": table(spark, d, "doc_labels")})
    return facts.groupBy("collection").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("fact").alias("n_different"))


# Point reads, contexts and pruning


@q("select file, requested_backend, used_backend from parser_results where file = (select min(file) from parser_results)")
def parser_result_of(spark: SparkSession, d: str) -> DataFrame:
    """What parsers said of one file."""
    p = table(spark, d, "parser_results")
    return p.where(F.col("file") == p.agg(F.min("file")).first()[0]).select("file", "requested_backend", "used_backend")


@q("select file, used_backend from parser_results where file in (select file from calls)")
def parser_results_retained(spark: SparkSession, d: str) -> DataFrame:
    """Reports on files that have calls."""
    return views.retained(table(spark, d, "parser_results"), "file", table(spark, d, "calls")).select("file", "used_backend")


@q("select * from (select 'outgoing' as direction, id from calls where contains(caller_symbol, 'parse') order by id limit 30) union all select * from (select 'incoming', id from calls where callee_text = 'parse' or ends_with(resolved_symbol, '::parse') order by id limit 30)")
def calls_capped(spark: SparkSession, d: str) -> DataFrame:
    """Calls from and to a name, each capped at ten for each of three levels."""
    c = table(spark, d, "calls")
    out = c.where(F.contains("caller_symbol", F.lit("parse"))).select(F.lit("outgoing").alias("direction"), "id").orderBy("id").limit(30)
    into = c.where((F.col("callee_text") == "parse") | F.endswith("resolved_symbol", F.lit("::parse"))).select(F.lit("incoming").alias("direction"), "id").orderBy("id").limit(30)
    return out.unionByName(into)


@q("select distinct resolved_symbol as callee from calls where contains(file, '/core/') and trim(resolved_symbol) <> ''")
def impact_callees(spark: SparkSession, d: str) -> DataFrame:
    """Symbols that files of a part of the tree call."""
    return table(spark, d, "calls").where(F.contains("file", F.lit("/core/")) & (F.trim("resolved_symbol") != "")).select(F.col("resolved_symbol").alias("callee")).distinct()


FILE = "(select max(file) from calls)"


def _facts(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {t: table(spark, d, t) for t in ("symbols", "imports", "calls", "type_impls", "bridge_edges")}


@q(f"""select 'symbol' as kind, id as item from symbols where file = {FILE} union select 'import', id from imports where file = {FILE} union select 'call', id from calls where file = {FILE}
      union select 'type_impl', id from type_impls where file = {FILE} union select 'importer', file from imports where resolved_file = {FILE}
      union select 'doc', from_id from bridge_edges where to_id = {FILE} or starts_with(to_id, {FILE} || '::')""")
def file_context(spark: SparkSession, d: str) -> DataFrame:
    """All that concerns one file."""
    facts = _facts(spark, d)
    return views.file_context(facts["calls"].agg(F.max("file")).first()[0], facts)


KEY = "(select max(resolved_symbol) from calls where contains(resolved_symbol, '::'))"
NAME = f"regexp_extract({KEY}, '^(.*)::(.*)$', 2)"


@q(f"""select 'definition' as kind, id as item from symbols where file = regexp_extract({KEY}, '^(.*)::(.*)$', 1) and name = {NAME}
      union select 'caller', coalesce(caller_symbol, file) from calls where resolved_symbol = {KEY} union select 'callee', coalesce(resolved_symbol, callee_text) from calls where caller_symbol = {KEY}
      union select 'type_impl', id from type_impls where implementing_type = {NAME} or trait_or_interface = {NAME} union select 'doc', from_id from bridge_edges where to_id = {KEY}""")
def symbol_context(spark: SparkSession, d: str) -> DataFrame:
    """All that concerns one symbol."""
    facts = _facts(spark, d)
    return views.symbol_context(facts["calls"].where("contains(resolved_symbol, '::')").agg(F.max("resolved_symbol")).first()[0], facts)


SCORE = "case when confidence.score::varchar in ('nan', 'inf', '-inf') then 0.0 else least(greatest(confidence.score, 0.0), 100.0) end"


@q(f"""select kind, id, score from (
        select 0 as turn, 'import' as kind, id, max({SCORE}) as score from imports where contains(file, '/src/') and {SCORE} >= 60 group by id
        union all select 1, 'call', id, max({SCORE}) from calls where contains(file, '/src/') and {SCORE} >= 60 group by id
        union all select 2, 'bridge', id, max({SCORE}) from bridge_edges where contains(to_id, '/src/') and {SCORE} >= 60 group by id) order by turn, score desc, id limit 400""")
def context_pruned(spark: SparkSession, d: str) -> DataFrame:
    """Edges of allowed files with a confidence of 60 or more, within one budget that imports, calls and bridge share in this order."""
    kinds = [("import", table(spark, d, "imports"), "file"), ("call", table(spark, d, "calls"), "file"), ("bridge", table(spark, d, "bridge_edges"), "to_id")]
    return views.pruned_edges(kinds, F.contains("file", F.lit("/src/")), 60.0, 400)


@q("select id, file || '#s' || (row_number() over (partition by file order by line_start, name, id, signature) - 1) as fact_id from (select distinct id, file, line_start, name, signature from symbols)")
def symbol_ordinals(spark: SparkSession, d: str) -> DataFrame:
    """Ids of symbols by their place in the file."""
    rows = table(spark, d, "symbols").select("id", "file", "line_start", "name", "signature").distinct()
    return views.with_ordinals(rows, "file", "line_start", ["name", "id", "signature"], "s").select("id", "fact_id")


# Views of search results


@q(f"select id, max(s)::double as score from (select id, greatest({sql_score('name', 'parse token')}, {sql_score('signature', 'parse token')}) as s from symbols where contains(file, '/src/')) where s >= 0.5 group by id order by score desc, id limit 20")
def search_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Results in a part of the tree with a least score, the best twenty."""
    some = table(spark, d, "symbols").where(F.contains("file", F.lit("/src/")))
    scored = some.select("id", F.greatest(T.keyword_score(F.col("name"), "parse token"), T.keyword_score(F.col("signature"), "parse token")).alias("score")).where("score >= 0.5")
    return S.best_of(scored, "id").orderBy(F.desc("score"), "id").limit(20)


@q(f"select file, count(*) as n_hits, max(s)::double as best from (select file, {sql_score('name', 'parse token')} as s from symbols) where s > 0 group by file")
def search_by_file(spark: SparkSession, d: str) -> DataFrame:
    """Results under their files."""
    return views.scored_by_file(table(spark, d, "symbols").select("file", T.keyword_score(F.col("name"), "parse token").alias("score")).where("score > 0"))


@q(f"""select project, id, score from (select project, id, max(s)::double as score from (select string_split(file, '/')[1] as project, id, {sql_score('name', 'parse token')} as s from symbols) where s > 0 group by project, id)
      qualify row_number() over (partition by project order by score desc, id) <= 5""")
def search_workspaces(spark: SparkSession, d: str) -> DataFrame:
    """The five best results of every repository."""
    scored = table(spark, d, "symbols").select("id", "file", T.keyword_score(F.col("name"), "parse token").alias("score")).where("score > 0")
    return views.best_per_project(scored, F.split("file", "/")[0], "id", 5)


# Extraction, manifests and differences of texts: no table holds such texts, so small ones are given here

SOURCES = [
    ("web/users.py", "python", "from fastapi import FastAPI\n@app.get('/users')\ndef users(): pass"),
    ("web/many.py", "python", "import flask\n@app.route('/u', methods=['POST', 'PUT'])\ndef u(): pass"),
    ("srv/main.rs", "rust", 'use axum::Router;\nimpl<T> Repo<T> for Users<T> where T: X {}\nlet a = Router::new().route("/u", get(list).post(add));'),
    ("srv/main.go", "go", 'import "github.com/gin-gonic/gin"\nfunc main() { r := gin.Default(); r.GET("/u", auth, users) }'),
    ("app/cats.ts", "typescript", "import {Get} from '@nestjs/common';\n@Controller('cats')\nclass C extends B<T> implements D {\n @Get('all')\n all() {}\n}"),
    ("app/Api.cs", "csharp", 'services.AddScoped<IUser, User>(); services.AddSingleton<Log>();\napp.MapGet("/users", GetUsers);'),
    ("lib/A.java", "java", "public class A extends B implements C, D { }"),
    ("lib/none.py", "python", None),
]


def _extracted(spark: SparkSession) -> DataFrame:
    return extract.extract(spark.createDataFrame(SOURCES, "path string, language string, text string"))


@q("""select * from (values ('web/users.py', 'users', '/users', 'GET'), ('web/many.py', 'u', '/u', 'POST'), ('web/many.py', 'u', '/u', 'PUT'), ('srv/main.rs', 'list', '/u', 'GET'), ('srv/main.rs', 'add', '/u', 'POST'),
      ('srv/main.go', 'users', '/u', 'GET'), ('app/cats.ts', 'all', '/cats/all', 'GET'), ('app/Api.cs', 'GetUsers', '/users', 'GET')) t(file, handler, path, verb)""")
def extracted_routes(spark: SparkSession, d: str) -> DataFrame:
    """Routes of small texts in several languages and frameworks."""
    return _extracted(spark).where("fact = 'route'").select("file", F.col("name").alias("handler"), F.col("target").alias("path"), F.col("detail")["method"].alias("verb"))


@q("select * from (values ('web/many.py', 'u', '/u'), ('web/many.py', 'u', '/u'), ('web/users.py', 'users', '/users')) t(file, handler, path)")
def routes_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Routes of one language, whatever its letter case, the first hundred."""
    hits = _extracted(spark).where((F.col("fact") == "route") & (F.lower("language") == "Python".lower()))
    return hits.select("file", F.col("name").alias("handler"), F.col("target").alias("path")).orderBy("file", "handler", "path").limit(100)


@q("select * from (values ('srv/main.rs', 'Users', 'Repo'), ('app/cats.ts', 'C', 'B'), ('app/cats.ts', 'C', 'D'), ('lib/A.java', 'A', 'B'), ('lib/A.java', 'A', 'C'), ('lib/A.java', 'A', 'D')) t(file, type_name, parent)")
def extracted_relations(spark: SparkSession, d: str) -> DataFrame:
    """Type relations of small texts."""
    return _extracted(spark).where("fact = 'type_impl'").select("file", F.col("name").alias("type_name"), F.col("target").alias("parent"))


@q("select * from (values ('app/Api.cs', 'IUser', 'User', 'scoped'), ('app/Api.cs', 'Log', 'Log', 'singleton')) t(file, service, implementation, lifetime)")
def extracted_bindings(spark: SparkSession, d: str) -> DataFrame:
    """Bindings of small texts."""
    return _extracted(spark).where("fact = 'di'").select("file", F.col("name").alias("service"), F.col("target").alias("implementation"), F.col("detail")["lifetime"].alias("lifetime"))


MANIFESTS = [
    ("web/package.json", '{"dependencies": {"react": "^18"}, "devDependencies": {"vite": "5"}}'),
    ("svc/go.mod", "module x\nrequire github.com/gin-gonic/gin v1.9.1\n"),
    ("py/requirements.txt", "flask>=2.0\n# none\nnumpy==1.26\n"),
    ("core/Cargo.toml", '[dependencies]\nserde = "1"\n[dev-dependencies]\ntempfile = "3"\n'),
    ("core/broken/package.json", "{"),
    ("core/notes.txt", "serde"),
]


@q("""select * from (values ('web/package.json', 'react', '^18', 'runtime'), ('web/package.json', 'vite', '5', 'dev'), ('svc/go.mod', 'github.com/gin-gonic/gin', 'v1.9.1', 'runtime'), ('py/requirements.txt', 'flask', '2.0', 'runtime'),
      ('py/requirements.txt', 'numpy', '1.26', 'runtime'), ('core/Cargo.toml', 'serde', '1', 'runtime'), ('core/Cargo.toml', 'tempfile', '3', 'dev')) t(source, name, version, kind)""")
def manifest_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """What small manifests list; one that does not parse lists nothing."""
    return manifests.dependencies(spark.createDataFrame(MANIFESTS, "path string, text string"))


@q("select * from (values (1, 2, 1, 2, 1, 'b', 'x'), (2, 2, 0, 2, 1, '', 'b'), (3, 1, 0, 1, 1, '', 'q')) t(k, old_start, old_lines, new_start, new_lines, removed, added)")
def text_hunks(spark: SparkSession, d: str) -> DataFrame:
    """Hunks between small texts."""
    pairs = spark.createDataFrame([(1, "a\nb\nc", "a\nx\nc"), (2, "a", "a\nb"), (3, None, "q"), (4, "same", "same")], "k int, old_text string, new_text string")
    return incremental.text_diff(pairs, "k").withColumns({"removed": F.array_join("removed", "\n"), "added": F.array_join("added", "\n")})


QUERIES, ORACLE = book.QUERIES, book.ORACLE
