"""Search over the texts of documents, symbols and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import search as S
from ..sources.tables import table
from .book import Book

book = Book()
q = book.query
LINES = "select doc_id, unnest(string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\\n$', ''), chr(10))) as content, unnest(range(1, len(string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\\n$', ''), chr(10))) + 1)) as line from documents"


def doc_lines(spark: SparkSession, d: str) -> DataFrame:
    return S.line_table(table(spark, d, "documents"), "doc_id", "text")


@q(f"select doc_id, line::int as line, content from ({LINES}) where contains(lower(content), 'queue')")
def find_literal(spark: SparkSession, d: str) -> DataFrame:
    return S.find_literal(doc_lines(spark, d), "queue")


@q(f"select doc_id, line::int as line, content from ({LINES}) where list_contains(regexp_split_to_array(content, '[^\\p{{L}}\\p{{N}}_]+'), 'cache')")
def find_word(spark: SparkSession, d: str) -> DataFrame:
    return S.find_literal(doc_lines(spark, d), "cache", whole_word=True)


@q(f"select doc_id, line::int as line, content, unnest(range(0, len(m)))::int as match_no, unnest(m) as match_text from (select *, regexp_extract_all(content, '[a-z]+_[a-z]+') as m from ({LINES})) where len(m) > 0")
def regex_search(spark: SparkSession, d: str) -> DataFrame:
    return S.find_regex(doc_lines(spark, d), "[a-z]+_[a-z]+")


@q(f"select doc_id, line::int as line, content, (strlen(substr(content, 1, (p - 1)::int)) + 1)::int as byte_column from (select *, unnest(range(1, length(content) + 1)) as p from ({LINES}) where contains(content, 'ee')) where substr(content, p::int, 2) = 'ee'")
def find_overlapping(spark: SparkSession, d: str) -> DataFrame:
    return S.overlapping(S.find_literal(doc_lines(spark, d), "ee", ignore_case=False), "ee")


@q(f"select doc_id, line::int as line, content as before, replace(content, 'cache', 'store') as after from ({LINES}) where contains(content, 'cache')")
def replace_literal(spark: SparkSession, d: str) -> DataFrame:
    return S.replace_preview(doc_lines(spark, d), "cache", "store")


@q(f"select * from (select doc_id, line::int as line, content as before, regexp_replace(content, '([a-z]+)_([a-z]+)', '\\2_\\1', 'g') as after from ({LINES})) where before <> after")
def replace_regex(spark: SparkSession, d: str) -> DataFrame:
    return S.replace_preview(doc_lines(spark, d), "([a-z]+)_([a-z]+)", "$2_$1", literal=False)


@q(f"with l as ({LINES}) select doc_id, sha256(string_agg(replace(content, 'cache', 'store'), chr(10) order by line)) as hash from l group by doc_id")
def replace_applied(spark: SparkSession, d: str) -> DataFrame:
    return S.replace_apply(doc_lines(spark, d), "doc_id", "cache", "store").select("doc_id", F.sha2("text", 256).alias("hash"))


@q(f"with l as ({LINES}) select doc_id, line::int as line, content, contains(content, 'queue') as is_hit from l where exists (select 1 from l h where h.doc_id = l.doc_id and contains(h.content, 'queue') and h.line between l.line - 2 and l.line + 2)")
def find_context(spark: SparkSession, d: str) -> DataFrame:
    return S.with_context(doc_lines(spark, d), F.contains("content", F.lit("queue")), "doc_id", 2)


@q("select w as word, count(*) as n, count(distinct doc_id) as n_docs from (select doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9_]+')) as w from documents) where w <> '' group by w")
def word_index(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences and documents of every ASCII word; two steps, so a common word is counted in parallel."""
    each = table(spark, d, "documents").select("doc_id", F.explode(F.split(F.lower("text"), "[^a-z0-9_]+")).alias("word")).where("word <> ''")
    return each.groupBy("word", "doc_id").count().groupBy("word").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("n_docs"))


SCORE = "case when lower({0}) = '{1}' then 1.0 when contains(lower({0}), '{1}') then 0.7 when {2} then 0.5 else 0.0 end"


def sql_score(c: str, query: str) -> str:
    return SCORE.format(c, query, " or ".join(f"contains(lower({c}), '{w}')" for w in query.split()))


@q(f"select id, max(s)::double as score from (select id, greatest({sql_score('name', 'parse token')}, {sql_score('file', 'parse token')}, {sql_score('signature', 'parse token')}) as s from symbols) where s > 0 group by id order by score desc, id limit 50")
def keyword_symbols(spark: SparkSession, d: str) -> DataFrame:
    return S.keyword_search(table(spark, d, "symbols"), "id", [F.col(c) for c in ("name", "file", "signature")], "parse token", 50)


@q(f"select node_id, max(greatest({sql_score('coalesce(title, $$)', 'harbor')}, {sql_score('path', 'harbor')}))::double as score from documents group by node_id having max(greatest({sql_score('coalesce(title, $$)', 'harbor')}, {sql_score('path', 'harbor')})) > 0 order by score desc, node_id limit 50".replace("$$", "''"))
def keyword_documents(spark: SparkSession, d: str) -> DataFrame:
    return S.keyword_search(table(spark, d, "documents"), "node_id", [F.col("title"), F.col("path")], "harbor", 50)


HEADS = f"select node_id, trim(regexp_replace(x, '^\\s*#{{1,6}}', ''), ' ') as h from (select node_id, unnest(string_split(regexp_replace(regexp_replace(text, '\\r?\\n$', ''), '\\r\\n', chr(10), 'g'), chr(10))) as x from documents) where regexp_matches(x, '^\\s*#{{1,6}}[^#]')"


@q(f"select node_id, max(s)::double as score from (select node_id, greatest({sql_score("coalesce(title, '')", 'harbor')}, {sql_score('path', 'harbor')}) as s from documents union all select node_id, {sql_score('h', 'harbor')} from ({HEADS})) where s > 0 group by node_id order by score desc, node_id limit 50")
def keyword_documents_all(spark: SparkSession, d: str) -> DataFrame:
    """As ``keyword_documents``, with the headings of each document."""
    return S.keyword_search(table(spark, d, "documents"), "node_id", [F.col("title"), F.col("path")], "harbor", 50, lists=[F.transform(T.headings(F.col("text")), lambda h: h["text"])])


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return table(spark, d, "embeddings").where("vec_id = 0").first().embedding


VEC = "select vec_id, round(list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)), 6) as score from embeddings"


@q(f"{VEC} order by score desc, vec_id limit 20")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return S.vector_search(table(spark, d, "embeddings"), "vec_id", "embedding", _query_vector(spark, d), 20)


@q(f"""with v as (select *, row_number() over (order by score desc, vec_id) as r from ({VEC} order by score desc, vec_id limit 50)),
  k as (select vec_id, row_number() over (order by vec_id) as r from (select vec_id from embeddings where label = 3 order by vec_id limit 50))
  select vec_id, round(sum(1.0::double / (60 + r)), 8) as score from (select vec_id, r from v union all select vec_id, r from k) group by vec_id order by score desc, vec_id limit 30""")
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    by_label = S.keyword_search(vectors, "vec_id", [F.col("label").cast("string")], "3", 50, 0.7)
    return S.fuse([S.vector_search(vectors, "vec_id", "embedding", _query_vector(spark, d), 50), by_label], "vec_id", 30)


VEC_ALL = "select q.vec_id as query_id, v.vec_id, round(list_cosine_similarity(v.embedding::double[], q.embedding::double[]), 6) as score from embeddings q, embeddings v where q.vec_id % 20 = 0"
TOP_ALL = "select * from ({0}) qualify row_number() over (partition by query_id order by score desc, vec_id) <= {1}"


@q(TOP_ALL.format(VEC_ALL, 20))
def vector_topk_all(spark: SparkSession, d: str) -> DataFrame:
    """The 20 nearest of all vectors to every vector whose id is divisible by 20."""
    vectors = table(spark, d, "embeddings")
    return S.vector_search_all(vectors.where("vec_id % 20 = 0"), vectors, "vec_id", "embedding", 20)


@q(f"""with v as (select query_id, vec_id, row_number() over (partition by query_id order by score desc, vec_id) as r from ({TOP_ALL.format(VEC_ALL, 50)})),
  k as (select vec_id, row_number() over (order by vec_id) as r from (select vec_id from embeddings where label = 3 order by vec_id limit 50)),
  f as (select query_id, vec_id, round(sum(1.0::double / (60 + r)), 8) as score from (select * from v union all select q.vec_id, k.vec_id, k.r from embeddings q, k where q.vec_id % 20 = 0) group by query_id, vec_id)
  {TOP_ALL.format("select * from f", 30)}""")
def hybrid_rrf_all(spark: SparkSession, d: str) -> DataFrame:
    """As ``hybrid_rrf``, for every vector whose id is divisible by 20."""
    vectors = table(spark, d, "embeddings")
    queries = vectors.where("vec_id % 20 = 0")
    by_label = S.keyword_search(vectors, "vec_id", [F.col("label").cast("string")], "3", 50, 0.7)
    each = queries.select(F.col("vec_id").alias("query_id")).crossJoin(F.broadcast(by_label))
    return S.fuse_all([S.vector_search_all(queries, vectors, "vec_id", "embedding", 50), each], "query_id", "vec_id", 30)


@q("select label, max(round(list_sum(embedding::double[]), 4)) as score from embeddings group by label")
def dedupe_best(spark: SparkSession, d: str) -> DataFrame:
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x)
    return S.best_of(table(spark, d, "embeddings").select("label", F.round(total, 4).alias("score")), "label")


@q("select distinct name from symbols where lower(name) like 'parse%'")
def complete_names(spark: SparkSession, d: str) -> DataFrame:
    return S.complete(table(spark, d, "symbols"), "name", "Parse")


ITEM = "kind || ' ' || name || ' in ' || file || ' - ' || signature"


@q(f"select id, {ITEM} as text, sha256({ITEM}) as content_hash from symbols where snapshot_no > 101 and sha256({ITEM}) not in (select sha256({ITEM}) from symbols where snapshot_no = 101)")
def embed_pending(spark: SparkSession, d: str) -> DataFrame:
    """Texts to embed of the symbols that later runs brought and whose content is not stored."""
    items = table(spark, d, "symbols").select("id", "snapshot_no", F.concat_ws("", "kind", F.lit(" "), "name", F.lit(" in "), "file", F.lit(" - "), "signature").alias("text")).withColumn("content_hash", F.sha2("text", 256))
    return S.to_embed(items.where("snapshot_no > 101"), items.where("snapshot_no = 101")).select("id", "text", "content_hash")


@q(f"with h as (select snapshot_no, sha256({ITEM}) as h from symbols) select count(*) as total, count_if(h in (select h from h where snapshot_no = 101))::bigint as skipped, count_if(h not in (select h from h where snapshot_no = 101))::bigint as embedded from h where snapshot_no > 101")
def embed_stats(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "symbols").select("snapshot_no", F.sha2(F.concat_ws("", "kind", F.lit(" "), "name", F.lit(" in "), "file", F.lit(" - "), "signature"), 256).alias("h"))
    known = items.where("snapshot_no = 101").select("h").distinct().withColumn("known", F.lit(True))
    joined = items.where("snapshot_no > 101").join(known, "h", "left")
    return joined.agg(F.count(F.lit(1)).alias("total"), F.count_if("known").alias("skipped"), F.count_if(F.col("known").isNull()).alias("embedded"))


@q("select doc_id, ceil(length(text) / 4.0)::bigint as tokens, (strlen(text) // 4)::bigint as tokens_of_bytes from documents")
def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.estimated_tokens(F.col("text")).alias("tokens"), T.estimated_tokens_of_bytes(F.col("text")).alias("tokens_of_bytes"))


QUERIES, ORACLE = book.QUERIES, book.ORACLE
