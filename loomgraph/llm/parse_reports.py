"""Source files that do not parse, told from the reports of their parsers.

The collection holds no file texts, only what parsers said about them, so the
statements of a report are what is parsed here.  There are four grammars of
statements: remarks on valid text and troubles of a backend, truncation, unfinished
merges, and text of another language.  Each is a set of productions, and a
production accepts a statement that has all of its words, in any order and with
any others between.  Grammars are ranked by how many of a statement's words are
theirs, and all are tried; the one ranked first of those that accept it names the
statement.  What none accepts is damage if it carries an error code or words of
rejection.  A language that a statement names is held against that of the file:
text that is, or reads like, the file's own language is not foreign.
``source_grammars`` does the same for texts where they are at hand.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths

# fixed values: the productions of each grammar of statements, as the words that all must be there
GRAMMARS = {
    "remark": (
        "row inside doc comment", "contains kept as text", "import never used", "longer than columns", "without trailing newline", "hints truncated", "suffix read by project setting", "attribute obsolete", "no syntax lost", "node kept tree complete", "tree complete", "comments not parsed",
        "deprecated still accepted", "folding information skipped", "nesting deeper", "dialect flag accepted there", "larger than limit accepted", "time budget not rejected", "no parser for", "quota reached before", "disabled by configuration", "worker was restarted", "not recorded by", "unexpected shutdown", "serialize",
    ),
    "truncated": (
        "ends inside", "end inside", "ended inside", "premature", "unexpected end of", "end of input", "no more input", "is cut at", "cut off", "stops in the middle", "statement stops", "never terminated", "has no end before", "remain open", "very end of the text", "rest of the file", "tree incomplete",
    ),
    "conflict": (
        "<<<<<<<", "=======", ">>>>>>>", "|||||||", "unmerged", "unresolved merge", "both sides of conflict", "alternatives of one hunk", "versions of the same", "second copy breaks", "shift operator without operands",
    ),
    "foreign": (
        "suffix content disagree", "belongs to no grammar", "0 of lines accepted", "lines rejected from first", "source is text under suffix", "content reads like", "cannot begin module", "object found where declarations", "not accepted by this grammar", "no rule of this language", "opens no token",
        "root node error", "shebang names another", "unexpected def",
    ),
}
WORD = r"[a-z]+|\b0\b|<{7}|={7}|>{7}|[|]{7}"
# a language that the text is said to be in
NAMED = r"reads like ([a-z+#]+)|source is ([a-z+#]+) text"
ERROR_CODE = r"^(e\d+|error|parseerror|syntaxerror|unexpected\w*|unterminated\w*|unbalanced\w*|missing\w*|invalid\w*|incomplete|languagemismatch|duplicateitem)$"
REJECTION = r"\b(unexpected|unterminated|unclosed|invalid|rejected|malformed|missing|cannot parse|syntax error|not valid)\b"
ALIASES = {"rs": "rust", "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "golang": "go", "c#": "csharp", "c++": "cpp", "kt": "kotlin"}

MESSAGE = r'"message"\s*:\s*"((?:[^"\\]|\\.)*)"?'
CODE = r'"code"\s*:\s*"((?:[^"\\]|\\.)*)"'
PLAIN = r'"\d+:\d+: ((?:[^"\\]|\\.)*)"?'


def statements(reason: Column, diagnostics: Column) -> Column:
    """Array of ``code, text`` structs in lower case.

    Diagnostics may be a list of objects, one object, a list of strings or
    broken off; what can be read of them is.  Nulls and blanks give none.
    """
    d = F.coalesce(diagnostics, F.lit(""))
    codes = F.regexp_extract_all(d, F.lit(CODE), F.lit(1))
    texts = F.regexp_extract_all(d, F.lit(MESSAGE), F.lit(1))

    def pair(text: Column, k: Column) -> Column:
        return F.struct(F.lower(F.coalesce(F.get(codes, k), F.lit(""))).alias("code"), F.lower(text).alias("text"))

    plain = F.transform(F.regexp_extract_all(d, F.lit(PLAIN), F.lit(1)), lambda t: F.struct(F.lit("").alias("code"), F.lower(t).alias("text")))
    first = F.when(F.trim(F.coalesce(reason, F.lit(""))) != "", F.array(F.struct(F.lit("").alias("code"), F.lower(reason).alias("text")))).otherwise(F.array().cast("array<struct<code:string,text:string>>"))
    return F.concat(first, F.transform(texts, pair), plain)


def worded(statement: Column) -> Column:
    """A statement with its words and the language it names, if any, so that these are taken out of the text but once."""
    text = statement["text"]
    named = F.coalesce(*[F.nullif(F.regexp_extract(text, NAMED, k), F.lit("")) for k in (1, 2)])
    return F.struct(statement["code"].alias("code"), text.alias("text"), F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).alias("words"), F.when(named.isNotNull(), language(named)).alias("named"))


def verdict(statement: Column, own: Column | None = None) -> Column:
    """``conflict``, ``foreign``, ``truncated``, ``corrupt`` or null for a harmless one, of a ``worded`` statement on a file in language ``own``."""
    text, code, words = statement["text"], statement["code"], statement["words"]
    tried = []
    for order, (family, productions) in enumerate(GRAMMARS.items()):
        theirs = F.array(*[F.lit(w) for w in sorted({w for p in productions for w in p.split()})])
        accepts = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.array_contains(words, w) for w in p.split()]) for p in productions])
        if family == "foreign" and own is not None:
            # a statement that names none says nothing about the file's own
            accepts = accepts & ~F.coalesce(statement["named"] == own, F.lit(False))
        tried.append(F.when(accepts, F.struct(F.size(F.array_intersect(words, theirs)).alias("rank"), F.lit(-order).alias("order"), F.lit(family).alias("family"))))
    known = F.array_max(F.array(*tried))["family"]
    unknown = F.when(code.rlike(ERROR_CODE) | text.rlike(REJECTION), "corrupt")
    return F.when(known.isNull(), unknown).when(known != "remark", known)


def latest_runs(results: DataFrame) -> DataFrame:
    """The latest row of each file by ``parsed_at``, then ``loaded_at``; paths in their shortest spelling.

    Rows without a file are left out; a missing time comes before any other.
    Rows equal in both times are ordered by their content, so the result does
    not depend on the order of rows.
    """
    row = F.struct("parsed_at", "loaded_at", F.coalesce("fallback_reason", F.lit("")).alias("reason"), F.coalesce("diagnostics_json", F.lit("")).alias("diagnostics"), F.coalesce("used_backend", F.lit("")).alias("used_backend"))
    return results.where("file is not null").select(paths.shortest(F.col("file")).alias("file"), row.alias("row")).groupBy("file").agg(F.max("row").alias("row")).select("file", "row.*")


def language(name: Column) -> Column:
    """A language's usual name: lower case, common aliases resolved; blank and null are ``unknown``."""
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    pairs = [F.lit(x) for kv in ALIASES.items() for x in kv]
    return F.when(low == "", "unknown").otherwise(F.coalesce(F.create_map(*pairs)[low], low))


def languages(files: DataFrame) -> DataFrame:
    """``file, language`` of each path by its latest snapshot; of several rows in it the greatest name counts."""
    named = files.where("path is not null").select(paths.shortest(F.col("path")).alias("file"), F.struct("snapshot_no", language(F.col("language")).alias("language")).alias("l"))
    return named.groupBy("file").agg(F.max("l").alias("l")).select("file", F.col("l.language").alias("language"))


def judge(results: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """``file, language, used_backend, damage`` for every file; damage is null where the text is valid.

    Without ``files``, and for files in no snapshot, the language is ``unknown``.
    """
    latest = latest_runs(results)
    known = latest.join(languages(files), "file", "left") if files is not None else latest.withColumn("language", F.lit(None).cast("string"))
    known = known.withColumn("language", F.coalesce("language", F.lit("unknown")))
    said = F.transform(statements(F.col("reason"), F.col("diagnostics")), worded)
    found = F.filter(F.transform(said, lambda x: verdict(x, F.col("language"))), lambda v: v.isNotNull())
    order = ("foreign", "conflict", "truncated", "corrupt")
    damage = reduce(lambda acc, k: acc.when(F.array_contains("found", k), k), order[1:], F.when(F.array_contains("found", order[0]), order[0]))
    return known.select("file", "language", "used_backend", found.alias("found")).select("file", "language", "used_backend", damage.alias("damage"))


def damage_rates(results: DataFrame, files: DataFrame) -> DataFrame:
    """Per repository and language: files reported on, damaged ones by kind, and the damaged share.

    The language of a file is that of its latest snapshot; files in no
    snapshot count under ``unknown``.
    """
    joined = judge(results, files).select(F.element_at(F.split("file", "/"), 1).alias("repo"), "language", "damage")
    kinds = [F.count_if(F.col("damage") == k).alias(f"n_{k}") for k in ("truncated", "conflict", "foreign", "corrupt")]
    out = joined.groupBy("repo", "language").agg(F.count(F.lit(1)).alias("n_files"), F.count("damage").alias("n_damaged"), *kinds)
    return out.withColumn("damaged_share", F.round(F.col("n_damaged") / F.col("n_files"), 6))


def damage_by_backend(results: DataFrame, files: DataFrame) -> DataFrame:
    """Per backend that was used: files reported on, damaged ones, and the damaged share; a null backend is ``(none)``."""
    out = judge(results, files).groupBy(F.coalesce("used_backend", F.lit("(none)")).alias("used_backend")).agg(F.count(F.lit(1)).alias("n_files"), F.count("damage").alias("n_damaged"))
    return out.withColumn("damaged_share", F.round(F.col("n_damaged") / F.col("n_files"), 6))
