"""Hand-written, generated, minified, vendored or blob: belief propagation over directory trees.

Every file and directory is a node with one of five labels.  Names and sizes
give evidence at the nodes; compatibilities of parent and child tie them.  The
directories above a file form a tree, so two passes of sum-product messages,
one level at a time from the deepest up and back down, give the marginals.
Siblings speak through their directory.  What the files, and what the
subdirectories, of one directory say together is weighted as ``VOICES`` of them
at most, so that a directory is not taken for generated just because it holds
many generated files beside others.  A directory with a telling name starts a
region of its own: it neither tells its parent anything nor is told.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..session import materialise, release

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")
E = [f"e{i}" for i in range(5)]
VOICES = 1
# parts that the files of a directory are joined with it in
PARTS = 8

# log odds of a telling name against handwritten, and of the root of a repository for it
SURE = 20.0
ROOT = 12.0

# P(child label | parent label), rows and columns in the order of LABELS
DIR_TO_DIR = (
    (0.996, 0.001, 0.001, 0.001, 0.001),
    (0.010, 0.970, 0.005, 0.010, 0.005),
    (0.450, 0.030, 0.500, 0.010, 0.010),
    (0.005, 0.005, 0.005, 0.980, 0.005),
    (0.500, 0.010, 0.010, 0.010, 0.470),
)
DIR_TO_FILE = (
    (0.860, 0.050, 0.040, 0.020, 0.030),
    (0.100, 0.850, 0.030, 0.010, 0.010),
    (0.450, 0.030, 0.500, 0.010, 0.010),
    (0.020, 0.020, 0.020, 0.930, 0.010),
    (0.500, 0.010, 0.010, 0.010, 0.470),
)

# fixed values: directory names in common use for copies of other projects
VENDOR_DIRS = (
    "vendor", "_vendor", "third_party", "third-party", "thirdparty", "3rdparty", "3rd_party", "3rd-party", "external", "externals", "extern", "contrib", "deps", "subprojects", "node_modules",
    "bower_components", "jspm_packages", "site-packages", "dist-packages", "godeps", "pods", "carthage", ".venv", "venv", "virtualenv",
)
# fixed values: directory names in common use for what tools write
GENERATED_DIRS = (
    "generated", "__generated__", "_generated", "autogen", "auto_generated", "generated-sources", "generated-src", "generated_src", "java-gen", "src-gen", "src_gen", "gen-src", "dist", "coverage", "lcov-report",
    "__pycache__", ".next", ".nuxt", ".gradle", "cmakefiles", "deriveddata", "storybook-static", ".svelte-kit", ".parcel-cache",
)
# fixed values: only directly under the root of a repository
GENERATED_ROOTS = ("build", "target", "out", "gen", "obj", "bin", "_build", "output")
# fixed values: file names that tools write
GENERATED_FILES = (
    r"(_pb2|_pb2_grpc|_pb|_grpc_pb)\.[a-z]+$|\.pb(\.gw|\.validate)?\.(go|h|cc|c|cpp|swift|dart|rb)$|\.grpc\.swift$|_grpc\.pb\.go$"
    r"|[._-](generated|autogen|gen|g)\.[a-z]+$|_autogen\.|_generated\.|\.g\.(cs|dart)$|\.g\.i\.cs$|\.freezed\.dart$|\.[dD]esigner\.(cs|vb)$|\.AssemblyInfo\.cs$|\.AssemblyAttributes\.cs$|\.GlobalUsings\.g\.cs$"
    r"|\.d\.ts$|\.(js|css|mjs)\.map(\.json)?$|\.graphql\.(js|ts|tsx)$|\.tab\.(c|h|cc|cpp|hpp)$|^lex\.|\.yy\.(c|h|cc|cpp)$|^(moc|ui|qrc)_[^/]*\.(cpp|h|hpp|cc|py)$"
    r"|^zz_generated[._]|^bindata\.go$|_mock\.gen\.go$|^R\.java$|^BuildConfig\.java$|\.snap$"
)
LOCK_FILES = r"^(package-lock\.json|npm-shrinkwrap\.json|pnpm-lock\.yaml|yarn\.lock|composer\.lock|cargo\.lock|poetry\.lock|pipfile(\.lock)?\.json|pipfile\.lock|gemfile\.lock|go\.sum|podfile\.lock|packages\.lock\.json|project\.assets\.json|mix\.lock|flake\.lock|uv\.lock|pubspec\.lock|gradle\.lockfile)$"
MINIFIED_FILES = r"[.-]min\.(js|css|mjs|cjs|html)$|\.bundle\.(js|css|mjs)$|\.chunk\.([^/]*\.)?(js|css|mjs)$|\.pack(ed)?\.js$|[.-][0-9a-f]{8,20}\.(js|css|mjs)$"
VERSIONED_DIR = r"^[A-Za-z@][\w.@]*-v?[0-9]+(\.[0-9]+)+([.-][\w.]+)?$"

# a file of hand-written text has neither so many bytes nor such long lines
BLOB_BYTES = 600_000
LONG_LINE = 1_500
LEAST_MINIFIED = 2_000


def _vector(*values: Column | float) -> list[Column]:
    return [v if isinstance(v, Column) else F.lit(float(v)) for v in values]


def _log_sum(terms: list[Column]) -> Column:
    top = F.greatest(*terms)
    return top + F.log(reduce(lambda a, b: a + b, [F.exp(t - top) for t in terms]))


def _message_up(belief: list[Column], table) -> list[Column]:
    """What a child tells its parent, for each label of the parent."""
    return [_log_sum([belief[j] + F.log(F.lit(table[i][j])) for j in range(5)]) for i in range(5)]


def _message_down(cavity: list[Column], table) -> list[Column]:
    """What a parent tells its child, for each label of the child."""
    return [_log_sum([cavity[i] + F.log(F.lit(table[i][j])) for i in range(5)]) for j in range(5)]


def file_evidence(path: Column, size: Column, per_line: Column, language: Column) -> list[Column]:
    """Log likelihoods of a file's name, size, bytes per line and language under the five labels."""
    name = F.element_at(F.split(path, "/"), -1)
    size, per_line = F.coalesce(size, F.lit(0)), F.coalesce(per_line, F.lit(0.0))
    long = (per_line > LONG_LINE) & (size > LEAST_MINIFIED)
    huge = size >= BLOB_BYTES
    # told by the suffix, or where that is none of these and a language is given, by that
    script = paths.extension(path).isin("js", "mjs", "cjs", "css", "html", "htm", "jsx") | (~paths.extension(path).rlike("[a-z]") & F.coalesce(language.isin("javascript", "css", "html"), F.lit(False)))
    generated = F.when(name.rlike(GENERATED_FILES) | F.lower(name).rlike(LOCK_FILES), SURE).otherwise(0.0)
    short_min = F.when(name.rlike(MINIFIED_FILES), SURE).when(long & script & ~huge, SURE).when(long, 4.0).otherwise(-4.0)
    # a long line or a huge file of any language but script is data
    blob = F.when(huge | (long & ~script), SURE).otherwise(-6.0)
    return _vector(0.0, generated, short_min, 0.0, blob)


def dir_evidence(path: Column) -> list[Column]:
    """Log likelihoods of a directory's name under the five labels; the root of a repository is plain."""
    parts = F.split(path, "/")
    name, depth = F.lower(F.element_at(parts, -1)), F.size(parts)
    vendored = F.when((depth > 1) & (name.isin(*VENDOR_DIRS) | F.element_at(parts, -1).rlike(VERSIONED_DIR)), SURE).otherwise(0.0)
    written = name.isin(*GENERATED_DIRS) | ((depth == 2) & name.isin(*GENERATED_ROOTS))
    generated = F.when((depth > 1) & written, SURE).otherwise(0.0)
    return _vector(F.when(depth == 1, ROOT).otherwise(0.0), generated, 0.0, vendored, 0.0)


def label_files(files: DataFrame) -> DataFrame:
    """``path, label, p_handwritten`` for every path in ``files(path, size, line_count, language)``; the language may be missing.

    Paths are taken in their shortest spelling and once, with the greatest size,
    bytes per line and language name of their rows; null paths are left out, null
    sizes, line counts and languages say nothing.  An empty table gives no row.  Other columns are
    ignored.
    """
    one = F.greatest(F.coalesce("line_count", F.lit(0)), F.lit(1))
    named = F.lower(F.trim("language")) if "language" in files.columns else F.lit(None).cast("string")
    leaf = (
        files.where(F.col("path").isNotNull())
        .select(paths.shortest(F.col("path")).alias("path"), F.col("size").alias("size"), (F.col("size") / one).alias("per_line"), named.alias("language"))
        .where("path <> ''")
        .groupBy("path")
        .agg(F.max("size").alias("size"), F.max("per_line").alias("per_line"), F.max("language").alias("language"))
    )
    leaf = materialise(leaf.select("path", paths.parent(F.col("path")).alias("dir"), *[v.alias(c) for v, c in zip(file_evidence(F.col("path"), F.col("size"), F.col("per_line"), F.col("language")), E, strict=True)]))
    said = leaf.select("dir", *[v.alias(c) for v, c in zip(_message_up([F.col(c) for c in E], DIR_TO_FILE), E, strict=True)])
    weight = F.least(F.lit(1.0), VOICES / F.count(F.lit(1)))
    from_files = said.groupBy("dir").agg(weight.alias("w"), *[(F.sum(c) * weight).alias(f"f{c}") for c in E])
    name = dir_evidence(F.col("dir"))
    # every directory on the way to the root
    depth = F.size(F.split("dir", "/"))
    chain = F.transform(F.sequence(F.lit(1), depth), lambda k: F.array_join(F.slice(F.split("dir", "/"), F.lit(1), k), "/"))
    dirs = leaf.select("dir").distinct().select(F.explode(chain).alias("dir")).distinct()
    dirs = dirs.join(from_files, "dir", "left").select(
        "dir", paths.parent(F.col("dir")).alias("up"), depth.alias("depth"), F.coalesce("w", F.lit(1.0)).alias("w"), ((name[1] > 0) | (name[3] > 0)).alias("telling"), *[(v + F.coalesce(f"f{c}", F.lit(0.0))).alias(c) for v, c in zip(name, E, strict=True)]
    )
    dirs = materialise(dirs)
    deepest = dirs.agg(F.max("depth")).first()[0] or 0
    levels: dict[int, DataFrame] = {}
    kept = [leaf, dirs]

    def keep(df: DataFrame) -> DataFrame:
        kept.append(materialise(df))
        return kept[-1]

    for k in range(deepest, 0, -1):
        here = dirs.where(F.col("depth") == k)
        if k < deepest:
            told = levels[k + 1].groupBy(F.col("up").alias("dir")).agg(weight.alias("v"), *[(F.sum(f"m{i}") * weight).alias(f"s{i}") for i in range(5)])
            here = here.join(told, "dir", "left").select("dir", "up", "w", "telling", F.coalesce("v", F.lit(1.0)).alias("v"), *[(F.col(E[i]) + F.coalesce(f"s{i}", F.lit(0.0))).alias(E[i]) for i in range(5)])
        else:
            here = here.select("dir", "up", "w", "telling", F.lit(1.0).alias("v"), *E)
        up = _message_up([F.col(c) for c in E], DIR_TO_DIR)
        here = here.select("*", *[F.when(F.col("telling"), 0.0).otherwise(v).alias(f"m{i}") for i, v in enumerate(up)])
        levels[k] = keep(here)
    beliefs: list[DataFrame] = []
    for k in range(1, deepest + 1):
        if k == 1:
            here = levels[1].select("dir", "w", "v", *E)
        else:
            above = beliefs[-1].select(F.col("dir").alias("up"), F.col("v").alias("av"), *[F.col(E[i]).alias(f"a{i}") for i in range(5)])
            down = _message_down([F.col(f"a{i}") - F.col(f"m{i}") * F.col("av") for i in range(5)], DIR_TO_DIR)
            here = levels[k].join(above, "up").select("dir", "w", "v", *[(F.col(E[i]) + F.when(F.col("telling"), 0.0).otherwise(down[i])).alias(E[i]) for i in range(5)])
        beliefs.append(keep(here))
    if not beliefs:
        return leaf.select("path", F.lit(LABELS[0]).alias("label"), F.lit(1.0).alias("p_handwritten"))
    around = reduce(DataFrame.unionByName, beliefs).select("dir", "w", *[F.col(E[i]).alias(f"a{i}") for i in range(5)])
    own = _message_up([F.col(c) for c in E], DIR_TO_FILE)
    down = _message_down([F.col(f"a{i}") - own[i] * F.col("w") for i in range(5)], DIR_TO_FILE)
    # one directory may hold a great part of all files, so each is joined in parts
    parts = around.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    joined = leaf.withColumn("part", F.pmod(F.xxhash64("path"), F.lit(PARTS)).cast("int")).join(parts, ["dir", "part"]).select("path", *[(F.col(E[i]) + down[i]).alias(E[i]) for i in range(5)])
    best = reduce(lambda acc, i: F.when(F.col(E[i]) >= F.greatest(*E), LABELS[i]).otherwise(acc), range(4, -1, -1), F.lit(LABELS[4]))
    out = joined.select("path", best.alias("label"), F.exp(F.col("e0") - _log_sum([F.col(c) for c in E])).alias("p_handwritten"))
    out = materialise(out)
    for df in kept:
        release(df)
    return out
