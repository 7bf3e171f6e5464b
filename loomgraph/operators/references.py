"""References to records that do not exist.

A Bloom filter over the parents' keys proves most orphans without a join; only
references it lets through are joined exactly.  The filter is made by one
aggregation inside the query and handed to the tasks as a scalar.  Its size
follows the number of different parent keys.  The driver holds a scalar several
times over for each scan that tests it: in the plan, in the generated code and
in the serialised tasks.  So parents and references are written out first, which
leaves one scan, and a filter of more than ``filter_bits`` is made in parts by the
hash of the key, where each part's references meet only their part's filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column as ClassicColumn
from pyspark.sql.internal import InternalFunction

from ..session import materialise, materialise_all, release

MAX_FILTER_BITS = 256 * 1024 * 1024
BITS_PER_KEY = 10
#: One filter may take this fraction of the driver's heap, as the scan that tests it holds it several times over; set by hand.
HEAP_SHARE = 64


def driver_heap(spark) -> int:
    """Bytes that the driver's heap may grow to."""
    return spark._jvm.java.lang.Runtime.getRuntime().maxMemory()


def filter_bits(spark) -> int:
    """The most bits of one filter: ``MAX_FILTER_BITS``, less where the driver's heap is small."""
    return max(1, min(MAX_FILTER_BITS, driver_heap(spark) * 8 // HEAP_SHARE))


def bloom_filter(hashes: DataFrame, n_keys: int) -> Column:
    """A scalar column with the filter over the column ``h``."""
    bits = max(1024, n_keys * BITS_PER_KEY)
    # the aggregate cuts to these session settings, whose defaults are lower than our own bound
    conf = hashes.sparkSession.conf
    for name, least in (("spark.sql.optimizer.runtime.bloomFilter.maxNumBits", bits), ("spark.sql.optimizer.runtime.bloomFilter.maxNumItems", n_keys)):
        if int(conf.get(name)) < least:
            conf.set(name, str(least))
    made = InternalFunction._invoke_internal_function_over_columns("bloom_filter_agg", F.col("h"), F.lit(max(1, n_keys)).cast("long"), F.lit(bits).cast("long"))
    return hashes.select("h").agg(made.alias("filter")).scalar()


def might_contain(spark, made: Column, hashed: Column) -> Column:
    """Whether ``hashed`` may be in the filter; false is proof that it is not."""
    utils = spark._jvm.org.apache.spark.sql.classic.ExpressionUtils
    test = spark._jvm.org.apache.spark.sql.catalyst.expressions.BloomFilterMightContain(utils.expression(made._jc), utils.expression(hashed._jc))
    return F.coalesce(ClassicColumn(utils.column(test)), F.lit(False))


def orphans(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Rows of ``refs`` without a parent in their run.

    ``refs`` has ``kind, key, run`` and any other columns; ``parents`` has
    ``kind, key, first_run, end_run``: a parent is there from ``first_run`` up
    to, but not in, ``end_run`` (null: still there).  Rows of ``refs`` with a
    null or blank key, or a null run, refer to nothing and are no orphans.
    A hot key is no trouble: the anti join streams the references and AQE may
    split their side.
    """
    spark = refs.sparkSession
    real = refs.where(F.col("key").isNotNull() & (F.trim("key") != "") & F.col("run").isNotNull())
    there = parents.where(F.col("key").isNotNull() & F.col("first_run").isNotNull()).select("kind", "key", "first_run", "end_run")
    hashed = F.xxhash64("kind", "key")

    def exact(some: DataFrame) -> DataFrame:
        r, p = some.alias("r"), there.alias("p")
        same = (F.col("r.kind") == F.col("p.kind")) & (F.col("r.key") == F.col("p.key"))
        lives = (F.col("p.first_run") <= F.col("r.run")) & (F.col("p.end_run").isNull() | (F.col("r.run") < F.col("p.end_run")))
        return r.join(p, same & lives, "left_anti")

    there = materialise(there.withColumn("h", hashed))
    # different keys, not deliveries; the count only sizes the filter
    n_keys = there.agg(F.approx_count_distinct("h", 0.02)).first()[0]
    parts = min(max(1, n_keys), -(-max(1, n_keys) * BITS_PER_KEY // filter_bits(spark)))
    part = F.pmod(F.xxhash64("kind", "key", F.lit(5)), F.lit(parts)).cast("int").alias("__part")
    keys = materialise_all([there.select("h", part)], "__part") if parts > 1 else there.withColumn("__part", F.lit(0))
    asked = materialise_all([real.select("*", part)], "__part")

    def tested():
        for k in range(parts):
            made = bloom_filter(keys.where(F.col("__part") == k), -(-n_keys // parts))
            yield asked.where(F.col("__part") == k).drop("__part").withColumn("__maybe", might_contain(spark, made, hashed))

    known = materialise_all(tested(), "__maybe")
    if parts > 1:
        release(keys)
    release(asked)
    return known.where("not __maybe").drop("__maybe").unionByName(exact(known.where("__maybe").drop("__maybe")))
