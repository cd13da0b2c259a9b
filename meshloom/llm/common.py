"""What the text operators share: scratch tables in the cluster's shared folder, connected components."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_FALLBACK = "/tmp/meshloom-checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a local folder if all runs
    in one process (tests); on a cluster an error, as executors would not see each other's files."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not found and (master != "local" and not master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (found or LOCAL_FALLBACK).rstrip("/")


class Scratch:
    """Tables of one run, written to the shared folder.

    A written table cuts lineage: a lost executor costs the tasks of the running stage only. ``drop`` deletes
    tables that nothing reads any more; those that the returned DataFrame reads stay.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.written: set[str] = set()

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        self.written.add(name)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)
            self.written.discard(name)

    def drop_but(self, *kept: str) -> None:
        """Deletes all tables written so far but those whose names begin with one of ``kept``."""
        self.drop(*[n for n in self.written if not n.startswith(kept)])


#: Bits of the bitmap that keeps rows out of a shuffle that surely aren't wanted; it is broadcast: 16 MB at most.
SIEVE_BITS = 26


def sifted(scratch: Scratch, rows: DataFrame, wanted: DataFrame, name: str, key: tuple[str, ...] = ("doc", "t"), inside: bool = True) -> DataFrame:
    """The ``rows`` whose key may be (surely isn't, if not inside) in ``wanted``; a bitmap of bounded size decides, written
    once for each name. Beyond its capacity it only holds back fewer rows."""
    h = F.xxhash64(*key).bitwiseAND(F.lit((1 << SIEVE_BITS) - 1))
    word, bit = F.shiftright(h, 6).cast("int"), h.bitwiseAND(F.lit(63)).cast("int")
    if inside:
        one = F.expr(f"shiftleft(1L, cast(xxhash64({', '.join(key)}) & 63 as int))")
        bits = scratch.write(f"sieve-{name}", wanted.select(word.alias("sieve_word"), one.alias("b")).groupBy("sieve_word").agg(F.bit_or("b").alias("sieve_bits")))
    else:
        bits = scratch.spark.read.schema("sieve_word int, sieve_bits long").parquet(scratch.path(f"sieve-{name}"))
    marked = rows.withColumns({"sieve_word": word, "sieve_bit": bit}).join(F.broadcast(bits), "sieve_word", "left")
    has = F.coalesce(F.expr("shiftrightunsigned(sieve_bits, sieve_bit) & 1 = 1"), F.lit(False))
    return marked.where(has if inside else ~has).drop("sieve_word", "sieve_bit", "sieve_bits")


def as_row(docs: DataFrame):
    """All columns of ``docs`` as one struct ``row``, so that none can clash with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for what is written meanwhile."""
    before = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def few_and_heavy(spark: SparkSession, rows: int):
    """For rows that carry long texts and take long: Arrow batches of at most so many, as thousands would fill a worker's
    memory, and all the shuffle's partitions, as their bytes say little about their work."""
    return settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.adaptive.coalescePartitions.enabled": "false"})


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def connected_components(scratch: Scratch, edges: DataFrame, name: str = "cc", most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of ``edges`` (u, v: long); root is the smallest node reachable.

    Alternates large-star and small-star steps until the edge set stays: each node then hangs on its root. Every
    step pre-aggregates (min per node), and joins written tables, whose hot nodes adaptive execution can split. No
    edge or label reaches the driver; one row of counts a round does.
    """
    now = scratch.write(f"{name}-0", edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for k in range(1, most_rounds + 1):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.write(f"{name}-{k}-low", both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.write(f"{name}-{k}-large", large)
        low2 = scratch.write(f"{name}-{k}-low2", large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = small.unionByName(low2.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        now = scratch.write(f"{name}-{k}", small)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        scratch.drop(f"{name}-{k - 1}", f"{name}-{k}-low", f"{name}-{k}-large", f"{name}-{k}-low2")
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
    raise RuntimeError(f"connected components did not settle within {most_rounds} rounds")
