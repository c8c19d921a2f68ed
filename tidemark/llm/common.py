"""Shared helpers of the training-data operators: scratch tables, inputs, crc splits.

Scratch data goes to the folder the cluster names in ``spark.checkpoint.dir``.
Only where that setting is absent (tests, a laptop) a local folder is chosen.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import small_batches


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder of this session."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and lost executors cost nothing upstream."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._scratch_path = path
    return kept


def drop_scratch(table: DataFrame) -> None:
    """Remove the files of a materialised table that nothing reads any more."""
    _delete(table.sparkSession, table._scratch_path)


def clean_scratch(spark: SparkSession) -> None:
    """Remove all scratch tables of this session's shared folder, once the results that read them are written."""
    _delete(spark, f"{shared_dir(spark)}/tidemark")


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that text operators work on: ``doc_id`` and ``text`` (null becomes empty); any others are left out."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def crc_mod(column: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``: the fold of a row. A null id falls in fold -1."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % mod, F.lit(-1))


def hot_keys(counted: DataFrame, key: str, n: str, most: int = 1024) -> DataFrame:
    """The keys of ``counted`` (one row a key, its rows in ``n``) that hold at least one row in ``most`` of all: at most ``most`` keys, whatever the size of the data."""
    # a join on the key will ask for keys that are not null; asked here as well, both branches share one exchange
    total = counted.filter(F.col(key).isNotNull()).agg(F.sum(n).alias("t_total"))
    return counted.crossJoin(F.broadcast(total)).filter(F.col(n) * most >= F.col("t_total")).select(key)


def join_spread(rows: DataFrame, keyed: DataFrame, key: str, hot: DataFrame, spread_by: list[str], salts: int = 256) -> DataFrame:
    """Inner join of ``rows`` with ``keyed`` on ``key``; rows of a ``hot`` key (see ``hot_keys``) are dealt to ``salts`` tasks by a hash of ``spread_by``.

    Only the hot keys are broadcast, and only their rows of ``keyed`` are copied.
    """
    marked = F.broadcast(hot.withColumn("t_hot", F.lit(True)))
    salt = F.when(F.col("t_hot"), F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    copies = F.when(F.col("t_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    left = rows.join(marked, key, "left").withColumn("t_salt", salt).drop("t_hot")
    right = keyed.join(marked, key, "left").withColumn("t_salt", F.explode(copies)).drop("t_hot")
    return left.join(right, [key, "t_salt"]).drop("t_salt")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
