"""Session helpers: a tuned local builder and the shared folder used for stage tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def local_session(cores: int = 8, app: str = "phrasewell") -> SparkSession:
    """Session for tests and the bench; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[[^-]|$)", spark.sparkContext.master):  # local-cluster is a cluster
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    own = spark.sparkContext.getCheckpointDir()
    if own is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="phrasewell-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no earlier run has used."""
    return f"{shared_dir(spark)}/phrasewell/{uuid.uuid4().hex}/{name}"


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage by writing to the shared folder; survives the loss of executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


#: Rows of an Arrow batch. Batches are held whole by Spark and by Python, and texts may be long.
BATCH_ROWS = 500


def short_batches(spark: SparkSession) -> None:
    """Let the session hand over at most ``BATCH_ROWS`` rows at a time to Python, or fewer if it is set so."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


BROADCAST_BYTES = 64_000_000


def fits(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether the values of ``df`` take at most ``max_bytes``, measured by one distributed sum.

    A side is broadcast only if it was measured this way; each caller has another way beyond it.
    """

    def size(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(value), F.lit(0)) + 16
        if isinstance(kind, T.ArrayType):
            if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)):
                each = F.aggregate(value, F.lit(16).cast("bigint"), lambda n, x: n + size(x, kind.elementType))
                return F.coalesce(each, F.lit(16))
            return F.coalesce(F.size(value), F.lit(0)) * 8 + 16
        if isinstance(kind, T.MapType):
            return size(F.map_keys(value), T.ArrayType(kind.keyType)) + size(F.map_values(value), T.ArrayType(kind.valueType))
        if isinstance(kind, T.StructType):
            return sum((size(value[f.name], f.dataType) for f in kind.fields), F.lit(16))
        if isinstance(kind, T.VariantType):
            raise TypeError("the size of a variant cannot be measured")
        return F.lit(8)

    row = sum((size(F.col(f.name), f.dataType) for f in df.schema.fields), F.lit(16))
    return (df.agg(F.sum(row.cast("bigint"))).first()[0] or 0) <= max_bytes
