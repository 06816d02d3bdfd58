"""Session-level helpers: shared storage, materialisation, spreading, global ranks."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import vellumine

# Python functions travel with their code, so executors needn't have the package installed.
cloudpickle.register_pickle_by_value(vellumine)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, read from the session.

    Only where that is unset (tests, local mode) a temporary folder of this machine is made.
    """
    got = spark.conf.get("spark.checkpoint.dir", None)
    if got:
        return got
    sc = spark.sparkContext
    got = sc._jsc.sc().getCheckpointDir()
    if got.isDefined():
        return got.get()
    if not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    made = tempfile.mkdtemp(prefix="vellumine-")
    sc.setCheckpointDir(made)
    return sc._jsc.sc().getCheckpointDir().get()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone at exit
        pass


#: Tables stored since the outermost ``stored_result`` began; None outside of one.
_OPEN: ContextVar[list[Stored] | None] = ContextVar("open_tables", default=None)


class Stored:
    """A DataFrame written to the shared folder as Parquet: lineage ends there."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark).rstrip('/')}/t-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        self.gone = False
        atexit.register(self.drop)
        made = _OPEN.get()
        if made is not None:
            made.append(self)

    def drop(self) -> None:
        """Free the space once nothing reads the table any more."""
        if not self.gone:
            self.gone = True
            atexit.unregister(self.drop)
            _remove(self.spark, self.path)


def materialise(df: DataFrame) -> DataFrame:
    """Write once to the shared folder, survive the loss of any executor, read back."""
    return Stored(df).df


def stored_result(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A query whose result is stored, after which all tables stored on the way are removed."""

    @wraps(query)
    def run(*args: object, **named: object) -> DataFrame:
        mark, keep = _OPEN.set([]), None
        try:
            out = query(*args, **named)
            if _OPEN.get():
                keep = Stored(out)
                out = keep.df
        finally:
            for table in _OPEN.get():
                if table is not keep:
                    table.drop()
            _OPEN.reset(mark)
        outer = _OPEN.get()
        if keep is not None and outer is not None:
            outer.append(keep)
        return out

    return run


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a CPU-bound Python stage enough tasks when the input has only a few splits.

    A large input already has more splits than cores and isn't shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(3 * cores, *keys)


def global_index(df: DataFrame, order: list, name: str = "idx") -> DataFrame:
    """Add a dense 0-based rank over ``order`` without a single-task window.

    Rows are range partitioned and sorted, stored once, and each partition's offset (one number
    a partition) is added.
    """
    spark = df.sparkSession
    raw = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    raw = materialise(raw)
    part = F.shiftright("_mid", 33)
    counts = sorted(
        (r["_p"], r["n"])
        for r in raw.groupBy(part.alias("_p")).agg(F.count("*").alias("n")).collect()
    )
    at, offsets = 0, []
    for p, n in counts:
        offsets.append((int(p), at))
        at += n
    low = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    off = spark.createDataFrame(offsets, "_p long, _off long")
    return (
        raw.withColumn("_p", part)
        .join(F.broadcast(off), "_p")
        .withColumn(name, F.col("_off") + low)
        .drop("_p", "_off", "_mid")
    )
