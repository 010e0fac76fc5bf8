"""Session helpers: reading tables, cutting lineage, building keys."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def reachable(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it.

    That is enough where the folder is on every machine, as in local mode; elsewhere pass the package with --py-files.
    """
    home = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    if home not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (home, env.get("PYTHONPATH", "")) if x)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    reachable(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    The setting is read from the session. Only where it is unset (tests, a laptop) a folder of our own is
    chosen, and only if the master is local: on a cluster a machine-local folder would lose data.
    """
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if known:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(known)
        return known
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="codeloom-checkpoint-")
    sc.setCheckpointDir(own)
    return own


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows are written to the shared folder and survive the loss of an executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settle(df: DataFrame) -> DataFrame:
    """As :func:`materialize`, for loops: the table forgets the order, partitioning and constraints of its plan.

    A checkpoint keeps these, and what joins say of them doubles from round to round, until planning takes longer than
    the work. If the session cannot build a table of plain rows, the checkpoint itself is returned.
    """
    done = materialize(df)
    try:
        rows = done._jdf.queryExecution().toRdd()
        return DataFrame(done.sparkSession._jsparkSession.internalCreateDataFrame(rows, done._jdf.schema(), False), done.sparkSession)
    except (AttributeError, TypeError):  # no classic session
        return done


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, per_slot: int = 3) -> DataFrame:
    """Spread few input splits over all slots before costly work on each row; many splits stay as they are."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= slots:
        return df
    return df.repartition(max(partitions(df.sparkSession), per_slot * slots))


def month_index(ts: Column) -> Column:
    """Months since year 0, an integer period key."""
    return F.year(ts) * 12 + F.month(ts) - 1


def month_label(index: Column) -> Column:
    return F.format_string("%04d-%02d", F.floor(index / 12).cast("int"), (index % 12 + 1).cast("int"))
