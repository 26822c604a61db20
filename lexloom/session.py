"""Session helpers: lineage cutting in the folder that all executors share."""

from __future__ import annotations

import tempfile
import warnings

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in ``spark.checkpoint.dir``; choose one only where none is set.

    A local session gets a temporary folder. A cluster session without the setting gets a folder in
    its warehouse, which must then be shared: a warning says so if its path looks machine-local.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        local = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if not local and (warehouse.startswith("file:") or "://" not in warehouse):
            warnings.warn("spark.checkpoint.dir is not set and the warehouse may be machine-local: name a folder that all executors share", stacklevel=2)
        named = tempfile.mkdtemp(prefix="lexloom-ckpt-") if local else f"{warehouse}/_checkpoints"
    sc.setCheckpointDir(named)


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of executors and has no lineage.

    Files stay until the session drops them: set ``spark.cleaner.referenceTracking.cleanCheckpoints``
    to have them deleted with the last reference to their rows.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: A table of so few bytes may be dealt out by a shuffle.
SMALL_BYTES = 256 << 20


def dealt(df: DataFrame) -> DataFrame:
    """The rows of a small table that lies in fewer files than there are cores, dealt out to all cores; other tables as they are.

    A file of one row group is read by one task, and what is computed from long texts would stay there.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SMALL_BYTES or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
