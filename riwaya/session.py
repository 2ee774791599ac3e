"""Session helpers: a tuned builder for local use and the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, name: str = "riwaya", checkpoints: str | None = None) -> SparkSession:
    """A local session with the settings that the tests and the bench use; ``checkpoints`` as in :func:`ensure_checkpoint_dir`."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if checkpoints:
        builder = builder.config("spark.checkpoint.dir", checkpoints)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession, folder: str | None = None) -> str:
    """The folder for checkpoints, which all executors share.

    The session's ``spark.checkpoint.dir`` wins, then ``folder``. Where neither is
    given, as in tests, a folder beside the session's tables is taken (the
    warehouse is shared by definition) and removed when the application ends.
    """
    sc = spark.sparkContext
    now = sc.getCheckpointDir()
    if now:
        return now
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or folder
    if not at:
        at = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints/{sc.applicationId}"
        path = sc._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    sc.setCheckpointDir(at)
    return sc.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own under the checkpoint folder, for tables and files that a job writes and reads again."""
    unique = spark.sparkContext._jvm.java.util.UUID.randomUUID().toString()
    return f"{ensure_checkpoint_dir(spark)}/{name}-{unique}"


def kept(df: DataFrame, name: str, folders: dict[str, str] | None = None) -> DataFrame:
    """``df``, computed once and read from a folder of its own from now on: compressed and by column, unlike a checkpoint.

    The folder is removed when the application ends; ``folders`` gets it, for :func:`removed` before that.
    """
    at = shared_folder(df.sparkSession, name)
    # values that repeat, as hashes of words, are written once for each file
    df.write.options(**{"compression": "zstd", "parquet.dictionary.page.size": str(8 << 20)}).parquet(at)
    path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    if folders is not None:
        folders[name] = at
    return df.sparkSession.read.schema(df.schema).parquet(at)


def removed(spark: SparkSession, folders: dict[str, str], *names: str) -> None:
    """Delete folders that :func:`kept` made (all where none are named), and let go of shuffle files that nothing uses any more."""
    for name in names or list(folders):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folders.pop(name))
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    spark.sparkContext._jvm.System.gc()
