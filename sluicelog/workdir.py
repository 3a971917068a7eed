"""Written tables that cut lineage, in the folder all executors share."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the setting is missing a local master gets a temporary folder; a
    cluster without it is refused, since no machine-local folder would do.
    """
    root = spark.conf.get(_SETTING, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{_SETTING} must name a folder that all executors share")
    own = spark.sparkContext.applicationId
    if own not in _OWN:
        _OWN[own] = "file://" + tempfile.mkdtemp(prefix="sluicelog-")
    return _OWN[own]


def temporary(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what lies there is removed when the driver's JVM ends, or by ``release``."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _system(spark, path).deleteOnExit(_path(spark, path))
    return path


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at ``path``."""
    return _system(spark, path).exists(_path(spark, path))


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The rows survive the loss of any executor, later plans start from the
    files, and nondeterministic ids stay as written.
    """
    spark = df.sparkSession
    path = temporary(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(table: DataFrame) -> None:
    """Remove the files of a ``materialize``d table that nothing will read any more."""
    spark = table.sparkSession
    for path in {x.rsplit("/", 1)[0] for x in table.inputFiles()}:
        _system(spark, path).delete(_path(spark, path), True)
