"""Session helpers shared by every operator: reading tables and cutting lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application.

    Workers on other machines, or started from another folder, could not import it else.
    """
    context = spark.sparkContext
    if getattr(context, "_cueloom_shipped", False):
        return
    root = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="cueloom-")) / "cueloom.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(target))
    context._cueloom_shipped = True


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; column pruning and filters reach the scan."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_session(app: str = "cueloom", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings that the operators expect of a cluster."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    ship_package(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir), or a temporary one
    where the session names none, as in local tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="cueloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def cut_dir(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables."""
    return f"{shared_dir(spark)}/cueloom-{spark.sparkContext.applicationId}"


def drop_cuts(spark: SparkSession) -> None:
    """Removes the intermediate tables of this application; frames read from them end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cut_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """The frame, written once to the shared folder and read back.

    For results used more than once: the work is done once, the files outlive a lost
    executor, and the lineage ends there.
    """
    spark = df.sparkSession
    path = f"{cut_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
