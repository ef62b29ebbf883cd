"""Session settings and the shared folder in which lineage is cut."""

from __future__ import annotations

import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import palimpsest

# Python workers get the functions of this package with their tasks, so that it need not be installed on executors.
cloudpickle.register_pickle_by_value(palimpsest)

CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(cores: str = "*", shuffle_partitions: int = 8, name: str = "palimpsest") -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read, as the cluster names it.

    A temporary folder is made, and set, only where the setting is absent and all runs in one process (local tests). On
    a cluster an absent setting is an error, since executors would each write to a disk of their own.
    """
    found = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set(CHECKPOINT_DIR, found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that its lineage ends there.

    Unlike a local checkpoint this survives the loss of any executor.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._palimpsest_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete what ``materialize`` wrote for ``df``, once nothing will read it again."""
    path = getattr(df, "_palimpsest_path", None)
    if path:
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder or file, if it is there."""
    fs, at = file_system(spark, path)
    fs.delete(at, True)


def file_system(spark: SparkSession, path: str):
    """Hadoop's (FileSystem, Path) of ``path``."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


#: Stores on which a rename refuses to replace a file, in one step.
ATOMIC_RENAME = ("hdfs", "viewfs", "webhdfs", "swebhdfs", "abfs", "abfss")


def write_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create ``path`` with ``text``, whole at once; False if it exists already. Of several writers exactly one gets True.

    The text is written aside and put in place by a step that fails where the name is taken: a hard link on local disks, a
    rename on stores whose rename refuses a taken name. On others (object stores, where a rename is a copy after a check) the file
    is created under the condition that it is not there; a store without conditional creation is an error.
    """
    jvm = spark.sparkContext._jvm
    fs, at = file_system(spark, path)
    scheme, data = fs.getUri().getScheme(), bytearray(text.encode("utf-8"))
    if fs.exists(at):
        return False
    if scheme != "file" and scheme not in ATOMIC_RENAME:
        try:
            out = fs.createFile(at).recursive().overwrite(False).must("fs.option.create.conditional.overwrite", True).build()
            out.write(data)
            out.close()
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception) or fs.exists(at):
                return False
            raise
    tmp = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(tmp, False)
    out.write(data)
    out.close()
    try:
        if scheme != "file":
            return bool(fs.rename(tmp, at))
        disk = lambda p: jvm.java.io.File(fs.makeQualified(p).toUri().getPath()).toPath()
        jvm.java.nio.file.Files.createLink(disk(at), disk(tmp))
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception):
            return False
        raise
    finally:
        fs.delete(tmp, False)


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, at = file_system(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def list_names(spark: SparkSession, path: str) -> list[str]:
    fs, at = file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []
