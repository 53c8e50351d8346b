"""The shared work folder: where tables that cut a lineage are written.

The folder is the one the cluster names in ``spark.checkpoint.dir``; every executor can read it, so a table
written there survives the loss of executors.  Only where that setting is absent and the master is local (tests, notebooks on
one machine) a temporary folder is made and registered as the checkpoint folder; on a cluster its absence is an error.

What was written is deleted by ``clean``, which callers may use once they are done with a query's result, and at the end of the process.
"""

from __future__ import annotations

import atexit
import io
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """The shared folder of this session, without a trailing slash."""
    named = spark.sparkContext.getConf().get(_SETTING) or spark.conf.get(_SETTING, None)
    if named:
        return named.rstrip("/")
    in_use = spark.sparkContext._jsc.sc().getCheckpointDir()
    if in_use.isDefined():
        return in_use.get().rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"{_SETTING} has to name a folder that all machines of {master} share")
    own = tempfile.mkdtemp(prefix="codequarry-")
    atexit.register(shutil.rmtree, own, True)
    spark.sparkContext.setCheckpointDir("file://" + own)
    return "file://" + own


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A path below the shared folder that nothing else uses; it is not created, and deleted by ``clean``."""
    root = f"{shared_root(spark)}/codequarry"
    name = f"{purpose}-{uuid.uuid4().hex}"
    store = FileStore(spark, root)
    if not _STORES:
        atexit.register(_clean_all)
    _STORES.setdefault(root, (store, set()))[1].add(name)
    return f"{root}/{name}"


#: The folders of this process, by root.
_STORES: dict[str, tuple[FileStore, set[str]]] = {}


def clean(spark: SparkSession) -> int:
    """Delete all folders written for queries so far; results that are still to be read from them are lost.  How many there were."""
    root = f"{shared_root(spark)}/codequarry"
    store, names = _STORES.get(root, (None, set()))
    gone = {n for n in names if not n.startswith("package-")}
    for name in gone:
        store.remove(name)
    names -= gone
    return len(gone)


def _clean_all() -> None:
    for store, names in _STORES.values():
        for name in names:
            try:
                store.remove(name)
            except Exception:  # noqa: BLE001 - the engine may be gone, and its temporary folder with it
                break


def materialised(df: DataFrame, purpose: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, lineage cut, safe against lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, purpose)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows hashed by ``keys`` into at least one partition per core.

    For work in Python that costs more than its input's size says: adaptive execution would coalesce a small shuffle into a few
    tasks, but leaves a number that was asked for.  A join on the same keys reuses the partitioning.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def ship(spark: SparkSession) -> None:
    """Let the executors' Python import this package, wherever the driver has it from; once per context."""
    context = spark.sparkContext
    if getattr(context, "_codequarry_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    image = io.BytesIO()
    with zipfile.ZipFile(image, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(package.rglob("*.py")):
            archive.write(path, path.relative_to(package.parent))
    root, _, name = new_folder(spark, "package").rpartition("/")
    context.addPyFile(FileStore(spark, root).write_bytes(f"{name}.zip", image.getvalue()))
    context._codequarry_shipped = True


class FileStore:
    """Small control files beside the tables, with an atomic replace (Hadoop rename with overwrite)."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        path = self._path(name)
        return path.getFileSystem(self._conf).exists(path)

    def read_text(self, name: str) -> str | None:
        """The file's text, or None where there is none."""
        path = self._path(name)
        fs = path.getFileSystem(self._conf)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace_text(self, name: str, text: str) -> None:
        """Write ``text`` under a fresh name, then rename it over ``name``: readers see the old or the new text, whole."""
        fresh = self._path(f"{name}.{uuid.uuid4().hex}.tmp")
        fs = fresh.getFileSystem(self._conf)
        stream = fs.create(fresh, True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
            stream.hsync() if hasattr(stream, "hsync") else stream.flush()
        finally:
            stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), self._conf)
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self._jvm.java.lang.reflect.Array.newInstance(rename.NONE.getClass(), 1)
        options[0] = rename.OVERWRITE
        context.rename(fresh, self._path(name), options)

    def create_text(self, name: str, text: str) -> bool:
        """Put ``text`` under ``name`` whole, unless there is a file of that name; whether it was put there."""
        if self.read_text(name) is not None:
            return False
        fresh = self._path(f"{name}.{uuid.uuid4().hex}.tmp")
        fs = fresh.getFileSystem(self._conf)
        stream = fs.create(fresh, True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        if fs.getScheme() == "file":  # the only rename that fails on an existing file here is that of a hard link
            taken = self._link(fresh, self._path(name))
            fs.delete(fresh, False)
            return taken
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), self._conf)
        try:
            context.rename(fresh, self._path(name), self._jvm.java.lang.reflect.Array.newInstance(self._jvm.org.apache.hadoop.fs.Options.Rename.NONE.getClass(), 0))
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in str(error.java_exception):
                raise
            fs.delete(fresh, False)
            return False
        return True

    def _link(self, fresh, target) -> bool:
        paths = self._jvm.java.nio.file.Paths
        try:
            self._jvm.java.nio.file.Files.createLink(paths.get(target.toUri().getPath(), self._no_words()), paths.get(fresh.toUri().getPath(), self._no_words()))
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in str(error.java_exception):
                raise
            return False
        return True

    def _no_words(self):
        return self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("java.lang.String"), 0)

    def write_bytes(self, name: str, data: bytes) -> str:
        """Write a new file; its full path."""
        path = self._path(name)
        stream = path.getFileSystem(self._conf).create(path, True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        return f"{self.root}/{name}"

    def remove(self, name: str) -> bool:
        """Delete a file or folder; whether there was one."""
        path = self._path(name)
        return path.getFileSystem(self._conf).delete(path, True)
