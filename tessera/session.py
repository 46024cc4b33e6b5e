"""Session construction and lineage cutting."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings every query of the library relies on.
CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(master: str = "local[*]", app: str = "tessera", **conf: str) -> SparkSession:
    """A session with the library's settings; conf (dots as double underscores) wins over them."""
    b = SparkSession.builder.master(master).appName(app).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for k, v in {**CONF, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the one the session names in spark.checkpoint.dir.

    Only on a local master, where neither the context nor the setting has one (tests), a temporary folder is set; on a
    cluster a machine's own folder would not outlive an executor, so that is an error.
    """
    sc = spark.sparkContext
    now = sc._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read back: later reads neither recompute it nor depend on an executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_tables: list[tuple[SparkSession, str]] = []


def cut_table(df: DataFrame) -> DataFrame:
    """df as a table written to the shared checkpoint folder, for loops: unlike a checkpoint, which carries the size
    estimates of its plan on, the next round starts from the size on disk. A table that is done with goes by
    drop_table(); the others are deleted when the driver ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _tables:
        atexit.register(drop_tables)
    _tables.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def drop_table(*tables: DataFrame) -> None:
    """Delete tables of cut_table() that nothing reads any more."""
    gone = {t._written for t in tables}
    for at in [x for x in _tables if x[1] in gone]:
        _tables.remove(at)
        _delete(*at)


def drop_tables() -> None:
    """Delete the written tables of this driver; a session that has stopped already leaves them to the folder's owner."""
    while _tables:
        try:
            _delete(*_tables.pop())
        except Exception:  # noqa: BLE001  the JVM may be gone
            return


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
