"""Session, table loading and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "fotoloom", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the library is tuned for; a cluster brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("FOTOLOOM_DRIVER_MEMORY", "8g"))
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_catalog(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = ("faces", "person", "photo_index")) -> None:
    """Temporary views of the tables, the view ``person_with_stats`` and the function ``person_face_count(id)`` for SQL users."""
    for name in names:
        load(spark, sf_dir, name).createOrReplaceTempView(name)
    spark.sql(
        """CREATE OR REPLACE TEMPORARY VIEW person_with_stats AS
        SELECT p.person_id, p.name, p.description, p.cover_face_id, p.created_at, p.updated_at,
          coalesce(f.face_count, 0) AS face_count, coalesce(f.photo_count, 0) AS photo_count
        FROM person p LEFT JOIN (SELECT person_id, count(*) AS face_count, count(DISTINCT image_id) AS photo_count FROM faces GROUP BY person_id) f
        ON p.person_id = f.person_id"""
    )
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION person_face_count(id BIGINT) RETURNS BIGINT RETURN SELECT count(*) FROM faces WHERE person_id = id")


_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or (unset, as in tests) a folder of our own."""
    global _own_dir
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="fotoloom-")
    return "file://" + _own_dir


def drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables that cut lineage: each is written once to the shared folder and read back from there,
    so a lost executor costs a re-read. What the planner sees of their size is compressed.

    ``free()`` removes the tables no longer needed; what a returned DataFrame still reads stays until
    the session ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, f"{shared_dir(spark).rstrip('/')}/fotoloom-{uuid.uuid4().hex}"
        self.n, self.paths = 0, {}
        atexit.register(self._sweep)

    def cut(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def path(self, df: DataFrame) -> str:
        """Where a table is stored, for tasks that read it themselves."""
        return self.paths[id(df)][1]

    def free(self, *dfs: DataFrame) -> None:
        for df in dfs:
            if id(df) in self.paths:
                drop(self.spark, self.paths.pop(id(df))[1])

    def _sweep(self) -> None:
        try:
            drop(self.spark, self.base)
        except Exception:  # the session is gone already; the folder is the cluster's scratch space
            pass


def parallelism(spark: SparkSession) -> int:
    """Tasks that a Python stage should have at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
