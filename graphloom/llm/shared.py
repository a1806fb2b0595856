"""Tables in the folder all executors share, and small column helpers."""

from __future__ import annotations

import atexit
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOTS: dict[str, str] = {}
BATCH = 1 << 20  # bytes of an Arrow batch
FEW = 1 << 20  # ids that are broadcast, at most


def shared_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where that is unset and the master is local."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.split("[")[0] == "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        _ROOTS[app] = f"{base.rstrip('/')}/graphloom-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _ROOTS[app])
    return _ROOTS[app]


def _remove(spark: SparkSession, path: str) -> None:
    """At the end of the application its tables go; a JVM that has already ended leaves them to the folder's owner."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:
        return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run, which gives the memory it has freed back to the system at its end: Spark keeps its Python workers."""

    @functools.wraps(run)
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return own


def fresh(name: str, *frames: DataFrame) -> str:
    """name, or name with underscores before it that no column of the frames has."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def without(docs: DataFrame, gone: DataFrame, *keys: Column, how: str = "left_anti") -> DataFrame:
    """docs without the rows whose keys (null or not) are a row of gone, or with how="left_semi" only these.

    Up to FEW rows of gone are broadcast, so that docs don't move; more are joined by a shuffle.
    """
    names = [fresh(f"__gone{i}", docs) for i in range(len(keys))]
    gone = gone.toDF(*names)
    same = functools.reduce(lambda a, b: a & b, [k.eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)])
    return docs.join(F.broadcast(gone) if gone.count() <= FEW // len(keys) ** 3 else gone.hint("shuffle_hash"), same, how)


def split_join(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with table (one row a key, which has `count` of the `total` rows), for keys that may be very frequent.

    Keys with at least total / 1,024 rows, 1,024 of them at most for one row a key and place, are broadcast, all others
    are joined by a shuffle.
    """
    hot = F.col(count) >= max(1000, total // 1024)
    mark = fresh("__hot", rows, table)
    more = [c for c in table.columns if c not in keys]
    marked = rows.join(F.broadcast(table.where(hot).withColumn(mark, F.lit(True))), keys, "left")
    frequent = marked.where(F.col(mark)).select(*rows.columns, *more)
    return frequent.unionByName(marked.where(F.col(mark).isNull()).select(*rows.columns).join(table.where(~hot), keys, how).select(*rows.columns, *more))


def fold_of(doc_id: Column | str) -> Column:
    """crc32 of doc_id as text, modulo 5."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % 5


def parts(df: DataFrame) -> int:
    """Shuffle partitions of the session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


_SHIPPED: set[str] = set()


def ship(df: DataFrame) -> DataFrame:
    """Give this package to the executors, which need not have it on their path.  Returns df.

    Arrow batches of the session are set to BATCH bytes at most unless the session has a limit of its own: texts pass to
    and from Python in small pieces, whatever their length.
    """
    import pathlib
    import zipfile

    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(BATCH))
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        _SHIPPED.add(sc.applicationId)
        package = pathlib.Path(__file__).resolve().parent.parent
        path = pathlib.Path(tempfile.mkdtemp(prefix="graphloom-")) / "graphloom_llm.zip"
        with zipfile.ZipFile(path, "w") as z:
            z.write(package / "__init__.py", "graphloom/__init__.py")
            for p in sorted((package / "llm").glob("*.py")):
                z.write(p, f"graphloom/llm/{p.name}")
        sc.addPyFile(str(path))
    return df
