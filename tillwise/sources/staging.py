"""Intermediate tables written to the shared folder.

A written table cuts the lineage: when an executor is lost, later jobs read the files again
and do not repeat the shuffles before them. Unlike a cached frame it is columnar, so every later
pass reads only the columns it needs.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillwise.session import shared_dir

_folder: ContextVar[str | None] = ContextVar("folder of the open stage area", default=None)


class StageArea:
    """One folder for the tables that a job stages, deleted with them by ``close``.

    Frames that read the tables are of no use afterwards.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/tillwise-stage/job-{uuid4()}"

    @contextmanager
    def collecting(self) -> Iterator[None]:
        """What is staged inside the block, by whichever operator, goes to this folder; a failure closes it."""
        before = _folder.set(self.path)
        try:
            yield
        except BaseException:
            self.close()
            raise
        finally:
            _folder.reset(before)

    def close(self) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)

    def __enter__(self) -> StageArea:
        return self

    def __exit__(self, *error) -> None:
        self.close()


PART = 8 << 20  # bytes of the tables read that a part stands for
UNKNOWN_SIZE = 1 << 60  # bytes: rows that come from no file are planned with a size beyond any table


def in_parts(frame: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by the keys to a number of parts that grows with the tables read, where that is more than shuffles have.

    A task that keeps a state for each key then holds a bounded number of them, however many rows there are.
    """
    spark = frame.sparkSession
    leaves = frame._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(place).stats().sizeInBytes())) for place in range(leaves.size())]
    parts = -(-sum(size for size in sizes if size < UNKNOWN_SIZE) // PART)
    return frame.repartition(parts, *[F.col(key) for key in keys]) if parts > spark.sparkContext.defaultParallelism else frame


LONGEST_METHOD = 8000  # bytes of a generated method that the JVM still compiles


@contextmanager
def compiled_methods(spark: SparkSession) -> Iterator[None]:
    """Jobs of the block run fused steps one by one where their generated method is too long for the JVM to compile.

    A longer method is interpreted for every row, many times slower than steps whose expressions are split over methods.
    """
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), LONGEST_METHOD)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stage(frame: DataFrame, name: str, row_group: int | None = None) -> DataFrame:
    """Write the frame below ``spark.checkpoint.dir`` and return a reader of the files.

    ``row_group`` is the size in bytes at which a file can be split: with a small one, many tasks can read what few have written.
    """
    spark = frame.sparkSession
    path = f"{_folder.get() or shared_dir(spark) + '/tillwise-stage'}/{name}-{uuid4()}"
    # Column names come from user files and may hold characters Parquet readers dislike.
    plain = [f"c{place}" for place in range(len(frame.columns))]
    options = {"compression": "zstd", **({"parquet.block.size": row_group} if row_group else {})}
    with compiled_methods(spark):
        frame.toDF(*plain).write.options(**options).parquet(path)
    kinds = ", ".join(f"{short} {field.dataType.simpleString()}" for short, field in zip(plain, frame.schema))
    return spark.read.schema(kinds).parquet(path).toDF(*frame.columns)
