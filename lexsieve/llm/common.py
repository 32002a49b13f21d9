"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexsieve.sources.tables import read_table

#: The white space that separates words, as a character class body.
BLANK = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def text_bytes(docs: DataFrame) -> int:
    """About how many bytes docs (text) has: as the plan tells, else by their sum."""
    told = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return told if told < 1 << 50 else docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once a row.

    A lambda variable is the only binding the optimizer never inlines again.
    """
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text, in order; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{BLANK}]+"), "")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32(doc_id as text) leaves this remainder; false for a null id."""
    crc = F.crc32(F.encode(doc_id.cast("string"), "UTF-8"))
    return F.coalesce(crc % modulus == remainder, F.lit(False))


def give_back() -> None:
    """Returns to the system what this process has freed but still holds."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc only
        trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, after which the worker gives memory back. Workers outlive their tasks, so what they
    keep would count against the executor in all later stages."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir.

    Only in a session within one machine, as in local tests, a folder is made where that setting is absent: on a
    cluster the others could not read it.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """df cut from its lineage by files in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


class Written:
    """Tables written as Parquet to the shared folder; each can be removed once nothing reads it."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.folder = f"{checkpoint_folder(spark)}/tables-{uuid.uuid4().hex}"
        self.made: list[tuple[DataFrame, str]] = []

    def table(self, df: DataFrame) -> DataFrame:
        """df as it was written: without lineage, so that lost executors cost nothing."""
        name = f"{self.folder}/{len(self.made)}"
        df.write.option("compression", "zstd").parquet(name)
        out = self.spark.read.schema(df.schema).parquet(name)
        self.made.append((out, name))
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df, name in self.made:
            if any(df is t for t in tables):
                remove(self.spark, name)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
