"""Packs as a Spark data source: spark.read.format("termpack").load(path), and its writer."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from lexsieve.sources import pack

SCHEMA = "kind string, term string, cat_name string, sev int, w boolean"


class TermPack(DataSource):
    """Rows of kind term, and of kind allow (term only). Option key: the mask's key in hexadecimal."""

    @classmethod
    def name(cls) -> str:
        return "termpack"

    def schema(self) -> str:
        return SCHEMA

    def key(self) -> bytes:
        return bytes.fromhex(self.options["key"]) if "key" in self.options else pack.KEY

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.key())

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self.key())


class _Reader(DataSourceReader):
    def __init__(self, path: str, key: bytes) -> None:
        self.path, self.key = path, key

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(self.path, "rb") as file:
            found = pack.decode(file.read(), self.key)
        for term, category, severity, word in found["entries"]:
            yield ("term", term, category, severity, word)
        for term in found["allow"]:
            yield ("allow", term, None, None, None)


class _Written(WriterCommitMessage):
    def __init__(self, rows: list[tuple]) -> None:
        self.rows = rows


class _Writer(DataSourceWriter):
    """A pack is one small file: tasks hand their rows to the driver, which writes it."""

    def __init__(self, path: str, key: bytes) -> None:
        self.path, self.key = path, key

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        return _Written([tuple(r) for r in iterator])

    def commit(self, messages: list[WriterCommitMessage]) -> None:
        rows = [r for m in messages if m for r in m.rows]
        terms = [tuple(r[1:]) for r in rows if r[0] == "term"]
        data = pack.encode(terms, [r[1] for r in rows if r[0] == "allow"], self.key)
        pack.decode(data, self.key)  # read back before anything is written
        with open(self.path, "wb") as file:
            file.write(data)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TermPack)
