"""A log of page snapshots, and the data source that reads it in batches or as a stream.

The log is a folder with one subfolder for each round of snapshots, ``seq=<number>``, of Parquet files; a round counts
once it is complete (Spark's ``_SUCCESS`` file). The source's offset is the last round taken. A
micro-batch takes all rounds after it; each row group of a file is a partition of its own, which an executor reads. The driver lists
folders and footers and sees no page.

    spark.dataSource.register(PageSnapshots)
    spark.readStream.format("page_snapshots").load(path)      # page_id, seq, html

``page_id`` is a string unless a schema is given. The log may lie in any store that pyarrow reaches by its address.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

NAME, SCHEMA = "page_snapshots", "page_id string, seq long, html string"


def append(pages: DataFrame, path: str, seq: int) -> None:
    """Add a round of snapshots (page_id, html) to the log; a round that was there is replaced."""
    pages.select(pages["page_id"].cast("string").alias("page_id"), pages["html"].cast("string").alias("html")).write.mode("overwrite").parquet(f"{path.rstrip('/')}/seq={seq}")


@dataclass
class RowGroup(InputPartition):
    path: str
    group: int
    seq: int


class _Log:
    def __init__(self, options: dict, schema: StructType):
        if not options.get("path"):
            raise ValueError(f"{NAME} needs the path of a log")
        self.address, self.schema = options["path"], schema

    def store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.address) if "://" in self.address or self.address.startswith("file:") else (fs.LocalFileSystem(), self.address)

    def rounds(self) -> dict[int, str]:
        """Complete rounds: number to folder."""
        from pyarrow import fs

        store, root = self.store()
        folders = {int(x.base_name[4:]): x.path for x in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if x.type == fs.FileType.Directory and x.base_name[:4] == "seq=" and x.base_name[4:].isdigit()}
        done = store.get_file_info([f"{p}/_SUCCESS" for p in folders.values()])
        return {n: p for (n, p), x in zip(folders.items(), done, strict=True) if x.type == fs.FileType.File}

    def between(self, after: int, upto: int) -> list[RowGroup]:
        """Row groups of the rounds after ``after``, up to ``upto``."""
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, _ = self.store()
        out = []
        for n, folder in sorted(self.rounds().items()):
            if after < n <= upto:
                for x in sorted(store.get_file_info(fs.FileSelector(folder)), key=lambda x: x.path):
                    if x.base_name.endswith(".parquet"):
                        with store.open_input_file(x.path) as f:
                            out.extend(RowGroup(x.path, g, n) for g in range(pq.ParquetFile(f).num_row_groups))
        return out

    def read(self, partition: RowGroup | None) -> Iterator:
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        if partition is None:  # Spark's stand-in where there is nothing to read
            return
        shape = to_arrow_schema(self.schema)
        store, _ = self.store()
        with store.open_input_file(partition.path) as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=256, row_groups=[partition.group]):
                own = {name: batch.column(name) for name in batch.schema.names} | {"seq": pa.array([partition.seq] * batch.num_rows, pa.int64())}
                yield pa.RecordBatch.from_arrays([own[x.name].cast(x.type) for x in shape], schema=shape)


class _Reader(_Log, DataSourceReader):
    def partitions(self) -> list[RowGroup]:
        return self.between(-1, max(self.rounds(), default=-1))


class _StreamReader(_Log, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"seq": -1}

    def latestOffset(self) -> dict:
        return {"seq": max(self.rounds(), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[RowGroup]:
        return self.between(start["seq"], end["seq"])

    def commit(self, end: dict) -> None:
        """Rounds stay in the log; whoever writes it decides how long."""


class PageSnapshots(DataSource):
    """Rows of page_id, seq and html."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(self.options, schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All complete rounds of a log."""
    spark.dataSource.register(PageSnapshots)
    return spark.read.format(NAME).load(path)


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """The log's rounds as they are completed."""
    spark.dataSource.register(PageSnapshots)
    return spark.readStream.format(NAME).load(path)
