"""The property graph as DataFrames."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbograph.schema import SCHEMAS


def conform(df: DataFrame, table: str) -> DataFrame:
    """``df`` with the columns and types of a table; columns that it lacks are null."""
    own = set(df.columns)
    columns = []
    for part in SCHEMAS[table].replace("(3,2)", "(3;2)").replace("(5,4)", "(5;4)").split(", "):
        name, kind = part.replace(";", ",").split(" ", 1)
        columns.append((F.col(name) if name in own else F.lit(None)).cast(kind).alias(name))
    return df.select(*columns)


@dataclass(frozen=True)
class DocumentGraph:
    """Twelve tables; operators take a graph and return DataFrames, writes return another graph."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, table: str) -> DataFrame:
        if table in self.tables:
            return self.tables[table]
        return self.spark.createDataFrame([], SCHEMAS[table])

    def with_table(self, table: str, rows: DataFrame) -> DocumentGraph:
        return replace(self, tables=self.tables | {table: rows})

    @staticmethod
    def from_tables(spark: SparkSession, tables: dict[str, DataFrame]) -> DocumentGraph:
        unknown = set(tables) - set(SCHEMAS)
        if unknown:
            raise ValueError(f"unknown tables: {sorted(unknown)}")
        return DocumentGraph(spark, {name: conform(df, name) for name, df in tables.items()})

    @staticmethod
    def read(spark: SparkSession, folder: str, names: Iterable[str] = tuple(SCHEMAS)) -> DocumentGraph:
        """Tables written by ``write``."""
        return DocumentGraph(spark, {n: spark.read.schema(SCHEMAS[n]).parquet(f"{folder}/{n}") for n in names})

    def write(self, folder: str, partitions: dict[str, str] | None = None) -> None:
        """Each table as Parquet under its name; never to the folder that the graph was read from."""
        for name in SCHEMAS:
            writer = self[name].write.mode("errorifexists")
            if partitions and name in partitions:
                writer = writer.partitionBy(partitions[name])
            writer.parquet(f"{folder}/{name}")

    def register_views(self, prefix: str = "") -> None:
        for name in SCHEMAS:
            self[name].createOrReplaceTempView(prefix + name)
