"""Collections as tables: materialise, scan, and views."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, DataType, StructField, StructType

from streamtable.sources.scratch import scratch


class Tables:
    """A registry of materialised collections. The first write of a name pins its schema; later writes must have it."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder, self.schemas = spark, folder or scratch(spark, "tables"), {}

    def write(self, name: str, df: DataFrame) -> None:
        """Appends df to a collection. Empty collections are legal."""
        schema = StructType([StructField(f.name, _nullable(f.dataType)) for f in df.schema])
        if self.schemas.setdefault(name, schema) != schema:
            raise TypeError(f"collection {name} has schema {self.schemas[name].simpleString()}, not {schema.simpleString()}")
        df.write.mode("append").parquet(f"{self.folder}/{name}")

    def scan(self, name: str) -> DataFrame:
        if name not in self.schemas:
            raise KeyError(f"schema not found for collection {name}")
        try:
            return self.spark.read.schema(self.schemas[name]).parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            raise KeyError(f"collection {name} has no data: {e}") from e

    def view(self, name: str) -> DataFrame:
        """The collection as a temporary SQL view of its name."""
        df = self.scan(name)
        df.createOrReplaceTempView(name)
        return df


def _nullable(kind: DataType) -> DataType:
    if isinstance(kind, ArrayType):
        return ArrayType(_nullable(kind.elementType), True)
    if isinstance(kind, StructType):
        return StructType([StructField(f.name, _nullable(f.dataType)) for f in kind])
    return kind


def record_shape(schema: StructType) -> str:
    """The shape of a collection's records: primitive, iterable, kv, gbk or row."""
    names = schema.names
    if names == ["key", "value"]:
        return "gbk" if isinstance(schema["value"].dataType, ArrayType) else "kv"
    if len(names) == 1:
        return "iterable" if isinstance(schema[0].dataType, ArrayType) else "primitive"
    return "row"
