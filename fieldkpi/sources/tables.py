"""Table, result-file and catalog access."""

from __future__ import annotations

from collections import OrderedDict

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Schemas of tables by path, each with the files it was read from; the latest are kept.
_SCHEMAS: OrderedDict[str, tuple[frozenset, StructType]] = OrderedDict()
_SCHEMAS_KEPT = 256
_MOST_FILES = 1000


def files_of(spark: SparkSession, path: str) -> frozenset | None:
    """Name, size and change time of each file under ``path``.

    None if it can't be listed or holds more than 1,000 files: next to a scan of so many,
    the job that reads one footer is nothing, and asking for each would take longer.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    try:
        where = hadoop.Path(path)
        system = where.getFileSystem(spark._jsc.hadoopConfiguration())
        listed, found = system.listFiles(where, True), set()
        while listed.hasNext():
            if len(found) == _MOST_FILES:
                return None
            f = listed.next()
            found.add((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    except Py4JError:
        return None
    return frozenset(found)


def read_table(
    spark: SparkSession, directory: str, name: str, schema: StructType | None = None
) -> DataFrame:
    """Scan one table stored as Parquet under ``directory``.

    With a known ``schema`` no job is needed to read file footers first. It is remembered
    as long as the table's files stay the same in name, size and change time, so a table
    that was written anew is read anew.
    """
    path = f"{directory.rstrip('/')}/{name}.parquet"
    if schema is not None:
        return spark.read.schema(schema).parquet(path)
    files = files_of(spark, path)
    known = _SCHEMAS.get(path)
    if files and known and known[0] == files:
        return spark.read.schema(known[1]).parquet(path)
    df = spark.read.parquet(path)
    if files:
        _SCHEMAS[path] = (files, df.schema)
        _SCHEMAS.move_to_end(path)
        while len(_SCHEMAS) > _SCHEMAS_KEPT:
            _SCHEMAS.popitem(last=False)
    return df


def list_columns(spark: SparkSession, table: str) -> DataFrame:
    """Column names and types of a catalog table or temporary view, in order."""
    fields = [
        (i, c.name, c.dataType) for i, c in enumerate(spark.catalog.listColumns(table))
    ]
    return spark.createDataFrame(
        fields, "ordinal_position int, column_name string, data_type string"
    ).orderBy("ordinal_position")


def preview(df: DataFrame, *order_by: str, rows: int = 10) -> DataFrame:
    """First rows of a frame; give ``order_by`` to make the choice repeatable."""
    return (df.orderBy(*order_by) if order_by else df).limit(rows)


def sorted_values(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of one column in order."""
    return df.select(column).distinct().orderBy(column)


def fill_nulls(df: DataFrame, value: float = 0.0, columns: list[str] | None = None) -> DataFrame:
    """Replace nulls in numeric columns."""
    return df.fillna(value, subset=columns)


def read_results_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Read an exported result file; the schema is given, never inferred."""
    return spark.read.csv(path, header=True, schema=schema)


def write_summary_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a summary as CSV with a header; Spark writes the parts in parallel."""
    df.write.mode(mode).csv(path, header=True)

