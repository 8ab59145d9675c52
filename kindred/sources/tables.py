"""Tables in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from kindred.functions.posts import literal_list
from kindred.sources.commits import Table


def read_or_empty(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The Parquet table at path, or an empty one if there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def page(df: DataFrame, key: str, skip: int, limit: int) -> DataFrame:
    """Rows skip to skip + limit in the order of key."""
    return df.orderBy(key).offset(skip).limit(limit)


def exported(df: DataFrame, path: str) -> None:
    """Each row as a line of JSON."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def overwritten(df: DataFrame, path: str) -> DataFrame:
    """df in place of the table of commits at path, which df may read."""
    return Table(df.sparkSession, path).overwrite(df)


def upserted(changes: DataFrame, path: str, key: str, newest: str, writer: str = "", epoch: int | None = None) -> DataFrame:
    """The table of commits at path with the changes: of each key the row that is last by ``newest``; a change wins a tie."""
    return Table(changes.sparkSession, path, key, newest).upsert(changes, writer, epoch)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, renames: dict[str, str], cache: str | None = None, refresh: bool = False) -> DataFrame:
    """Lines of JSON with columns renamed; with a cache, a table of commits, that is read if there is one and no refresh is asked for."""
    def scan() -> DataFrame:
        return spark.read.schema(schema).json(path).withColumnsRenamed(renames)

    if cache is None:
        return scan()
    held = Table(spark, cache)
    return held.overwrite(scan()) if refresh or not held.exists() else held.read()


def read_csv_lists(spark: SparkSession, path: str, schema: StructType | str, lists: list[str]) -> DataFrame:
    """A CSV with a header, whose columns ``lists`` hold literal lists of strings."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path).withColumns({c: literal_list(F.col(c)) for c in lists})


def audit_line(form: str, *columns: str | Column) -> Column:
    """A line of text for a person to read."""
    return F.format_string(form, *columns)
