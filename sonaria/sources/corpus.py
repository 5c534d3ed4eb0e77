"""Corpus readers: tab-separated splits and pipe-delimited metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonaria.functions import text
from sonaria.sources import records
from sonaria.sources.sinks import PIPE, TSV

# Last-wins order of rows read from splits: split, file, block in the file, row in the block.
FILE_ORDER = ["file_rank", "file_name", "block_start", "row_id"]


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def read_tsv_splits(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """path, sentence and the order columns of every existing split, in the order of ``names``.

    Missing splits are skipped. Line breaks inside quotes belong to the text, and a file is read in as
    many tasks as its size asks for.
    """
    read = None
    for rank, name in enumerate(names):
        path = f"{root.rstrip('/')}/{name}"
        if not _exists(spark, path):
            continue
        columns = _header(spark, path)
        parsed = _parsed(records.read_records(spark, path, TSV["sep"]), columns, TSV)
        header = (F.col("block") == 0) & (F.col("row") == 0)
        found = F.array(*[F.coalesce(F.col(f"fields.{_quoted(c)}"), F.lit("")) for c in columns])
        same = found == F.array(*[F.lit(c) for c in columns])
        # Every file of a split has the same header line.
        checked = F.when(header, F.when(same, F.lit(True)).otherwise(F.raise_error(F.lit("headers differ"))))
        part = parsed.where(checked.isNull()).select(
            "fields.path",
            "fields.sentence",
            F.lit(rank).alias("file_rank"),
            text.basename(F.col("file")).alias("file_name"),
            F.col("block").alias("block_start"),
            F.col("row").alias("row_id"),
        )
        read = part if read is None else read.unionByName(part)
    if read is None:
        schema = "path string, sentence string, file_rank int, file_name string, block_start long, row_id long"
        return spark.createDataFrame([], schema)
    return read


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _parsed(rows: DataFrame, columns: list[str], dialect: dict[str, str]) -> DataFrame:
    """Adds struct ``fields`` with all columns as strings; nothing is inferred from the data."""
    schema = ", ".join(f"{_quoted(c)} string" for c in columns)
    options = {k: v for k, v in dialect.items() if k != "header"} | {"lineSep": "\u0000"}
    return rows.withColumn("fields", F.from_csv("record", schema, options))


def _header(spark: SparkSession, path: str) -> list[str]:
    """Columns named by the header line."""
    return spark.read.options(**TSV, inferSchema="false").csv(path).columns


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """file, text of quoted pipe-delimited metadata, read like the splits; blank rows are left out."""
    rows = _parsed(records.read_records(spark, path, PIPE["sep"]), ["file", "text"], PIPE).select("fields.*")
    return rows.where(F.coalesce(F.col("file"), F.lit("")) != "").withColumn(
        "text", F.coalesce("text", F.lit(""))
    )


def read_raw_metadata(spark: SparkSession, path: str) -> DataFrame:
    """file, text of unquoted lines: the text is all that follows the first pipe."""
    line = F.col("value")
    bar = F.instr(line, "|")
    return spark.read.text(path).where(F.length(line) > 0).select(
        F.when(bar > 0, F.left(line, bar - 1)).otherwise(line).alias("file"),
        F.when(bar > 0, F.substring(line, bar + 1, F.length(line))).otherwise(F.lit("")).alias("text"),
    )
