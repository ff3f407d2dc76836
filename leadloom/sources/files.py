"""Readers and writers of the file formats that feeds come in."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

GAZETTEER = "country string, code string, name string, region string, lat string, lng string, population string"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """CSV of places; rows without coordinates go, a population that is no number is null."""
    rows = spark.read.option("header", True).schema(GAZETTEER).csv(path)
    return rows.withColumns({c: F.col(c).try_cast("double") for c in ("lat", "lng")} | {"population": F.col("population").try_cast("long")}).where("lat is not null and lng is not null")


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines and # comments are skipped, bad rows come back in ``corrupt``."""
    fields = T.StructType([*T._parse_datatype_string(schema).fields, T.StructField("corrupt", T.StringType())])
    lines = spark.read.text(path).where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    return lines.select(F.from_json("value", fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}).alias("x")).select("x.*")


def csv_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.option("header", True).schema(schema).csv(path)


def missing_columns(df: DataFrame, needed: dict[str, str]) -> list[str]:
    """Names of the changes (column -> change) that a table lacks."""
    return sorted({change for column, change in needed.items() if column not in df.columns})


def write_sorted_csv(df: DataFrame, path: str) -> None:
    """Distinct rows in order; Spark renames the files when all are written."""
    df.distinct().orderBy(*df.columns).write.mode("overwrite").option("header", True).csv(path)


def has_table(spark: SparkSession, folder: str, name: str) -> bool:
    """Whether a folder holds a table, asked of the file system that the path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def has_columns(spark: SparkSession, folder: str, name: str, *columns: str) -> bool:
    return has_table(spark, folder, name) and set(columns) <= set(table(spark, folder, name).columns)


def keyed_json(spark: SparkSession, path: str, schema: str, key: str = "url") -> DataFrame:
    """Records of a JSON file (a list, or one a line), one a key: the last in the file's order; without a key they go."""
    rows = spark.read.option("multiLine", True).schema(schema).json(path).where(F.col(key).isNotNull())
    return rows.withColumn("_at", F.monotonically_increasing_id()).groupBy(key).agg(F.max_by(F.struct(*(c for c in rows.columns if c != key)), "_at").alias("_x")).select(key, "_x.*")


def text_lists(spark: SparkSession, sources: dict[str, str], protocols: dict[str, str]) -> DataFrame:
    """source, place and url of the lines of many text lists; a line without a protocol gets its source's.  Blank lines and # comments go."""
    parts = None
    for name, path in sources.items():
        line = F.trim("value")
        rows = spark.read.text(path).where((line != "") & ~line.startswith("#"))
        url = F.when(line.contains("://"), line).otherwise(F.concat(F.lit(protocols.get(name, "http") + "://"), line))
        rows = rows.select(F.lit(name).alias("source"), F.monotonically_increasing_id().alias("place"), url.alias("url"))
        parts = rows if parts is None else parts.unionAll(rows)
    return parts if parts is not None else spark.createDataFrame([], "source string, place long, url string")


#: Rows of a file that is replaced as a whole: it is written by one task.
MOST_ROWS = 1_000_000


def replace_file(lines: DataFrame, path: str) -> None:
    """Put the lines (columns place and line, in order of place) into one file, in the stead of the one that is there.

    They are written aside and renamed over the old file at the end, so a reader sees
    the old file or the new one whole; where writing fails, the old one stays.
    """
    spark = lines.sparkSession
    if lines.limit(MOST_ROWS + 1).count() > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows are no single file")
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs
    target = fs.Path(path)
    aside = fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        lines.orderBy("place", "line").coalesce(1).select("line").write.text(aside.toString())
        part = next(x.getPath() for x in system.listStatus(aside) if x.getPath().getName().startswith("part-"))
        if system.getScheme() == "file":
            # The local file system's own overwrite deletes first; a move of the operating system does not.
            system.delete(fs.Path(target.getParent(), f".{target.getName()}.crc"), False)
            option = jvm.java.nio.file.StandardCopyOption
            moves = spark.sparkContext._gateway.new_array(jvm.java.nio.file.CopyOption, 1)
            moves[0] = option.ATOMIC_MOVE
            local = [jvm.java.nio.file.Paths.get(system.makeQualified(x).toUri()) for x in (part, target)]
            jvm.java.nio.file.Files.move(*local, moves)
        else:
            context = fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
            options = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
            options[0] = fs.Options.Rename.OVERWRITE
            context.rename(context.makeQualified(part), context.makeQualified(target), options)
    finally:
        system.delete(aside, True)


def replace_csv(df: DataFrame, path: str, columns: list[str], *, order: list[str] | None = None) -> None:
    """One CSV file with a header: the distinct rows of the columns, in order of them or of ``order``."""
    rows = df.select(*(F.col(c).cast("string").alias(c) for c in columns), *(F.col(c).alias(f"_{c}") for c in order or [])).distinct()
    by = [f"_{c}" for c in order] if order else columns
    body = rows.select(F.struct(F.lit(1), *by).alias("place"), F.to_csv(F.struct(*columns)).alias("line"))
    head = rows.sparkSession.range(1).select(F.lit(",".join(columns)).alias("line"))
    first = F.struct(F.lit(0), *(F.lit(None).cast(rows.schema[c].dataType) for c in by))
    replace_file(head.select(first.cast(body.schema["place"].dataType).alias("place"), "line").unionByName(body), path)


def replace_json(df: DataFrame, path: str, key: str) -> None:
    """One JSON file: a list of the rows in order of their key, one a line."""
    rows = df.select(F.col(key).alias("place"), F.to_json(F.struct(*df.columns)).alias("record"))
    last = rows.agg(F.max(F.struct("place", "record"))).first()[0]
    if last is None:
        return replace_file(df.sparkSession.range(1).select(F.col("id").alias("place"), F.lit("[]").alias("line")), path)
    least = rows.agg(F.min(F.struct("place", "record"))).first()[0]
    mark = lambda end: (F.col("place").eqNullSafe(F.lit(end["place"]))) & (F.col("record") == end["record"])
    line = F.concat(F.when(mark(least), "[").otherwise(" "), "record", F.when(mark(last), "]").otherwise(","))
    return replace_file(rows.distinct().select(F.struct("place", "record").alias("place"), line.alias("line")), path)
