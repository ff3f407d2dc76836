"""ZIP archives of tab-separated tables, and the gazetteer that they make.

An archive's member is unpacked as a stream: a task holds the packed archive and one
piece of lines, not the table.  Lines carry their number, so that rules about the
first line of a kind hold in any order of execution.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines that a task hands over at once, and bytes of a line that are kept.
PIECE = 10_000
LINE_BYTES = 1 << 20

# Places of the columns in tables of postcodes and of places.
CODE_COLUMNS = {"country": 0, "code": 1, "name": 2, "region": 3, "region_code": 4, "lat": 9, "lng": 10}
PLACE_COLUMNS = {"name": 1, "lat": 4, "lng": 5, "kind": 6, "country": 8, "region_code": 10, "population": 14}
POPULATED = "P"


def archives(spark: SparkSession, path: str) -> DataFrame:
    """path and content of the ZIP files under a path, through Spark's own reader."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")


def lines(packed: DataFrame) -> DataFrame:
    """path, number (from 0) and line of the member that is named as its archive, `XX.txt` in `XX.zip`, in any case.

    Blank lines keep their number and are left out.  An archive that cannot be read,
    or has no such member, gives one row with its reason in ``failed``.
    """

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                yield from _unpacked(path, content)

    return packed.select("path", "content").mapInPandas(work, "path string, number long, line string, failed string")


def _unpacked(path: str, content: bytes) -> Iterator[pd.DataFrame]:
    wanted = path.rsplit("/", 1)[-1].rsplit(".", 1)[0].upper() + ".TXT"
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            name = next((x for x in archive.namelist() if x.upper() == wanted), None)
            if name is None:
                raise KeyError(f"no member {wanted}")
            with archive.open(name) as member:
                piece: list[tuple[int, str]] = []
                number = 0
                while raw := member.readline(LINE_BYTES):
                    text = raw.decode("utf-8", "replace").rstrip("\r\n")
                    if text.strip():
                        piece.append((number, text))
                    number += 1
                    if len(piece) >= PIECE:
                        yield _frame(path, piece)
                        piece = []
                if piece:
                    yield _frame(path, piece)
    except (KeyError, zipfile.BadZipFile, zipfile.LargeZipFile, NotImplementedError, OSError, EOFError) as problem:
        yield pd.DataFrame({"path": [path], "number": [None], "line": [None], "failed": [str(problem)]})


def _frame(path: str, piece: list[tuple[int, str]]) -> pd.DataFrame:
    return pd.DataFrame({"path": path, "number": [n for n, _ in piece], "line": [x for _, x in piece], "failed": None})


def _cut(rows: DataFrame, columns: dict[str, int]) -> DataFrame:
    """The named columns, trimmed; whole tells whether a line has all of them."""
    parts = F.split("line", "\t", -1)
    out = rows.where("failed is null").select("path", "number", parts.alias("p"))
    return out.select("path", "number", (F.size("p") > max(columns.values())).alias("whole"), *(F.trim(F.get("p", F.lit(k))).alias(c) for c, k in columns.items()))


def _number(text: Column) -> Column:
    """A coordinate; null for what is no number or not finite."""
    found = text.try_cast("double")
    return F.when(~F.isnan(found) & (F.abs(found) < F.lit(float("inf"))), found)


def code_rows(rows: DataFrame) -> DataFrame:
    """Postcodes: path, number, country, code, name, region, region_code, lat, lng and used; lines without coordinates are not used."""
    found = _cut(rows, CODE_COLUMNS).withColumns({"country": F.upper("country"), "lat": _number(F.col("lat")), "lng": _number(F.col("lng"))})
    return found.withColumn("used", F.col("whole") & F.col("lat").isNotNull() & F.col("lng").isNotNull())


def region_names(codes: DataFrame) -> DataFrame:
    """country, region_code and region: the name that a region's first usable line gives, in the order of archives and lines."""
    rows = codes.where("used and region != '' and region_code != ''")
    return rows.groupBy("country", "region_code").agg(F.min_by("region", F.struct("path", "number")).alias("region"))


def place_rows(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """Populated places: path, number, country, name, region, lat, lng, population and used; other kinds of features are left out.

    A population that is no number counts as 0, an unknown region as ''.
    """
    found = _cut(rows, PLACE_COLUMNS).where(~F.col("whole") | (F.col("kind") == POPULATED))
    found = found.withColumns({"country": F.upper("country"), "lat": _number(F.col("lat")), "lng": _number(F.col("lng"))})
    found = found.withColumn("population", F.when(F.col("population").rlike("^[0-9]+$"), F.col("population").try_cast("long")))
    used = F.col("whole") & (F.col("name") != "") & F.col("lat").isNotNull() & F.col("lng").isNotNull()
    met = found.join(regions, ["country", "region_code"], "left")
    return met.select("path", "number", "country", "name", F.coalesce("region", F.lit("")).alias("region"), "lat", "lng", F.coalesce("population", F.lit(0)).cast("long").alias("population"), F.coalesce(used, F.lit(False)).alias("used"))


def gazetteer(code_lines: DataFrame, place_lines: DataFrame) -> DataFrame:
    """country, code, name, region, lat, lng and population of all usable lines, each once: codes without a population, places without a code."""
    codes = code_rows(code_lines)
    places = place_rows(place_lines, region_names(codes))
    columns = ["country", "code", "name", "region", "lat", "lng", "population"]
    left = codes.where("used").withColumn("population", F.lit(None).cast("long")).select(*columns)
    return left.unionByName(places.where("used").withColumn("code", F.lit("")).select(*columns)).distinct()


def skipped(code_lines: DataFrame, place_lines: DataFrame) -> DataFrame:
    """table, lines read and lines skipped."""
    codes = code_rows(code_lines)
    counted = lambda rows, name: rows.agg(F.lit(name).alias("table"), F.count("*").alias("lines"), F.count_if(~F.col("used")).alias("skipped"))
    return counted(codes, "codes").unionByName(counted(place_rows(place_lines, region_names(codes)), "places"))


def packed_tables(rows: DataFrame, block: Column, line: Column) -> DataFrame:
    """Archives (path, content) of the rows' lines, one for each block, which has to bound its rows; lines stand in their own order."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        name = f"{frame['block'].iloc[0]:08d}"
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("readme.txt", "about this archive\n")
            archive.writestr(f"{name}.txt", "\n".join(frame.sort_values(["place", "line"])["line"]) + "\n")
        return pd.DataFrame({"path": [f"{name}.zip"], "content": [out.getvalue()]})

    return rows.select(block.cast("long").alias("block"), F.col("place"), line.alias("line")).groupBy("block").applyInPandas(pack, "path string, content binary")
