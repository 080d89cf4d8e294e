"""Text and code files of a folder tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.text import language_of

#: Folders that hold what others made, and hidden ones.
SKIPPED = r"/(\.[^/]+|node_modules|build|target|dist)/"
MARKDOWN, TEXT = "*.md", "*.{txt,text}"


def read_text_files(spark: SparkSession, path: str, pattern: str = MARKDOWN) -> DataFrame:
    """path, content of each file under a folder whose name fits the pattern, skipped folders left out."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True)
    return files.select(F.input_file_name().alias("path"), F.col("value").alias("content")).where(~F.col("path").rlike(SKIPPED))


def _glob(path: Column, patterns: tuple[str, ...]) -> Column:
    """Whether a path fits one of the patterns, in which * stands for anything."""
    fits = F.lit(False)
    for pattern in patterns:
        fits = fits | path.like("%" + pattern.replace("%", r"\%").replace("_", r"\_").replace("*", "%"))
    return fits


def read_code(spark: SparkSession, path: str, include: tuple[str, ...] = ("*",), exclude: tuple[str, ...] = ()) -> DataFrame:
    """path, language, content of the source files under a folder, by the languages known and the patterns given."""
    files = read_text_files(spark, path, "*.*").withColumn("language", language_of(F.col("path")))
    wanted = _glob(F.col("path"), include) & ~_glob(F.col("path"), exclude)
    return files.where(F.col("language").isNotNull() & wanted).select("path", "language", "content")


def source_plan(spark: SparkSession, path: str) -> DataFrame:
    """lane, path, content: prose in the content lane, code in the code lane."""
    prose = read_text_files(spark, path, "*.{md,txt,text}").select(F.lit("content").alias("lane"), "path", "content")
    code = read_code(spark, path).select(F.lit("code").alias("lane"), "path", "content")
    return prose.unionByName(code)
