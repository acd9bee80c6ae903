"""Files as tables: listing, attributes, text with encoding fallback, raw lines, CSV."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Extensions and sizes.
DATA_EXTENSIONS = ["csv", "txt", "pdf", "docx", "doc", "rtf"]
LOG_EXTENSIONS = ["csv", "txt", "tsv"]
UPLOAD_EXTENSIONS = ["csv", "pdf", "txt", "rtf", "doc", "docx", "tsv"]
MAX_UPLOAD_MB, MAX_LOG_MB = 200, 50
MIME_TYPES = {
    "csv": "text/csv", "txt": "text/plain", "tsv": "text/tab-separated-values", "pdf": "application/pdf", "rtf": "application/rtf", "doc": "application/msword",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
}


def scan_files(spark: SparkSession, directory: str, extensions: list[str] | None = None, recursive: bool = True) -> DataFrame:
    """``(path, modificationTime, length, content)``; unselected content is never read."""
    wanted = ",".join(extensions or DATA_EXTENSIONS)
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + wanted + "}")
    return reader.option("recursiveFileLookup", str(recursive).lower()).load(directory)


def list_files(spark: SparkSession, directory: str, extensions: list[str] | None = None, recursive: bool = True) -> DataFrame:
    """Names and times, newest first."""
    files = scan_files(spark, directory, extensions, recursive).select("path", "modificationTime", "length")
    return files.orderBy(F.col("modificationTime").desc(), "path")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(?<=.)\.([^.]*)$", 1))


def file_info(files: DataFrame, allowed: list[str] | None = None, *more: Column) -> DataFrame:
    """Attributes of each file, and what else is to be taken from it in the same pass."""
    name = file_name(F.col("path"))
    ext = extension(name)
    return files.select(
        "path", name.alias("filename"), ext.alias("extension"), F.col("length").alias("size_bytes"), F.round(F.col("length") / 1048576, 2).alias("size_mb"),
        ext.isin(allowed or DATA_EXTENSIONS).alias("is_supported_type"), *more,
    )


def validation_summary(info: DataFrame) -> DataFrame:
    valid = F.col("is_supported_type") & (F.col("size_bytes") > 0)
    return info.agg(
        F.count(F.lit(1)).alias("total_files"), F.count_if(valid).alias("valid_files"), F.count_if(~valid).alias("invalid_files"), F.sum("size_bytes").alias("total_bytes"),
        F.array_join(F.sort_array(F.collect_set(F.when(valid, F.col("extension")))), ",").alias("types"),
        F.round(F.count_if(valid) * 100.0 / F.count(F.lit(1)), 4).alias("success_rate"),
    )


def decode_text(content: Column) -> Column:
    """Text of bytes: UTF-16 by its mark, UTF-8 where valid, else Latin-1, in which every byte is a character."""
    mark = F.hex(F.substring(content, 1, 2))
    return (
        F.when(mark.isin("FFFE", "FEFF"), F.decode(content, "UTF-16"))
        .when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
        .otherwise(F.decode(content, "ISO-8859-1"))
    )


def encoding_name(content: Column) -> Column:
    mark = F.hex(F.substring(content, 1, 2))
    return F.when(mark.isin("FFFE", "FEFF"), "utf-16").when(F.is_valid_utf8(content.cast("string")), "utf-8").otherwise("latin-1")


def read_texts(files: DataFrame) -> DataFrame:
    return files.select(F.col("path").alias("file"), encoding_name(F.col("content")).alias("encoding"), decode_text(F.col("content")).alias("text"))


def to_lines(texts: DataFrame) -> DataFrame:
    """``(file, line_no, line)``; blank lines count."""
    return texts.select("file", F.posexplode(F.split("text", r"\r\n?|\n", -1)).alias("line_no", "line"))


def read_csv_groups(spark: SparkSession, groups: dict[str, list[str]], null_value: str = "") -> dict[str, DataFrame]:
    """Headered CSV files, one DataFrame per group of equal schema (``DDL -> paths``).

    The schema is given, so Spark reads each file once and pushes column pruning into the parser.
    """
    return {
        ddl: spark.read.option("header", True).option("nullValue", null_value).schema(ddl).csv(paths).withColumn("source_file", F.col("_metadata.file_name"))
        for ddl, paths in groups.items()
    }


def union_groups(groups: dict[str, DataFrame]) -> DataFrame:
    """All groups as one table; columns a group lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), groups.values())


def check_uploads(files: DataFrame, hostile: Column, log_files: bool = False) -> DataFrame:
    """Errors of each file: size, extension, MIME type of the extension, hostile content."""
    marked = file_info(files, LOG_EXTENSIONS if log_files else UPLOAD_EXTENSIONS, hostile.alias("hostile"))
    cap = MAX_LOG_MB if log_files else MAX_UPLOAD_MB
    mime = F.try_element_at(F.create_map(*[F.lit(x) for kv in MIME_TYPES.items() for x in kv]), F.col("extension"))
    errors = F.array_compact(F.array(
        F.when(F.col("size_bytes") > cap * 1048576, F.concat(F.lit("File too large (max: "), F.lit(str(cap)), F.lit("MB)"))),
        F.when(~F.col("is_supported_type"), F.concat(F.lit("File type not allowed: "), F.col("extension"))),
        F.when(mime.isNull(), F.lit("Detected file type not allowed")), F.when(F.col("hostile"), F.lit("File contains potentially malicious content")),
    ))
    return marked.select("path", "filename", "extension", "size_mb", F.coalesce(mime, F.lit("application/octet-stream")).alias("mime_type"), errors.alias("errors"), (F.size(errors) == 0).alias("is_valid"))
