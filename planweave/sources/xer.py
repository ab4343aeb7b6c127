"""Schedule exports: tab-separated text of several tables, one file per source.

Decoding needs Python (UTF-8 with or without mark, else Windows-1252, else
Latin-1); everything after it is DataFrame operations. The state of the
format, current table and current fields, is a forward fill over a file's
lines, so files are independent and any number is read in parallel.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from os import PathLike, fspath

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The tables that are interpreted.
KNOWN_TABLES = ("PROJECT", "PROJWBS", "TASK", "TASKPRED", "CALENDAR")
#: Everything at which a line ends.
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

#: What is said about lines that break the format.
BAD_TABLE = "malformed table declaration"
FIELDS_WITHOUT_TABLE = "field declaration without table"
BAD_FIELDS = "malformed field declaration"
RECORD_WITHOUT_FIELDS = "record without table fields"
LONG_RECORD = "record has more values than declared fields"
SHORT_RECORD = "record has fewer values than declared fields"
UNKNOWN_CONTROL = "unknown control record "
BAD_LINE = "malformed non-XER record"


def decode_bytes(data: bytes) -> str:
    for name in ("utf-8-sig", "cp1252"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            pass
    return data.decode("latin-1")


def decoded(content: Column) -> Column:
    return F.arrow_udf(lambda x: pa.array([None if b is None else decode_bytes(b) for b in x.to_pylist()], pa.string()), "string")(content)


@dataclass
class Exports:
    """records: source_id, table, rec_idx, line_number, fields, values, raw_line, rec (map), extra. diagnostics: source_id, line_number, message, raw_line. tables: source_id, table, also those without records."""

    records: DataFrame
    diagnostics: DataFrame
    sources: DataFrame
    tables: DataFrame

    def table(self, name: str) -> DataFrame:
        return self.records.where(F.col("table") == name)

    @property
    def unknown_tables(self) -> DataFrame:
        return self.records.where(~F.col("table").isin(*KNOWN_TABLES))


def parse_text(texts: DataFrame) -> Exports:
    """Exports from rows of source_id and text."""
    lines = texts.select("source_id", F.posexplode(F.split("text", LINE_ENDS)).alias("at", "raw_line")).where("raw_line <> ''")
    lines = lines.select("source_id", (F.col("at") + 1).alias("line_number"), "raw_line", F.split("raw_line", "\t").alias("cells"))
    lines = lines.withColumn("marker", F.regexp_replace(F.element_at("cells", 1), "^\ufeff+", ""))
    n = F.size("cells")
    name = F.when((F.col("marker") == "%T") & (n == 2), F.upper(F.trim(F.regexp_replace(F.element_at("cells", 2), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))))
    lines = lines.withColumn("declared", F.when(name != "", name))
    by_line = Window.partitionBy("source_id").orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("part", F.sum(F.col("marker").isin("%T", "%E").cast("int")).over(by_line))
    in_part = Window.partitionBy("source_id", "part").orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("table", F.first("declared", ignorenulls=True).over(in_part))
    own = F.when((F.col("marker") == "%F") & F.col("table").isNotNull() & (n > 1), F.slice("cells", 2, n - 1))
    lines = lines.withColumn("fields", F.last(own, ignorenulls=True).over(in_part))
    values, wide = F.slice("cells", 2, n - 1), F.size("fields")
    usable = F.col("table").isNotNull() & F.col("fields").isNotNull()
    said = (
        F.when(F.col("marker") == "%T", F.when(F.col("declared").isNull(), BAD_TABLE))
        .when(F.col("marker") == "%F", F.when(F.col("table").isNull(), FIELDS_WITHOUT_TABLE).when(n < 2, BAD_FIELDS))
        .when(F.col("marker") == "%R", F.when(~usable, RECORD_WITHOUT_FIELDS).when(n - 1 > wide, LONG_RECORD).when(n - 1 < wide, SHORT_RECORD))
        .when(F.col("marker") == "%E", F.lit(None))
        .when(F.col("marker").startswith("%"), F.concat(F.lit(UNKNOWN_CONTROL), "marker"))
        .otherwise(BAD_LINE)
    )
    diagnostics = lines.withColumn("message", said).where("message is not null").select("source_id", "line_number", "message", "raw_line")
    # A table that is declared again replaces the one before, also where the new one has no rows.
    latest = lines.where("declared is not null").groupBy("source_id", F.col("declared").alias("table")).agg(F.max("part").alias("part"))
    rows = lines.where((F.col("marker") == "%R") & usable).join(latest, ["source_id", "table", "part"], "left_semi")
    padded = F.transform("fields", lambda f, i: F.struct(f.alias("key"), F.nullif(F.get(values, i), F.lit("")).alias("value")))
    # Of fields with one name, the last counts: a field is kept if its name does not come again.
    last = F.filter(padded, lambda x, i: ~F.array_contains(F.slice("fields", i + 2, F.size("fields")), x["key"]))
    rows = rows.select(
        "source_id", "table",
        (F.row_number().over(Window.partitionBy("source_id", "table").orderBy("line_number")) - 1).alias("rec_idx"),
        "line_number", "fields", values.alias("values"), "raw_line", F.map_from_entries(last).alias("rec"),
        F.when(n - 1 > wide, F.array_join(F.slice(values, wide + 1, F.greatest(n - 1 - wide, F.lit(0))), "\t")).alias("extra"),
    )
    return Exports(rows, diagnostics, texts.select("source_id"), latest.select("source_id", "table"))


class InvalidExport(ValueError):
    """Input that is no export: empty, too large, or without projects."""


def read_files(spark: SparkSession, *paths: str, max_bytes: int | None = None) -> DataFrame:
    """(path, length, source_id, content) of files; source_id is the SHA-256 of the content. A path that doesn't exist is an error, and so is a file of more than max_bytes."""
    files = spark.read.format("binaryFile").load(list(paths))
    if max_bytes is not None and (large := files.where(F.col("length") > max_bytes).select("path").orderBy("path").limit(5).collect()):
        raise InvalidExport(f"larger than {max_bytes} bytes: {', '.join(r.path for r in large)}")
    return files.select("path", "length", F.sha2("content", 256).alias("source_id"), "content")


def read_exports(spark: SparkSession, *paths: str, max_bytes: int | None = None) -> Exports:
    """Exports from files; source_id is the path."""
    files = read_files(spark, *paths, max_bytes=max_bytes)
    return parse_text(files.select(F.col("path").alias("source_id"), decoded(F.col("content")).alias("text")))


def parse_bytes(spark: SparkSession, exports: dict[str, bytes]) -> Exports:
    """Exports from bytes in memory, by source_id."""
    frame = spark.createDataFrame([(k, bytearray(v)) for k, v in exports.items()], "source_id string, content binary")
    return parse_text(frame.select("source_id", decoded(F.col("content")).alias("text")))


def parse(spark: SparkSession, source: str | bytes | PathLike) -> Exports:
    """An export from bytes, from a path, or from a text: a string that has a line end is a text, any other one is a path."""
    if isinstance(source, bytes | bytearray):
        return parse_bytes(spark, {hashlib.sha256(source).hexdigest(): bytes(source)})
    if isinstance(source, str) and re.search(LINE_ENDS, source):
        frame = spark.createDataFrame([(hashlib.sha256(source.encode("utf-8", "surrogatepass")).hexdigest(), source)], "source_id string, text string")
        return parse_text(frame)
    return read_exports(spark, fspath(source))


def validate(exports: Exports) -> Exports:
    """exports, if there are any and each of them declares projects."""
    declared = exports.tables.where("table = 'PROJECT'").select("source_id")
    if bad := exports.sources.join(declared, "source_id", "left_anti").limit(5).collect():
        raise InvalidExport(f"no project records: {', '.join(str(r.source_id) for r in bad)}")
    if exports.sources.isEmpty():
        raise InvalidExport("no exports")
    return exports


def uploadable(files: DataFrame, max_bytes: int = 25 << 20) -> DataFrame:
    """files (path, length) with `refused`: why a file would not be taken, else null."""
    return files.withColumn(
        "refused", F.when(~F.lower("path").endswith(".xer"), "not an .xer file").when(F.col("length") > max_bytes, "too large").when(F.col("length") == 0, "empty")
    )


def synthetic_export(spark: SparkSession, activities: int) -> DataFrame:
    """source_id and text of an export of one project with that many activities and edges to the three after each."""
    ids = spark.range(activities)
    heads = [
        (0, 0, "%T\tPROJECT\n%F\tproj_id\tproj_name\n%R\tBENCH\tBenchmark\n%T\tPROJWBS\n%F\twbs_id\tproj_id\twbs_name\n%R\tW\tBENCH\tWork\n%T\tTASK\n%F\ttask_id\tproj_id\twbs_id\ttask_name\ttask_type"),
        (2, 0, "%T\tTASKPRED\n%F\ttask_id\tpred_task_id\tpred_type\tlag_hr_cnt"),
        (4, 0, "%E\n"),
    ]
    head = spark.createDataFrame(heads, "part int, at long, line string")
    tasks = ids.select(F.lit(1).alias("part"), F.col("id").alias("at"), F.format_string("%%R\tA%d\tBENCH\tW\tActivity %d\tTT_Task", "id", "id").alias("line"))
    edges = ids.withColumn("step", F.explode(F.array(*map(F.lit, (1, 2, 3))))).where("id >= step")
    edges = edges.select(F.lit(3).alias("part"), (F.col("step") * activities + F.col("id")).alias("at"), F.format_string("%%R\tA%d\tA%d\tPR_FS\t0", "id", F.col("id") - F.col("step")).alias("line"))
    rows = head.unionByName(tasks).unionByName(edges)
    joined = rows.groupBy(F.lit("synthetic").alias("source_id")).agg(F.array_sort(F.collect_list(F.struct("part", "at", "line"))).alias("x"))
    return joined.select("source_id", F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("text"))
