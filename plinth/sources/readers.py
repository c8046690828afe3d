"""Sources with explicit schemas, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
MANIFEST = "url string, ok boolean, status int, kind string, path string, bytes long, fetched_at string, subject string, number string, poid string, tier string, name string"
SECTION = (
    "struct<term:string,term_code:string,component:string,section:string,class_id:string,capacity:int,"
    "meetings:array<struct<date_start:string,date_end:string,days:array<string>,time_start:string,time_end:string>>,schedule_note:string,instructor:string,location:string>"
)
COURSE = (
    "course_id string, subject string, catalog_number string, title string, credits double, faculty string, career string, units_string string, description_raw string, prereq_raw string, coreq_raw string, "
    f"credit_exclusion_raw string, terms_offered array<string>, source_url string, fetched_at string, sections array<{SECTION}>, note_raw string, term_notes map<string,string>, meta_sections int, meta_sections_online int"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, html), a row for each file; bytes that aren't UTF-8 become replacement characters."""
    return spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("html"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The last successful entry of each url of a JSON-lines log; blank and broken lines are skipped."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line")).where(F.trim("value") != "")
    rows = lines.select("line", F.from_json("value", MANIFEST).alias("r")).where("r.ok and r.url is not null")
    return latest(rows.select("line", "r.*"), "url", F.col("line")).drop("line")


def latest(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """The row of each key with the largest order."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("r")).select(key, "r.*")


def courses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COURSE).json(path)


def with_listing(manifest_: DataFrame, listing: DataFrame) -> DataFrame:
    """Files of the manifest and of a listing (path), the manifest's columns first; subject and number from 'subject__number' in the name."""
    stem = F.regexp_extract("path", "([^/]+?)(?:\\.[^.]*)?$", 1)
    own = listing.select("path", F.get(F.split(stem, "__"), F.lit(0)).alias("stem_subject"), F.get(F.split(stem, "__"), F.lit(1)).alias("stem_number"))
    out = manifest_.join(own, "path", "full_outer")
    return out.withColumns({"subject": F.coalesce("subject", "stem_subject"), "number": F.coalesce("number", "stem_number")}).drop("stem_subject", "stem_number")


def allowed(url: Column, denied: list[str]) -> Column:
    """Whether no denied prefix begins the url's path."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    out = F.lit(True)
    for p in denied:
        out &= ~F.startswith(path, F.lit(p))
    return out


def first_per_key(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """At most n rows of each key (a crawl's limit), the first by order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("__n") <= n).drop("__n")


def write_json(df: DataFrame, path: str, partition: str | None = None) -> None:
    """JSON lines; nulls are written."""
    w = df.write.mode("overwrite").option("ignoreNullFields", "false")
    (w.partitionBy(partition) if partition else w).json(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_snapshot(df: DataFrame, path: str) -> None:
    """A snapshot partition; a query for one snapshot reads only it."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """One file with a header, for small reports."""
    df.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def markdown(df: DataFrame, most: int = 200) -> str:
    """A small table as Markdown, all its rows; ValueError if it has more than ``most``."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the table has more than {most} rows")
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join("" if x is None else str(x) for x in r) + " |" for r in rows)])
