"""File readers: every text file is read as text first, then cast by an explicit map."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatlake import constants as C
from threatlake.functions import activity as A
from threatlake.functions import labels as L
from threatlake.functions.numbers import cast_by_map
from threatlake.functions.times import parse_flow_time, parse_log_time, parse_text
from threatlake.operators.filters import union_all


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def normalize_name(name: str) -> str:
    return re.sub(r"[ /.\-]", "_", name.strip().lower())


def normalize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[normalize_name(c) for c in df.columns])


def strip_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def file_day(path: Column) -> Column:
    """Weekday in a file name, 'Unknown' without one."""
    found = F.regexp_extract(path, "(" + "|".join(C.WEEKDAYS) + ")", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("Unknown"))


def read_text_csv(
    spark: SparkSession, path, columns: list[str] | None = None, encoding: str = "UTF-8",
    tag: str | None = None, nan_is_null: bool = False, multiline: bool = False,
) -> DataFrame:
    """CSV with every column as text; short rows are padded with NULL, names are stripped.

    A quote inside quoted text is doubled and a backslash is an ordinary letter. ``columns`` states the header in
    file order, so no file is opened to find it. ``tag`` adds the weekday of the file name under that name;
    ``nan_is_null`` reads the text 'nan' as NULL; ``multiline`` admits line ends inside quotes (files are then not split).
    """
    reader = spark.read.options(header=True, mode="PERMISSIVE", encoding=encoding, quote='"', escape='"', multiLine=multiline)
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).option("enforceSchema", True)
    df = reader.csv(path)
    names = [c.strip() for c in df.columns]
    extra = [file_day(F.col("_metadata.file_name")).alias(tag)] if tag else []

    def value(raw):
        text = F.col(f"`{raw}`").cast("string")
        return F.nullif(text, F.lit("nan")) if nan_is_null else text

    return df.select(*[value(raw).alias(name) for raw, name in zip(df.columns, names)], *extra)


def union_days(frames: list[DataFrame], keep: list[str]) -> DataFrame:
    """One table from day files, wanted columns only."""
    return union_all([f.select(*[F.col(f"`{c}`") for c in keep]) for f in frames])


def reconcile(union: DataFrame, frames: list[DataFrame]) -> DataFrame:
    """Rows of the union against the sum over its parts."""
    parts = union_all([f.agg(F.count("*").alias("n")) for f in frames]).agg(F.sum("n"))
    return union.agg(F.count("*").alias("rows")).select(
        "rows", parts.scalar().alias("expected")).withColumn("matches", F.col("rows") == F.col("expected"))


_IDENTITY = ("Flow ID", "Source IP", "Destination IP")
_SMALL = ("Source Port", "Destination Port", "Protocol")
_LONG_WORDS = ("IAT", "Active", "Idle")


def flow_types() -> dict[str, str]:
    """Cast map of a flow file: text identity, whole counters, long times, double statistics."""
    types = {name: "string" for name in _IDENTITY} | {name: "int" for name in _SMALL}
    for source, name in C.FLOW_COLUMNS.items():
        if name in C.DOUBLE_MEASURES:
            types[source] = "double"
        elif name in C.FLOW_FEATURES:
            types[source] = "bigint" if source.split()[0] in _LONG_WORDS or "IAT" in source else "int"
    return types


def clean_flows(raw: DataFrame, day: str = "source_day", padded_day: str = "Monday") -> DataFrame:
    """Typed flow rows with cleaned label, family, attack flag and parsed time; one projection."""
    label = F.col("Label")
    marked = raw.withColumns({
        "event_time_raw": F.col("Timestamp"),
        "event_time": parse_flow_time(F.col("Timestamp"), F.col(day), padded_day),
        "label_clean": L.label_clean(label), "attack_family": L.attack_family(label), "is_attack": L.is_attack(label),
    })
    types = {name: kind for name, kind in flow_types().items() if name in set(raw.columns)}
    return cast_by_map(marked, types, ("event_time_raw", "event_time", "label_clean", "attack_family", "is_attack", day))


# ---- user activity logs ------------------------------------------------------------------------

def _unified(df: DataFrame, **columns: Column) -> DataFrame:
    base = {"event_id_src": F.col("id"), "event_time": parse_log_time(F.col("date")), "user_id": F.col("user"), "pc_id": F.col("pc")}
    types = {"filename": "string", "activity_type": "string"}
    out = {**base, **columns}
    return df.select(*[
        out.get(name, F.lit(None)).cast(types.get(name, "bigint")).alias(name) if name not in base else base[name].alias(name)
        for name in C.ACTIVITY_COLUMNS])


LOGON_COLUMNS = ["id", "date", "user", "pc", "activity"]
EMAIL_COLUMNS = ["id", "date", "user", "pc", "to", "cc", "bcc", "from", "size", "attachments", "content"]
FILE_COLUMNS = ["id", "date", "user", "pc", "filename", "content"]


def read_logon(spark: SparkSession, path) -> DataFrame:
    return _unified(read_text_csv(spark, path, LOGON_COLUMNS), activity_type=F.col("activity"))


def read_device(spark: SparkSession, path) -> DataFrame:
    return _unified(read_text_csv(spark, path, LOGON_COLUMNS), activity_type=A.device_activity(F.col("activity")))


def read_email(spark: SparkSession, path, domain: str = C.CORPORATE_DOMAIN) -> DataFrame:
    """Mail log; the body column is pruned by the CSV parser."""
    return _unified(
        read_text_csv(spark, path, EMAIL_COLUMNS), activity_type=F.lit("Email"),
        email_size=F.col("size").try_cast("bigint"),
        email_recipients_count=A.recipient_count(F.col("to"), F.col("cc"), F.col("bcc")),
        email_attachments_count=F.col("attachments").try_cast("bigint"),
        email_to_external_domain=A.to_external(F.col("to"), domain),
        email_from_external_address=A.from_external(F.col("from"), domain))


def read_file_events(spark: SparkSession, path) -> DataFrame:
    return _unified(
        read_text_csv(spark, path, FILE_COLUMNS), activity_type=F.lit("File_Activity"), filename=F.col("filename"))


def unify_activity(frames: list[DataFrame], sort: bool = False) -> DataFrame:
    """All logs in one schema without unparsed times; ``sort`` orders globally by time."""
    rows = union_all(frames).filter(F.col("event_time").isNotNull())
    return rows.orderBy("event_time") if sort else rows


def _by_name(spark: SparkSession, path) -> DataFrame:
    """CSV files whose headers may differ in order or columns: files of one header are read together, then joined by name."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")
    heads = lines.where("at = 0").groupBy("file").agg(F.first("value").alias("head")).groupBy("head").agg(F.collect_list("file").alias("files")).collect()
    frames = [spark.read.options(header=True, quote='"', escape='"').csv([unquote(f) for f in r.files]).withColumn("_file", F.col("_metadata.file_name")) for r in heads]
    return union_all(frames)


def read_snapshots(spark: SparkSession, path) -> DataFrame:
    """Monthly directory files named YYYY-MM.csv, columns found by each file's own header; any other name is an error, text is trimmed."""
    columns = ["user_id", *C.DIRECTORY_ATTRIBUTES]
    df = _by_name(spark, path)
    name = F.col("_file")
    month = F.regexp_extract(name, r"^(\d{4}-\d{2})\.csv$", 1)
    checked = F.when(month != "", month).otherwise(F.raise_error(F.concat(F.lit("unexpected snapshot file: "), name)))
    day = F.to_date(F.concat(checked, F.lit("-01")))
    have = set(df.columns)
    text = [(F.trim(F.col(c)) if c in have else F.lit(None).cast("string")).alias(C.DIRECTORY_ATTRIBUTES.get(c, c)) for c in columns]
    return df.select(day.alias("snapshot_date"), *text)


def read_insiders(spark: SparkSession, path, dataset: str = "4.2", formats=("M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy")) -> DataFrame:
    """Answer key of one data set, month first by default; rows without both dates are dropped."""
    raw = read_text_csv(spark, path).filter(F.trim("dataset") == dataset)

    def moment(c):
        return F.coalesce(*[parse_text(F.trim(c), fmt) for fmt in formats])

    rows = raw.select(
        F.col("user").alias("user_id"), F.col("scenario").try_cast("int").alias("scenario"),
        moment("start").alias("window_start"), moment("end").alias("window_end"))
    return rows.dropna(subset=["window_start", "window_end"])


def insider_ids(spark: SparkSession, path, prefix: str) -> DataFrame:
    """User ids from answer files named <prefix>USER.csv."""
    name = F.regexp_extract("_metadata.file_name", r"^(.*)\.csv$", 1)
    files = spark.read.format("binaryFile").load(path).select(name.alias("_name"))
    return files.select(F.replace("_name", F.lit(prefix), F.lit("")).alias("user_id")).distinct()


def read_psychometric(spark: SparkSession, path) -> DataFrame:
    raw = read_text_csv(spark, path)
    return raw.select("user_id", *[F.col(c).try_cast("int").alias(f"ocean_{c.lower()}") for c in "OCEAN"])
