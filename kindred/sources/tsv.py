"""Tab-separated sources and sinks with strict checks, selections by id, and manifests of stored tables."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.sources.store import numbered, stored

RECORD = ("entity_id", "business_name", "business_address", "country")
TRUTH = ("source1_entity_id", "matched_entity_ids")
CANDIDATES = ("source1_entity_id", "candidate_entity_ids")
INDEX_VERSION = 1


class DataError(ValueError):
    """A file or table breaks its contract."""


def check_schema(columns: list[str], expected: tuple[str, ...]) -> None:
    """Exact names in exact order."""
    if tuple(columns) != tuple(expected):
        missing, extra = sorted(set(expected) - set(columns)), sorted(set(columns) - set(expected))
        raise DataError(f"columns are {list(columns)}, not {list(expected)}; missing {missing}, unexpected {extra}")


def read_tsv(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """All strings; empty fields are '', the text NA stays; no quoting; a wrong header or field count is an error."""
    head = spark.read.text(path).limit(1).first()
    check_schema(head[0].split("\t") if head else [], columns)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns] + [T.StructField("_corrupt", T.StringType())])
    df = spark.read.csv(path, sep="\t", header=True, schema=schema, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", enforceSchema=True, quote="", encoding="UTF-8")
    bad = F.raise_error(F.concat(F.lit(f"malformed line in {path}: "), F.col("_corrupt")))
    return df.select(*[F.when(F.col("_corrupt").isNotNull(), bad.cast("string")).otherwise(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in columns])


def read_typed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a table that write_tsv wrote, with their types again; a field that does not fit is an error."""
    head = spark.read.text(path).limit(1).first()
    check_schema(head[0].split("\t") if head else [], tuple(schema.names))
    return spark.read.csv(path, sep="\t", header=True, schema=schema, mode="FAILFAST", quote="", nullValue="")


def bad_ids(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """One row: how many ids are empty or lack the prefix, and the five smallest."""
    wrong = df.filter(F.coalesce(~F.col(column).startswith(f"{prefix}-"), F.lit(True)) | (F.col(column) == f"{prefix}-"))
    return wrong.agg(F.count("*").alias("n")).join(wrong.orderBy(column).limit(5).agg(F.array_sort(F.collect_list(F.coalesce(column, F.lit("")))).alias("examples")))


def check_prefix(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """df itself, with the check inside the plan: the scan that reads a bad id fails and names it."""
    ok = F.col(column).startswith(f"{prefix}-") & (F.length(column) > len(prefix) + 1)
    return df.withColumn(column, F.when(F.coalesce(ok, F.lit(False)), F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"{column} must start with {prefix}-: "), F.coalesce(column, F.lit("null")))).cast("string")))


def read_source(spark: SparkSession, path: str, source: str) -> DataFrame:
    return check_prefix(read_tsv(spark, path, RECORD), "entity_id", source).withColumn("source", F.lit(source))


def parse_targets(raw: Column) -> Column:
    """The sorted ids of a comma list; an empty cell is an empty list; an empty item, a foreign prefix or a repeated id is an error."""
    items = F.transform(F.split(raw, ","), lambda x: F.trim(x))
    empty = F.trim(raw) == ""
    valid = F.forall(items, lambda x: x.rlike(r"^S[23]-.+$")) & (F.size(F.array_distinct(items)) == F.size(items))
    error = F.raise_error(F.concat(F.lit("invalid list of matched ids: "), raw)).cast("array<string>")
    return F.when(empty, F.array().cast("array<string>")).when(valid, F.array_sort(items)).otherwise(error)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(s1, targets); every reference record once, those without matches included."""
    raw = check_prefix(read_tsv(spark, path, TRUTH), "source1_entity_id", "S1")
    df = raw.select(F.col("source1_entity_id").alias("s1"), parse_targets(F.col("matched_entity_ids")).alias("targets"))
    check_unique(df, "s1")
    return df


def truth_errors(spark: SparkSession, path: str) -> DataFrame:
    """(line, error, text) of a truth file's broken lines, the header as line 1. Lines are counted in two levels, within the blocks that tasks read and over blocks, so that a file of any size is read in parallel."""
    lines = spark.read.text(path).select(F.col("value").alias("text"), F.input_file_name().alias("_file"), F.input_file_block_start().alias("_block"), F.monotonically_increasing_id().alias("_at"))
    lines = stored(lines)
    own = F.row_number().over(Window.partitionBy("_file", "_block").orderBy("_at"))
    counts = lines.groupBy(F.col("_file").alias("f"), F.col("_block").alias("b")).agg(F.count("*").alias("n"))
    counts = counts.withColumn("before", F.sum("n").over(Window.partitionBy("f").orderBy("b")) - F.col("n")).drop("n")
    rows = lines.withColumn("own", own).join(counts, (F.col("_file") == F.col("f")) & (F.col("_block") == F.col("b"))).withColumn("line", F.col("own") + F.col("before"))
    cells = F.split("text", "\t")
    rows = rows.select("_file", "line", "text", F.get(cells, F.lit(0)).alias("s1"), F.get(cells, F.lit(1)).alias("ids"), F.size(cells).alias("n"))
    items = F.transform(F.split("ids", ","), lambda x: F.trim(x))
    some = F.trim("ids") != ""
    header = (F.col("line") == 1) & (F.col("text") == "\t".join(TRUTH))
    error = F.when(F.col("n") != 2, "not two fields").when(~F.col("s1").rlike("^S1-.+"), "wrong id").when(some & F.exists(items, lambda x: x == ""), "empty item")
    error = error.when(some & F.exists(items, lambda x: ~x.rlike("^S[23]-.+")), "wrong prefix").when(some & (F.size(F.array_distinct(items)) < F.size(items)), "repeated item")
    first = rows.filter(~header).groupBy("s1").agg(F.min("line").alias("first"))
    again = rows.filter(~header).join(first, "s1", "left").withColumn("error", F.coalesce(error, F.when(F.col("line") > F.col("first"), "repeated record")))
    return again.filter("error IS NOT NULL").select("line", "error", "text")


def check_unique(df: DataFrame, *keys: str) -> None:
    twice = df.groupBy(*keys).count().filter("count > 1").orderBy(*keys).limit(5).collect()
    if twice:
        raise DataError(f"repeated {', '.join(keys)}: {[tuple(r)[:-1] for r in twice]}")


def select_ids(df: DataFrame, ids: DataFrame, column: str = "entity_id", require_all: bool = True) -> DataFrame:
    """Rows whose id is asked for; an id that is not there is an error. ids: one column of that name."""
    if require_all:
        missing = [r[0] for r in ids.join(df, column, "left_anti").select(column).orderBy(column).limit(5).collect()]
        if missing:
            raise DataError(f"{column} not found: {missing}")
    return df.join(ids.select(column).distinct(), column, "left_semi")


def positioned(df: DataFrame, *order: str, limit: int | None = None) -> DataFrame:
    """df with `position` from 0 in the given order, without a task that holds all rows."""
    out = numbered(df, [], *order)
    return out if limit is None else out.filter(F.col("position") < limit)


def id_list(ids: Column) -> Column:
    """Sorted distinct ids, comma-separated; '' for none."""
    return F.array_join(F.array_sort(F.array_distinct(F.coalesce(ids, F.array().cast("array<string>")))), ",")


def submission(entities: DataFrame, links: DataFrame, column: str = "matched_entity_ids") -> DataFrame:
    """A row for every reference record in entities (s1), with the list of its targets in links (s1, target)."""
    lists = links.groupBy("s1").agg(F.collect_set("target").alias("t"))
    return entities.select("s1").distinct().join(lists, "s1", "left").select(F.col("s1").alias("source1_entity_id"), id_list(F.col("t")).alias(column))


def write_tsv(df: DataFrame, path: str, compression: str = "none") -> None:
    """Header, tabs, no quoting."""
    df.write.mode("overwrite").csv(path, sep="\t", header=True, quote="", emptyValue="", nullValue="", escapeQuotes=False, compression=compression)


def write_json(path: str, value: object) -> None:
    """Whole or not at all: a temporary file beside it takes its name."""
    fd, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(fd, "w") as f:
        json.dump(value, f, sort_keys=True, indent=1)
    os.replace(temporary, path)


def digest(df: DataFrame) -> DataFrame:
    """One row (rows, digest): a content digest that the rows' order and partitions do not change. It adds up 60 bits of each row's MD5; nulls and the bounds of values have marks of their own."""
    value = [F.coalesce(F.col(c).cast("string") if t != "binary" else F.hex(c), F.lit("\x1e")) for c, t in ((f"`{c}`", t) for c, t in df.dtypes)]
    row = F.conv(F.substring(F.md5(F.concat_ws("\x1f", *value)), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(row), F.lit(0).cast("decimal(38,0)")).cast("string").alias("digest"))


def fingerprint(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def store_index(tables: dict[str, DataFrame], path: str, source: str, extra: dict | None = None) -> None:
    """Tables as Parquet in new folders of path; the manifest, written last, names them, so a broken build is never opened."""
    build, spark = uuid.uuid4().hex[:12], next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.parquet(f"{path}/{build}/{name}")
    manifest = {"version": INDEX_VERSION, "source": source, "build": build, "tables": sorted(tables), **(extra or {})}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "manifest string").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def open_index(spark: SparkSession, path: str, source: str, expect: dict | None = None) -> dict[str, DataFrame]:
    manifest = json.loads(spark.read.parquet(f"{path}/manifest").first()[0])
    wrong = {k: (manifest.get(k), v) for k, v in {"version": INDEX_VERSION, "source": source, **(expect or {})}.items() if manifest.get(k) != v}
    if wrong:
        raise DataError(f"index does not fit: {wrong}")
    return {t: spark.read.parquet(f"{path}/{manifest['build']}/{t}") for t in manifest["tables"]}
