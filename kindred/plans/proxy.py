"""Views that turn the driver's tables into sources of a linkage problem. The same text runs in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import text as X

#: Documents as business records: the first eight words of the first line are the name, the next eight the address.
PARTY = """SELECT concat('S', 1 + doc_id % 3, '-', doc_id) AS entity_id, concat('S', 1 + doc_id % 3) AS source,
  regexp_extract(split_part(text, chr(10), 1), '^[^ ]+( +[^ ]+){0,7}', 0) AS business_name,
  regexp_extract(split_part(text, chr(10), 1), '^[^ ]+( +[^ ]+){7} +([^ ]+( +[^ ]+){0,7})', 2) AS business_address,
  lang AS country, left(text, 40) AS fam FROM documents"""
#: Customers as records whose addresses have numbers.
PARTY_NUM = """SELECT concat('S', 1 + c_custkey % 3, '-', c_custkey) AS entity_id, concat('S', 1 + c_custkey % 3) AS source,
  concat(c_mktsegment, ' ', c_nationkey) AS business_name, concat(c_custkey % 97, ' ', c_mktsegment, ' ', 10000 + c_custkey % 53) AS business_address,
  cast(c_nationkey % 3 AS string) AS country, cast(c_custkey % 97 AS string) AS fam FROM customer"""
#: What follows a WITH in DuckDB: records, normalised texts, tokens, truth.
WITH = f"""party AS ({PARTY}),
rep AS (SELECT *, trim(regexp_replace(replace(lower(business_name), 'ß', 'ss'), '[\\p{{P}}\\s]+', ' ', 'g')) AS nn,
  trim(regexp_replace(replace(lower(business_address), 'ß', 'ss'), '[\\p{{P}}\\s]+', ' ', 'g')) AS an FROM party),
tok AS (SELECT *, list_sort(list_distinct(list_filter(string_split(nn, ' '), lambda t: t <> ''))) AS nu, list_sort(list_distinct(list_filter(string_split(an, ' '), lambda t: t <> ''))) AS au FROM rep),
link AS (SELECT a.entity_id AS s1, b.entity_id AS target, b.source, a.country FROM party a JOIN party b ON a.fam = b.fam WHERE a.source = 'S1' AND b.source <> 'S1'),
truth AS (SELECT p.entity_id AS s1, p.country, count(l.target) AS n_true FROM party p LEFT JOIN link l ON l.s1 = p.entity_id WHERE p.source = 'S1' GROUP BY ALL)"""


def party(spark: SparkSession, sf_dir: str, numbers: bool = False) -> DataFrame:
    """entity_id, source, business_name, business_address, country, fam."""
    name = "customer" if numbers else "documents"
    spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(PARTY_NUM if numbers else PARTY)


def links(records: DataFrame) -> DataFrame:
    """(s1, target) of records of one family."""
    a = records.filter("source = 'S1'").select(F.col("entity_id").alias("s1"), "fam")
    return a.join(records.filter("source <> 'S1'").select(F.col("entity_id").alias("target"), "fam"), "fam").select("s1", "target")


def truth(records: DataFrame) -> DataFrame:
    """(s1, targets); a record without its family in other sources has none."""
    lists = links(records).groupBy("s1").agg(F.array_sort(F.collect_set("target")).alias("targets"))
    s1 = records.filter("source = 'S1'").select(F.col("entity_id").alias("s1"))
    return s1.join(lists, "s1", "left").withColumn("targets", F.coalesce("targets", X.no_words()))
