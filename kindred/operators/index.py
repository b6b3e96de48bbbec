"""The source side's inverted index: exact keys, postings, document frequencies, populations. Country is part of every key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions import text as X
from kindred.sources.store import stored


def keys(records: DataFrame) -> DataFrame:
    """(source, country, pass, value, target): exact name, exact address and sorted-token signature of represented records; empty values have no key."""
    each = F.array(
        F.struct(F.lit("exact_name").alias("pass"), F.col("name.norm").alias("value")),
        F.struct(F.lit("exact_address").alias("pass"), F.col("address.norm").alias("value")),
        F.struct(F.lit("name_signature").alias("pass"), F.array_join("name.uniq", " ").alias("value")),
    )
    return records.select("source", "country", F.col("entity_id").alias("target"), F.explode(each).alias("k")).select("source", "country", "k.pass", "k.value", "target").filter("value <> ''")


def postings(records: DataFrame) -> DataFrame:
    """(source, country, field, token, target), each token of a field once a record."""
    def of(field: str) -> Column:
        return F.transform(f"{field}.uniq", lambda t: F.struct(F.lit(field).alias("field"), t.alias("token")))

    each = F.concat(of("name"), of("address"))
    return records.select("source", "country", F.col("entity_id").alias("target"), F.explode(each).alias("p")).select("source", "country", "p.field", "p.token", "target")


def token_df(posted: DataFrame) -> DataFrame:
    return posted.groupBy("source", "country", "field", "token").agg(F.count("*").alias("df"))


def populations(records: DataFrame) -> DataFrame:
    return records.groupBy("source", "country").agg(F.count("*").alias("population"))


def idf(df: Column, population: Column) -> Column:
    """ln((population + 1) / (df + 1)) + 1; a token that is not there has df 0 and so the greatest weight."""
    return F.log((F.coalesce(population, F.lit(0)) + 1) / (F.coalesce(df, F.lit(0)) + 1)) + 1.0


def build(records: DataFrame, secondary: bool = False) -> dict[str, DataFrame]:
    """All tables of the index from records (entity_id, business_name, business_address, country, source). The texts are represented once (secondary: name2 and address2 too): the tables are lazy, what they are made of is stored."""
    r = stored(X.enhanced(X.represented(records)) if secondary else X.represented(records))
    posted = postings(r)
    return {"records": r, "keys": keys(r), "postings": posted, "token_df": token_df(posted), "populations": populations(r)}


def materialised(idx: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The index with every table stored, for queries that read them several times. Tables with rows for each record are not broadcast: files of repeated words say little of their size in memory."""
    tables = {name: df if name == "records" else stored(df) for name, df in idx.items()}
    return tables | {name: tables[name].hint("merge") for name in ("records", "keys", "postings")}
