"""Jobs in shards that can stop and resume, and tables that are sealed: data first, then a manifest with what it must hold.

A shard or sealed table is a folder of Parquet files named by its build and one line of JSON beside it, written last through
Spark's committers. What has no manifest does not exist: a broken job leaves files that nothing names, and the next run
writes the shards that are missing. Every manifest carries the identity of the inputs, so parts of different runs never mix.
"""

from __future__ import annotations

import hashlib
import importlib.metadata
import json
import os
import platform
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.sources.tsv import DataError, digest

PACKAGES = ("pyspark", "pyarrow", "pandas", "numpy")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Whole or not at all, wherever the folder lies: a file beside it is written and takes its name."""
    fs, p = _fs(spark, path)
    _, temporary = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(temporary, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(temporary, p):
        raise OSError(f"could not write {path}")


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(name, bytes, time of change) of a file or of the files in a folder, by name."""
    fs, p = _fs(spark, path)
    return sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(p) if not s.isDirectory())


def code_digest() -> str:
    """Of this package's sources."""
    root, h = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), hashlib.sha256()
    for folder, _, names in sorted(os.walk(root)):
        for name in sorted(names):
            if name.endswith(".py") and os.sep + "llm" not in folder:
                with open(os.path.join(folder, name), "rb") as f:
                    h.update(name.encode() + b"\0" + f.read())
    return h.hexdigest()


def packages() -> dict[str, str]:
    return {p: importlib.metadata.version(p) for p in PACKAGES} | {"python": platform.python_version()}


def identity(spark: SparkSession, inputs: dict[str, str], config: dict | None = None) -> str:
    """A digest of the inputs' contents (by row, whatever the files), of a configuration, of the code and of the packages."""
    contents = {name: tuple(digest(spark.read.text(path)).first()) for name, path in sorted(inputs.items())}
    body = json.dumps([contents, config or {}, code_digest(), packages()], sort_keys=True, default=str)
    return hashlib.sha256(body.encode()).hexdigest()


def require(found: dict, expected: dict, what: str) -> None:
    wrong = {k: (found.get(k), v) for k, v in expected.items() if found.get(k) != v}
    if wrong:
        raise DataError(f"{what} does not fit: {wrong}")


def seal(df: DataFrame, path: str, identity_: str, **facts) -> dict:
    """Writes df and then its manifest (rows, content digest, columns, identity, facts); a sealed table is never overwritten."""
    spark = df.sparkSession
    if exists(spark, f"{path}/manifest.json"):
        raise DataError(f"{path} is sealed already")
    build = uuid.uuid4().hex[:12]
    df.write.parquet(f"{path}/{build}")
    n = digest(spark.read.schema(df.schema).parquet(f"{path}/{build}")).first()
    manifest = {"build": build, "rows": n["rows"], "digest": n["digest"], "columns": df.columns, "identity": identity_, **facts}
    write_text(spark, f"{path}/manifest.json", json.dumps(manifest, sort_keys=True))
    return manifest


def manifest(spark: SparkSession, path: str) -> dict | None:
    return json.loads(read_text(spark, f"{path}/manifest.json")) if exists(spark, f"{path}/manifest.json") else None


def open_sealed(spark: SparkSession, path: str, identity_: str | None = None, check: bool = True, **facts) -> DataFrame:
    """The table of a sealed folder; another identity or fact is an error, and so (check) is another content."""
    m = manifest(spark, path)
    if m is None:
        raise DataError(f"{path} is not sealed")
    require(m, facts | ({"identity": identity_} if identity_ else {}), path)
    df = spark.read.parquet(f"{path}/{m['build']}").select(m["columns"])
    if check:
        n = digest(df).first()
        require({"rows": n["rows"], "digest": n["digest"]}, {"rows": m["rows"], "digest": m["digest"]}, path)
    return df


# Pair tables: keys by name, features as one array of single-precision numbers


def seal_pairs(pairs: DataFrame, path: str, names: tuple[str, ...], identity_: str, keys: tuple[str, ...] = ("s1", "target", "label"), **facts) -> dict:
    """The pairs' keys and features (in the order of names); a pair that stands twice is an error."""
    twice = pairs.groupBy("s1", "target").count().filter("count > 1").limit(1).collect()
    if twice:
        raise DataError(f"pair {tuple(twice[0])[:2]} stands twice")
    x = F.array(*[F.col(n).cast("float") for n in names]).alias("features")
    return seal(pairs.select(*keys, x), path, identity_, features=list(names), **facts)


def open_pairs(spark: SparkSession, path: str, names: tuple[str, ...], identity_: str | None = None, **facts) -> DataFrame:
    """Sealed pairs with their features as columns again."""
    df = open_sealed(spark, path, identity_, features=list(names), **facts)
    return df.select(*[c for c in df.columns if c != "features"], *[F.get("features", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)])


def by_entity(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """(s1, n, positives) for every record of entities (s1), those without pairs included; a pair of another record is an error when read."""
    counted = pairs.groupBy("s1").agg(F.count("*").alias("n"), F.sum("label").alias("positives"))
    out = entities.select("s1", F.lit(True).alias("known")).join(counted, "s1", "full")
    name = F.when(F.col("known"), F.col("s1")).otherwise(F.raise_error(F.concat(F.lit("pairs of an unexpected record "), "s1")).cast("string"))
    return out.select(name.alias("s1"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("positives", F.lit(0)).alias("positives"))


# Shards


def shard_of(key: str, shards: int):
    """The shard of a record: by its id alone, so a record never moves when others come or go."""
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def run(entities: DataFrame, job: Callable[[DataFrame], DataFrame], path: str, shards: int, identity_: str, only: int | None = None, key: str = "s1") -> list[int]:
    """Runs job on the records of each shard that is not sealed yet (or of one) and seals its result; returns the shards written. A shard of another identity is an error."""
    spark, done = entities.sparkSession, []
    for k in range(shards) if only is None else [only]:
        m = manifest(spark, f"{path}/shard-{k}")
        if m:
            require(m, {"identity": identity_, "shard": k, "shards": shards}, f"{path}/shard-{k}")
            continue
        mine = entities.filter(shard_of(key, shards) == k)
        seal(job(mine), f"{path}/shard-{k}", identity_, shard=k, shards=shards, entities=mine.count())
        done.append(k)
    return done


def missing(spark: SparkSession, path: str, shards: int, identity_: str) -> list[int]:
    out = []
    for k in range(shards):
        m = manifest(spark, f"{path}/shard-{k}")
        if m:
            require(m, {"identity": identity_, "shard": k, "shards": shards}, f"{path}/shard-{k}")
        else:
            out.append(k)
    return out


def merged(spark: SparkSession, path: str, shards: int, identity_: str, entities: DataFrame | None = None, key: str = "s1", unique: tuple[str, ...] = ()) -> DataFrame:
    """All shards as one table. Checked: every shard sealed with this identity and its content whole, the numbers of records, records in their own shard, no repeated `unique` columns, and, with entities, that these are exactly the records."""
    if left := missing(spark, path, shards, identity_):
        raise DataError(f"{path}: shards {left} are missing")
    out, total = None, 0
    for k in range(shards):
        total += manifest(spark, f"{path}/shard-{k}")["entities"]
        part = open_sealed(spark, f"{path}/shard-{k}", identity_)
        if part.filter(shard_of(key, shards) != k).limit(1).count():
            raise DataError(f"{path}/shard-{k} holds a record of another shard")
        out = part if out is None else out.unionByName(part)
    if unique and out.groupBy(*unique).count().filter("count > 1").limit(1).count():
        raise DataError(f"{path}: repeated {unique}")
    if entities is not None:
        if total != entities.count():
            raise DataError(f"{path}: the shards were made for {total} records")
        foreign = out.select(key).distinct().join(entities.select(F.col(key)), key, "left_anti").limit(1).collect()
        if foreign:
            raise DataError(f"{path}: {foreign[0][0]} is not asked for")
    return out
