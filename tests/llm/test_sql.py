"""Queries of this subpackage that SQL can express, against DuckDB on the smallest tables and on odd rows."""

import os
import random

import duckdb
import numpy as np
import pytest

from kindred.llm import mixing, near, quality, queries

SF = "/root/testdata/sf0.001"


def canonical(df):
    def text(v):
        if v is None or v != v:
            return "None"
        return repr(float(v)) if isinstance(v, (float, np.floating)) else str(v)

    return sorted(map(tuple, df[sorted(df.columns)].astype(object).map(text).values.tolist()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "labels", "embeddings", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours, theirs = queries.QUERIES[name](spark, SF).toPandas(), c.execute(queries.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and canonical(ours) == canonical(theirs)


@pytest.mark.parametrize("seed", [1, 2])
def test_odd_documents(spark, tmp_path, seed):
    """Nulls, white space, repeated rows, upper case, symbols and copies: mixing, quality and near dedup."""
    r = random.Random(seed)
    words = [f"Word{k}" for k in range(60)] + ["x#y", "$$$", "ÄÖ", "z!", "a\tb", "\n", "\n\n"]
    base = [" ".join(r.choices(words, k=r.randint(0, 90))) for _ in range(40)]
    rows = [(i, r.choice([*base, None, "", "  \n"]), r.choice(["en", "de", None]), r.choice(["s", "T", None, "é"])) for i in range(150)]
    rows += [rows[3]] * 30 + [(k, base[0].lower() + " tail", "en", "s") for k in (500, 501)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int("$" not in (t or "")), 0) for i, t, *_ in rows[:140]], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/d")
    labels.write.parquet(f"{tmp_path}/l")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    c.execute(f"CREATE VIEW labels AS SELECT * FROM '{tmp_path}/l/*.parquet'")
    for ours, sql in ((mixing.result(docs), mixing.SQL), (quality.result(docs, labels), quality.SQL), (near.grouped(docs), near.SQL)):
        assert canonical(ours.toPandas()) == canonical(c.execute(sql).df())
