"""Chat formatting with cumulative-snapshot collapse.

Logs often hold a conversation again after every turn. A conversation goes if another one continues it, and of equal ones
the smallest conv_id stays. A prefix is known by its number of turns and two sums of 64-bit hashes of (place, role, text)
over its turns: each turn's sums are the hashes of the prefix that it ends. The last sums of each conversation are
anti-joined with the sums of all proper prefixes; both sides are first made distinct, so a first turn or a whole
conversation that a third of the log repeats is one row. Places and sums are taken in two levels, by `part` (1,024 turn
numbers) and over parts, so that a conversation of any length is never in one task; a long one is rendered in parts.

Defined cases: turns stand in the order of turn (null last), role and text, and repeated rows are turns of their own; a
null role or text is an empty one; rows without a conv_id are one conversation (kept only if no other equals it); an empty
table gives an empty result; other columns have no effect. Marks that look like the template's own are broken up in texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import stored

PART = 1024


def rendered(role: Column, text: Column) -> Column:
    """One turn: <|role|>, a line break, the text, <|end|>, a line break."""
    plain = lambda x: F.replace(x, F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit("<|"), plain(role), F.lit("|>\n"), plain(text), F.lit("<|end|>\n"))


def prefixes(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), n_turns, h1, h2, and role and text: every turn with the hashes of the prefix that it ends."""
    t = conversations.select(F.col("conv_id").cast("bigint"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_last(), "role", "text", "own"]
    ranged = t.withColumn("own", F.monotonically_increasing_id()).orderBy(*order)
    t = stored(ranged.select("conv_id", "role", "text", F.monotonically_increasing_id().alias("at")))  # `at` rises along the sorted table
    t = t.withColumn("stretch", F.shiftright("at", 33))
    inner = Window.partitionBy("conv_id", "stretch").orderBy("at")
    outer = Window.partitionBy("conv_id").orderBy("stretch")

    def before(rows: DataFrame, sums: dict[str, Column]) -> DataFrame:
        """rows with, for each sum, what the conversation's earlier stretches hold (b_…) and what all do (n_…)."""
        per = rows.groupBy("conv_id", "stretch").agg(*[v.alias(k) for k, v in sums.items()])
        exact = lambda c, k: c.cast("bigint" if k == "n" else "decimal(38,0)")
        per = per.select(F.col("conv_id").alias("c"), F.col("stretch").alias("s"), *[exact(F.sum(k).over(outer) - F.col(k), k).alias(f"b_{k}") for k in sums], *[exact(F.sum(k).over(Window.partitionBy("conv_id")), k).alias(f"n_{k}") for k in sums])
        return rows.join(per, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("stretch") == F.col("s"))).drop("c", "s")

    t = before(t, {"n": F.count("*")}).withColumn("place", F.row_number().over(inner) + F.col("b_n"))
    for k in (1, 2):  # sums of 64-bit numbers, exact in 38 digits
        t = t.withColumn(f"x{k}", F.xxhash64(F.lit(k), "place", "role", "text").cast("decimal(38,0)"))
    t = stored(t.withColumn("s1", F.sum("x1").over(inner).cast("decimal(38,0)")).withColumn("s2", F.sum("x2").over(inner).cast("decimal(38,0)")).drop("b_n"))
    t = before(t, {"t1": F.sum("x1").cast("decimal(38,0)"), "t2": F.sum("x2").cast("decimal(38,0)")})
    return t.select("conv_id", "place", F.col("n_n").alias("n_turns"), *[(F.col(f"s{k}") + F.col(f"b_t{k}")).cast("decimal(38,0)").alias(f"h{k}") for k in (1, 2)], "role", "text")


def maximal(marked: DataFrame) -> DataFrame:
    """(conv_id, copies) of the conversations that no other continues; copies: how many are equal to it, itself included."""
    key = ["place", "h1", "h2"]
    whole = marked.filter("place = n_turns").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    proper = marked.filter("place < n_turns").select(*key).distinct()
    return whole.join(proper, key, "left_anti").select("conv_id", "copies")


def formatted(conversations: DataFrame) -> DataFrame:
    """A row per maximal conversation and part: conv_id, part, n_turns (of the conversation), copies, text."""
    marked = stored(prefixes(conversations))
    kept = stored(maximal(marked)).withColumnRenamed("conv_id", "kept_id")
    turns = marked.join(kept, F.col("conv_id").eqNullSafe(F.col("kept_id"))).withColumn("part", F.floor((F.col("place") - 1) / PART).cast("bigint"))
    lines = turns.groupBy("conv_id", "part", "n_turns", "copies").agg(F.array_sort(F.collect_list(F.struct("place", rendered(F.col("role"), F.col("text")).alias("line")))).alias("lines"))
    return lines.select("conv_id", "part", "n_turns", "copies", F.array_join("lines.line", "").alias("text"))


#: The same in DuckDB.
SQL = f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, ''), coalesce(text, '')) AS place,
    concat('<|', replace(coalesce(role, ''), '<|', '< |'), '|>', chr(10), replace(coalesce(text, ''), '<|', '< |'), '<|end|>', chr(10)) AS line
  FROM conversations),
s AS (
  SELECT conv_id, place, line, count(*) OVER (PARTITION BY conv_id) AS n_turns,
    string_agg(concat(length(line), ':', line), '') OVER (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix
  FROM t),
whole AS (SELECT min(conv_id) AS conv_id, n_turns, count(*) AS copies, prefix FROM s WHERE place = n_turns GROUP BY n_turns, prefix),
kept AS (SELECT * FROM whole WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.place < s.n_turns AND s.place = whole.n_turns AND s.prefix = whole.prefix))
SELECT kept.conv_id, CAST((s.place - 1) // {PART} AS BIGINT) AS part, kept.n_turns, kept.copies, string_agg(s.line, '' ORDER BY s.place) AS text
FROM kept JOIN s ON s.conv_id IS NOT DISTINCT FROM kept.conv_id GROUP BY ALL
"""
