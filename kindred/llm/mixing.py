"""Mixing sources to target weights by Efraimidis-Spirakis sampling (native: DataFrame functions only).

Each source gets a budget of words (its target). Whole epochs over the source come first; of the next epoch, the documents
with the smallest exponential keys -ln(u) / weight are taken until their sizes fill what is left of the budget (a document
that would cross the budget is taken if at least half of it fits). u is 60 bits of the document's MD5, so reruns agree and SQL
can follow.

No source is sorted as a whole. Keys fall in about sqrt(n) buckets a source; sums by bucket show the bucket in which the
budget ends, and only that bucket's distinct keys are sorted, each with its number of rows. What is decided for a source is
then one small row: its epochs, the largest key taken and how many of the rows with that key are. Texts are not shuffled.

Defined cases: null and empty texts have size 0 and are never worth words; a null source is a source of its own, last in
order; a source without words has target 0; rows equal in id and text share their key, and where the budget ends among
them as many are taken as fit (any, since they are equal); a null id is an id like others; an empty table gives an empty
result. Further columns are left alone, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import occurrences, spaced, stored, words_of

WEIGHTS = (5, 2, 1)


def quality_weight(text: Column, size: Column) -> Column:
    """1 for plain prose, less the more symbols there are a word; never 0."""
    symbols = sum((occurrences(text, c) for c in "#*$%&|<>"), F.lit(0))
    return 1.0 / (1.0 + 4.0 * F.coalesce(F.try_divide(symbols.cast("double"), size.cast("double")), F.lit(0.0)))


SEED = 17


def sized(docs: DataFrame, source: str = "source", text: str = "text", id_col: str = "doc_id", seed: int = SEED) -> DataFrame:
    """docs with `_m_source`, `_m_size` (words), `_m_key` (the exponential key) and `_m_tie`."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumn("_m_source", F.col(source)).withColumn("_m_text", t)
    d = d.withColumn("_m_size", F.size(words_of(spaced(F.col("_m_text")))).cast("bigint"))
    named = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), "_m_text")
    d = d.withColumn("_m_tie", F.conv(F.substring(F.md5(named), 1, 15), 16, 10).cast("bigint"))
    u = (F.col("_m_tie").cast("double") + 0.5) / float(1 << 60)
    return d.withColumn("_m_key", -F.log(u) / quality_weight(F.col("_m_text"), F.col("_m_size"))).drop("_m_text")


def targets(sizes: DataFrame, share: float = 1.5, ceiling: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sizes: (source, source_size, n), a row a source. Adds `target`: share of all sizes by weight, where none exceeds ceiling times its source's size.

    Resharing what capped sources leave over gives every other one the same words a unit of weight. In the order of
    ceiling over weight, a source is capped exactly if its part of what those before it leave is at least its ceiling.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    s = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights)) + 1))
    s = s.withColumn("cap", ceiling * F.col("source_size")).withColumn("budget", share * F.sum("source_size").over(everything))
    rank = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    s = s.withColumn("before", F.coalesce(F.sum("cap").over(rank.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("rest", F.sum("weight").over(rank.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("capped", F.col("cap") <= F.col("weight") * (F.col("budget") - F.col("before")) / F.col("rest"))
    unit = F.try_divide(F.col("budget") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(everything), F.sum(F.when(~F.col("capped"), F.col("weight")).otherwise(0.0)).over(everything))
    return s.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.least("cap", F.col("weight") * unit))).select("source", "source_size", "n", "target")


def _bucket(key: Column, n: Column) -> Column:
    """About sqrt(n) buckets whose order is that of the keys."""
    return F.floor((1.0 - F.exp(-key)) * F.ceil(F.sqrt(n.cast("double")))).cast("bigint")


def plan(rows: DataFrame, **options) -> DataFrame:
    """rows: (_m_source, _m_size, _m_key, _m_tie). One row a source: source, source_size, target, epochs, and where the next epoch ends: buckets below `cut_bucket`, and in it keys up to (cut_key, cut_tie)."""
    sizes = rows.groupBy(F.col("_m_source").alias("source")).agg(F.sum("_m_size").alias("source_size"), F.count("*").alias("n"))
    goal = targets(sizes, **options).withColumn("epochs", F.coalesce(F.floor(F.try_divide("target", F.col("source_size").cast("double"))), F.lit(0)).cast("bigint"))
    goal = stored(goal.withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size")))
    b = rows.join(goal.select("source", "n"), F.col("_m_source").eqNullSafe(F.col("source")))
    b = b.select("source", _bucket(F.col("_m_key"), F.col("n")).alias("bucket"), "_m_size", "_m_key", "_m_tie")
    sums = b.groupBy("source", "bucket").agg(F.sum("_m_size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words")
    ends = sums.withColumn("before", before).join(goal.select(F.col("source").alias("s"), "left"), F.col("source").eqNullSafe(F.col("s"))).filter("left > 0 AND before <= left AND left < before + words")
    ends = stored(ends.select(F.col("source").alias("s"), F.col("bucket").alias("cut_bucket"), (F.col("left") - F.col("before")).alias("room")))
    last = b.join(ends, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("cut_bucket")))
    last = last.filter("_m_size > 0").groupBy("s", "cut_bucket", "_m_key", "_m_tie", "_m_size", "room").agg(F.count("*").alias("rows"))
    sofar = F.sum(F.col("_m_size") * F.col("rows")).over(Window.partitionBy("s", "cut_bucket").orderBy("_m_key", "_m_tie", "_m_size").rowsBetween(Window.unboundedPreceding, -1))
    fit = F.floor((F.col("room") - F.coalesce(sofar, F.lit(0))) / F.col("_m_size") + 0.5).cast("bigint")  # the last one if half of it fits
    taken = last.withColumn("take", F.least(fit, "rows")).filter("take > 0")
    cut = taken.groupBy(F.col("s").alias("cs")).agg(F.max(F.struct("_m_key", "_m_tie", "_m_size", "take", "rows")).alias("cut"))
    out = goal.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").join(cut, F.col("source").eqNullSafe(F.col("cs")), "left")
    cuts = [F.col(f"cut.{a}").alias(b) for a, b in (("_m_key", "cut_key"), ("_m_tie", "cut_tie"), ("take", "cut_take"), ("rows", "cut_rows"))]
    return stored(out.select("source", "source_size", "n", "target", "epochs", "cut_bucket", *cuts))


def _decided(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """rows with what is decided for their source, prefixed `_p_`, with `_copies`, and with `_edge` for those whose key is the last one and only taken in part. The decisions, a row a source, are joined as Spark's size limit for broadcasts decides."""
    p = decided.select(*[F.col(c).alias(f"_p_{c}") for c in decided.columns])
    out = rows.join(p, F.col("_m_source").eqNullSafe(F.col("_p_source")))
    bucket = _bucket(F.col("_m_key"), F.col("_p_n"))
    last = (F.col("_m_key") == F.col("_p_cut_key")) & (F.col("_m_tie") == F.col("_p_cut_tie"))
    inside = (bucket == F.col("_p_cut_bucket")) & ((F.col("_m_key") < F.col("_p_cut_key")) | ((F.col("_m_key") == F.col("_p_cut_key")) & (F.col("_m_tie") < F.col("_p_cut_tie"))) | (last & (F.col("_p_cut_take") == F.col("_p_cut_rows"))))
    chosen = F.coalesce((bucket < F.col("_p_cut_bucket")) | F.coalesce(inside, F.lit(False)), F.lit(False))
    out = out.withColumn("_copies", F.when(F.col("_m_size") > 0, F.col("_p_epochs") + chosen.cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return out.withColumn("_edge", F.coalesce(last & (F.col("_m_size") > 0) & (F.col("_p_cut_take") < F.col("_p_cut_rows")), F.lit(False)))


def _copies(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """rows with the columns of _decided(); of the rows at an edge, which are equal, as many are taken once more as the plan says.

    These rows are numbered where they lie and stored; sums by their tasks' numbers show in which of them the count ends, so
    that no group of equal rows is sorted or gathered.
    """
    out = _decided(rows, decided)
    if decided.filter("cut_take < cut_rows").isEmpty():
        return out
    edge = stored(out.filter("_edge").withColumn("_m_n", F.monotonically_increasing_id()))
    place = F.shiftright("_m_n", 33)
    sums = edge.groupBy(F.col("_m_source").alias("_b_source"), place.alias("_b_place")).agg(F.count("*").alias("_b_rows"))
    before = F.sum("_b_rows").over(Window.partitionBy("_b_source").orderBy("_b_place")) - F.col("_b_rows")
    own = F.row_number().over(Window.partitionBy("_m_source", F.shiftright("_m_n", 33)).orderBy("_m_n")) - 1
    numbered = edge.withColumn("_own", own).join(sums.withColumn("_before", before), F.col("_m_source").eqNullSafe(F.col("_b_source")) & (place == F.col("_b_place")))
    more = (F.col("_own") + F.col("_before") < F.col("_p_cut_take")).cast("bigint")
    return out.filter("NOT _edge").unionByName(numbered.withColumn("_copies", F.col("_copies") + more).select(out.columns))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix: docs' rows and columns, each row as often as it is taken (0, 1 or 2 times by the default shares)."""
    rows = sized(docs)
    decided = plan(stored(rows.select("_m_source", "_m_size", "_m_key", "_m_tie")), **options)
    out = _copies(rows, decided).filter("_copies > 0").withColumn("_again", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies"))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def result(docs: DataFrame) -> DataFrame:
    """The digest that op3 returns."""
    rows = stored(sized(docs.select("doc_id", "source", "text")).select("doc_id", "_m_source", "_m_size", "_m_key", "_m_tie"))
    out = _copies(rows, plan(rows))
    return out.select(F.col("doc_id").cast("bigint"), F.col("_m_source").alias("source"), F.col("_m_size").alias("size"), F.col("_p_source_size").alias("source_size"), F.round("_p_target", 6).alias("target"), (F.col("_copies") * F.col("_m_size")).alias("taken"))


def _sql(seed: int = SEED, share: float = 1.5, ceiling: float = 2.0) -> str:
    """result() in DuckDB: the water level of the targets is found among the sources' own levels, and each source is sorted as a whole."""
    symbols = " + ".join(f"length(t) - length(replace(t, '{c}', ''))" for c in "#*$%&|<>")
    weights = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) AS BIGINT) AS size FROM documents),
k AS (SELECT doc_id, source, size, CAST({symbols} AS DOUBLE) AS symbols, CAST(concat('0x', left(md5(concat_ws('|', '{seed}', coalesce(CAST(doc_id AS VARCHAR), ''), t)), 15)) AS BIGINT) AS tie FROM d),
e AS (SELECT *, -ln((CAST(tie AS DOUBLE) + 0.5) / {float(1 << 60)}) / (1.0::DOUBLE / (1.0 + 4.0 * CASE WHEN size = 0 THEN 0.0 ELSE symbols / size END)) AS key FROM k),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} {weights} END AS DOUBLE) AS weight FROM e GROUP BY source),
level AS (SELECT a.source_size * {ceiling} / a.weight AS x, (SELECT sum(least({ceiling} * b.source_size, b.weight * a.source_size * {ceiling} / a.weight)) FROM s b) AS filled FROM s a),
budget AS (SELECT sum(source_size) * {share} AS b FROM s),
below AS (SELECT coalesce(max(x), 0.0) AS x FROM level, budget WHERE filled <= b),
unit AS (SELECT x + coalesce((b - (SELECT sum(least({ceiling} * source_size, weight * x)) FROM s)) / nullif((SELECT sum(weight) FROM s WHERE {ceiling} * source_size > weight * x), 0), 0.0) AS u FROM below, budget),
g AS (SELECT source, source_size, least({ceiling} * source_size, weight * u) AS target FROM s, unit),
h AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size + 1e-12) END AS epochs FROM g),
o AS (SELECT e.*, h.source_size, h.target, h.epochs, h.target - h.epochs * h.source_size AS room,
  coalesce(sum(e.size) OVER (PARTITION BY e.source ORDER BY key, tie, e.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sofar FROM e JOIN h ON h.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, source, size, source_size, round(target, 6) AS target, CAST(CASE WHEN size = 0 THEN 0 ELSE size * (epochs + CASE WHEN room > 1e-9 AND sofar + size / 2.0 <= room THEN 1 ELSE 0 END) END AS BIGINT) AS taken FROM o
"""


SQL = _sql()
