"""Quality rules with risk-controlled cutoffs (native: DataFrame functions only).

Each document gets counts over its whole text. A rule rejects a document whose measure is at or above a cutoff. Cutoffs come
from fixed grids and are chosen per stratum on labelled documents that the base rule keeps, in two halves by a hash of the id:

1. The first half orders the steps (rule, cutoff): each rule goes from its strictest cutoff to the one of its greatest gain
   (share of bad documents caught less `loss` times the share of good ones lost), and the steps of all rules are merged by
   the share of good documents that they lose.
2. The second half certifies them along this path. A step is tested by how many good documents it and all before it reject
   together: it passes if the exact binomial upper bound (Clopper-Pearson) on that share stays below `alpha`. Steps are tested
   in the order that was fixed before (fixed-sequence testing), up to the first that fails, so that a stratum needs no
   correction for their number; `delta` is divided by the number of strata (Bonferroni).

So with probability 1 - delta, in no stratum do the rules together reject more than `alpha` of the good documents. With
alpha = 0.05, delta = 0.05 and four strata a stratum needs 86 good labelled documents in the second half, about 170 in all.

Defined cases: null and empty texts have no words and fail the base rule; a null stratum is a stratum of its own; a stratum
with too few labels to certify anything gets no cutoff, so only the base rule acts there; null, contradictory or repeated
labels count once, as bad if any says so; an empty label table leaves the base rule alone; an empty input gives an empty
result. Other columns of the input have no effect, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import occurrences, spaced, stored, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Measures and their grids of cutoffs; a document is rejected where the measure is at or above the cutoff.
GRIDS: dict[str, tuple[float, ...]] = {
    "symbols_per_word": (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 1.2),
    "bangs_per_word": (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 1.2),
    "upper_share": (0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.65, 0.8),
    "dup_line_share": (0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.65, 0.8),
    "repeat_share": (0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.5),
    "long_words": (7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0, 40.0),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "bangs_per_word": ("n_bangs", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "long_words": ("word_chars", "n_words"),
}


def _covered(windows: Column) -> Column:
    """Words in those windows that occur twice or more; windows: (hash, start), sorted. Neighbours are compared once each way."""
    n = F.size(windows)
    after = F.zip_with(windows, F.slice(windows, 2, F.greatest(n, F.lit(1))), lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False)))
    before = F.concat(F.array(F.lit(False)), after)
    marked = F.zip_with(F.zip_with(after, F.slice(before, 1, F.greatest(n, F.lit(1))), lambda a, b: a | b), windows, lambda hit, x: F.when(hit, x["i"]))
    return F.array_sort(F.array_compact(marked))


def _total(starts: Column) -> Column:
    gaps = F.zip_with(starts, F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda s, x: s + x)


def with_measures(docs: DataFrame, text_col: str = "text", stratum: str = "lang") -> DataFrame:
    """docs with one more column, `_q`: a struct of the stratum, the counts of the base rule, base_failed and the measures of GRIDS. No shuffle: each text is looked at where it lies.

    Words of a window are taken by place (a slice would copy the whole array each time). Windows are compared by 64-bit hashes, within one text only; a text without a repeated window (the usual case) is
    recognised by one pass over its hashes, and only the others are sorted.
    """
    q = lambda name: F.col(f"_q_{name}")
    d = docs.withColumn("_q_text", F.coalesce(F.col(text_col), F.lit("")))
    d = d.withColumn("_q_flat", spaced(q("text")))
    d = d.withColumns({"_q_words": words_of(q("flat")), "_q_lines": F.filter(F.split(q("text"), "\n", -1), lambda x: F.trim(spaced(x)) != "")})
    counts = {
        "n_words": F.size(q("words")),
        "word_chars": F.length(F.replace(q("flat"), F.lit(" "), F.lit(""))),
        "n_symbols": sum((occurrences(q("text"), c) for c in SYMBOLS), F.lit(0)),
        "n_lines": F.size(q("lines")),
        "n_dup_lines": F.size(q("lines")) - F.size(F.array_distinct(q("lines"))),
        "n_bangs": occurrences(q("text"), "!"),
        "n_upper": F.regexp_count(q("text"), F.lit(r"\p{Lu}")),
        "hashes": F.when(F.size(q("words")) > WINDOW, F.transform(F.sequence(F.lit(0), F.size(q("words")) - WINDOW), lambda i: F.xxhash64(*[F.get(q("words"), i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>")),
    }
    d = d.withColumns({f"_q_{k}": v if k == "hashes" else v.cast("bigint") for k, v in counts.items()}).drop("_q_words", "_q_flat", "_q_lines", "_q_text")
    d = d.withColumn("_q_windows", F.when(F.size(F.array_distinct(q("hashes"))) < F.size(q("hashes")), F.sort_array(F.transform(q("hashes"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    d = d.withColumn("_q_starts", F.when(q("windows").isNotNull(), _covered(q("windows"))))
    d = d.withColumn("_q_n_repeat_words", F.when(q("starts").isNotNull(), _total(q("starts"))).otherwise(F.lit(0).cast("bigint")))
    share = lambda a, b: F.coalesce(F.try_divide(q(a).cast("double"), q(b).cast("double")), F.lit(0.0))
    parts = [F.col(stratum).alias("stratum"), *[q(k).alias(k) for k in COUNTS]]
    parts += [share(a, b).alias(name) for name, (a, b) in SHARES.items()]
    parts += [((q("n_words") < 20) | (100 * q("n_repeat_words") > 30 * q("n_words"))).alias("base_failed")]
    return d.select(*[F.col(f"`{c}`") for c in docs.columns], F.struct(*parts).alias("_q"))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang") -> DataFrame:
    """One row per row of docs: doc_id and the fields of `_q`, without the text."""
    return with_measures(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(stratum).alias("lang"))).select("doc_id", "_q.*")


def _log_gamma(x: Column) -> Column:
    """Stirling's series at x + 7, brought back to x."""
    z = x + 7
    series = (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    for i in range(7):
        series = series - F.log(x + i)
    return series


def _at_most(k: Column, n: Column, p: Column) -> Column:
    """P(Binomial(n, p) <= k) for k < n * p: the regularised incomplete beta function of (n - k, k + 1) at 1 - p, by its continued fraction, whose steps grow with the root of n."""
    a, b, x = n - k, k + 1.0, 1.0 - p
    safe = lambda v: F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)

    def half(s: Column, step: Column) -> Column:
        d, c = 1 / safe(1 + step * s["d"]), safe(1 + step / s["c"])
        return F.struct(d.alias("d"), c.alias("c"), (s["h"] * d * c).alias("h"))

    def both(s: Column, m: Column) -> Column:
        even = half(s, m * (b - m) * x / ((a - 1 + 2 * m) * (a + 2 * m)))
        return F.get(F.transform(F.array(even), lambda t: half(t, -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 1 + 2 * m)))), F.lit(0))

    first = 1 / safe(1 - (a + b) * x / (a + 1))
    steps = F.sequence(F.lit(1), (F.ceil(5 * F.sqrt(n)) + 50).cast("int"))
    fraction = F.aggregate(steps, F.struct(first.alias("d"), F.lit(1.0).alias("c"), first.alias("h")), both, lambda s: s["h"])
    return F.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * F.log(x) + b * F.log(p)) * fraction / a


def certified(k: Column, n: Column, alpha: Column, delta: Column) -> Column:
    """Whether k false rejections among n good documents show, at confidence 1 - delta, a rate below alpha: P(Binomial(n, alpha) <= k) <= delta, exactly."""
    k, n = k.cast("double"), n.cast("double")
    return F.when((n > 0) & (k < n * alpha), _at_most(k, n, alpha) <= delta).otherwise(F.lit(False))


def _path(half: DataFrame, loss: float) -> DataFrame:
    """(stratum, rank, rule, cutoff): the steps in the order in which they are to be tested. Counts are first summed per stratum and measure step, so nothing is gathered by stratum; a stratum has at most as many rows as GRIDS has cutoffs."""
    steps = [F.struct(F.lit(name).alias("rule"), sum(((F.col(name) >= c).cast("int") for c in grid), F.lit(0)).alias("step")) for name, grid in GRIDS.items()]
    counts = half.select("stratum", "good", F.explode(F.array(*steps)).alias("s")).groupBy("stratum", "s.rule", "s.step").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    per = counts.groupBy("stratum", "rule").agg(F.collect_list(F.struct("step", "good", "bad")).alias("at"), F.sum("good").alias("good"), F.sum("bad").alias("bad"))  # at most one entry for each step of a grid
    grid = F.create_map(*[x for name, g in GRIDS.items() for x in (F.lit(name), F.array(*[F.struct(F.lit(i + 1).alias("step"), F.lit(c).alias("cutoff")) for i, c in enumerate(g)]))])
    over = lambda what: F.aggregate("at", F.lit(0).cast("bigint"), lambda s, x: s + F.when(x["step"] >= F.col("g.step"), x[what]).otherwise(0))
    tests = per.select("*", F.explode(F.element_at(grid, F.col("rule"))).alias("g")).select("stratum", "rule", "g.cutoff", F.try_divide(over("good").cast("double"), F.col("good")).alias("lost"), F.try_divide(over("bad").cast("double"), F.col("bad")).alias("caught"))
    gain = F.col("caught") - loss * F.col("lost")
    best = F.max(F.when(F.col("gain") > 0, F.struct("gain", "cutoff"))).over(Window.partitionBy("stratum", "rule"))["cutoff"]
    useful = tests.withColumn("gain", gain).withColumn("best", best).filter("cutoff >= best AND caught > 0")
    order = Window.partitionBy("stratum").orderBy("lost", F.desc("caught"), "rule", F.desc("cutoff"))
    return useful.select("stratum", F.row_number().over(order).alias("rank"), "rule", "cutoff")


def tuning(doc_id: Column) -> Column:
    """Whether a labelled document orders the steps (else it certifies them): by the first digit of its id's MD5."""
    return F.conv(F.substring(F.md5(doc_id.cast("string").cast("binary")), 1, 1), 16, 10).cast("int") % 2 == 0


def cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05, loss: float = 20.0) -> DataFrame:
    """The certified cutoffs: (stratum, rule, cutoff), and of the stratum's second half good, good_lost, bad, bad_caught by all its rules together."""
    marks = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = measured.filter(~F.col("base_failed")).join(marks, "doc_id").withColumn("good", (F.col("quality") > 0).cast("long"))
    known = stored(known.select("stratum", "good", tuning(F.col("doc_id")).alias("tuning"), *GRIDS))
    path = stored(_path(known.filter("tuning"), loss))
    lists = path.groupBy(F.col("stratum").alias("s")).agg(F.collect_list(F.struct("rank", "rule", "cutoff")).alias("steps"))
    value = F.create_map(*[x for name in GRIDS for x in (F.lit(name), F.col(name))])
    first = F.array_min(F.transform(F.filter("steps", lambda x: F.element_at(F.col("value"), x["rule"]) >= x["cutoff"]), lambda x: x["rank"]))
    judged_by = known.filter("NOT tuning").withColumn("value", value).join(lists, F.col("stratum").eqNullSafe(F.col("s")), "left").select("stratum", "good", first.alias("first"))
    counts = stored(judged_by.groupBy("stratum", "first").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad")))
    totals = counts.groupBy(F.col("stratum").alias("s")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    strata = max(1, totals.count())
    at = counts.filter("first IS NOT NULL").select(F.col("stratum").alias("cs"), F.col("first").alias("cr"), F.col("good").alias("g"), F.col("bad").alias("b"))
    sofar = Window.partitionBy("stratum").orderBy("rank")
    steps = path.join(at, F.col("stratum").eqNullSafe(F.col("cs")) & (F.col("rank") == F.col("cr")), "left").join(totals, F.col("stratum").eqNullSafe(F.col("s")))
    steps = steps.withColumn("good_lost", F.coalesce(F.sum("g").over(sofar), F.lit(0))).withColumn("bad_caught", F.coalesce(F.sum("b").over(sofar), F.lit(0)))
    passed = F.min(certified(F.col("good_lost"), F.col("good"), F.lit(alpha), F.lit(delta / strata))).over(sofar)
    last = Window.partitionBy("stratum")
    kept = steps.withColumn("passed", passed).filter("passed").withColumn("good_lost", F.max("good_lost").over(last)).withColumn("bad_caught", F.max("bad_caught").over(last))
    return kept.groupBy("stratum", "rule", "good", "good_lost", "bad", "bad_caught").agg(F.min("cutoff").alias("cutoff")).select("stratum", "rule", "cutoff", "good", "good_lost", "bad", "bad_caught")


def _with_verdicts(measured: DataFrame, q: str, chosen: DataFrame) -> DataFrame:
    """measured with `_rejected_by`; q: where the measures are. The cutoffs, a stored table of a few rows a stratum, are joined as Spark's size limit for broadcasts decides."""
    wide = chosen.groupBy("stratum").pivot("rule", list(GRIDS)).agg(F.min("cutoff"))
    wide = stored(wide.select(F.col("stratum").alias("_cut_stratum"), *[F.col(name).alias(f"_cut_{name}") for name in GRIDS]))
    out = measured.join(wide, F.col(f"{q}stratum").eqNullSafe(F.col("_cut_stratum")), "left")
    rule = F.coalesce(*[F.when(F.col(f"{q}{name}") >= F.col(f"_cut_{name}"), F.lit(name)) for name in GRIDS])
    return out.withColumn("_rejected_by", F.when(F.col(f"{q}base_failed"), F.lit("base")).otherwise(rule)).drop(*wide.columns)


def judged(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05, loss: float = 20.0, **columns: str) -> DataFrame:
    """Every row of docs with its measures, base_failed, rejected_by (the first rule that rejects it, else null) and kept."""
    m = stored(measures(docs, **columns))
    return _with_verdicts(m, "", cutoffs(m, labels, alpha, delta, loss)).withColumnRenamed("_rejected_by", "rejected_by").withColumn("kept", F.col("rejected_by").isNull())


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05, loss: float = 20.0) -> DataFrame:
    """The rows of docs that are kept, with their columns. Each text is measured once: the rows are stored with their measures, and no text is shuffled."""
    m = stored(with_measures(docs))
    chosen = cutoffs(m.select("doc_id", "_q.*"), labels, alpha, delta, loss)
    return _with_verdicts(m, "_q.", chosen).filter("_rejected_by IS NULL").select(*[F.col(f"`{c}`") for c in docs.columns])


def result(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The digest that op7 returns."""
    return judged(docs, labels).select(F.col("doc_id").cast("bigint"), *COUNTS, "base_failed", "kept", "rejected_by")


def _sql(alpha: float = 0.05, delta: float = 0.05, loss: float = 20.0) -> str:
    """result() in DuckDB: windows as text, a row a document, rule and cutoff, and the binomial sum term by term."""
    word = "[^ \\t\\n\\x0B\\f\\r]+"
    symbols = " + ".join(f"length(t) - length(replace(t, '{c}', ''))" for c in SYMBOLS)
    shares = "\n  UNION ALL ".join(f"SELECT rid, stratum, base_failed, doc_id, '{name}' AS rule, {i} AS ord, coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0.0) AS value FROM m" for i, (name, (a, b)) in enumerate(SHARES.items()))
    grid = ", ".join(f"('{name}', {c}::DOUBLE)" for name, g in GRIDS.items() for c in g)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang AS stratum, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}') AS words FROM documents),
place AS (SELECT rid, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM d WHERE len(words) > {WINDOW}),
win AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, array_to_string(words[i:i + {WINDOW - 1}], ' ')) AS often FROM place),
gap AS (SELECT rid, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, {WINDOW})) AS n FROM win WHERE often > 1),
rep AS (SELECT rid, CAST(sum(n) AS BIGINT) AS n FROM gap GROUP BY rid),
c AS (SELECT rid, doc_id, stratum, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST({symbols} AS BIGINT) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines, length(t) - length(replace(t, '!', '')) AS n_bangs, len(regexp_extract_all(t, '\\p{{Lu}}')) AS n_upper FROM d),
m AS (SELECT c.*, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, n_words < 20 OR 100 * coalesce(rep.n, 0) > 30 * n_words AS base_failed FROM c LEFT JOIN rep USING (rid)),
v AS ({shares}),
mark AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
known AS (SELECT v.*, CAST(quality > 0 AS INTEGER) AS good, CAST(concat('0x', left(md5(CAST(v.doc_id AS VARCHAR)), 1)) AS INTEGER) % 2 = 0 AS tuning FROM v JOIN mark USING (doc_id) WHERE NOT base_failed),
grid AS (SELECT * FROM (VALUES {grid}) g(rule, cutoff)),
tested AS (SELECT stratum, rule, cutoff, CAST(sum(good) FILTER (value >= cutoff) AS DOUBLE) AS gl, CAST(sum(1 - good) FILTER (value >= cutoff) AS DOUBLE) AS bc, nullif(sum(good), 0) AS g, nullif(sum(1 - good), 0) AS b FROM known JOIN grid USING (rule) WHERE tuning GROUP BY ALL),
gain AS (SELECT stratum, rule, cutoff, coalesce(gl, 0) / g AS lost, coalesce(bc, 0) / b AS caught, coalesce(bc, 0) / b - {loss} * (coalesce(gl, 0) / g) AS gain FROM tested),
best AS (SELECT stratum, rule, cutoff AS least FROM gain WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY gain DESC, cutoff DESC) = 1),
path AS (SELECT gain.stratum, gain.rule, cutoff, row_number() OVER (PARTITION BY gain.stratum ORDER BY lost, caught DESC, gain.rule, cutoff DESC) AS rank FROM gain JOIN best ON best.stratum IS NOT DISTINCT FROM gain.stratum AND best.rule = gain.rule WHERE cutoff >= least AND caught > 0),
seconds AS (SELECT DISTINCT rid, stratum, good FROM known WHERE NOT tuning),
firsts AS (SELECT k.rid, min(rank) AS rank FROM known k JOIN path p ON p.stratum IS NOT DISTINCT FROM k.stratum AND p.rule = k.rule AND k.value >= p.cutoff WHERE NOT tuning GROUP BY k.rid),
total AS (SELECT stratum, CAST(sum(good) AS BIGINT) AS n, (SELECT count(*) FROM (SELECT DISTINCT stratum FROM seconds)) AS strata FROM seconds GROUP BY stratum),
lost AS (SELECT p.stratum, p.rule, p.cutoff, p.rank, n, strata, (SELECT count(*) FROM seconds s JOIN firsts f USING (rid) WHERE s.stratum IS NOT DISTINCT FROM p.stratum AND f.rank <= p.rank AND s.good = 1) AS k FROM path p JOIN total ON total.stratum IS NOT DISTINCT FROM p.stratum),
sure AS (SELECT *, bool_and(n > 0 AND k < n * {alpha} AND list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({alpha}) + (n - j) * ln(1 - {alpha})))) <= {delta} / strata) OVER (PARTITION BY stratum ORDER BY rank) AS passed FROM lost),
chosen AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM sure WHERE passed GROUP BY stratum, rule),
hit AS (SELECT v.rid, arg_min(v.rule, v.ord) AS rule FROM v JOIN chosen ch ON ch.stratum IS NOT DISTINCT FROM v.stratum AND ch.rule = v.rule AND v.value >= ch.cutoff GROUP BY v.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND hit.rule IS NULL AS kept, CASE WHEN base_failed THEN 'base' ELSE hit.rule END AS rejected_by FROM m LEFT JOIN hit USING (rid)
"""


SQL = _sql()
