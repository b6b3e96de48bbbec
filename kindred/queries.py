"""One query for each operator of the engine, over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred import oracle
from kindred.functions import fuzzy, hashing
from kindred.functions import text as X
from kindred.operators import audit, blocking, decide, features, index, metrics, miss, model, ranking, retrieve, sampling, validate
from kindred.plans import linkage, policy, presets, proxy
from kindred.plans.proxy import PARTY_NUM, WITH
from kindred.sources import shards, store, tsv
from kindred.sources.store import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
CAPS = dict.fromkeys(ranking.PASSES, 40) | {"char_name": 0}
GRID = [0.5, 0.6, 0.7, 0.8, 0.9, 0.95]


def query(name: str, sql: str = "") -> Callable:
    """Registers f(party, truth) under name; sql follows `WITH …` of the proxy views."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            p = proxy.party(spark, sf_dir)
            return f(p, proxy.truth(p))

        QUERIES[name] = run
        if sql:
            SQL[name] = f"WITH {WITH}{sql}" if sql.lstrip().startswith(",") else f"WITH {WITH} {sql}"
        return f

    return register


def on_numbers(name: str, sql: str = "") -> Callable:
    """The same over records with numbers: f(party)."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(proxy.party(spark, sf_dir, True))
        if sql:
            SQL[name] = f"WITH party AS ({PARTY_NUM}){sql}" if sql.lstrip().startswith(",") else f"WITH party AS ({PARTY_NUM}) {sql}"
        return f

    return register


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 9) for n in names})


def s1(p: DataFrame) -> DataFrame:
    return p.filter("source = 'S1'")


def others(p: DataFrame) -> DataFrame:
    return p.filter("source <> 'S1'")


def sized(p: DataFrame, t: DataFrame, seed: int = 7) -> DataFrame:
    """(s1, country, n_true, key)."""
    e = t.select("s1", F.size("targets").cast("bigint").alias("n_true")).join(p.select(F.col("entity_id").alias("s1"), "country"), "s1")
    return e.withColumn("key", hashing.sha_key(F.col("s1"), seed))


# Sources and sinks

query("a_04_source_scan", "SELECT entity_id, business_name, business_address, country, source FROM party WHERE source = 'S2'")(lambda p, t: tsv.check_prefix(p.filter("source = 'S2'"), "entity_id", "S2").drop("fam"))
query("a_06_id_prefix", "SELECT count(*) AS n, list_sort(list(entity_id))[1:5] AS examples FROM party WHERE NOT starts_with(entity_id, 'S2-')")(lambda p, t: tsv.bad_ids(p, "entity_id", "S2"))
query("a_08_parse_matches", "SELECT t.s1, coalesce(string_agg(l.target, '|' ORDER BY l.target), '') AS targets FROM truth t LEFT JOIN link l USING (s1) GROUP BY t.s1")(
    lambda p, t: t.select("s1", F.array_join(tsv.parse_targets(F.array_join(F.reverse("targets"), ", ")), "|").alias("targets"))
)
query("a_09_truth", "SELECT s1, n_true FROM truth")(lambda p, t: t.select("s1", F.size("targets").cast("bigint").alias("n_true")))
query("a_10_selected_sources", "SELECT entity_id, business_name FROM party WHERE source = 'S2' AND entity_id IN (SELECT target FROM link)")(
    lambda p, t: tsv.select_ids(p.filter("source = 'S2'"), metrics.links(t).filter("target LIKE 'S2-%'").select(F.col("target").alias("entity_id"))).select("entity_id", "business_name")
)
query("a_11_selected_truth", "SELECT s1, n_true FROM truth WHERE n_true > 0")(lambda p, t: tsv.select_ids(t, metrics.links(t).select("s1"), "s1").select("s1", F.size("targets").cast("bigint").alias("n_true")))
query("a_12_positions", "SELECT entity_id, row_number() OVER (ORDER BY entity_id) - 1 AS position FROM party WHERE source = 'S1' QUALIFY position < 50")(lambda p, t: tsv.positioned(s1(p).select("entity_id"), "entity_id", limit=50))
query("a_18_lookup", "SELECT DISTINCT entity_id, business_name, country FROM party WHERE entity_id IN (SELECT target FROM link)")(lambda p, t: retrieve.lookup(others(p), metrics.links(t).select(F.col("target").alias("entity_id")).distinct()).select("entity_id", "business_name", "country"))
query("a_25_submission", "SELECT t.s1 AS source1_entity_id, coalesce(string_agg(l.target, ',' ORDER BY l.target), '') AS matched_entity_ids FROM truth t LEFT JOIN link l USING (s1) GROUP BY t.s1")(lambda p, t: tsv.submission(t, metrics.links(t)))
query("a_33_ids", "SELECT DISTINCT entity_id FROM party WHERE source = 'S1'")(lambda p, t: s1(p).select("entity_id").distinct())
query("d_36_digest", """SELECT count(*) AS rows, CAST(coalesce(sum(CAST(concat('0x', left(md5(concat_ws(chr(31), entity_id, source, business_name, business_address, country, fam)), 15)) AS BIGINT)), 0) AS VARCHAR) AS digest FROM party""")(lambda p, t: tsv.digest(p))

# Text

query("b_01_normalise", "SELECT entity_id, nn AS name, an AS address FROM rep")(lambda p, t: p.select("entity_id", X.normalize(F.col("business_name")).alias("name"), X.normalize(F.col("business_address")).alias("address")))
query("b_02_tokens", "SELECT entity_id, array_to_string(list_filter(string_split(nn, ' '), lambda t: t <> ''), '|') AS tokens FROM rep")(lambda p, t: p.select("entity_id", F.array_join(X.tokens(X.normalize(F.col("business_name"))), "|").alias("tokens")))
on_numbers("b_03_digit_tokens", "SELECT entity_id, array_to_string(list_filter(string_split(business_address, ' '), lambda t: regexp_full_match(t, '[0-9]+')), '|') AS digits FROM party")(lambda p: p.select("entity_id", F.array_join(X.digits(X.tokens(X.normalize(F.col("business_address")))), "|").alias("digits")))
on_numbers("b_04_postal_like", "SELECT entity_id, array_to_string(list_filter(string_split(business_address, ' '), lambda t: regexp_full_match(t, '[0-9]{4,10}')), '|') AS postal FROM party")(lambda p: p.select("entity_id", F.array_join(X.postal_like(X.tokens(X.normalize(F.col("business_address")))), "|").alias("postal")))
query("b_05_representation", "SELECT entity_id, nn AS norm, array_to_string(nu, '|') AS uniq, CAST(len(au) AS INTEGER) AS n_address FROM tok")(lambda p, t: X.represented(p).select("entity_id", F.col("name.norm").alias("norm"), F.array_join("name.uniq", "|").alias("uniq"), F.size("address.uniq").alias("n_address")))
query("s_08_four_grams", "SELECT entity_id, CASE WHEN length(replace(nn, ' ', '')) < 4 THEN CAST(replace(nn, ' ', '') <> '' AS BIGINT) ELSE len(list_distinct(list_transform(range(1, length(replace(nn, ' ', '')) - 2), lambda i: substring(replace(nn, ' ', ''), i, 4)))) END AS n FROM rep")(
    lambda p, t: p.withColumn("x", X.normalize(F.col("business_name"))).select("entity_id", F.size(X.ngrams(F.col("x"), 4, True)).cast("bigint").alias("n"))
)
query("s_09_three_grams", "SELECT entity_id, CASE WHEN length(replace(an, ' ', '')) < 3 THEN 0 ELSE len(list_distinct(list_transform(range(1, length(replace(an, ' ', '')) - 1), lambda i: substring(replace(an, ' ', ''), i, 3)))) END AS n FROM rep")(
    lambda p, t: p.withColumn("x", X.normalize(F.col("business_address"))).select("entity_id", F.size(X.ngrams(F.col("x"), 3, False)).cast("bigint").alias("n"))
)
query("s_15_secondary", f"SELECT entity_id, {oracle.secondary('business_name')} AS name FROM party")(lambda p, t: p.select("entity_id", X.secondary(F.col("business_name")).alias("name")))
on_numbers("s_16_core_name", f"SELECT entity_id, {oracle.secondary('business_name')} AS core FROM party")(lambda p: p.select("entity_id", X.core_name(X.secondary(F.concat("business_name", F.lit(" Holdings Ltd.")))).alias("core")))
on_numbers("s_17_canonical_number", "SELECT entity_id, CAST(CAST(split_part(business_address, ' ', 1) AS BIGINT) AS VARCHAR) AS number FROM party")(lambda p: p.select("entity_id", X.canonical_number(F.concat(F.lit("000"), F.split_part("business_address", F.lit(" "), F.lit(1)))).alias("number")))
on_numbers("s_18_address", "SELECT entity_id, split_part(business_address, ' ', 1) AS primary_number, CASE WHEN split_part(business_address, ' ', 1) = split_part(business_address, ' ', 3) THEN 1 ELSE 2 END AS n_numbers, split_part(business_address, ' ', 3) AS postal FROM party")(
    lambda p: X.enhanced(p).select("entity_id", F.col("address2.primary").alias("primary_number"), F.size("address2.numbers").alias("n_numbers"), F.array_join("address2.postal", "|").alias("postal"))
)

_PAIRS = ", pr AS (SELECT l.s1, l.target, a.nu AS x, b.nu AS y, a.nn AS xn, b.nn AS yn, a.au AS xa, b.au AS ya FROM link l JOIN tok a ON a.entity_id = l.s1 JOIN tok b ON b.entity_id = l.target)"


def pairs(p: DataFrame, t: DataFrame) -> DataFrame:
    r = X.represented(p)
    return metrics.links(t).join(r.select(F.col("entity_id").alias("s1"), F.col("name").alias("qn"), F.col("address").alias("qa")), "s1").join(r.select(F.col("entity_id").alias("target"), "source", "country", F.col("name").alias("tn"), F.col("address").alias("ta")), "target")


def measured(name: str, value: Callable[[], object], sql: str) -> None:
    query(name, f"{_PAIRS} SELECT s1, target, {sql} AS v FROM pr")(lambda p, t: pairs(p, t).select("s1", "target", value().alias("v")))


_BOTH = "CAST(len(list_intersect({0}, {1})) AS DOUBLE)"
measured("s_01_jaccard", lambda: F.round(X.jaccard(F.col("qn.uniq"), F.col("tn.uniq")), 9), f"round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE {_BOTH.format('x', 'y')} / len(list_distinct(list_concat(x, y))) END, 9)")
measured("s_02_overlap", lambda: F.round(X.overlap(F.col("qa.uniq"), F.col("ta.uniq")), 9), f"round(CASE WHEN len(xa) = 0 OR len(ya) = 0 THEN 0.0 ELSE {_BOTH.format('xa', 'ya')} / least(len(xa), len(ya)) END, 9)")
measured("s_07_jaro_winkler", lambda: F.round(fuzzy.similarities({"n": (F.col("qn.norm"), F.col("tn.norm"), "jw")})["n_jw"], 9), "round(CASE WHEN xn = '' OR yn = '' THEN 0.0 ELSE jaro_winkler_similarity(xn, yn) END, 9)")
measured("s_10_length_ratio", lambda: F.round(X.length_ratio(F.col("qn.norm"), F.col("tn.norm")), 9), "round(CASE WHEN xn = '' OR yn = '' THEN 0.0 ELSE CAST(least(length(xn), length(yn)) AS DOUBLE) / greatest(length(xn), length(yn)) END, 9)")
measured("s_11_first_token", lambda: F.coalesce(F.get("qn.tokens", F.lit(0)) == F.get("tn.tokens", F.lit(0)), F.lit(False)), "xn <> '' AND yn <> '' AND split_part(xn, ' ', 1) = split_part(yn, ' ', 1)")
measured("s_12_initials", lambda: X.initials(F.col("qn.tokens")), "array_to_string(list_transform(list_filter(string_split(xn, ' '), lambda t: t <> ''), lambda t: left(t, 1)), '')")
#: Each reference record with the target whose number is 7, 8, 10 or 11 more, so that most pairs differ; the same in the SQL.
_NEAR = """, near AS (SELECT q.entity_id AS s1, x.entity_id AS target, q.country, q.business_name AS rn, q.business_address AS ra, q.nn, q.an, q.nu, q.au, x.business_name AS x_rn, x.business_address AS x_ra, x.nn AS x_nn, x.an AS x_an, x.nu AS x_nu, x.au AS x_au
  FROM tok q JOIN tok x ON CAST(split_part(x.entity_id, '-', 2) AS BIGINT) - CAST(split_part(q.entity_id, '-', 2) AS BIGINT) IN (7, 8, 10, 11) WHERE q.source = 'S1' AND x.source <> 'S1'), """


def near(p: DataFrame) -> DataFrame:
    r = stored(X.represented(p))
    number = lambda c: F.split_part(c, F.lit("-"), F.lit(2)).cast("bigint")
    q = r.filter("source = 'S1'").select(F.col("entity_id").alias("s1"), F.col("name").alias("qn"), F.col("address").alias("qa")).withColumn("number", F.explode(F.transform(F.array(*map(F.lit, (7, 8, 10, 11))), lambda k: k + number(F.col("s1")))))
    return q.join(r.filter("source <> 'S1'").select(F.col("entity_id").alias("target"), "source", "country", F.col("name").alias("tn"), F.col("address").alias("ta"), number(F.col("entity_id")).alias("number")), "number")


def measured_ratio(name: str, field: str, measure: str) -> None:
    a, b = {"n": ("nn", "x_nn"), "a": ("an", "x_an")}[field]
    sql = _NEAR + oracle.ratios("near", "f", {field: (a, b)}) + f" SELECT s1, target, round(f.{measure}, 9) AS v FROM near JOIN f ON f.a = near.{a} AND f.b = near.{b}"
    query(name, sql)(lambda p, t: near(p).select("s1", "target", F.round(fuzzy.similarities({"x": (F.col(f"q{field}.norm"), F.col(f"t{field}.norm"), measure)})[f"x_{measure}"], 9).alias("v")))


measured_ratio("s_04_fuzzy_ratios", "n", "ratio")
measured_ratio("s_05_token_sort", "a", "sort")
measured_ratio("s_06_token_set", "a", "set")
query("s_14_rule_score", _NEAR + oracle.rule("near", "r") + " SELECT s1, target, rule FROM r")(lambda p, t: features.with_rule(near(p)).select("s1", "target", F.col("exp001_rule_score").alias("rule")))
query("h_01_set_algebra", "SELECT l.s1, count(*) FILTER (l.source = 'S2') AS kept, count(*) FILTER (l.source <> 'S2') AS lost, count(*) AS every FROM link l GROUP BY l.s1")(
    lambda p, t: t.filter(F.size("targets") > 0).withColumn("q", F.filter("targets", lambda x: x.startswith("S2-"))).select("s1", *[F.size(f("targets", "q")).cast("bigint").alias(n) for n, f in (("kept", F.array_intersect), ("lost", F.array_except), ("every", F.array_union))])
)
query("h_05_missing_ids", "SELECT target AS entity_id FROM link EXCEPT SELECT entity_id FROM party WHERE source = 'S2'")(lambda p, t: metrics.links(t).select(F.col("target").alias("entity_id")).distinct().join(p.filter("source = 'S2'"), "entity_id", "left_anti"))
query("h_07_append_all", "SELECT source, country FROM party UNION ALL SELECT 'ALL', country FROM party")(lambda p, t: p.select("source", "country").unionByName(p.select(F.lit("ALL").alias("source"), "country")))

# Index

_POST = """, x AS (SELECT * FROM tok WHERE source <> 'S1'), q AS (SELECT * FROM tok WHERE source = 'S1'),
post AS (SELECT source, country, 'name' AS field, unnest(nu) AS token, entity_id AS target FROM x UNION ALL SELECT source, country, 'address', unnest(au), entity_id FROM x),
tdf AS (SELECT source, country, field, token, count(*) AS df FROM post GROUP BY ALL), pop AS (SELECT source, country, count(*) AS population FROM x GROUP BY ALL),
qtok AS (SELECT entity_id AS s1, country, 'name' AS field, unnest(nu) AS token FROM q UNION ALL SELECT entity_id, country, 'address', unnest(au) FROM q),
term AS (SELECT s1, source, country, field, token, df, regexp_full_match(token, '[0-9]+') AS num FROM qtok JOIN tdf USING (country, field, token)),
role AS (SELECT *, 'name_token' AS pass FROM term WHERE field = 'name' AND length(token) >= 3 AND df <= 60 UNION ALL SELECT *, 'address_token' FROM term WHERE field = 'address' AND length(token) >= 3 AND df <= 40
  UNION ALL SELECT *, 'numeric_address' FROM term WHERE field = 'address' AND num AND df <= 250),
rare AS (SELECT * FROM role QUALIFY row_number() OVER (PARTITION BY s1, source, pass ORDER BY df, token) <= CASE pass WHEN 'numeric_address' THEN 3 ELSE 4 END),
kk AS (SELECT entity_id, source, country, 'exact_name' AS pass, nn AS value FROM tok UNION ALL SELECT entity_id, source, country, 'exact_address', an FROM tok UNION ALL SELECT entity_id, source, country, 'name_signature', array_to_string(nu, ' ') FROM tok),
kf AS (SELECT * FROM kk WHERE value <> ''),
ex AS (SELECT a.entity_id AS s1, b.source, b.entity_id AS target, a.pass FROM kf a JOIN kf b USING (country, pass, value) WHERE a.source = 'S1' AND b.source <> 'S1'
  QUALIFY row_number() OVER (PARTITION BY s1, b.source, a.pass ORDER BY b.entity_id) <= 250),
th AS (SELECT DISTINCT r.s1, r.source, p.target, r.pass FROM rare r JOIN post p USING (source, country, field, token)),
tr AS (SELECT *, row_number() OVER (PARTITION BY s1, source ORDER BY df, field, token) AS i FROM term WHERE length(token) >= 3 OR (field = 'address' AND num)),
pb AS (SELECT a.s1, a.source, a.country, a.field AS lf, a.token AS lt, b.field AS rf, b.token AS rt, row_number() OVER (PARTITION BY a.s1, a.source ORDER BY a.i, b.i) AS probe
  FROM tr a JOIN tr b ON a.s1 = b.s1 AND a.source = b.source AND a.i < b.i WHERE a.i <= 8 AND b.i <= 8 AND a.df <= 5000 QUALIFY probe <= 10),
bh AS (SELECT pb.*, c.target FROM pb JOIN post c ON c.source = pb.source AND c.country = pb.country AND c.field = lf AND c.token = lt JOIN post d ON d.source = c.source AND d.country = c.country AND d.target = c.target AND d.field = rf AND d.token = rt),
ok AS (SELECT *, count(*) OVER (PARTITION BY s1, source, probe) AS hits FROM bh QUALIFY hits <= 150),
ih AS (SELECT DISTINCT s1, source, target, unnest([CASE WHEN lf = 'name' THEN 'name_token' WHEN regexp_full_match(lt, '[0-9]+') THEN 'numeric_address' ELSE 'address_token' END, CASE WHEN rf = 'name' THEN 'name_token' WHEN regexp_full_match(rt, '[0-9]+') THEN 'numeric_address' ELSE 'address_token' END]) AS pass FROM ok),
org AS (SELECT s1, source, target, list_sort(list_distinct(list(pass))) AS passes FROM (SELECT * FROM ex UNION ALL SELECT * FROM th UNION ALL SELECT * FROM ih) GROUP BY ALL),
w AS (SELECT s1, source, k.country, field, token, ln((coalesce(population, 0) + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM (SELECT qtok.*, s.source FROM qtok CROSS JOIN (SELECT 'S2' AS source UNION ALL SELECT 'S3') s) k
  LEFT JOIN tdf USING (source, country, field, token) LEFT JOIN pop ON pop.source = k.source AND pop.country = k.country),
ws AS (SELECT s1, source, field, sum(idf) AS total FROM w GROUP BY ALL),
ov AS (SELECT o.s1, o.source, o.target, w.field, sum(w.idf) AS both FROM org o JOIN w ON w.s1 = o.s1 AND w.source = o.source JOIN post p ON p.target = o.target AND p.field = w.field AND p.token = w.token GROUP BY ALL),
cmp AS (SELECT o.*, q.country, coalesce(n.both / wn.total, 0) AS name_idf, coalesce(a.both / wa.total, 0) AS address_idf,
  CASE WHEN len(q.nu) = 0 OR len(x.nu) = 0 THEN 0 ELSE len(list_intersect(q.nu, x.nu)) / len(list_distinct(list_concat(q.nu, x.nu))) END AS nj,
  CASE WHEN len(q.au) = 0 OR len(x.au) = 0 THEN 0 ELSE len(list_intersect(q.au, x.au)) / len(list_distinct(list_concat(q.au, x.au))) END AS aj,
  list_filter(q.au, lambda t: regexp_full_match(t, '[0-9]+')) AS qd, list_filter(x.au, lambda t: regexp_full_match(t, '[0-9]+')) AS xd
  FROM org o JOIN q ON q.entity_id = o.s1 JOIN x ON x.entity_id = o.target LEFT JOIN ov n ON n.s1 = o.s1 AND n.target = o.target AND n.field = 'name' LEFT JOIN ov a ON a.s1 = o.s1 AND a.target = o.target AND a.field = 'address'
  LEFT JOIN ws wn ON wn.s1 = o.s1 AND wn.source = o.source AND wn.field = 'name' LEFT JOIN ws wa ON wa.s1 = o.s1 AND wa.source = o.source AND wa.field = 'address'),
dig AS (SELECT *, CASE WHEN len(qd) = 0 OR len(xd) = 0 THEN 0 ELSE len(list_intersect(qd, xd)) / least(len(qd), len(xd)) END AS dg FROM cmp),
sc AS (SELECT s1, source, target, country, array_to_string(passes, '|') AS passes, round(name_idf, 9) AS name_idf, round(address_idf, 9) AS address_idf,
  round(CASE WHEN list_contains(passes, 'exact_name') THEN 100 + 30 * aj + 10 * dg ELSE 0 END, 9) AS exact_name_score, round(CASE WHEN list_contains(passes, 'exact_address') THEN 100 + 30 * nj ELSE 0 END, 9) AS exact_address_score,
  round(CASE WHEN list_contains(passes, 'name_signature') THEN 105 + 20 * aj ELSE 0 END, 9) AS name_signature_score, round(CASE WHEN list_contains(passes, 'name_token') THEN 100 * name_idf + 20 * nj ELSE 0 END, 9) AS name_token_score,
  round(CASE WHEN list_contains(passes, 'address_token') THEN 100 * address_idf + 20 * aj + 20 * dg ELSE 0 END, 9) AS address_token_score, round(CASE WHEN list_contains(passes, 'numeric_address') THEN 80 * dg + 20 * nj + 20 * aj ELSE 0 END, 9) AS numeric_address_score FROM dig),
best AS (SELECT *, greatest(exact_name_score, exact_address_score, name_signature_score, name_token_score, address_token_score, numeric_address_score) AS best_score,
  CAST(exact_name_score > 0 AS INTEGER) + CAST(exact_address_score > 0 AS INTEGER) + CAST(name_signature_score > 0 AS INTEGER) + CAST(name_token_score > 0 AS INTEGER) + CAST(address_token_score > 0 AS INTEGER) + CAST(numeric_address_score > 0 AS INTEGER) AS pass_count,
  list_sort([exact_name_score, exact_address_score, name_signature_score, name_token_score, address_token_score, numeric_address_score, 0.0], 'DESC')[2] AS second_score FROM sc),
rk AS (SELECT *, CASE WHEN exact_name_score > 0 THEN row_number() OVER (PARTITION BY s1, source ORDER BY exact_name_score DESC, target) ELSE 0 END AS exact_name_rank,
  CASE WHEN name_token_score > 0 THEN row_number() OVER (PARTITION BY s1, source ORDER BY name_token_score DESC, target) ELSE 0 END AS name_token_rank,
  CASE WHEN address_token_score > 0 THEN row_number() OVER (PARTITION BY s1, source ORDER BY address_token_score DESC, target) ELSE 0 END AS address_token_rank,
  CASE WHEN exact_address_score > 0 THEN row_number() OVER (PARTITION BY s1, source ORDER BY exact_address_score DESC, target) ELSE 0 END AS exact_address_rank,
  CASE WHEN numeric_address_score > 0 THEN row_number() OVER (PARTITION BY s1, source ORDER BY numeric_address_score DESC, target) ELSE 0 END AS numeric_address_rank, 0 AS char_name_rank,
  CASE WHEN name_signature_score > 0 THEN row_number() OVER (PARTITION BY s1, source ORDER BY name_signature_score DESC, target) ELSE 0 END AS name_signature_rank FROM best),
el AS (SELECT * FROM rk WHERE exact_name_rank BETWEEN 1 AND 40 OR name_token_rank BETWEEN 1 AND 40 OR address_token_rank BETWEEN 1 AND 40 OR exact_address_rank BETWEEN 1 AND 40 OR name_signature_rank BETWEEN 1 AND 40),
sel AS (SELECT * FROM el QUALIFY row_number() OVER (PARTITION BY s1, source ORDER BY best_score DESC, pass_count DESC, target) <= 60)
"""


def built(p: DataFrame) -> dict[str, DataFrame]:
    return index.build(others(p))


def found(p: DataFrame) -> DataFrame:
    """Retrieved pairs; scores rounded as in the SQL, so that ties fall alike, and ranked after that."""
    return linkage.candidates(p, places=9)


def pool(p: DataFrame) -> DataFrame:
    return found(p).withColumn("passes", F.array_join("passes", "|"))


def q_of(p: DataFrame) -> DataFrame:
    return retrieve.queries_with_sources(stored(X.represented(s1(p))))


def terms_of(p: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    idx = built(p)
    return retrieve.query_terms(q_of(p), idx), idx


query("a_14_postings", _POST + "SELECT source, country, field, token, target FROM post")(lambda p, t: built(p)["postings"])
query("a_17_keys", _POST + "SELECT source, country, pass, value, entity_id AS target FROM kf WHERE source <> 'S1'")(lambda p, t: built(p)["keys"])
query("d_07_token_df", _POST + "SELECT source, country, field, token, df FROM tdf")(lambda p, t: built(p)["token_df"])
query("d_08_populations", _POST + "SELECT source, country, population FROM pop")(lambda p, t: built(p)["populations"])
query("d_10_idf", _POST + "SELECT source, country, field, token, round(ln((population + 1) / (df + 1)) + 1, 9) AS idf FROM tdf JOIN pop USING (source, country)")(
    lambda p, t: (lambda i: i["token_df"].join(i["populations"], ["source", "country"]).select("source", "country", "field", "token", F.round(index.idf(F.col("df"), F.col("population")), 9).alias("idf")))(built(p))
)
query("b_09_informative_tokens", _POST + "SELECT s1, source, field, token, df, pass FROM rare")(lambda p, t: retrieve.informative(terms_of(p)[0], presets.IndexConfig()).select("s1", "source", "field", "token", "df", "pass"))
query("c_01_exact_lookup", _POST + "SELECT s1, source, target, pass FROM ex")(lambda p, t: retrieve.exact_hits(q_of(p), built(p), 250)[0])
query("c_02_rare_tokens", _POST + "SELECT s1, source, target, pass FROM th")(lambda p, t: (lambda x: retrieve.token_hits(retrieve.informative(x[0], presets.IndexConfig()), x[1]))(terms_of(p)))
query("f_09_legacy_probes", _POST + "SELECT s1, source, lf, lt, rf, rt, CAST(probe AS INTEGER) AS probe FROM pb")(lambda p, t: (lambda x: retrieve.probes(x[0], x[1], presets.IndexConfig()).select("s1", "source", "lf", "lt", "rf", "rt", "probe"))(terms_of(p)))
query("c_03_intersections", _POST + "SELECT DISTINCT source, country, lf, lt, rf, rt, hits FROM ok")(
    lambda p, t: (lambda x: retrieve.intersections(retrieve.probes(x[0], x[1], presets.IndexConfig()), x[1], presets.IndexConfig())[0].filter("hits BETWEEN 1 AND 150"))(terms_of(p))
)
query("c_04_intersection_hits", _POST + "SELECT s1, source, target, pass FROM ih")(lambda p, t: (lambda x: retrieve.intersection_hits(retrieve.probes(x[0], x[1], presets.IndexConfig()), x[1], None, presets.IndexConfig()))(terms_of(p)))
query("h_03_provenance", _POST + "SELECT s1, source, target, array_to_string(passes, '|') AS passes FROM org")(lambda p, t: retrieve.provenance(q_of(p), built(p), presets.IndexConfig()).withColumn("passes", F.array_join("passes", "|")))
query("c_07_retrieval", _POST + "SELECT s1, source, target, passes, name_idf, exact_name_score, exact_address_score, name_signature_score, name_token_score, address_token_score, numeric_address_score, best_score, pass_count, second_score FROM best")(
    lambda p, t: pool(p).select("s1", "source", "target", "passes", F.round("name_idf", 9).alias("name_idf"), *[f"{x}_score" for x in ranking.PASSES[:-1]], "best_score", "pass_count", "second_score")
)
query("c_08_pool_counts", _POST + "SELECT s1, count(*) AS n, count(DISTINCT target) AS n_distinct FROM rk GROUP BY s1")(lambda p, t: pool(p).groupBy("s1").agg(F.count("*").alias("n"), F.count_distinct("target").alias("n_distinct")))
_RANKS = ["exact_name_rank", "name_token_rank", "address_token_rank", "exact_address_rank", "name_signature_rank"]
query("f_01_pass_ranks", _POST + f"SELECT s1, source, target, {', '.join(f'CAST({r} AS INTEGER) AS {r}' for r in _RANKS)} FROM rk")(lambda p, t: found(p).select("s1", "source", "target", *_RANKS))
query("b_11_pass_eligibility", _POST + "SELECT s1, source, target FROM el")(lambda p, t: ranking.eligible(found(p), CAPS).select("s1", "source", "target"))
query("f_05_budget", _POST + "SELECT s1, source, target, best_score FROM sel")(lambda p, t: ranking.budgeted(found(p), CAPS, 60).select("s1", "source", "target", "best_score"))
query("c_09_labels", _POST + "SELECT sel.s1, sel.target, CAST(link.target IS NOT NULL AS INTEGER) AS label FROM sel LEFT JOIN link ON link.s1 = sel.s1 AND link.target = sel.target")(lambda p, t: linkage.labelled(ranking.budgeted(found(p), CAPS, 60), t).select("s1", "target", "label"))
query("c_13_retained_truth", _POST + "SELECT link.s1, link.target FROM link JOIN sel ON link.s1 = sel.s1 AND link.target = sel.target")(lambda p, t: metrics.links(t).join(ranking.budgeted(found(p), CAPS, 60).select("s1", "target"), ["s1", "target"], "left_semi"))
_PER = """, kept AS (SELECT t.s1, t.n_true, count(DISTINCT sel.target) AS n, count(DISTINCT link.target) AS kept FROM truth t LEFT JOIN sel ON sel.s1 = t.s1 LEFT JOIN link ON link.s1 = t.s1 AND link.target = sel.target GROUP BY ALL) """
query("d_13_candidate_metrics", _POST + _PER + """SELECT count(*) AS entities, CAST(sum(n_true) AS BIGINT) AS true_links, CAST(sum(kept) AS BIGINT) AS kept_links, round(sum(kept) / sum(n_true), 9) AS link_recall, count(*) FILTER (kept = n_true) AS all_kept,
  round(avg(n), 9) AS mean_candidates, round(quantile_cont(n, 0.5), 9) AS median_candidates, round(quantile_cont(n, 0.95), 9) AS p95_candidates, round(quantile_cont(n, 0.99), 9) AS p99_candidates, max(n) AS max_candidates, count(*) FILTER (n = 0) AS zero_entities FROM kept""")(
    lambda p, t: rounded(metrics.candidate_metrics(t, ranking.budgeted(found(p), CAPS, 60)), "link_recall", "mean_candidates", "median_candidates", "p95_candidates", "p99_candidates").select("entities", "true_links", "kept_links", "link_recall", "all_kept", "mean_candidates", "median_candidates", "p95_candidates", "p99_candidates", "max_candidates", "zero_entities")
)
query("d_14_candidates_by_entity", _POST + "SELECT s1, string_agg(DISTINCT target, ',' ORDER BY target) AS targets FROM sel GROUP BY s1")(lambda p, t: metrics.candidate_sets(ranking.budgeted(found(p), CAPS, 60)).withColumn("targets", F.array_join("targets", ",")))
def _frontier() -> str:
    """The candidates of each budget, and their metrics."""
    caps = lambda b: " OR ".join(f"{x}_rank BETWEEN 1 AND {b.caps[x]}" for x in ranking.PASSES)
    kept = [f"(SELECT '{name}' AS budget, s1, target FROM rk WHERE {caps(b)} QUALIFY row_number() OVER (PARTITION BY s1, source ORDER BY best_score DESC, pass_count DESC, target) <= {b.total})" for name, b in presets.BUDGETS.items()]
    return _POST + f""", kb AS ({' UNION ALL '.join(kept)}), per AS (SELECT g.budget, t.s1, t.n_true, count(DISTINCT kb.target) AS n, count(DISTINCT link.target) AS kept
  FROM truth t CROSS JOIN (SELECT unnest({list(presets.BUDGETS)}) AS budget) g LEFT JOIN kb ON kb.s1 = t.s1 AND kb.budget = g.budget LEFT JOIN link ON link.s1 = t.s1 AND link.target = kb.target GROUP BY ALL)
SELECT budget, CAST(sum(n_true) AS BIGINT) AS true_links, CAST(sum(kept) AS BIGINT) AS kept_links, round(sum(kept) / sum(n_true), 9) AS link_recall, count(*) FILTER (kept = n_true) AS all_kept, round(avg(n), 9) AS mean_candidates, max(n) AS max_candidates FROM per GROUP BY budget"""


query("d_22_budget_frontier", _frontier())(
    lambda p, t: rounded(metrics.budget_frontier(found(p), t, presets.BUDGETS), "link_recall", "mean_candidates").select("budget", "true_links", "kept_links", "link_recall", "all_kept", "mean_candidates", "max_candidates")
)
query("d_26_diagnostics")(lambda p, t: retrieve.diagnostics(X.represented(s1(p)), built(p), presets.IndexConfig()))
query("d_12_planned_probes")(lambda p, t: (lambda x: retrieve.probes(x[0], x[1], presets.INDEX["compact_14"]))(terms_of(p)))
query("f_08_candidate_budget")(lambda p, t: linkage.candidates(p, presets.INDEX["compact_6"]).select("s1", "source", "target", "best_score"))
query("d_31_oracle", _POST + """, m AS (SELECT t.s1, t.n_true, count(DISTINCT link.target) AS tp FROM truth t LEFT JOIN el ON el.s1 = t.s1 LEFT JOIN link ON link.s1 = t.s1 AND link.target = el.target GROUP BY ALL)
SELECT round(avg(CASE WHEN n_true = 0 THEN 1.0 WHEN tp = 0 THEN 0 ELSE 1.25 * tp / (1.25 * tp + 0.25 * (n_true - tp)) END), 9) AS macro_fbeta, round(avg(CAST(tp = n_true AS DOUBLE)), 9) AS coverage FROM m""")(
    lambda p, t: rounded(metrics.oracle(t, ranking.eligible(found(p), CAPS)).select("macro_fbeta", "coverage"), "macro_fbeta", "coverage")
)
query("m_01_miss_classes", _POST + """SELECT link.s1, link.target, CASE WHEN sel.target IS NOT NULL THEN 'retained' WHEN rk.target IS NOT NULL THEN 'cap_ranking_miss' ELSE 'discovery_miss' END AS class
FROM link LEFT JOIN rk ON rk.s1 = link.s1 AND rk.target = link.target LEFT JOIN sel ON sel.s1 = link.s1 AND sel.target = link.target""")(lambda p, t: miss.classified(t, found(p), presets.Budget("b", 60, CAPS)).select("s1", "target", "class"))
query("m_04_cap_counterfactual", _POST + """, k AS (SELECT 'pool' AS mode, s1, target, row_number() OVER (PARTITION BY s1, source ORDER BY best_score DESC, pass_count DESC, target) AS k FROM rk
  UNION ALL SELECT 'eligible', s1, target, row_number() OVER (PARTITION BY s1, source ORDER BY best_score DESC, pass_count DESC, target) FROM el)
SELECT mode, CAST(total AS INTEGER) AS total, count(*) FILTER (k <= total) AS kept_links FROM k JOIN link USING (s1, target) CROSS JOIN (SELECT unnest([10, 20, 40, 60, 80, 120]) AS total) GROUP BY mode, total""")(lambda p, t: miss.cap_counterfactual(t, found(p), CAPS))
query("d_28_miss_summary", _POST + """, c AS (SELECT link.country, link.source, CASE WHEN sel.target IS NOT NULL THEN 'r' WHEN rk.target IS NOT NULL THEN 'c' ELSE 'd' END AS class
FROM link LEFT JOIN rk ON rk.s1 = link.s1 AND rk.target = link.target LEFT JOIN sel ON sel.s1 = link.s1 AND sel.target = link.target)
SELECT country, source, count(*) AS links, count(*) FILTER (class = 'r') AS retained, count(*) FILTER (class = 'c') AS cap_ranking_miss, count(*) FILTER (class = 'd') AS discovery_miss FROM c GROUP BY GROUPING SETS ((), (country), (source), (country, source))""")(lambda p, t: miss.summary(miss.classified(t, found(p), presets.Budget("b", 60, CAPS)), p))
query("m_02_discovery")(lambda p, t: (lambda i: miss.discovery(metrics.links(t), X.represented(s1(p)), i["records"], i["token_df"], presets.IndexConfig()))(built(p)))


def reasons(p: DataFrame, t: DataFrame) -> DataFrame:
    terms, idx = terms_of(p)
    usable = terms.filter("length(token) >= 3 OR (field = 'address' AND numeric)")
    probed = retrieve.probes(terms, idx, presets.IndexConfig())
    return miss.intersection_reasons(metrics.links(t), usable, idx["records"], probed, retrieve.intersections(probed, idx, presets.IndexConfig())[0], presets.IndexConfig())


query("m_03_intersection_reasons")(reasons)

# Query-side blockers

_LEX = """, q AS (SELECT * FROM tok WHERE source = 'S1'), x AS (SELECT * FROM tok WHERE source <> 'S1'),
qk AS (SELECT entity_id AS s1, country, 'n' AS kind, unnest(list_filter(nu, lambda t: length(t) >= 4)) AS value FROM q UNION ALL SELECT entity_id, country, 'a', unnest(list_filter(au, lambda t: length(t) >= 4)) FROM q),
qr AS (SELECT * FROM qk QUALIFY count(*) OVER (PARTITION BY country, kind, value) <= 25),
qa AS (SELECT * FROM qr UNION ALL SELECT entity_id, country, 'en', nn FROM q WHERE nn <> '' UNION ALL SELECT entity_id, country, 'ea', an FROM q WHERE an <> ''),
xa AS (SELECT entity_id AS target, country, 'n' AS kind, unnest(nu) AS value FROM x UNION ALL SELECT entity_id, country, 'a', unnest(au) FROM x UNION ALL SELECT entity_id, country, 'en', nn FROM x WHERE nn <> '' UNION ALL SELECT entity_id, country, 'ea', an FROM x WHERE an <> ''),
hit AS (SELECT DISTINCT s1, target FROM qa JOIN xa USING (country, kind, value)),
m AS (SELECT h.s1, h.target, x.source, (q.nn <> '' AND q.nn = x.nn) AS en, (q.an <> '' AND q.an = x.an) AS ea, len(list_intersect(q.nu, x.nu)) AS sn, len(list_intersect(q.au, x.au)) AS sa,
  len(list_filter(list_intersect(q.au, x.au), lambda t: regexp_full_match(t, '[0-9]+'))) AS sd FROM hit h JOIN q ON q.entity_id = h.s1 JOIN x ON x.entity_id = h.target),
lex AS (SELECT s1, source, target, CAST(100 * CAST(en AS INTEGER) + 90 * CAST(ea AS INTEGER) + 20 * sn + 8 * sa + 12 * sd AS DOUBLE) AS blocking_score FROM m WHERE en OR ea OR sn >= 1 OR sa >= 2 OR (sa >= 1 AND sd >= 1)
  QUALIFY row_number() OVER (PARTITION BY s1, source ORDER BY blocking_score DESC, target) <= 25)
"""


def lexical(p: DataFrame) -> DataFrame:
    return blocking.lexical(stored(X.represented(s1(p))), stored(X.represented(others(p))))


query("c_05_lexical_blocker", _LEX + "SELECT s1, source, target, blocking_score FROM lex")(lambda p, t: lexical(p).select("s1", "source", "target", "blocking_score"))
query("b_06_query_index", _LEX + "SELECT s1, country, kind, value FROM qr")(
    lambda p, t: blocking._frequent(blocking._keys(X.represented(s1(p)), "s1", {"n": blocking._long(F.col("name.uniq"), 4), "a": blocking._long(F.col("address.uniq"), 4)}), {"n": 25, "a": 25}).select("s1", "country", "kind", "value")
)
query("b_07_admission", _LEX + "SELECT s1, target FROM m WHERE en OR ea OR sn >= 1 OR sa >= 2 OR (sa >= 1 AND sd >= 1)")(lambda p, t: blocking.lexical(X.represented(s1(p)), X.represented(others(p)), presets.LexicalConfig(top_k=1 << 30)).select("s1", "target"))
query("d_09_query_df", ", u AS (SELECT country, 'name' AS kind, unnest(nu) AS token FROM tok WHERE source = 'S1' UNION ALL SELECT country, 'address', unnest(au) FROM tok WHERE source = 'S1') SELECT country, kind, token, count(*) AS df FROM u GROUP BY ALL")(lambda p, t: blocking.query_df(X.represented(s1(p))).filter("kind IN ('name', 'address')"))
def _grams(a: str) -> str:
    t = f"replace({a}, ' ', '')"
    return f"CASE WHEN length({t}) = 0 THEN []::VARCHAR[] WHEN length({t}) < 4 THEN [{t}] ELSE list_distinct(list_transform(range(1, length({t}) - 2), lambda i: substring({t}, i, 4))) END"


def _multipass(side: str, name: str) -> str:
    """(name, country, kind, value) of one side."""
    kinds = {"exact_name": "[nn]", "exact_address": "[an]", "name_signature": "[array_to_string(nu, ' ')]", "name": "list_filter(nu, lambda w: length(w) >= 3)", "address": "list_filter(au, lambda w: length(w) >= 3)", "numeric": "list_filter(au, lambda w: regexp_full_match(w, '[0-9]+'))", "char": "g"}
    return " UNION ALL ".join(f"SELECT * FROM (SELECT entity_id AS {name}, country, '{k}' AS kind, unnest({v}) AS value FROM {side}) WHERE value <> ''" for k, v in kinds.items())


_SHARE = "CASE WHEN len({0}) = 0 OR len({1}) = 0 THEN 0.0 ELSE CAST(len(list_intersect({0}, {1})) AS DOUBLE) / {2} END"
_MULTI = f""", gr AS (SELECT *, {_grams('nn')} AS g FROM tok), q AS (SELECT * FROM gr WHERE source = 'S1'), x AS (SELECT * FROM gr WHERE source <> 'S1'),
qk AS ({_multipass('q', 's1')}), qr AS (SELECT * FROM qk QUALIFY count(*) OVER (PARTITION BY country, kind, value) <= CASE kind WHEN 'name' THEN 60 WHEN 'address' THEN 40 WHEN 'numeric' THEN 250 WHEN 'char' THEN 6 ELSE 1 << 30 END),
xk AS ({_multipass('x', 'target')}), met AS (SELECT s1, target, count(*) FILTER (kind = 'char') AS ch, count(*) FILTER (kind <> 'char') AS other FROM qr JOIN xk USING (country, kind, value) GROUP BY ALL HAVING ch >= 2 OR other > 0),
qt AS (SELECT entity_id AS s1, country, 'name' AS kind, unnest(nu) AS token FROM q UNION ALL SELECT entity_id, country, 'address', unnest(au) FROM q), pop AS (SELECT country, count(*) AS n FROM q GROUP BY country),
w AS (SELECT s1, kind, token, ln((pop.n + 1) / (count(*) OVER (PARTITION BY qt.country, kind, token) + 1)) + 1 AS idf FROM qt JOIN pop USING (country)), ws AS (SELECT s1, kind, sum(idf) AS total FROM w GROUP BY ALL),
ov AS (SELECT m.s1, m.target, w.kind, sum(idf) AS hit FROM met m JOIN x ON x.entity_id = m.target JOIN w ON w.s1 = m.s1 AND list_contains(CASE w.kind WHEN 'name' THEN x.nu ELSE x.au END, w.token) GROUP BY ALL),
cm AS (SELECT m.s1, m.target, x.source, q.nn <> '' AND q.nn = x.nn AS en, q.an <> '' AND q.an = x.an AS ea, len(x.nu) > 0 AND q.nu = x.nu AS sg, len(list_intersect(q.nu, x.nu)) AS sn, len(list_intersect(q.au, x.au)) AS sa, ch, coalesce(n.hit / wn.total, 0) AS ni, coalesce(a.hit / wa.total, 0) AS ai,
  {_SHARE.format('q.nu', 'x.nu', 'len(list_distinct(list_concat(q.nu, x.nu)))')} AS nj, {_SHARE.format('q.au', 'x.au', 'len(list_distinct(list_concat(q.au, x.au)))')} AS aj, {_SHARE.format('q.g', 'x.g', 'len(list_distinct(list_concat(q.g, x.g)))')} AS cj,
  list_filter(q.au, lambda w: regexp_full_match(w, '[0-9]+')) AS qd, list_filter(x.au, lambda w: regexp_full_match(w, '[0-9]+')) AS xd
  FROM met m JOIN q ON q.entity_id = m.s1 JOIN x ON x.entity_id = m.target LEFT JOIN ov n ON n.s1 = m.s1 AND n.target = m.target AND n.kind = 'name' LEFT JOIN ov a ON a.s1 = m.s1 AND a.target = m.target AND a.kind = 'address'
  LEFT JOIN ws wn ON wn.s1 = m.s1 AND wn.kind = 'name' LEFT JOIN ws wa ON wa.s1 = m.s1 AND wa.kind = 'address'),
dg AS (SELECT *, len(list_intersect(qd, xd)) AS sd, {_SHARE.format('qd', 'xd', 'least(len(qd), len(xd))')} AS d FROM cm),
mp AS (SELECT s1, source, target, round(CASE WHEN en THEN 100 + 30 * aj + 10 * d ELSE 0 END, 9) AS exact_name_score, round(CASE WHEN ea THEN 100 + 30 * nj ELSE 0 END, 9) AS exact_address_score, round(CASE WHEN sg THEN 105 + 20 * aj ELSE 0 END, 9) AS name_signature_score,
  round(CASE WHEN sn > 0 AND ni > 0 THEN 100 * ni + 20 * nj ELSE 0 END, 9) AS name_token_score, round(CASE WHEN sa >= 2 OR ai >= 0.25 THEN 100 * ai + 20 * aj + 20 * d ELSE 0 END, 9) AS address_token_score,
  round(CASE WHEN sd > 0 THEN 80 * d + 20 * nj + 20 * aj ELSE 0 END, 9) AS numeric_address_score, round(CASE WHEN ch >= 2 AND cj >= 0.2 THEN 100 * cj + 20 * nj ELSE 0 END, 9) AS char_name_score FROM dg
  WHERE en OR ea OR sg OR (sn > 0 AND ni > 0) OR sa >= 2 OR ai >= 0.25 OR sd > 0 OR (ch >= 2 AND cj >= 0.2))
"""
_MULTI_SCORES = [f"{x}_score" for x in ranking.PASSES]
query("c_06_multipass_blocker", _MULTI + f"SELECT s1, source, target, {', '.join(_MULTI_SCORES)} FROM mp")(
    lambda p, t: rounded(blocking.multipass(X.represented(s1(p)), X.represented(others(p)), presets.MultiPassConfig(pool=1 << 30), False), *_MULTI_SCORES).select("s1", "source", "target", *_MULTI_SCORES)
)
query("c_06_multipass_pool")(lambda p, t: blocking.multipass(X.represented(s1(p)), X.represented(others(p)), texts=False))
query("f_02_multipass_ranks")(lambda p, t: ranking.budgeted(blocking.multipass(X.represented(s1(p)), X.represented(others(p)), texts=False), presets.BUDGETS["balanced"].caps, presets.BUDGETS["balanced"].total).select("s1", "source", "target", "best_score", "pass_count"))

# Metrics, on predictions that SQL can make too: targets of the family whose number is not divisible by 4, and each record's own number in S2

_PRED = """, pred AS (SELECT s1, target FROM link WHERE CAST(split_part(target, '-', 2) AS BIGINT) % 4 <> 0 UNION SELECT s1, concat('S2-', CAST(split_part(s1, '-', 2) AS BIGINT) + 1) FROM truth WHERE CAST(split_part(s1, '-', 2) AS BIGINT) % 6 = 0),
em AS (SELECT t.s1, t.country, t.n_true, count(DISTINCT p.target) AS np, count(DISTINCT link.target) AS tp FROM truth t LEFT JOIN pred p ON p.s1 = t.s1 LEFT JOIN link ON link.s1 = p.s1 AND link.target = p.target GROUP BY ALL),
ev AS (SELECT s1, country, n_true, tp, np - tp AS fp, n_true - tp AS fn, CASE WHEN n_true = 0 THEN CAST(np = 0 AS DOUBLE) WHEN np = 0 THEN 0.0 ELSE tp / np END AS precision, CASE WHEN n_true = 0 THEN CAST(np = 0 AS DOUBLE) ELSE tp / n_true END AS recall,
  CASE WHEN n_true = 0 THEN CAST(np = 0 AS DOUBLE) WHEN tp = 0 THEN 0.0 ELSE 1.25 * tp / (1.25 * tp + 0.25 * (n_true - tp) + (np - tp)) END AS fbeta FROM em)
"""
_MACRO = "count(*) AS entities, round(avg(fbeta), 9) AS macro_fbeta, round(avg(precision), 9) AS macro_precision, round(avg(recall), 9) AS macro_recall, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, count(*) FILTER (n_true = 0) AS singletons, count(*) FILTER (n_true = 0 AND fp = 0) AS correct_singletons"
_MACRO_COLUMNS = ["entities", "macro_fbeta", "macro_precision", "macro_recall", "tp", "fp", "fn", "singletons", "correct_singletons"]


def predicted(t: DataFrame) -> DataFrame:
    n = lambda c: F.split_part(c, F.lit("-"), F.lit(2)).cast("bigint")
    own = t.filter(n("s1") % 6 == 0).select("s1", F.concat(F.lit("S2-"), n("s1") + 1).alias("target"))
    return metrics.links(t).filter(n("target") % 4 != 0).unionByName(own).distinct()


def macro(df: DataFrame, *by: str) -> DataFrame:
    return rounded(df.select(*by, *_MACRO_COLUMNS), "macro_fbeta", "macro_precision", "macro_recall")


query("d_15_entity_metrics", _PRED + "SELECT s1, n_true, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(fbeta, 9) AS fbeta FROM ev")(lambda p, t: rounded(metrics.entity_metrics(t, predicted(t)), "precision", "recall", "fbeta"))
query("d_17_evaluation", _PRED + f"SELECT {_MACRO} FROM ev")(lambda p, t: macro(metrics.evaluated(metrics.entity_metrics(t, predicted(t)))))
query("d_18_official_score", _PRED + "SELECT round(avg(fbeta), 9) AS score FROM ev")(lambda p, t: metrics.evaluated(metrics.entity_metrics(t, predicted(t))).select(F.round("macro_fbeta", 9).alias("score")))
query("d_19_slices", _PRED + f""", lab AS (SELECT ev.*, unnest(list_concat([['overall', 'all'], ['country', country], ['multiplicity', CASE WHEN n_true = 0 THEN '0' WHEN n_true <= 2 THEN '1-2' WHEN n_true <= 4 THEN '3-4' ELSE '5+' END]],
  list_concat(list_transform(src, lambda s: ['source', s]), list_transform(src, lambda s: ['source_country', concat(s, '|', country)])))) AS l
  FROM ev JOIN (SELECT t.s1, list_sort(list_distinct(list(coalesce(link.source, 'singleton')))) AS src FROM truth t LEFT JOIN link ON link.s1 = t.s1 GROUP BY t.s1) USING (s1))
SELECT l[1] AS dimension, l[2] AS value, {_MACRO} FROM lab GROUP BY ALL""")(lambda p, t: macro(metrics.sliced(metrics.entity_metrics(t, predicted(t)), p, t), "dimension", "value"))
query("d_21_false_negatives", _PRED + ", c AS (SELECT * FROM link WHERE source = 'S2') SELECT count(*) FILTER (c.target IS NULL) AS blocker_fn, count(*) FILTER (c.target IS NOT NULL) AS matcher_fn, count(*) AS fn FROM link LEFT JOIN c ON c.s1 = link.s1 AND c.target = link.target LEFT JOIN pred ON pred.s1 = link.s1 AND pred.target = link.target WHERE pred.target IS NULL")(
    lambda p, t: metrics.false_negatives(t, metrics.links(t).filter("target LIKE 'S2-%'"), predicted(t))
)
query("d_23_error_slices", _PRED + """, f AS (SELECT coalesce(link.s1, pred.s1) AS s1, coalesce(link.target, pred.target) AS target, link.target IS NOT NULL AS t, pred.target IS NOT NULL AS p FROM link FULL JOIN pred ON pred.s1 = link.s1 AND pred.target = link.target),
l AS (SELECT f.*, unnest([['entity', CASE WHEN n_true = 0 THEN 'singleton' ELSE 'matched' END], ['multiplicity', CASE WHEN n_true = 0 THEN '0' WHEN n_true <= 2 THEN '1-2' WHEN n_true <= 4 THEN '3-4' ELSE '5+' END], ['source_country', concat(left(f.target, 2), '|', country)]]) AS l FROM f JOIN truth USING (s1))
SELECT l[1] AS dimension, l[2] AS value, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t) AS fp, count(*) FILTER (NOT p) AS fn FROM l GROUP BY ALL""")(lambda p, t: metrics.error_slices(t, predicted(t), p))
query("d_30_ownership", ", o AS (SELECT target, count(DISTINCT s1) AS n FROM link GROUP BY target) SELECT CAST(sum(n) AS BIGINT) AS links, count(*) AS targets, count(*) FILTER (n > 1) AS conflicts, max(n) AS most_owners, count(*) FILTER (n > 1 AND target LIKE 'S2-%') AS conflicts_s2, count(*) FILTER (n > 1 AND target LIKE 'S3-%') AS conflicts_s3 FROM o")(
    lambda p, t: metrics.ownership(t)
)
query("d_30_conflicts", "SELECT target, string_agg(DISTINCT s1, ',' ORDER BY s1) AS owners FROM link GROUP BY target HAVING count(DISTINCT s1) > 1 ORDER BY target LIMIT 20")(lambda p, t: metrics.conflicts(t).withColumn("owners", F.array_join("owners", ",")))

# Audits

query("d_01_source_counts", "SELECT source, count(*) AS n_rows, count(*) FILTER (trim(business_name) = '') AS missing_business_name, count(*) FILTER (trim(business_address) = '') AS missing_business_address, count(*) FILTER (NOT starts_with(entity_id, concat(source, '-'))) AS wrong_prefix FROM party GROUP BY source")(
    lambda p, t: audit.source_counts(p).drop("missing_entity_id", "missing_country")
)
query("d_01_countries", "SELECT source, country, count(*) AS n_rows FROM party GROUP BY ALL")(lambda p, t: audit.country_counts(p))
query("d_02_duplicates", ", g AS (SELECT source, business_name, business_address, country, count(*) AS n FROM party GROUP BY ALL) SELECT source, count(*) AS n_distinct, count(*) FILTER (n > 1) AS repeated, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS rows_in_repeated, CAST(sum(n - 1) AS BIGINT) AS excess FROM g GROUP BY source")(
    lambda p, t: audit.duplicates(p, "business_name", "business_address", "country")
)
query("d_03_lengths", "SELECT source, count(*) AS n, round(avg(length(business_name)), 9) AS mean_len, CAST(min(length(business_name)) AS INTEGER) AS min_len, " + ", ".join(f"CAST(quantile_disc(length(business_name), {p / 100}) AS INTEGER) AS p{p}" for p in (25, 50, 75, 90, 95, 99)) + ", CAST(max(length(business_name)) AS INTEGER) AS max_len FROM party WHERE trim(business_name) <> '' GROUP BY source")(
    lambda p, t: rounded(audit.lengths(p, "business_name"), "mean_len")
)
query("d_04_match_counts", "SELECT CAST(n_true AS INTEGER) AS matches, count(*) AS entities FROM truth GROUP BY ALL")(lambda p, t: audit.match_counts(t))
query("d_04_coverage", ", k AS (SELECT t.s1, t.n_true, bool_or(link.source = 'S2') AS a, bool_or(link.source = 'S3') AS b FROM truth t LEFT JOIN link ON link.s1 = t.s1 GROUP BY ALL) SELECT CASE WHEN n_true = 0 THEN 'singleton' WHEN a AND b THEN 'both' WHEN a THEN 'S2 only' ELSE 'S3 only' END AS kind, count(*) AS entities, CAST(sum(n_true) AS BIGINT) AS links FROM k GROUP BY ALL")(
    lambda p, t: audit.coverage(t)
)
query("d_04_links_by_source", "SELECT source, count(*) AS links, count(DISTINCT target) AS targets FROM link GROUP BY source")(lambda p, t: audit.links_by_source(t))
query("d_05_country_shift", """, s AS (SELECT CASE WHEN CAST(split_part(entity_id, '-', 2) AS BIGINT) % 5 = 0 THEN 'test' ELSE 'train' END AS split, source, country FROM party), e AS (SELECT * FROM s UNION ALL SELECT split, 'ALL', country FROM s),
n AS (SELECT source, country, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'test') AS test FROM e GROUP BY ALL)
SELECT source, country, train, test, round(train / sum(train) OVER (PARTITION BY source), 9) AS train_share, round(test / sum(test) OVER (PARTITION BY source), 9) AS test_share, round(100 * (test / sum(test) OVER (PARTITION BY source) - train / sum(train) OVER (PARTITION BY source)), 6) AS change_points, train = 0 AND test > 0 AS test_only FROM n""")(
    lambda p, t: rounded(audit.country_shift(p.withColumn("split", F.when(F.split_part("entity_id", F.lit("-"), F.lit(2)).cast("bigint") % 5 == 0, "test").otherwise("train"))), "train_share", "test_share").withColumn("change_points", F.round("change_points", 6))
)
query("c_10_positive_profile")(lambda p, t: audit.profile(features.with_rule(pairs(p, t)), ["name_ratio", "name_token_jaccard", "address_ratio", "address_token_jaccard"]))
query("d_27_jaccard_profile", _PAIRS + """, v AS (SELECT split_part(target, '-', 1) AS source, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE CAST(len(list_intersect(x, y)) AS DOUBLE) / len(list_distinct(list_concat(x, y))) END AS value FROM pr)
SELECT source, count(*) AS n, round(avg(value), 9) AS mean, round(quantile_cont(value, 0.5), 9) AS q50, round(quantile_cont(value, 0.95), 9) AS q95 FROM v GROUP BY GROUPING SETS ((), (source))""")(
    lambda p, t: rounded(audit.profile(pairs(p, t).withColumn("j", X.jaccard(F.col("qn.uniq"), F.col("tn.uniq"))), ["j"]).filter("country IS NULL").select("source", "n", "mean", "q50", "q95"), "mean", "q50", "q95")
)
query("c_11_link_countries", "SELECT count(*) AS links, count(*) FILTER (b.country IS NULL) AS missing_targets, count(*) FILTER (a.country <> b.country) AS across_countries FROM link LEFT JOIN party a ON a.entity_id = link.s1 LEFT JOIN party b ON b.entity_id = link.target")(lambda p, t: audit.link_countries(t, p))
query("c_14_integrity", "SELECT CAST(0 AS BIGINT) AS truth_without_record, CAST(0 AS BIGINT) AS record_without_truth, count(DISTINCT target) AS unknown_targets FROM link WHERE source = 'S3'")(lambda p, t: audit.integrity(t, p.filter("source <> 'S3'")))
query("d_33_output_audit", ", m AS (SELECT s1, count(*) FILTER (source = 'S2') AS n FROM link GROUP BY s1) SELECT count(*) AS n_rows, count(*) FILTER (coalesce(m.n, 0) > 0) AS linked, CAST(sum(coalesce(m.n, 0)) AS BIGINT) AS links, CAST(sum(n_true) AS BIGINT) AS candidate_links, CAST(0 AS BIGINT) AS one_sided, CAST(0 AS BIGINT) AS not_subset FROM truth LEFT JOIN m USING (s1)")(
    lambda p, t: audit.output_audit(t.withColumn("targets", F.filter("targets", lambda x: x.startswith("S2-"))), t)
)
query("d_34_throughput", "SELECT CAST(s AS BIGINT) AS shard, count(*) AS n, s + 1.5::DOUBLE AS seconds, CAST(count(*) AS DOUBLE) / (s + 1.5) AS per_second FROM (SELECT CAST(split_part(s1, '-', 2) AS BIGINT) % 4 AS s FROM truth) GROUP BY s UNION ALL SELECT -1, count(*), 4.5, CAST(count(*) AS DOUBLE) / 4.5 FROM truth")(
    lambda p, t: audit.throughput(t.groupBy((F.split_part("s1", F.lit("-"), F.lit(2)).cast("bigint") % 4).alias("shard")).agg(F.count("*").alias("n")).withColumn("seconds", F.col("shard") + 1.5))
)
def broken_lists(t: DataFrame) -> DataFrame:
    """A submission with a fault of each kind, by the records' numbers."""
    n = F.split_part("source1_entity_id", F.lit("-"), F.lit(2)).cast("bigint")
    s = tsv.submission(t, predicted(t))
    ids = F.col("matched_entity_ids")
    ids = F.when(n % 11 == 0, F.lit("S3-1,S2-1")).when(n % 11 == 3, F.lit("S2-4,S2-4")).when(n % 11 == 5, F.lit("S2-5,,S3-5")).when(n % 11 == 6, F.col("source1_entity_id")).when(n % 11 == 7, F.lit("X-7")).otherwise(ids)
    s = s.withColumn("matched_entity_ids", ids).filter(n % 13 != 1)
    return s.unionByName(s.filter(n % 17 == 2)).unionByName(s.filter(n % 19 == 3).withColumn("source1_entity_id", F.concat(F.lit("S2-"), n)))


_BROKEN = _PRED + """, sub AS (SELECT t.s1, CAST(split_part(t.s1, '-', 2) AS BIGINT) AS n, coalesce(string_agg(DISTINCT p.target, ',' ORDER BY p.target), '') AS ids FROM truth t LEFT JOIN pred p ON p.s1 = t.s1 GROUP BY t.s1),
bad AS (SELECT s1, n, CASE n % 11 WHEN 0 THEN 'S3-1,S2-1' WHEN 3 THEN 'S2-4,S2-4' WHEN 5 THEN 'S2-5,,S3-5' WHEN 6 THEN s1 WHEN 7 THEN 'X-7' ELSE ids END AS ids FROM sub WHERE n % 13 <> 1),
r AS (SELECT s1, CASE WHEN trim(ids) = '' THEN []::VARCHAR[] ELSE string_split(ids, ',') END AS items FROM (SELECT s1, ids FROM bad UNION ALL SELECT s1, ids FROM bad WHERE n % 17 = 2 UNION ALL SELECT concat('S2-', n), ids FROM bad WHERE n % 19 = 3)),
i AS (SELECT s1, unnest(items) AS target FROM r), v AS (
  SELECT 'blank_entity' AS rule, s1 AS x FROM r WHERE trim(s1) = '' UNION ALL SELECT 'wrong_entity_prefix', s1 FROM r WHERE NOT starts_with(s1, 'S1-') UNION ALL SELECT 'repeated_entity', s1 FROM r GROUP BY s1 HAVING count(*) > 1
  UNION ALL SELECT 'blank_item', s1 FROM i WHERE trim(target) = '' UNION ALL SELECT 'repeated_item', s1 FROM r WHERE len(list_distinct(items)) < len(items) UNION ALL SELECT 'unsorted', s1 FROM r WHERE list_sort(items) <> items
  UNION ALL SELECT 'self_match', s1 FROM i WHERE target = s1 UNION ALL SELECT 'wrong_prefix', target FROM i WHERE NOT regexp_full_match(target, 'S[23]-.+') AND target <> s1
  UNION ALL SELECT 'missing_entity', s1 FROM truth WHERE s1 NOT IN (SELECT s1 FROM r) UNION ALL SELECT DISTINCT 'unknown_entity', s1 FROM r WHERE s1 NOT IN (SELECT s1 FROM truth)
  UNION ALL SELECT DISTINCT 'unknown_target', target FROM i WHERE target NOT IN (SELECT entity_id FROM party WHERE source <> 'S1'))
SELECT rule, count(x) AS n, min(x) AS example FROM (SELECT unnest(['blank_entity', 'wrong_entity_prefix', 'repeated_entity', 'blank_item', 'repeated_item', 'unsorted', 'self_match', 'wrong_prefix', 'missing_entity', 'unknown_entity', 'unknown_target']) AS rule) LEFT JOIN v USING (rule) GROUP BY rule"""
query("m_14_validator", _BROKEN)(lambda p, t: validate.violations(broken_lists(t), "matched_entity_ids", t, others(p).select(F.col("entity_id").alias("target"))))
query("h_04_subset", "SELECT DISTINCT s1 FROM link WHERE source = 'S3'")(lambda p, t: validate.not_subset(t, t.withColumn("targets", F.filter("targets", lambda x: x.startswith("S2-")))))

# Splits and samples

_KEY = ", e AS (SELECT *, sha256(concat('7:', s1)) AS key FROM truth) "
query("g_03_split", _KEY + ", k AS (SELECT *, count(*) OVER (PARTITION BY country, n_true > 0) AS n, row_number() OVER (PARTITION BY country, n_true > 0 ORDER BY key, s1) AS r FROM e) SELECT s1, CASE WHEN n >= 2 THEN r <= greatest(1, least(round_even(n * 0.3, 0), n - 1)) ELSE r <= round_even(n * 0.3, 0) END AS validation FROM k")(
    lambda p, t: sampling.split(sized(p, t), 0.3).select("s1", "validation")
)
_ALLOC = _KEY + ", g AS (SELECT country, n_true, count(*) AS n FROM e GROUP BY ALL), a AS (SELECT *, 60.0::DOUBLE * n / sum(n) OVER () AS x FROM g), b AS (SELECT *, floor(x) + CAST(row_number() OVER (ORDER BY x - floor(x) DESC, country, n_true) <= 60 - sum(floor(x)) OVER () AS INTEGER) AS take FROM a) "
query("g_04_allocation", _ALLOC + "SELECT country, n_true, n, CAST(take AS BIGINT) AS take FROM b")(lambda p, t: sampling.allocate(sized(p, t).groupBy("country", "n_true").agg(F.count("*").alias("n")), 60, ["country", "n_true"]))
query("g_05_stratified_sample", _ALLOC + "SELECT s1 FROM (SELECT e.s1, take, row_number() OVER (PARTITION BY country, n_true ORDER BY key, s1) AS r FROM e JOIN b USING (country, n_true)) WHERE r <= take")(lambda p, t: sampling.stratified(sized(p, t), 60, ["country", "n_true"]).select("s1"))
query("g_06_quota_sample", _KEY + ", r AS (SELECT * FROM e WHERE n_true = 0), g AS (SELECT country, count(*) AS n FROM r GROUP BY ALL), a AS (SELECT *, 30.0::DOUBLE * n / sum(n) OVER () AS x FROM g), b AS (SELECT *, floor(x) + CAST(row_number() OVER (ORDER BY x - floor(x) DESC, country) <= 30 - sum(floor(x)) OVER () AS INTEGER) AS take FROM a) SELECT s1 FROM (SELECT r.s1, take, row_number() OVER (PARTITION BY country ORDER BY key, s1) AS k FROM r JOIN b USING (country)) WHERE k <= take")(
    lambda p, t: sampling.excluding(sized(p, t), metrics.links(t).select("s1"), 30).select("s1")
)
query("g_07_smallest_hashes", ", h AS (SELECT s1, target, sha256(concat('9:', s1, '|', target)) AS key FROM link) SELECT s1, target FROM h ORDER BY key LIMIT 50")(lambda p, t: sampling.first(metrics.links(t).withColumn("key", hashing.sha_key(F.concat_ws("|", "s1", "target"), 9)), 50, "key").drop("key"))
query("g_08_nested_prefix", _KEY + "SELECT s1 FROM e ORDER BY key, s1 LIMIT 40")(lambda p, t: sampling.first(sized(p, t), 40, "key", "s1").select("s1"))
query("g_01_entity_keys")(lambda p, t: s1(p).select("entity_id", F.hex(hashing.entity_key(F.col("entity_id"), 2028)).alias("key")))
query("g_02_pair_keys")(lambda p, t: metrics.links(t).select("s1", "target", F.hex(hashing.pair_key(F.col("s1"), F.col("target"), 2031)).alias("key")))
query("g_13_halves")(lambda p, t: s1(p).select("entity_id", sampling.halves(hashing.entity_key(F.col("entity_id"), 2030)).alias("half")))
query("g_12_partitions", _KEY + """, v AS (SELECT s1 FROM e WHERE n_true > 4), r AS (SELECT * FROM e WHERE n_true <= 4), k AS (SELECT *, count(*) OVER (PARTITION BY country, n_true > 0) AS n, row_number() OVER (PARTITION BY country, n_true > 0 ORDER BY key, s1) AS i FROM r)
SELECT s1, 'evaluation' AS partition FROM v UNION ALL SELECT s1, CASE WHEN CASE WHEN n >= 2 THEN i <= greatest(1, least(round_even(n * 0.25, 0), n - 1)) ELSE i <= round_even(n * 0.25, 0) END THEN 'tune' ELSE 'fit' END FROM k""")(
    lambda p, t: sampling.partitions(sized(p, t), t.filter(F.size("targets") > 4), 0.25).select("s1", "partition")
)
query("f_10_shards", "SELECT entity_id, CAST((row_number() OVER (ORDER BY entity_id) - 1) % 4 AS BIGINT) AS shard FROM party WHERE source = 'S1'")(lambda p, t: ranking.shard(tsv.positioned(s1(p).select("entity_id"), "entity_id"), "position", 4).drop("position"))
_SCORED = ", s AS (SELECT s1, target, source, CAST(1 AS INTEGER) AS label, (CAST(split_part(target, '-', 2) AS BIGINT) * 37 % 101) / 100.0::DOUBLE AS score FROM link UNION ALL SELECT p.entity_id, concat('S3-', CAST(split_part(p.entity_id, '-', 2) AS BIGINT) + 2), 'S3', 0, (CAST(split_part(p.entity_id, '-', 2) AS BIGINT) * 53 % 101) / 100.0::DOUBLE FROM party p WHERE p.source = 'S1' AND NOT EXISTS (SELECT 1 FROM link l WHERE l.s1 = p.entity_id AND l.target = concat('S3-', CAST(split_part(p.entity_id, '-', 2) AS BIGINT) + 2)))"


def scores(p: DataFrame, t: DataFrame) -> DataFrame:
    """Pairs with scores that SQL can make too: all links, and each record with the next number in S3."""
    n = lambda c: F.split_part(c, F.lit("-"), F.lit(2)).cast("bigint")
    true = metrics.links(t).select("s1", "target", F.substring("target", 1, 2).alias("source"), F.lit(1).alias("label"), (n("target") * 37 % 101 / 100.0).alias("score"))
    other = t.select("s1", F.concat(F.lit("S3-"), n("s1") + 2).alias("target"), F.lit("S3").alias("source"), F.lit(0).alias("label"), (n("s1") * 53 % 101 / 100.0).alias("score"))
    return true.unionByName(other.join(true, ["s1", "target"], "left_anti"))


query("g_09_training_pairs", _SCORED + """, n AS (SELECT *, 100 * score AS hardness, sha256(concat('5:', s1, '|', target)) AS k FROM s), h AS (SELECT s1, target FROM n WHERE label = 0 QUALIFY row_number() OVER (PARTITION BY s1 ORDER BY hardness DESC, target DESC) <= 20)
SELECT s1, target, 'positive' AS kind FROM n WHERE label = 1 UNION ALL SELECT s1, target, 'hard' FROM h UNION ALL (SELECT s1, target, 'easy' FROM (SELECT * FROM n WHERE label = 0 AND hardness <= 55 QUALIFY row_number() OVER (PARTITION BY s1 ORDER BY k, target DESC) <= 3) e WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.s1 = e.s1 AND h.target = e.target))""")(
    lambda p, t: sampling.training_pairs(scores(p, t).withColumns({"hardness": 100 * F.col("score"), "pair_key": hashing.sha_key(F.concat_ws("|", "s1", "target"), 5)})).select("s1", "target", "kind")
)

# Scores and decisions

query("b_14_source_thresholds", _SCORED + " SELECT s1, target, score FROM s WHERE score >= CASE source WHEN 'S2' THEN 0.6 ELSE 0.4 END")(lambda p, t: decide.accepted(scores(p, t), decide.Policy(0.6, 0.4)))
query("b_12_accepted_ids", _SCORED + " SELECT s1, string_agg(DISTINCT target, ',' ORDER BY target) AS targets FROM s WHERE score >= 0.5 GROUP BY s1")(lambda p, t: scores(p, t).filter("score >= 0.5").groupBy("s1").agg(tsv.id_list(F.collect_set("target")).alias("targets")))
query("b_13_predictions", _SCORED + " SELECT t.s1, count(s.target) AS n FROM truth t LEFT JOIN s ON s.s1 = t.s1 AND s.score >= 0.5 GROUP BY t.s1")(lambda p, t: t.join(scores(p, t).filter("score >= 0.5").select("s1", "target"), "s1", "left").groupBy("s1").agg(F.count("target").alias("n")))
query("b_15_filter_by_source", "SELECT s1, target FROM link WHERE source = 'S3'")(lambda p, t: metrics.links(t).filter(F.col("target").startswith("S3-")))
query("b_18_positive_links", "SELECT s1, target FROM link")(lambda p, t: metrics.links(t))
query("b_19_subset_table", "SELECT s1, country, n_true, n_true = 0 AS is_singleton FROM truth")(lambda p, t: sized(p, t).select("s1", "country", "n_true", (F.col("n_true") == 0).alias("is_singleton")))
query("f_06_score_ranks", _SCORED + " SELECT s1, target, CAST(row_number() OVER (PARTITION BY s1 ORDER BY score DESC, target) AS INTEGER) AS rank, CAST(row_number() OVER (PARTITION BY s1, source ORDER BY score DESC, target) AS INTEGER) AS source_rank FROM s")(lambda p, t: ranking.score_ranks(scores(p, t)).select("s1", "target", "rank", "source_rank"))
query("f_07_top_scores", _SCORED + ", r AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY score DESC, target) AS k FROM s) SELECT s1, round(max(score) FILTER (k = 1), 9) AS top, round(coalesce(max(score) FILTER (k = 1), 0) - coalesce(max(score) FILTER (k = 2), 0), 9) AS gap FROM r GROUP BY s1")(
    lambda p, t: ranking.score_ranks(scores(p, t)).groupBy("s1").agg(F.round(F.max("score"), 9).alias("top"), F.round(F.max("score") - F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))), F.lit(0.0)), 9).alias("gap"))
)
query("f_12_exclusivity", _SCORED + " SELECT s1, target, score FROM s WHERE score >= 0.5 QUALIFY row_number() OVER (PARTITION BY target ORDER BY score DESC, s1) = 1")(lambda p, t: decide.accepted(scores(p, t), decide.Policy(0.5, 0.5, exclusivity=True)))
query("f_13_shares", "SELECT source, country, round(count(*) / sum(count(*)) OVER (PARTITION BY source), 9) AS share FROM party GROUP BY source, country")(lambda p, t: audit.country_counts(p).select("source", "country", F.round(F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy("source")), 9).alias("share")))
_CURVE = _SCORED + f""", g AS (SELECT unnest({GRID}) AS threshold), c AS (SELECT t.s1, n_true, threshold, count(s.target) FILTER (s.label = 1) AS tp, count(s.target) FILTER (s.label = 0) AS fp FROM truth t CROSS JOIN g LEFT JOIN s ON s.s1 = t.s1 AND s.score >= threshold GROUP BY ALL),
f AS (SELECT CAST(threshold AS DOUBLE) AS threshold, round(avg(CASE WHEN n_true = 0 THEN CAST(fp = 0 AS DOUBLE) WHEN tp = 0 THEN 0 ELSE 1.25 * tp / (1.25 * tp + 0.25 * (n_true - tp) + fp) END), 9) AS macro_fbeta FROM c GROUP BY ALL) """
query("e_07_threshold_curve", _CURVE + "SELECT * FROM f")(lambda p, t: metrics.threshold_curve(scores(p, t), t, GRID).select("threshold", F.round("macro_fbeta", 9).alias("macro_fbeta")))
query("e_06_best_threshold", _CURVE + "SELECT * FROM f ORDER BY macro_fbeta DESC, threshold DESC LIMIT 1")(lambda p, t: metrics.best_threshold(scores(p, t), t, GRID).select("threshold", F.round("macro_fbeta", 9).alias("macro_fbeta")))
query("e_11_source_threshold_search", _SCORED + f""", g AS (SELECT unnest({GRID}) AS threshold), h AS (SELECT t.s1, n_true, src, threshold, count(s.target) FILTER (s.label = 1) AS tp, count(s.target) FILTER (s.label = 0) AS fp FROM truth t CROSS JOIN g CROSS JOIN (SELECT unnest(['S2', 'S3']) AS src) LEFT JOIN s ON s.s1 = t.s1 AND s.source = src AND s.score >= threshold GROUP BY ALL),
j AS (SELECT a.threshold AS s2, b.threshold AS s3, a.n_true, a.tp + b.tp AS tp, a.fp + b.fp AS fp FROM h a JOIN h b ON a.s1 = b.s1 WHERE a.src = 'S2' AND b.src = 'S3')
SELECT * FROM (SELECT CAST(s2 AS DOUBLE) AS s2, CAST(s3 AS DOUBLE) AS s3, round(avg(CASE WHEN n_true = 0 THEN CAST(fp = 0 AS DOUBLE) WHEN tp = 0 THEN 0 ELSE 1.25 * tp / (1.25 * tp + 0.25 * (n_true - tp) + fp) END), 9) AS macro_fbeta FROM j GROUP BY ALL) ORDER BY macro_fbeta DESC, s2 + s3 DESC, s2 DESC LIMIT 1""")(
    lambda p, t: rounded(decide.source_thresholds(scores(p, t), t, GRID), "macro_fbeta")
)
query("e_12_claims", _SCORED + ", c AS (SELECT target, count(*) AS n FROM s WHERE score >= 0.5 GROUP BY target) SELECT count(*) AS claimed, CAST(sum(n - 1) AS BIGINT) AS repeated FROM c")(lambda p, t: decide.claims(decide.accepted(scores(p, t), decide.Policy(0.5, 0.5))))
query("e_13_assessment", _SCORED + """, a AS (SELECT * FROM s WHERE score >= 0.5), em AS (SELECT t.s1, n_true, count(a.target) AS np, count(a.target) FILTER (a.label = 1) AS tp FROM truth t LEFT JOIN a ON a.s1 = t.s1 GROUP BY ALL)
SELECT round(avg(CASE WHEN n_true = 0 THEN CAST(np = 0 AS DOUBLE) WHEN tp = 0 THEN 0 ELSE 1.25 * tp / (1.25 * tp + 0.25 * (n_true - tp) + np - tp) END), 9) AS macro_fbeta, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(np - tp) AS BIGINT) AS fp FROM em""")(
    lambda p, t: rounded(decide.assessed(scores(p, t), t, decide.Policy(0.5, 0.5)).select("macro_fbeta", "tp", "fp"), "macro_fbeta")
)
_LEXICAL_PAIRS = _LEX + """, near AS (SELECT l.s1, l.target, l.source, l.blocking_score, q.nn, q.an, q.nu, q.au, x.nn AS x_nn, x.an AS x_an, x.nu AS x_nu, x.au AS x_au FROM lex l JOIN q ON q.entity_id = l.s1 JOIN x ON x.entity_id = l.target), """ + oracle.rule("near", "r")
query("e_28_rule_matches", _LEXICAL_PAIRS + " SELECT s1, source, target, rule AS score FROM r WHERE rule >= 96")(lambda p, t: linkage.rule_matches(p)[1].select("s1", "source", "target", "score"))


def first_featured(p: DataFrame) -> DataFrame:
    """Pass-eligible pairs, uncapped, with the first 51 features."""
    return features.with_first(ranking.eligible(found(p), CAPS))


def _first_features() -> str:
    """The 51 features, each from its definition."""
    share = lambda f: f"(f{f}.set / 100.0)"
    words = lambda x: f"list_filter(string_split({x}, ' '), lambda w: w <> '')"
    digits = lambda x: f"list_filter({x}, lambda w: regexp_full_match(w, '[0-9]+'))"
    postal = lambda x: f"list_filter({x}, lambda w: regexp_full_match(w, '[0-9]{{4,10}}'))"
    both = lambda x, y: f"CAST(len(list_intersect({x}, {y})) AS DOUBLE)"
    jaccard = lambda x, y: f"CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0 ELSE {both(x, y)} / len(list_distinct(list_concat({x}, {y}))) END"
    overlap = lambda x, y: f"CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0 ELSE {both(x, y)} / least(len({x}), len({y})) END"
    lengths = lambda x, y: f"CASE WHEN {x} = '' OR {y} = '' THEN 0.0 ELSE CAST(least(length({x}), length({y})) AS DOUBLE) / greatest(length({x}), length({y})) END"
    equal = lambda x, y: f"{x} <> '' AND {x} = {y}"
    initials = lambda x: f"array_to_string(list_transform({words(x)}, lambda w: left(w, 1)), '')"
    value = {}
    for name, f, norm, uniq in (("name", "n", "nn", "nu"), ("address", "a", "an", "au")):
        x, y, u, v = f"r.{norm}", f"r.x_{norm}", f"r.{uniq}", f"r.x_{uniq}"
        value |= {
            f"normalized_{name}_exact": equal(x, y), f"{name}_ratio": f"f{f}.ratio", f"{name}_token_set_ratio": f"f{f}.set", f"{name}_token_sort_ratio": f"f{f}.sort", f"{name}_token_jaccard": jaccard(u, v),
            f"{name}_token_containment": overlap(u, v), f"shared_{name}_tokens": both(u, v), f"{name}_idf_overlap": f"r.{name}_idf", f"{name}_length_ratio": lengths(x, y),
        }
    d, e = digits("r.au"), digits("r.x_au")
    value |= {
        "name_first_token_agreement": "r.nn <> '' AND r.x_nn <> '' AND split_part(r.nn, ' ', 1) = split_part(r.x_nn, ' ', 1)", "name_initials_agreement": equal(initials("r.nn"), initials("r.x_nn")),
        "left_address_missing": "r.an = ''", "right_address_missing": "r.x_an = ''", "digit_token_overlap": overlap(d, e), "left_has_numeric": f"len({d}) > 0", "right_has_numeric": f"len({e}) > 0",
        "exact_numeric_token_agreement": f"len({d}) > 0 AND {d} = {e}", "postal_like_agreement": f"len(list_intersect({postal('r.au')}, {postal('r.x_au')})) > 0", "shared_digit_tokens": both(d, e), "source_is_s3": "r.source = 'S3'", "country_agreement": "true",
        "pass_count": "r.pass_count", "best_retrieval_score": "r.best_score", "second_best_retrieval_score": "r.second_score", "char_name_score": "0.0", "exp001_rule_score": "r.rule",
        **{f"{k}_score": f"r.{k}_score" for k in ranking.PASSES if k != "char_name"}, **{f"{k}_reciprocal_rank": f"CASE WHEN r.{k}_rank > 0 THEN 1.0::DOUBLE / r.{k}_rank ELSE 0.0 END" for k in ranking.PASSES},
        "name_address_similarity_product": f"{share('n')} * {share('a')}", "name_high_address_low": f"{share('n')} >= 0.9 AND {share('a')} < 0.5", "address_high_name_low": f"{share('a')} >= 0.9 AND {share('n')} < 0.5",
    }
    columns = ", ".join(f"round(CAST({value[k]} AS DOUBLE), 9) AS {k}" for k in features.FIRST)
    near_ = ", near AS (SELECT el.*, q.nn, q.an, q.nu, q.au, x.nn AS x_nn, x.an AS x_an, x.nu AS x_nu, x.au AS x_au FROM el JOIN q ON q.entity_id = el.s1 JOIN x ON x.entity_id = el.target), "
    return _POST + near_ + oracle.rule("near", "r") + f" SELECT r.s1, r.target, {columns} FROM r JOIN r_f fn ON fn.a = r.nn AND fn.b = r.x_nn JOIN r_f fa ON fa.a = r.an AND fa.b = r.x_an"


query("x_51_features", _first_features())(lambda p, t: first_featured(p).select("s1", "target", *[F.round(x, 9).alias(x) for x in features.FIRST]))
query("x_83_features")(lambda p, t: linkage.featured(p).select("s1", "target", *features.ALL))
on_numbers("s_19_numeric_features")(lambda p: linkage.featured(p).select("s1", "target", *features.MORE))


def fitted(p: DataFrame, t: DataFrame) -> DataFrame:
    f = stored(linkage.labelled(linkage.featured(p), t))
    return model.scored(f, model.fit(linkage.training(f), model.logistic()))


query("e_02_logistic_scores")(lambda p, t: fitted(p, t).select("s1", "target", "score"))
query("e_15_cross_evidence")(lambda p, t: decide.cross_evidence(X_enhanced(p, t)))
query("e_16_decision_features")(lambda p, t: decide_features(p, t))


def X_enhanced(p: DataFrame, t: DataFrame) -> DataFrame:
    e = X.enhanced(others(p)).select(F.col("entity_id").alias("target"), F.col("name2").alias("tn2"), F.col("address2").alias("ta2"))
    return scores(p, t).join(e, "target")


def decide_features(p: DataFrame, t: DataFrame) -> DataFrame:
    """The guardian's inputs from featured pairs, scored by the rule."""
    return policy.decision_tables(linkage.featured(p).withColumn("score", F.col("exp001_rule_score") / 100.0))[0]


# Further operators, mostly on the parts above

query("a_31_retrieval_pool", _POST + "SELECT source, count(*) AS pairs, count(DISTINCT s1) AS records FROM rk GROUP BY source")(lambda p, t: found(p).groupBy("source").agg(F.count("*").alias("pairs"), F.count_distinct("s1").alias("records")))
query("a_32_feature_pairs")(lambda p, t: linkage.training(stored(linkage.labelled(first_featured(p).select("s1", "target", "exp001_rule_score", "best_retrieval_score"), t))).select("s1", "target", "label", "kind", "hardness"))
query("b_08_multipass_admission", _MULTI + "SELECT s1, target FROM mp")(lambda p, t: blocking.multipass(X.represented(s1(p)), X.represented(others(p)), presets.MultiPassConfig(pool=1 << 30), False).select("s1", "target"))
query("b_10_same_country", _POST + "SELECT CAST(0 AS BIGINT) AS across, count(*) AS pairs FROM rk")(
    lambda p, t: found(p).select("s1", "country").join(p.select(F.col("entity_id").alias("s1"), F.col("country").alias("c")), "s1").agg(F.count_if(F.col("c") != F.col("country")).alias("across"), F.count("*").alias("pairs"))
)
query("b_16_finite_scores", _SCORED + " SELECT s1, target, score FROM s")(lambda p, t: decide.finite(scores(p, t)).select("s1", "target", "score"))
_APPROVED = {"guardian": None, "exclusivity": False, "penalty": 0.0, "s2": 0.6, "s3": 0.4}


def approved(p: DataFrame, t: DataFrame) -> DataFrame:
    """What the approved policy accepts; each of four others must be refused, and how many are is in the result."""
    refused = 0
    for other in (decide.Policy(0.61, 0.4), decide.Policy(0.6, 0.4, guardian=0.1), decide.Policy(0.6, 0.4, exclusivity=True), decide.Policy(0.6, 0.4, penalty=0.01)):
        try:
            other.require(_APPROVED)
        except ValueError:
            refused += 1
    mine = decide.Policy(0.6, 0.4)
    mine.require(_APPROVED)
    return decide.accepted(scores(p, t), mine).agg(F.count("*").alias("accepted"), F.round(F.sum("score"), 6).alias("total")).withColumn("refused", F.lit(refused))


query("b_20_policy", _SCORED + " SELECT count(*) AS accepted, round(sum(score), 6) AS total, 4 AS refused FROM s WHERE score >= CASE source WHEN 'S2' THEN 0.6 ELSE 0.4 END")(approved)
query("b_21_strict_lists", "SELECT count(*) AS rows_checked, CAST(0 AS BIGINT) AS broken FROM truth")(
    lambda p, t: tsv.submission(t, metrics.links(t)).withColumn("x", tsv.parse_targets(F.col("matched_entity_ids"))).agg(F.count("*").alias("rows_checked"), F.count_if((F.array_join("x", ",") != F.col("matched_entity_ids")) | (F.size(F.array_distinct("x")) != F.size("x"))).alias("broken"))
)
query("c_10_positive_pairs", "SELECT l.s1, l.target, a.business_name AS left_name, b.business_name AS right_name FROM link l JOIN party a ON a.entity_id = l.s1 JOIN party b ON b.entity_id = l.target")(lambda p, t: pairs(p, t).select("s1", "target", F.col("qn.raw").alias("left_name"), F.col("tn.raw").alias("right_name")))
query("c_12_cross_source_pairs", _SCORED + ", k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY s1, source ORDER BY score DESC, target) <= 3) SELECT x.s1, x.target AS a, y.target AS b FROM k x JOIN k y ON x.s1 = y.s1 WHERE x.source = 'S2' AND y.source = 'S3'")(lambda p, t: decide.cross_pairs(scores(p, t)))
query("c_15_split_outer", """, s AS (SELECT CASE WHEN CAST(split_part(entity_id, '-', 2) AS BIGINT) % 50 = 0 THEN 'test' ELSE 'train' END AS split, source, country FROM party), e AS (SELECT * FROM s UNION ALL SELECT split, 'ALL', country FROM s)
SELECT source, country, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'test') AS test FROM e GROUP BY ALL""")(
    lambda p, t: audit.country_shift(p.withColumn("split", F.when(F.split_part("entity_id", F.lit("-"), F.lit(2)).cast("bigint") % 50 == 0, "test").otherwise("train"))).select("source", "country", "train", "test")
)


def merged_shards(p: DataFrame) -> DataFrame:
    """Four shards of the reference records, and their union in the original order."""
    numbered = ranking.shard(tsv.positioned(s1(p).select("entity_id"), "entity_id"), "position", 4)
    parts = [numbered.filter(F.col("shard") == k) for k in range(4)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.orderBy("position").select("position", "entity_id")


query("c_16_shard_merge", "SELECT row_number() OVER (ORDER BY entity_id) - 1 AS position, entity_id FROM party WHERE source = 'S1'")(lambda p, t: merged_shards(p))
query("m_07_merge_checks", "SELECT count(*) AS n, count(DISTINCT entity_id) AS n_distinct, max(position) AS last FROM (SELECT row_number() OVER (ORDER BY entity_id) - 1 AS position, entity_id FROM party WHERE source = 'S1')")(lambda p, t: merged_shards(p).agg(F.count("*").alias("n"), F.count_distinct("entity_id").alias("n_distinct"), F.max("position").alias("last")))
query("d_06_quick_audit", "SELECT source, count(*) AS n_rows, count(DISTINCT entity_id) AS n_ids, min(entity_id) AS first_id, count(*) FILTER (trim(business_address) = '') AS missing FROM party GROUP BY source")(
    lambda p, t: p.groupBy("source").agg(F.count("*").alias("n_rows"), F.count_distinct("entity_id").alias("n_ids"), F.min("entity_id").alias("first_id"), F.count_if(F.trim("business_address") == "").alias("missing"))
)
query("d_16_fbeta", _PRED + "SELECT s1, round(fbeta, 9) AS fbeta FROM ev WHERE n_true > 0")(lambda p, t: metrics.entity_metrics(t, predicted(t)).filter("n_true > 0").select("s1", F.round(metrics.fbeta(F.col("precision"), F.col("recall")), 9).alias("fbeta")))
_BY = "SELECT {0}, count(*) AS entities, CAST(sum(kept.n_true) AS BIGINT) AS true_links, CAST(sum(kept) AS BIGINT) AS kept_links, round(avg(n), 9) AS mean_candidates, round(quantile_cont(n, 0.95), 9) AS p95_candidates, count(*) FILTER (n = 0) AS zero_entities FROM kept JOIN truth USING (s1) GROUP BY ALL"
_BY_COLUMNS = ["entities", "true_links", "kept_links", "mean_candidates", "p95_candidates", "zero_entities"]
query("d_20_blocking_by_country", _POST + _PER + _BY.format("country"))(
    lambda p, t: rounded(metrics.candidate_metrics(t.join(p.select(F.col("entity_id").alias("s1"), "country"), "s1"), ranking.budgeted(found(p), CAPS, 60), by=["country"]), "mean_candidates", "p95_candidates").select("country", *_BY_COLUMNS)
)
query("d_25_benchmark_by_multiplicity", _POST + _PER + _BY.format("CASE WHEN truth.n_true = 0 THEN '0' WHEN truth.n_true <= 2 THEN '1-2' WHEN truth.n_true <= 4 THEN '3-4' ELSE '5+' END AS matches"))(
    lambda p, t: rounded(metrics.candidate_metrics(t.withColumn("matches", metrics.multiplicity(F.size("targets"))), ranking.budgeted(found(p), CAPS, 60), by=["matches"]), "mean_candidates", "p95_candidates").select("matches", *_BY_COLUMNS)
)
query("d_24_error_causes")(lambda p, t: metrics.error_causes(linkage.labelled(first_featured(p).withColumn("score", F.col("exp001_rule_score")), t), 90.0))
query("d_29_pool_counts", _POST + "SELECT sel.source, sel.country, count(*) AS pairs, count(link.target) AS positives FROM sel LEFT JOIN link ON link.s1 = sel.s1 AND link.target = sel.target GROUP BY ALL")(
    lambda p, t: linkage.labelled(ranking.budgeted(found(p), CAPS, 60), t).groupBy("source", "country").agg(F.count("*").alias("pairs"), F.sum("label").alias("positives"))
)
_GUARD = _SCORED + ", g AS (SELECT t.s1, n_true, coalesce(max(score), -1) AS g, count(s.target) FILTER (score >= 0.5 AND label = 1) AS tp, count(s.target) FILTER (score >= 0.5 AND label = 0) AS fp FROM truth t LEFT JOIN s ON s.s1 = t.s1 GROUP BY ALL) "
query("d_35_guardian_confusion", _GUARD + "SELECT count(*) FILTER (g > 0.5 AND n_true > 0) AS passed_matched, count(*) FILTER (g > 0.5 AND n_true = 0) AS passed_single, count(*) FILTER (g <= 0.5 AND n_true > 0) AS stopped_matched, count(*) FILTER (g <= 0.5 AND n_true = 0) AS stopped_single FROM g")(
    lambda p, t: decide.guardian_confusion(scores(p, t).withColumn("guardian_probability", F.col("score")), t, 0.5)
)
query("e_14_guardian_cutoff", _GUARD + """, c AS (SELECT cutoff, round(avg(CASE WHEN g > cutoff THEN CASE WHEN n_true = 0 THEN CAST(fp = 0 AS DOUBLE) WHEN tp = 0 THEN 0 ELSE 1.25 * tp / (1.25 * tp + 0.25 * (n_true - tp) + fp) END ELSE CAST(n_true = 0 AS DOUBLE) END), 12) AS f
  FROM g CROSS JOIN (SELECT CAST(unnest(range(0, 91, 2)) / 100 AS DOUBLE) AS cutoff) GROUP BY cutoff) SELECT cutoff FROM c ORDER BY f DESC, cutoff LIMIT 1""")(
    lambda p, t: t.sparkSession.createDataFrame([(decide.guardian_cutoff(scores(p, t).withColumn("guardian_probability", F.col("score")), t, decide.Policy(0.5, 0.5)),)], "cutoff double")
)
query("d_37_importance")(lambda p, t: importances(p, t))
query("e_01_vectors")(lambda p, t: features.vectors(first_featured(p), features.FIRST).select("s1", "target", F.col("features").cast("string").alias("features")))
query("e_10_fine_thresholds", _SCORED + """, g AS (SELECT CAST(unnest(range(50, 101, 5)) / 100 AS DOUBLE) AS threshold), c AS (SELECT t.s1, n_true, threshold, count(s.target) FILTER (s.label = 1) AS tp, count(s.target) FILTER (s.label = 0) AS fp FROM truth t CROSS JOIN g LEFT JOIN s ON s.s1 = t.s1 AND s.score >= threshold GROUP BY ALL)
SELECT threshold, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, count(*) FILTER (n_true = 0 AND fp = 0) AS correct_singletons FROM c GROUP BY threshold""")(lambda p, t: metrics.threshold_curve(scores(p, t), t, [x / 100 for x in range(50, 101, 5)]).select("threshold", "tp", "fp", "correct_singletons"))
# The same searches on the thresholds of the reference
_CONFIGURED = _CURVE.replace(f"unnest({GRID})", f"unnest({list(presets.PROBABILITY_THRESHOLDS)})")
query("e_06_configured_threshold", _CONFIGURED + "SELECT * FROM f ORDER BY macro_fbeta DESC, threshold DESC LIMIT 1")(lambda p, t: metrics.best_threshold(scores(p, t), t, presets.PROBABILITY_THRESHOLDS).select("threshold", F.round("macro_fbeta", 9).alias("macro_fbeta")))
query("e_07_configured_curve", _CONFIGURED + "SELECT * FROM f")(lambda p, t: metrics.threshold_curve(scores(p, t), t, presets.PROBABILITY_THRESHOLDS).select("threshold", F.round("macro_fbeta", 9).alias("macro_fbeta")))
_FINE = _SCORED + f""", g AS (SELECT CAST(unnest({list(presets.FINE_THRESHOLDS)}) AS DOUBLE) AS threshold), c AS (SELECT t.s1, n_true, threshold, count(s.target) FILTER (s.label = 1) AS tp, count(s.target) FILTER (s.label = 0) AS fp FROM truth t CROSS JOIN g LEFT JOIN s ON s.s1 = t.s1 AND s.score >= threshold GROUP BY ALL)
SELECT threshold, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, count(*) FILTER (n_true = 0 AND fp = 0) AS correct_singletons, round(avg(CASE WHEN n_true = 0 THEN CAST(fp = 0 AS DOUBLE) WHEN tp = 0 THEN 0 ELSE 1.25 * tp / (1.25 * tp + 0.25 * (n_true - tp) + fp) END), 9) AS macro_fbeta FROM c GROUP BY threshold"""
query("e_10_thousandths", _FINE)(lambda p, t: metrics.threshold_curve(scores(p, t), t, presets.FINE_THRESHOLDS).select("threshold", "tp", "fp", "correct_singletons", F.round("macro_fbeta", 9).alias("macro_fbeta")))
query("e_11_reference_grid", SQL["e_11_source_threshold_search"].split(" ", 1)[1].removeprefix(WITH).strip().replace(f"unnest({GRID})", f"unnest({list(decide.GRID)})"))(lambda p, t: rounded(decide.source_thresholds(scores(p, t), t), "macro_fbeta"))
query("f_03_top_k", _LEX + "SELECT s1, source, target FROM m WHERE en OR ea OR sn >= 1 OR sa >= 2 OR (sa >= 1 AND sd >= 1) QUALIFY row_number() OVER (PARTITION BY s1, source ORDER BY 100 * CAST(en AS INTEGER) + 90 * CAST(ea AS INTEGER) + 20 * sn + 8 * sa + 12 * sd DESC, target) <= 3")(
    lambda p, t: blocking.lexical(X.represented(s1(p)), X.represented(others(p)), presets.LexicalConfig(top_k=3)).select("s1", "source", "target")
)
query("f_04_pool_prune", _POST + "SELECT s1, source, target FROM best QUALIFY row_number() OVER (PARTITION BY s1, source ORDER BY best_score DESC, pass_count DESC, target) <= 10")(lambda p, t: ranking.pruned(found(p), 10).select("s1", "source", "target"))
query("a_12_all_positions", "SELECT entity_id, row_number() OVER (ORDER BY entity_id) - 1 AS position FROM party WHERE source = 'S1'")(lambda p, t: tsv.positioned(s1(p).select("entity_id"), "entity_id"))
query("f_03_top_25", _LEX + "SELECT s1, source, target FROM lex")(lambda p, t: blocking.lexical(X.represented(s1(p)), X.represented(others(p)), presets.LexicalConfig()).select("s1", "source", "target"))
query("f_04_pool_of_120", _POST + "SELECT s1, source, target FROM best QUALIFY row_number() OVER (PARTITION BY s1, source ORDER BY best_score DESC, pass_count DESC, target) <= 120")(lambda p, t: ranking.pruned(found(p), presets.MultiPassConfig().pool).select("s1", "source", "target"))
query("f_11_link_ranks", _POST + """, a AS (SELECT s1, target, row_number() OVER (PARTITION BY s1, source ORDER BY best_score DESC, pass_count DESC, target) AS k FROM rk), b AS (SELECT s1, target, row_number() OVER (PARTITION BY s1, source ORDER BY best_score DESC, pass_count DESC, target) AS k FROM el)
SELECT link.s1, link.target, CAST(a.k AS INTEGER) AS pool_rank, CAST(b.k AS INTEGER) AS eligible_rank FROM link JOIN a ON a.s1 = link.s1 AND a.target = link.target JOIN b ON b.s1 = link.s1 AND b.target = link.target""")(
    lambda p, t: miss.classified(t, found(p), presets.Budget("b", 60, CAPS)).filter("eligible_rank IS NOT NULL").select("s1", "target", "pool_rank", "eligible_rank")
)
query("g_10_hardness", _LEXICAL_PAIRS + " SELECT s1, target, round(0.7 * CAST(CAST(rule AS FLOAT) AS DOUBLE) + 0.3 * least(CAST(CAST(blocking_score AS FLOAT) AS DOUBLE), 100.0), 4) AS hardness FROM r")(
    lambda p, t: features.with_rule(lexical(p)).select("s1", "target", F.round(sampling.hardness(F.col("exp001_rule_score"), F.col("blocking_score")), 4).alias("hardness"))
)
query("g_11_importance_sample", _SCORED + " SELECT s1, target FROM s ORDER BY sha256(concat('3:', s1, '|', target)) LIMIT 25")(lambda p, t: sampling.first(scores(p, t), 25, hashing.sha_key(F.concat_ws("|", "s1", "target"), 3)).select("s1", "target"))
query("g_14_ordered_candidates", _POST + "SELECT s1, source, string_agg(target, ',' ORDER BY best_score DESC, target) AS targets FROM sel GROUP BY s1, source")(
    lambda p, t: ranking.budgeted(found(p), CAPS, 60).groupBy("s1", "source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("best_score")).alias("k"), "target"))), lambda x: x["target"]), ",").alias("targets"))
)
query("h_02_token_sets", _PAIRS + " SELECT s1, target, len(list_intersect(x, y)) AS shared, len(list_distinct(list_concat(x, y))) AS every FROM pr")(
    lambda p, t: pairs(p, t).select("s1", "target", X.shared(F.col("qn.uniq"), F.col("tn.uniq")).cast("bigint").alias("shared"), F.size(F.array_union("qn.uniq", "tn.uniq")).cast("bigint").alias("every"))
)
query("h_06_exclusion", "SELECT s1 FROM truth EXCEPT SELECT s1 FROM link")(lambda p, t: t.select("s1").join(metrics.links(t).select("s1"), "s1", "left_anti"))
query("s_13_reciprocal_rank", _POST + "SELECT s1, target, round(CASE WHEN name_token_rank > 0 THEN 1.0::DOUBLE / name_token_rank ELSE 0 END, 9) AS v FROM rk")(lambda p, t: found(p).select("s1", "target", F.round(F.when(F.col("name_token_rank") > 0, 1.0 / F.col("name_token_rank")).otherwise(0.0), 9).alias("v")))
query("s_22_term_kinds", _POST + "SELECT CASE WHEN field = 'name' THEN 'name' WHEN num THEN 'numeric' ELSE 'address' END AS kind, count(*) AS n FROM term GROUP BY 1")(
    lambda p, t: terms_of(p)[0].groupBy(F.when(F.col("field") == "name", "name").when(F.col("numeric"), "numeric").otherwise("address").alias("kind")).agg(F.count("*").alias("n"))
)
query("m_05_probe_trace", _POST + ", h AS (SELECT s1, source, probe, count(*) AS hits FROM bh GROUP BY ALL) SELECT pb.s1, pb.source, CAST(pb.probe AS INTEGER) AS probe, coalesce(hits, 0) AS hits FROM pb LEFT JOIN h ON h.s1 = pb.s1 AND h.source = pb.source AND h.probe = pb.probe")(
    lambda p, t: (lambda x: retrieve.probe_trace(retrieve.probes(x[0], x[1], presets.IndexConfig()), x[1], presets.IndexConfig()).select("s1", "source", "probe", "hits"))(terms_of(p))
)


def importances(p: DataFrame, t: DataFrame) -> DataFrame:
    f = stored(linkage.labelled(first_featured(p), t))
    found_ = model.importance(model.fit(linkage.training(f), model.logistic(), features.FIRST), features.FIRST)
    return p.sparkSession.createDataFrame(list(found_.items()), "feature string, value double")


# Files, stored tables and shards: written to the shared folder, and read again


def _place(p: DataFrame) -> str:
    return f"{store.shared_folder(p.sparkSession)}/kindred-{p.sparkSession.sparkContext.applicationId}/{uuid.uuid4().hex}"


def scanned(p: DataFrame, t: DataFrame) -> DataFrame:
    path = _place(p)
    tsv.write_tsv(p.filter("source = 'S2'").select(*tsv.RECORD), path)
    return tsv.read_source(p.sparkSession, path, "S2")


def typed(p: DataFrame, t: DataFrame) -> DataFrame:
    """Retrieved pairs as text, and typed again."""
    rows, path = found(p).select("s1", "source", "target", "name_idf", "pass_count", "name_token_rank", "best_score"), _place(p)
    tsv.write_tsv(rows, path)
    return rounded(tsv.read_typed(p.sparkSession, path, rows.schema), "name_idf")


def indexed(p: DataFrame, t: DataFrame) -> DataFrame:
    path = _place(p)
    tsv.store_index(index.build(others(p)), path, "both", {"split": "train"})
    return tsv.open_index(p.sparkSession, path, "both", {"split": "train"})["token_df"]


def paired(p: DataFrame, t: DataFrame) -> DataFrame:
    """Scores through a sealed table of single-precision features."""
    path = _place(p)
    shards.seal_pairs(scores(p, t), path, ("score",), "identity", part="fit")
    return shards.open_pairs(p.sparkSession, path, ("score",), "identity", part="fit")


def sharded(p: DataFrame, t: DataFrame, only: tuple[int, ...] = (2, 0)) -> DataFrame:
    """Scores by four shards of the records: two are run one by one, the rest when the job is resumed; then merged with all checks."""
    entities, path, mine = s1(p).select(F.col("entity_id").alias("s1")), _place(p), scores(p, t).select("s1", "target", "score")
    job = lambda some: mine.join(some, "s1", "left_semi")
    for k in only:
        shards.run(entities, job, path, 4, "identity", k)
    if sorted(shards.run(entities, job, path, 4, "identity")) != [1, 3]:
        raise ValueError("a finished shard ran again")
    return shards.merged(p.sparkSession, path, 4, "identity", entities, unique=("s1", "target"))


def manifests(p: DataFrame, t: DataFrame) -> DataFrame:
    """What the manifests of a sharded job add up to."""
    entities, path = s1(p).select(F.col("entity_id").alias("s1")), _place(p)
    shards.run(entities, lambda some: metrics.links(t).join(some, "s1", "left_semi"), path, 3, "identity")
    found_ = [shards.manifest(p.sparkSession, f"{path}/shard-{k}") for k in range(3)]
    return p.sparkSession.createDataFrame([(len(found_), sum(m["entities"] for m in found_), sum(m["rows"] for m in found_))], "shards int, entities bigint, rows bigint")


def truth_file(p: DataFrame, t: DataFrame) -> DataFrame:
    """A truth file with a fault of each kind, by the records' order, and its errors by line."""
    rows = tsv.positioned(s1(p).select("entity_id"), "entity_id").select("position", F.col("entity_id").alias("s1"))
    k = F.col("position") % 9
    ids = F.when(k == 2, "S2-1,S2-1").when(k == 4, "S2-1,,S3-1").when(k == 5, "X-1").when(k == 7, "S2-1, S3-2").otherwise("")
    lines = rows.select("position", F.when(k == 1, F.col("s1")).when(k == 3, F.concat(F.lit("Q-"), "position", F.lit("\t"))).when(F.col("position") % 27 == 8, F.lit("S1-twice\t")).otherwise(F.concat("s1", F.lit("\t"), ids)).alias("value"))
    head = p.sparkSession.createDataFrame([(-1, "\t".join(tsv.TRUTH))], "position bigint, value string")
    path = _place(p)
    head.unionByName(lines).coalesce(1).sortWithinPartitions("position").select("value").write.text(path)
    return tsv.truth_errors(p.sparkSession, path).select("line", "error")


query("a_07_truth_errors", """, n AS (SELECT row_number() OVER (ORDER BY entity_id) - 1 AS position FROM party WHERE source = 'S1')
SELECT position + 2 AS line, CASE WHEN position % 9 = 1 THEN 'not two fields' WHEN position % 9 = 2 THEN 'repeated item' WHEN position % 9 = 3 THEN 'wrong id' WHEN position % 9 = 4 THEN 'empty item' WHEN position % 9 = 5 THEN 'wrong prefix' ELSE 'repeated record' END AS error
FROM n WHERE position % 9 BETWEEN 1 AND 5 OR (position % 27 = 8 AND position > 8)""")(truth_file)
query("d_32_pool_merge", _POST + _PER + "SELECT round(sum(kept) / sum(n_true), 9) AS recall, round(avg(n), 9) AS mean_pairs, CAST(sum(n) AS BIGINT) AS pairs, count(*) FILTER (n = 0) AS without FROM kept")(
    lambda p, t: rounded(metrics.candidate_metrics(t, ranking.budgeted(found(p), CAPS, 60)).select(F.col("link_recall").alias("recall"), F.col("mean_candidates").alias("mean_pairs"), F.round(F.col("mean_candidates") * F.col("entities"), 0).cast("bigint").alias("pairs"), F.col("zero_entities").alias("without")), "recall", "mean_pairs")
)


def owned(p: DataFrame, t: DataFrame) -> DataFrame:
    """One owner a target, if the truth allows it."""
    try:
        decide.check_exclusivity(t)
        allowed = True
    except ValueError:
        allowed = False
    return decide.accepted(scores(p, t), decide.Policy(0.5, 0.5, exclusivity=allowed)).agg(F.count("*").alias("accepted")).withColumn("allowed", F.lit(allowed))


query("e_24_ownership_rule", _SCORED + """, c AS (SELECT count(*) = 0 AS allowed FROM (SELECT target FROM link GROUP BY target HAVING count(DISTINCT s1) > 1)), a AS (SELECT * FROM s WHERE score >= 0.5)
SELECT CASE WHEN allowed THEN (SELECT count(DISTINCT target) FROM a) ELSE (SELECT count(*) FROM a) END AS accepted, allowed FROM c""")(owned)
_TYPED = _POST + " SELECT s1, source, target, round(name_idf, 9) AS name_idf, CAST(pass_count AS INTEGER) AS pass_count, CAST(name_token_rank AS INTEGER) AS name_token_rank, best_score FROM rk"
query("a_02_tsv_scan", "SELECT entity_id, business_name, business_address, country, source FROM party WHERE source = 'S2'")(scanned)
query("a_15_stored_index", _POST + "SELECT source, country, field, token, df FROM tdf")(indexed)
query("a_20_typed_rows", _TYPED)(typed)
query("a_21_pair_table", _SCORED + " SELECT s1, target, label, CAST(CAST(score AS FLOAT) AS DOUBLE) AS score FROM s")(paired)
query("a_23_pairs_by_entity", _SCORED + " SELECT t.s1, count(s.target) AS n, coalesce(CAST(sum(label) AS BIGINT), 0) AS positives FROM truth t LEFT JOIN s ON s.s1 = t.s1 GROUP BY t.s1")(lambda p, t: shards.by_entity(scores(p, t), t))
query("d_11_idf_overlap", _POST + "SELECT s1, target, name_idf, address_idf FROM rk")(lambda p, t: rounded(found(p).select("s1", "target", "name_idf", "address_idf"), "name_idf", "address_idf"))
query("e_23_promotion", _SCORED + """, a AS (SELECT * FROM s WHERE score >= 0.5), em AS (SELECT t.s1, n_true, count(a.target) AS np, count(a.target) FILTER (a.label = 1) AS tp FROM truth t LEFT JOIN a ON a.s1 = t.s1 GROUP BY ALL),
f AS (SELECT avg(CASE WHEN n_true = 0 THEN CAST(np = 0 AS DOUBLE) WHEN tp = 0 THEN 0 ELSE 1.25 * tp / (1.25 * tp + 0.25 * (n_true - tp) + np - tp) END) AS f FROM em)
SELECT CASE WHEN f >= 0.95 THEN 'MAJOR' WHEN f >= 0.94 THEN 'PROMOTE' WHEN f >= 0.92 THEN 'REVIEW' ELSE 'REJECT' END AS band FROM f""")(
    lambda p, t: p.sparkSession.createDataFrame([(linkage.promotion(decide.assessed(scores(p, t), t, decide.Policy(0.5, 0.5)).first()["macro_fbeta"]),)], "band string")
)
query("g_15_smoke_limit", "SELECT entity_id, row_number() OVER (ORDER BY entity_id) - 1 AS position FROM party WHERE source = 'S1' QUALIFY position < 20")(lambda p, t: tsv.positioned(s1(p).select("entity_id"), "entity_id", limit=20))
query("m_06_sharded_pairs", _SCORED + " SELECT s1, target, score FROM s")(sharded)
query("m_10_shard_manifests", "SELECT 3 AS shards, count(*) AS entities, CAST(sum(n_true) AS BIGINT) AS rows FROM truth")(manifests)
measured_ratio("s_03_empty_is_zero", "a", "ratio")

# Second-stage models and policies, over the proxy's records: a quarter tunes, the rest fits


def staged(p: DataFrame, t: DataFrame) -> dict[str, DataFrame]:
    """Featured, labelled pairs and truth, by part."""
    pairs = stored(linkage.labelled(linkage.featured(p), t))
    side = stored(linkage.split(p, t).select("s1", "validation"))
    of = lambda df, tune: df.join(side.filter(F.col("validation") == tune).select("s1"), "s1", "left_semi")
    return {"fit": of(pairs, False), "tune": of(pairs, True), "fit_truth": of(t, False), "tune_truth": of(t, True)}


def second_stage(p: DataFrame, t: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    parts = staged(p, t)
    return parts, policy.variants(parts["tune"], policy.fit(parts["fit"], parts["fit_truth"]))


def policies(p: DataFrame, t: DataFrame) -> DataFrame:
    parts, scored = second_stage(p, t)
    picked, rows = policy.tune(scored, parts["tune_truth"], t)
    schema = "name string, variant string, s2 double, s3 double, guardian double, exclusivity boolean, penalty double, macro_fbeta double, macro_precision double, macro_recall double, chosen boolean"
    return p.sparkSession.createDataFrame([tuple((r | {"chosen": r is picked}).values()) for r in rows], schema)


def grouped_scores(p: DataFrame, t: DataFrame) -> DataFrame:
    parts = staged(p, t)
    return policy.scored_group(parts["tune"], policy.fit(parts["fit"], parts["fit_truth"]), "relative").select("s1", "target", "score")


def boosted_scores(p: DataFrame, t: DataFrame) -> DataFrame:
    """Trees as configured, but 20 rounds of them."""
    f = stored(linkage.labelled(first_featured(p), t))
    return model.scored(f, model.fit(linkage.training(f), model.boosted(rounds=20), features.FIRST), features.FIRST).select("s1", "target", "score")


query("e_03_boosted_scores")(boosted_scores)
query("e_17_group_scores")(grouped_scores)
query("e_19_variants")(lambda p, t: second_stage(p, t)[1])
query("e_20_policies")(policies)
