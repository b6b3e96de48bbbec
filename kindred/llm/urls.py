"""URL filters: listed rules first, then association rules mined from labelled urls.

Listed rules (host/path) fit a host and its subdomains if the url's path starts with the rule's path; the longest wins.
They are joined by host: a url looks up each suffix of its host, so a list of any length is an inverted index.

Association rules: a url is the set of its tokens (scheme, labels of the host, its last two labels, words of the path,
names of query parameters; figures are one token). Each labelled page counts, so a url of several pages counts as often. Before
mining, tokens that too few bad urls have for any rule, and those that all urls have, are left out; tokens that stand in
exactly the same pages (a path that always comes as a whole) are one item, so long urls don't multiply sets. All
items that then are left of a url are mined. Spark's FP-growth finds the frequent sets of these items together with the label, of any length; sets whose confidence and support suffice and that no subset
with as much confidence makes needless become blocking rules; their numbers are then counted on all labelled urls in full.
A rule must be `lift` times as sure as the share of bad urls or, where that asks for too much, leave at most one part in
`lift` of the share of good urls. Rules are indexed by their rarest token, looked up by a url's tokens and checked in full.

Urls are judged once each, however many pages have them. Defined cases: a null url, or one without `://`, has an empty host
and path, fits no listed rule and has no tokens, so it is allowed; null labels are not used, a page with several labels is
bad if any is; without labelled urls or mined rules everything else is allowed; repeated rows are judged each; an empty
table gives an empty result; other columns have no effect.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import stored

#: The rules of the query op4.
LISTED = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BAD = "=bad"


def _parts(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def split(pages: DataFrame) -> DataFrame:
    """pages with host and path."""
    host, path = _parts(F.col("url"))
    return pages.withColumn("host", host).withColumn("path", path)


def tokens(url: Column) -> Column:
    """The distinct tokens of a url."""
    host, path = _parts(url)
    labels = F.split(host, r"\.")
    mark = lambda prefix, a: F.transform(F.filter(a, lambda x: x != ""), lambda x: F.concat(F.lit(prefix), F.regexp_replace(F.lower(x), r"\d+", "9")))
    query = F.transform(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda x: F.substring_index(x, "=", 1))
    domain = F.array(F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."))
    every = F.concat(mark("h:", labels), mark("h:", F.flatten(F.transform(labels, lambda x: F.filter(F.split(x, "-"), lambda y: (y != x) & (F.length(y) > 1))))), mark("d:", domain), mark("p:", F.split(path, r"[/._\-]+")), mark("q:", query))
    scheme = F.array(F.concat(F.lit("s:"), F.lower(F.substring_index(url, "://", 1))))
    return F.when(F.instr(url, "://") > 0, F.array_distinct(F.concat(scheme, every))).otherwise(F.array().cast("array<string>"))


def listed(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, rule_verdict) of those hosts and paths that a rule fits. rules: rule, verdict."""
    r = rules.select("rule", F.col("verdict").alias("rule_verdict"), F.regexp_extract("rule", r"^([^/]*)", 1).alias("suffix"), F.regexp_extract("rule", r"^[^/]*(.*)$", 1).alias("start"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = hosts.select("host", "path").distinct().withColumn("suffix", F.explode(F.array_distinct(suffixes))).join(r, "suffix").filter(F.expr("startswith(path, start)"))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("size"), "rule", "rule_verdict")).alias("b"))
    return best.select("host", "path", "b.rule", "b.rule_verdict")


def _items(labelled: DataFrame, n: int, enough: int) -> tuple[DataFrame, DataFrame]:
    """(id, bad, t) with each url's items, and (name, members): which tokens an item stands for. labelled: id, items, bad."""
    each = labelled.select("id", F.col("bad").cast("long").alias("bad"), F.explode("items").alias("item"))
    mark = lambda k: F.sum(F.xxhash64(F.lit(k), "id").cast("decimal(38,0)")).alias(f"h{k}")
    sums = each.groupBy("item").agg(F.count("*").alias("n"), F.sum("bad").alias("b"), mark(1), mark(2)).filter((F.col("b") >= enough) & (F.col("n") < n))
    same = sums.groupBy("n", "b", "h1", "h2").agg(F.min("item").alias("name"), F.array_sort(F.collect_list("item")).alias("members"))  # members stand in one url together: no more than its tokens
    same = stored(same.select("name", "members"))
    lists = each.join(same.withColumnRenamed("name", "item").drop("members"), "item").withColumnRenamed("item", "name").groupBy("id").agg(F.array_sort(F.collect_list("name")).alias("t"))
    return labelled.select("id", "bad").join(lists, "id", "left").withColumn("t", F.coalesce("t", F.array().cast("array<string>"))), same


def mine(labelled: DataFrame, support: float = 0.0005, least: int = 20, confidence: float = 0.6, lift: float = 2.0, partitions: int | None = None, longest: int | None = None) -> DataFrame:
    """Rules (rule_id, items, support, confidence) from (items, bad), a row a labelled page. support: the least share of urls that must have the tokens and the label, `least` their least number. longest: the most items of a rule, None for any number."""
    labelled = stored(labelled.withColumn("id", F.monotonically_increasing_id()))
    n, bad = labelled.agg(F.count("*"), F.sum(F.col("bad").cast("bigint"))).first()
    schema = "rule_id bigint, items array<string>, support bigint, confidence double"
    if not n or not bad:
        return labelled.sparkSession.createDataFrame([], schema)
    fewest = max(math.ceil(support * n), least)
    if fewest > bad:
        return labelled.sparkSession.createDataFrame([], schema)
    baskets, members = _items(labelled, n, fewest)
    sets = FPGrowth(itemsCol="t", minSupport=(fewest - 0.5) / n, minConfidence=1.0)
    sets = sets.setNumPartitions(partitions) if partitions else sets
    found = sets.fit(baskets.select(F.when(F.col("bad"), F.concat("t", F.array(F.lit(BAD)))).otherwise(F.col("t")).alias("t"))).freqItemsets
    if longest is not None:
        found = found.filter(F.size(F.array_remove("items", BAD)) <= longest)
    found = stored(found.withColumn("items", F.array_sort("items")))
    both = found.filter(F.array_contains("items", BAD) & (F.size("items") > 1)).select(F.array_remove("items", BAD).alias("items"), F.col("freq").alias("support"))
    sure = min(lift * bad / n, 1 - (1 - bad / n) / lift)  # below 1 unless all urls are bad
    enough = (F.col("confidence") >= confidence) & (F.col("confidence") >= sure)
    rules = both.join(found, "items").withColumn("confidence", F.col("support") / F.col("freq")).filter(enough)
    rules = stored(rules.select(F.xxhash64("items").alias("rule_id"), "items", "support", "confidence"))
    # A rule is needless if a subset of its items is a rule of at least its confidence. Most are by a subset of one item less; looked up by ids, a rule's size in rows.
    parts = rules.filter(F.size("items") > 1).withColumn("item", F.explode("items")).select("rule_id", "confidence", F.xxhash64(F.array_remove("items", F.col("item"))).alias("part"))
    needless = parts.join(rules.select(F.col("rule_id").alias("part"), F.col("confidence").alias("c")), "part").filter("c >= confidence").select("rule_id").distinct()
    rules = stored(rules.join(needless, "rule_id", "left_anti").select("rule_id", "items", "support", "confidence"))
    # What is left can contain smaller ones only: a needless rule's own reason is a subset too. These are looked up by their rarest item.
    index = _indexed(rules).select("item", F.col("items").alias("part"), F.col("confidence").alias("c"))
    inside = rules.withColumn("item", F.explode("items")).join(index, "item").filter("c >= confidence AND size(part) < size(items)").filter(F.size(F.array_except("part", "items")) == 0)
    rules = rules.join(inside.select("rule_id").distinct(), "rule_id", "left_anti").select("rule_id", F.explode("items").alias("name"))
    rules = stored(rules.join(members, "name").groupBy("rule_id").agg(F.array_sort(F.flatten(F.collect_list("members"))).alias("items")))
    # The numbers of each rule on whole urls.
    held = labelled.select("id", "bad", "items", F.explode("items").alias("item"))
    hits = held.join(_indexed(rules.withColumn("confidence", F.lit(0.0))).select("item", F.col("items").alias("rule_items")), "item").filter(F.size(F.array_except("rule_items", "items")) == 0)
    counts = hits.groupBy(F.col("rule_items").alias("items")).agg(F.sum(F.col("bad").cast("bigint")).alias("support"), F.count("*").alias("freq"))
    return counts.withColumn("confidence", F.col("support") / F.col("freq")).filter(enough).select(F.xxhash64("items").alias("rule_id"), "items", "support", "confidence")


def _indexed(rules: DataFrame) -> DataFrame:
    """(item, items, confidence): each rule by that of its tokens that the fewest rules have."""
    often = rules.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("often"))
    keyed = rules.withColumn("item", F.explode("items")).join(often, "item").groupBy("rule_id", "items", "confidence").agg(F.min(F.struct("often", "item")).alias("k"))
    return keyed.select(F.col("k.item").alias("item"), "items", "confidence")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, mined_rule, mined_confidence): for each url that rules fit, the surest. urls: url, items."""
    index = _indexed(rules).select("item", F.col("items").alias("rule_items"), "confidence")
    hits = urls.withColumn("item", F.explode("items")).join(index, "item").filter(F.size(F.array_except("rule_items", "items")) == 0)
    best = hits.groupBy("url").agg(F.max(F.struct("confidence", F.array_join("rule_items", " ").alias("rule"))).alias("b"))
    return best.select("url", F.col("b.rule").alias("mined_rule"), F.col("b.confidence").alias("mined_confidence"))


def judged(pages: DataFrame, rules: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Per row of pages: page_id, host, path, rule, verdict, mined_rule, mined_confidence. rules: rule, verdict; labels: page_id, bad."""
    marks = labels.filter("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("m"))
    urls = stored(pages.select("url").distinct().withColumn("items", tokens(F.col("url"))))
    known = pages.filter("url IS NOT NULL").select("page_id", "url").join(marks, "page_id").select(tokens(F.col("url")).alias("items"), (F.col("m") > 0).alias("bad"))
    mined = matched(urls.filter(F.size("items") > 0), stored(mine(known, **options)))
    places = split(urls.select("url"))
    by_url = places.join(listed(places, rules), ["host", "path"], "left").join(mined, "url", "left").withColumnRenamed("url", "u")
    out = pages.select("page_id", "url").join(stored(by_url), F.col("url").eqNullSafe(F.col("u")))
    verdict = F.coalesce("rule_verdict", F.when(F.col("mined_rule").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "mined_rule", "mined_confidence")


def result(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """The digest that op4 returns. A page is bad if its label says toxic or of low quality; labels are joined as page_id = doc_id.

    In the synthetic tables such labels tell nothing of the urls, so no rule reaches the least confidence there, and every
    page without a listed rule is allowed.
    """
    rules = pages.sparkSession.createDataFrame(list(LISTED), "rule string, verdict string")
    bad = F.coalesce(F.col("toxic") > 0, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))
    return judged(pages, rules, labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")))
