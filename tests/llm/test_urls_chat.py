import random
import time
from itertools import combinations

import duckdb
from pyspark.sql import functions as F

from kindred.llm import chat, urls

PAGE = "page_id long, url string, html string, host string"
URLS = ["http://a.b.net/x", "HTTPS://A.Example.NET/en/1?q=1#t", "http://example.net", "http://notexample.net/en/1", "http://example.com/de/", "x://example.com?de/", "http://org/fr/9", "http://q.org/frx", None, "no scheme", "http:///p", "ftp://sub.example.com/de/x.html#a/b", "http://Ä.example.org/fr/1", "http://a.b.net/x"]


def expected(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host, path = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] + [len(path)])]
    fits = [(r, v) for r, v in urls.LISTED if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, *(max(fits, key=lambda x: len(x[0])) if fits else (None, "allow"))


def test_listed_rules(spark):
    pages = spark.createDataFrame([(i, u, "", "clash") for i, u in enumerate(URLS)], PAGE)
    got = urls.result(pages, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got} == {i: expected(u) for i, u in enumerate(URLS)}
    assert urls.result(pages.limit(0), spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int")).count() == 0


def test_rules_equal_brute_force(spark):
    r = random.Random(3)
    rows = []
    for _ in range(300):
        items = sorted(r.sample("abcdefg", r.randint(1, 5)))
        rows.append((items, ("a" in items and "b" in items and r.random() < 0.95) or r.random() < 0.05))
    got = {tuple(x["items"]): (x["support"], round(x["confidence"], 9)) for x in urls.mine(spark.createDataFrame(rows, "items array<string>, bad boolean"), least=5).collect()}
    bad = sum(b for _, b in rows)
    sure = {}
    for n in range(1, 8):
        for s in combinations("abcdefg", n):
            has = [b for i, b in rows if set(s) <= set(i)]
            if sum(has) >= max(5, 0.0005 * 300) and sum(has) / len(has) >= max(0.6, 2 * bad / 300):
                sure[s] = (sum(has), round(sum(has) / len(has), 9))
    want = {s: v for s, v in sure.items() if not any(set(o) < set(s) and sure[o][1] >= v[1] for o in sure)}
    assert got == want and ("a", "b") in got


def brute_rules(rows, letters, least, sure):
    found = {}
    for n in range(1, len(letters) + 1):
        for s in combinations(letters, n):
            has = [b for i, b in rows if set(s) <= set(i)]
            if sum(has) >= least and sum(has) / len(has) >= sure:
                found[s] = (sum(has), round(sum(has) / len(has), 9))
    return {s: v for s, v in found.items() if not any(set(o) < set(s) and found[o][1] >= v[1] for o in found)}


def test_rules_of_any_length_equal_brute_force(spark):
    """Four or five tokens together tell, and more than half of the urls are bad."""
    for seed, noise in ((3, 0.05), (4, 0.55)):
        r = random.Random(seed)
        rows = [(sorted(r.sample("abcdefg", r.randint(1, 7))), False) for _ in range(500)]
        rows = [(i, set("abcd") <= set(i) or r.random() < noise) for i, _ in rows]
        share = sum(b for _, b in rows) / 500
        got = urls.mine(spark.createDataFrame(rows, "items array<string>, bad boolean"), least=5, longest=None).collect()
        want = brute_rules(rows, "abcdefg", 5, max(0.6, min(2 * share, 1 - (1 - share) / 2)))
        assert {tuple(x["items"]): (x["support"], round(x["confidence"], 9)) for x in got} == want and ("a", "b", "c", "d") in want
    assert share > 0.5


def test_four_tokens_together_block(spark):
    """No three of the tokens tell more than half: only the four are bad; and the same where most labelled urls are bad."""
    parts = [(a, b, c, d) for a in ("m", "w") for b in ("x", "y") for c in ("en", "de") for d in ("buy", "read")]
    for bad in (lambda p: p == ("m", "x", "en", "buy"), lambda p: p != ("w", "y", "de", "read")):
        rows = [(16 * k + i, f"http://{p[0]}.{p[1]}.org/{p[2]}/{p[3]}", "", "") for k in range(30) for i, p in enumerate(parts)]
        labels = spark.createDataFrame([(i, 1, int(bad(parts[i % 16]))) for i, *_ in rows], "doc_id long, quality int, toxic int")
        got = urls.judged(spark.createDataFrame(rows, PAGE), spark.createDataFrame([], "rule string, verdict string"), labels.selectExpr("doc_id AS page_id", "toxic > 0 AS bad")).collect()
        assert {r["page_id"] for r in got if r["verdict"] == "block"} == {i for i, *_ in rows if bad(parts[i % 16])}


def test_urls_of_many_items_lose_none(spark):
    """Two tokens together tell, and stand in bad urls behind 17 others that tell more."""
    r = random.Random(5)
    rows = [([*r.sample([f"f{k}" for k in range(40)], 17), "y", "z"], True) for _ in range(200)] + [([x], False) for x in ("y", "z", "x") for _ in range(200)]
    got = {tuple(x["items"]): x["support"] for x in urls.mine(spark.createDataFrame(rows, "items array<string>, bad boolean")).collect()}
    assert got[("y", "z")] == 200


def test_mined_rules_block(spark):
    r = random.Random(1)
    rows = [(i, f"http://{r.choice(['www', 'm'])}.{r.choice(['spam-farm', 'good', 'fine'])}.example.org/en/{i}", "", "") for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int("spam" in u)) for i, u, _, _ in rows[:300]], "doc_id long, quality int, toxic int")
    got = urls.result(spark.createDataFrame(rows, PAGE), labels).collect()
    assert {r["page_id"] for r in got if r["verdict"] == "block"} == {i for i, u, _, _ in rows if "spam" in u}
    assert all(r["rule"] is None and r["mined_rule"] for r in got if r["verdict"] == "block")


def test_long_and_repeated_urls_cost_little(spark):
    """Bad pages share a path of 200 words, some urls stand on many pages, and one word of the path alone says nothing."""
    words = "/".join(f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(200))
    rows = [(i, f"http://h{'x' * (i % 25)}.example.org/{words}/{chr(97 + i % 26)}{'y' * (i % 40)}", "", "") for i in range(400)]
    rows += [(1000 + i, f"http://g{'z' * (i % 90)}.example.org/waa/{'v' * (i % 80)}", "", "") for i in range(900)]
    rows += [(3000 + i, "http://often.example.org/waa", "", "") for i in range(500)]
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, *_ in rows], "page_id long, bad int")
    none = spark.createDataFrame([], "rule string, verdict string")
    start = time.time()
    got = urls.judged(spark.createDataFrame(rows, PAGE), none, labels).collect()
    assert time.time() - start < 60
    assert {r["page_id"] for r in got if r["verdict"] == "block"} == set(range(400))


def test_mined_rules_on_held_out_urls(spark):
    """Three quarters of the urls are labelled; what makes a url bad is a pair of its tokens, with some noise."""
    r = random.Random(9)
    rows, bad = [], {}
    for i in range(6000):
        host, lang, topic, tail = r.choice("abcdefgh"), r.choice(["en", "de", "fr"]), r.choice(["win", "news", "shop", "play"]), r.choice(["free", "now", "read", "list"])
        rows.append((i, f"https://www.{host}{host}.example.org/{lang}/{topic}/{tail}-{i}", "", ""))
        bad[i] = (topic, tail) in (("win", "free"), ("play", "now")) or (host == "c" and lang == "de")
    labels = [(i, 1, int(bad[i] != (r.random() < 0.02))) for i in bad if i % 4]
    got = urls.result(spark.createDataFrame(rows, PAGE), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    held = [x for x in got if x["page_id"] % 4 == 0 and x["rule"] is None]  # /fr/ is listed
    blocked = {x["page_id"] for x in held if x["verdict"] == "block"}
    hit = sum(bad[i] for i in blocked)
    assert hit >= 0.98 * len(blocked) and hit >= 0.98 * sum(bad[x["page_id"]] for x in held)


CHAT = "conv_id long, turn long, role string, text string, copies string"


def test_snapshots_collapse(spark):
    full = [("user", "hi"), ("assistant", "hello <|user|>"), ("user", "bye")]
    rows = []
    for conv, turns in ((1, full[:1]), (2, full[:2]), (3, full), (4, full), (5, [("user", "hi"), ("assistant", "other")]), (6, [("system", None)]), (7, [(None, "")])):
        rows += [(conv, k, role, text, "clash") for k, (role, text) in enumerate(turns)]
    random.Random(2).shuffle(rows)
    got = {r["conv_id"]: r for r in chat.formatted(spark.createDataFrame(rows, CHAT)).collect()}
    assert set(got) == {3, 5, 6, 7} and got[3]["copies"] == 2 and got[3]["n_turns"] == 3
    assert got[3]["text"] == "<|user|>\nhi<|end|>\n<|assistant|>\nhello < |user|><|end|>\n<|user|>\nbye<|end|>\n"


def test_equals_sql(spark):
    r = random.Random(5)
    rows = []
    for conv in range(120):
        turns = [(r.choice(["user", "assistant", None]), r.choice(["a", "b", None])) for _ in range(r.randint(1, 5))]
        rows += [(conv, r.choice([k, k, None, 0]), role, text, "") for k, (role, text) in enumerate(turns)]
    rows += [(None, r.choice([None, 1]), "user", r.choice("abc"), "") for _ in range(40)]
    rows += [(500, k if k % 3 else None, "user", f"t{k % 50}", "") for k in range(2100)]
    df = spark.createDataFrame(rows, CHAT).repartition(7)
    conversations = df.toPandas()
    conversations["turn"], conversations["conv_id"] = conversations["turn"].astype("Int64"), conversations["conv_id"].astype("Int64")
    c = duckdb.connect()
    c.register("conversations", conversations)
    key = lambda x: tuple((v is None, v) for v in x)
    want = sorted(map(tuple, c.execute(chat.SQL).fetchall()), key=key)
    got = sorted(((r["conv_id"], r["part"], r["n_turns"], r["copies"], r["text"]) for r in chat.formatted(df).collect()), key=key)
    assert got == want and any(x[1] == 2 for x in got) and any(x[0] is None for x in got)


def test_a_log_without_ids_or_turns_is_not_one_row(spark):
    """Half of the rows have no conv_id and no turn: they spread over tasks and rows."""
    rows = [(None, None, "user", f"text {k % 700}", "") for k in range(6000)] + [(k, 0, "user", f"x{k}", "") for k in range(6000)]
    d = spark.createDataFrame(rows, CHAT).repartition(6)
    places = chat.prefixes(d).filter("conv_id IS NULL").select("place", "text").collect()
    assert sorted(r["place"] for r in places) == list(range(1, 6001))
    assert [r["text"] for r in sorted(places)] == sorted(t for _, _, _, t, _ in rows[:6000])
    got = chat.formatted(d).filter("conv_id IS NULL").collect()
    assert len(got) == 6 and {r["n_turns"] for r in got} == {6000}
    assert "".join(r["text"] for r in sorted(got, key=lambda r: r["part"])).count("<|end|>") == 6000


def test_long_conversations_have_parts(spark):
    rows = [(1, k, "user", f"t{k}", "") for k in range(3000)] + [(2, k, "user", f"t{k}", "") for k in range(2500)] + [(None, 0, "user", "x", "")]
    got = chat.formatted(spark.createDataFrame(rows, CHAT)).collect()
    assert sorted((r["conv_id"] or -1, r["part"]) for r in got) == [(-1, 0), (1, 0), (1, 1), (1, 2)]
    text = "".join(r["text"] for r in sorted((r for r in got if r["conv_id"]), key=lambda r: r["part"]))
    assert text == "".join(f"<|user|>\nt{k}<|end|>\n" for k in range(3000))
    assert chat.formatted(spark.createDataFrame([], CHAT)).count() == 0
    assert sorted((r["conv_id"] or -1, r["part"]) for r in chat.formatted(spark.createDataFrame(rows, CHAT).withColumn("turn", F.lit(None).cast("long"))).collect()) == [(-1, 0), (1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2)]
