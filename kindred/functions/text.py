"""Text columns: conservative and secondary normalisation, tokens, n-grams, numbers. Only Unicode folding leaves the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Legal forms and generic words that may end a business name.
SUFFIXES = (
    "inc incorporated corporation corp co company ltd limited llc llp plc gmbh ag kg bv nv sa sas sarl srl spa pty pte pvt private public "
    "liability enterprises enterprise holdings holding group solutions services technologies technology international intl udyog societe "
    "anonyme sro oy ab aps"
)
#: Letters that no decomposition turns into ASCII.
LETTERS = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ı": "i", "ħ": "h", "ŋ": "ng", "’": "'", "‘": "'", "–": "-", "—": "-"}
#: Devanagari consonants, vowels and signs in plain Latin letters.
DEVANAGARI = dict(zip("कखगघङचछजझञटठडढणतथदधनपफबभमयरलवशषसह", "k kh g gh n c ch j jh n t th d dh n t th d dh n p ph b bh m y r l v s s s h".split(), strict=True))
VOWELS = dict(zip("अआइईउऊऋएऐओऔ", "a a i i u u r e ai o au".split(), strict=True))
SIGNS = dict(zip("ािीुूृेैोौंः", "a i i u u r e ai o au m h".split(), strict=True)) | {"्": ""}
#: Greek and Cyrillic letters in plain Latin letters.
GREEK = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", "a v g d e z i th i k l m n x o p r s s t y f ch ps o".split(), strict=True))
CYRILLIC = dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюя", "a b v g d e zh z i i k l m n o p r s t u f kh ts ch sh shch  y  e iu ia".split(" "), strict=True))
_PLAIN = LETTERS | VOWELS | GREEK | CYRILLIC


def no_words() -> Column:
    return F.array().cast("array<string>")


def fold(text: str) -> str:
    return unicodedata.normalize("NFKC", text).casefold()


def latin(text: str) -> str:
    """text in lower-case ASCII: marks are dropped, other scripts spelled by the tables above, and what is unknown goes. A Devanagari consonant has an `a` before another one, not at a word's end."""
    out, s = [], unicodedata.normalize("NFKD", text.casefold())
    for i, c in enumerate(s):
        if c < "\x80":
            out.append(c)
        elif c in DEVANAGARI:
            out.append(DEVANAGARI[c] + ("a" if s[i + 1 : i + 2] in DEVANAGARI and i + 1 < len(s) else ""))
        elif c in SIGNS:
            out.append(SIGNS[c])
        elif c in _PLAIN:
            out.append(_PLAIN[c])
        elif c.isdecimal():
            out.append(str(unicodedata.decimal(c)))
        elif c.isspace():
            out.append(" ")
    return "".join(out)


@F.pandas_udf(StringType())
def folded(x: pd.Series) -> pd.Series:
    return x.map(fold, na_action="ignore")


@F.pandas_udf(StringType())
def latinised(x: pd.Series) -> pd.Series:
    return x.map(latin, na_action="ignore")


def normalize(text: Column) -> Column:
    """NFKC, case folding, every run of white space and punctuation (category P) as one space, trimmed; null: empty."""
    return F.trim(F.regexp_replace(folded(F.coalesce(text, F.lit(""))), r"(?U)[\p{P}\s\x1c-\x1f]+", " "))


def tokens(normalized: Column) -> Column:
    return F.array_remove(F.split(normalized, " "), "")


def digits(words: Column) -> Column:
    return F.filter(words, lambda t: t.rlike(r"^\p{Nd}+$"))


def postal_like(words: Column) -> Column:
    return F.filter(words, lambda t: t.rlike(r"^\p{Nd}{4,10}$"))


def unique(words: Column) -> Column:
    return F.sort_array(F.array_distinct(words))  # array_sort compares by a lambda, which costs many times more


def signature(words: Column) -> Column:
    """The distinct tokens, sorted, in one string."""
    return F.array_join(unique(words), " ")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 if either is empty."""
    n = F.size(F.array_intersect(a, b))  # under no condition, so that Spark makes it once for all measures of a pair
    return F.coalesce(n / F.greatest(F.size(a) + F.size(b) - n, F.lit(1)), F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """The overlap coefficient; 0 if either is empty."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.greatest(F.least(F.size(a), F.size(b)), F.lit(1)), F.lit(0.0))


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def length_ratio(a: Column, b: Column) -> Column:
    return F.when((a != "") & (b != ""), F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))).otherwise(0.0)


def initials(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda t: F.substring(t, 1, 1)), "")


def ngrams(text: Column, n: int, keep_short: bool) -> Column:
    """Distinct n-grams of text without its spaces. A shorter text is one gram (keep_short) or none; an empty one none."""
    t = F.replace(text, F.lit(" "), F.lit(""))
    size = F.length(t)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1))), lambda i: F.substring(t, i, n)))
    short = F.when(size > 0, F.array(t)).otherwise(no_words()) if keep_short else no_words()
    return F.when(size >= n, grams).otherwise(short)


#: What the secondary normalisation removes or parts, in this order.
SECONDARY = (r"https?://|www\.", r"(?<=[a-z0-9])\.(?:com|org|net|in|fr|co)\b", r"(?<=[a-z])(?=\d)|(?<=\d)(?=[a-z])", r"[^a-z0-9]+")


def secondary(text: Column) -> Column:
    """Latin letters and figures only: web prefixes and common endings of domains go, letters part from figures."""
    t = latinised(F.coalesce(text, F.lit("")))
    for pattern in SECONDARY:
        t = F.regexp_replace(t, pattern, " ")
    return F.trim(t)


def core_name(normalized: Column) -> Column:
    """A secondary-normalised name without the legal forms that end it; the whole name if nothing else is in it."""
    core = F.regexp_replace(normalized, rf"(^| )({'|'.join(SUFFIXES.split())})( ({'|'.join(SUFFIXES.split())}))*$", "")
    return F.when(core == "", normalized).otherwise(core)


def canonical_number(token: Column) -> Column:
    return F.regexp_replace(token, "^0+(?=.)", "")


def parts(raw: Column, norm: Column) -> Column:
    """The struct of represented() made again from its texts."""
    t = tokens(norm)
    return F.struct(raw.alias("raw"), norm.alias("norm"), t.alias("tokens"), unique(t).alias("uniq"), unique(digits(t)).alias("digits"), unique(postal_like(t)).alias("postal"))


def represented(records: DataFrame, *keep: str) -> DataFrame:
    """records with `name` and `address`: structs of raw, norm, tokens, uniq, digits and postal. Made once a record, never for a pair."""
    r = records.withColumns({"_n": normalize(F.col("business_name")), "_a": normalize(F.col("business_address"))})
    r = r.withColumns({"_nt": tokens(F.col("_n")), "_at": tokens(F.col("_a"))})
    part = lambda raw, n, t: F.struct(
        F.coalesce(F.col(raw), F.lit("")).alias("raw"), F.col(n).alias("norm"), F.col(t).alias("tokens"), unique(F.col(t)).alias("uniq"),
        unique(digits(F.col(t))).alias("digits"), unique(postal_like(F.col(t))).alias("postal"),
    )
    return r.withColumns({"name": part("business_name", "_n", "_nt"), "address": part("business_address", "_a", "_at")}).drop("_n", "_a", "_nt", "_at")


def enhanced(records: DataFrame) -> DataFrame:
    """records with `name2` (text, core) and `address2` (text, numbers, primary, postal) of the secondary normalisation."""
    r = records.withColumns({"_n2": secondary(F.col("business_name")), "_a2": secondary(F.col("business_address")), "_l2": latinised(F.coalesce(F.col("business_address"), F.lit("")))})
    numbers = F.transform(F.filter(tokens(F.col("_a2")), lambda t: t.rlike("^[0-9]+$")), canonical_number)
    raw = F.filter(F.regexp_extract_all(F.col("_l2"), F.lit("[a-z0-9]+"), 0), lambda t: t.rlike("[0-9]") & F.length(t).between(4, 8))
    return r.withColumns({
        "name2": F.struct(F.col("_n2").alias("text"), core_name(F.col("_n2")).alias("core")),
        "address2": F.struct(F.col("_a2").alias("text"), F.array_distinct(numbers).alias("numbers"), F.coalesce(F.get(numbers, F.lit(0)), F.lit("")).alias("primary"), F.array_distinct(F.transform(raw, lambda t: F.when(t.rlike("^[0-9]+$"), canonical_number(t)).otherwise(t))).alias("postal")),
    }).drop("_n2", "_a2", "_l2")
