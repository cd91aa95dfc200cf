"""Cleaning and testing of article texts.  All functions are expressions on columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sentiment import any_of

# References that are decoded, in this order.
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'))
# Phrases.
PAYWALL = (
    "subscribe", "subscription", "paywall", "premium", "member only", "sign in to continue", "login to read", "free trial", "unlock",
    "this article is for subscribers", "become a member",
)
PAYWALL_URL = ("login", "subscribe", "paywall", "signin")
JUNK = ("click here", "subscribe now", "sign up", "follow us", "terms of service", "privacy policy", "cookie policy", "advertisement", "sponsored content")
FINANCE = (
    "stock", "shares", "trading", "earnings", "revenue", "profit", "dividend", "market", "investor", "investment", "financial", "quarter",
    "analyst", "price", "valuation", "buy", "sell", "rating", "upgrade", "downgrade",
)
NEWS_DOMAINS = (
    "yahoo.com", "reuters.com", "cnn.com", "bbc.com", "marketwatch.com", "bloomberg.com", "wsj.com", "fortune.com", "cnbc.com", "ap.com",
    "washingtonpost.com", "nytimes.com", "businessinsider.com", "forbes.com", "benzinga.com", "seekingalpha.com", "fool.com", "zacks.com",
    "carboncredits.com", "newser.com", "thetradable.com", "thehill.com", "usatoday.com", "abcnews.go.com", "cbsnews.com", "nbcnews.com",
    "foxnews.com", "espn.com", "techcrunch.com", "tipranks.com",
)
PASSAGE = ("stock", "share", "price", "earnings", "revenue")


def clean_text(text: Column) -> Column:
    """White space to one space, then five references decoded, then trimmed."""
    out = F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " ")
    for name, value in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(value))
    return F.trim(out)


def strip_markup(text: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", ""), r"\[[^\]]*\]", "")
    return F.trim(F.regexp_replace(out, r"[ \t\n\r\f\x0B]+", " "))


def long_enough(df: DataFrame, column: str = "text", least: int = 50) -> DataFrame:
    """Rows whose text, after :func:`strip_markup`, has ``least`` characters."""
    return df.withColumn(column, strip_markup(F.col(column))).where(F.length(column) >= least)


def clean_for_analysis(text: Column, most: int = 512) -> Column:
    """Without URLs, white space to one space, cut to ``most`` characters, trimmed."""
    out = F.regexp_replace(text, r"https?://[^ \t\n\r]+", "")
    return F.trim(F.substring(F.regexp_replace(out, r"[ \t\n\r\f\x0B]+", " "), 1, most))


def title_of(text: Column) -> Column:
    """What comes before the first full stop; without one, the first 100 characters."""
    return F.when(F.contains(text, F.lit(".")), F.substring_index(text, ".", 1)).otherwise(F.substring(text, 1, 100))


def is_relevant(title: Column, body: Column, symbol: Column, name: Column) -> Column:
    text = F.lower(F.concat_ws(" ", title, body))
    return F.contains(text, F.lower(symbol)) | F.contains(text, F.lower(name))


def is_relevant_ext(title: Column, body: Column, symbol: Column, name: Column) -> Column:
    """The symbol, a company word of over three letters, or a finance word in a title of
    over 20 characters."""
    text = F.lower(F.concat_ws(" ", title, body))
    word = F.exists(F.split(F.lower(name), " "), lambda w: (F.length(w) > 3) & F.contains(text, w))
    return F.contains(text, F.lower(symbol)) | ((name != symbol) & word) | (any_of(F.lower(title), FINANCE) & (F.length(title) > 20))


def company_words(title: Column, name: Column) -> Column:
    """How many words of the name, over three letters long, the title contains."""
    return F.size(F.filter(F.split(F.lower(name), " "), lambda w: (F.length(w) > 3) & F.contains(F.lower(title), w))).cast("long")


def is_legitimate(text: Column) -> Column:
    """At most three junk phrases, and three sentences of over 20 characters at least."""
    junk = F.lit(0)
    for p in JUNK:
        junk = junk + F.contains(F.lower(text), F.lit(p)).cast("int")
    good = F.size(F.filter(F.split(text, r"\."), lambda s: F.length(F.trim(s)) > 20))
    return (junk <= 3) & (good >= 3)


def is_paywalled(text: Column, url: Column) -> Column:
    return any_of(F.lower(text), PAYWALL) | any_of(F.lower(url), PAYWALL_URL)


def truncate_sentences(text: Column, most: int) -> Column:
    """Whole sentences within ``most`` characters and ``...``; texts that fit stay."""
    parts = F.split(text, r"\. ")
    cut = F.aggregate(
        parts,
        F.struct(F.lit("").alias("t"), F.lit(True).alias("open")),
        lambda a, s: F.struct(
            F.when(a.open & (F.length(a.t) + F.length(s) + 2 <= most), F.concat(a.t, s, F.lit(". "))).otherwise(a.t).alias("t"),
            (a.open & (F.length(a.t) + F.length(s) + 2 <= most)).alias("open"),
        ),
        lambda a: F.concat(F.trim(a.t), F.lit("...")),
    )
    return F.when(F.length(text) <= most, text).otherwise(cut)


def url_hash(url: Column) -> Column:
    return F.sha2(url, 256)


def parse_published(value: Column) -> Column:
    """A time in one of the usual formats; null if it is in none."""
    formats = ("yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyyMMdd'T'HHmmss", "d MMM yyyy HH:mm:ss X", "yyyy-MM-dd")
    value = F.regexp_replace(F.regexp_replace(value, r"^[A-Za-z]{3}, ", ""), r" (GMT|UTC)$", " Z")
    return F.coalesce(*(F.try_to_timestamp(value, F.lit(f)) for f in formats))


def decode_redirect_url(url: Column) -> Column:
    """The news URL inside the base64 segment after ``/articles/``, if one is found."""
    part = F.regexp_extract(url, r"/articles/([^?/]+)", 1)

    def plain(code: Column) -> Column:
        code = F.translate(F.rtrim(code, F.lit("=")), "-_", "+/")
        code = F.rpad(code, (F.ceil(F.length(code) / 4) * 4).cast("int"), F.lit("="))
        return F.coalesce(F.decode(F.try_to_binary(code, F.lit("base64")), "ISO-8859-1"), F.lit(""))

    texts = F.concat(plain(part), F.lit(" "), plain(F.when(F.startswith(part, F.lit("CBM")), F.substring(part, 4, 10000)).otherwise("")))
    found = F.regexp_extract_all(texts, F.lit(r"https?://[\x21\x23-\x26\x28-\x3B\x3D\x3F-\x5F\x61-\x7E]+"), F.lit(0))
    good = lambda u: (F.length(u) >= 30) & ~F.contains(u, F.lit("google.com")) & any_of(u, NEWS_DOMAINS)
    return F.get(F.filter(found, good), 0)


def enrich(df: DataFrame, summary: str = "text", extracted: str = "extracted") -> DataFrame:
    """Summary and extracted text as one where the latter is longer, with success flag and ratio."""
    a, b = F.coalesce(F.length(summary), F.lit(0)), F.coalesce(F.length(extracted), F.lit(0))
    return df.withColumns(
        {
            "full_text": F.when(b > a, F.concat_ws(" ", summary, extracted)).otherwise(F.col(summary)),
            "extraction_successful": b > 100,
            "extracted_length": b.cast("long"),
            "enhancement_ratio": F.round(100.0 * b / F.greatest(F.lit(1), a), 1),
        }
    )


def normalize_listing(df: DataFrame, base_url: str, least_title: int = 15) -> DataFrame:
    """Absolute URLs (others dropped), titles long enough, summaries of over 20 characters cut to 200."""
    url = F.when(F.startswith("url", F.lit("/")), F.concat(F.lit(base_url), F.col("url"))).otherwise(F.col("url"))
    df = df.withColumn("url", url).where(F.startswith("url", F.lit("http")) & (F.length("title") >= least_title))
    return df.withColumn("summary", F.when(F.length("summary") > 20, F.substring("summary", 1, 200)))
