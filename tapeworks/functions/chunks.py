"""Small vectorised helpers: sentence chunks, batched scorers, article extraction."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import bounded_batches
from .phrases import phrases_met
from .sentiment import any_of, clamp, model_boost
from .text import PASSAGE


def chunks(text: str | None, most: int) -> list[str]:
    """Sentences joined by ``. `` up to ``most`` characters; longer ones are cut at words."""
    out: list[str] = []

    def gather(parts: list[str], joint: str) -> None:
        held = ""
        for part in parts:
            if held and len(held) + len(joint) + len(part) > most:
                out.append(held)
                held = ""
            if len(part) > most and joint != " ":
                gather(part.split(), " ")
            else:
                held = f"{held}{joint}{part}" if held else part
        if held:
            out.append(held)

    gather([s.strip() for s in re.split(r"[.!?]+", text or "") if s.strip()], ". ")
    return out


def chunk_text(text: Column, most: int = 400) -> Column:
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunks(t, most))

    bounded_batches()
    return run(text)


def score_with(df: DataFrame, load: Callable[[], Callable[[list[str]], list[tuple[str, float]]]], text: str = "text") -> DataFrame:
    """``df`` with ``label`` and ``score`` of a model that each worker loads once."""
    kind = T.StructType([T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            yield pd.DataFrame(model(batch.fillna("").tolist()), columns=["label", "score"])

    bounded_batches()
    return df.withColumn("__m", run(F.col(text))).select("*", "__m.label", "__m.score").drop("__m")


def score_long(df: DataFrame, id: str, text: str, score: Callable[[Column], Column], most: int = 1000) -> DataFrame:
    """id, the mean score over the chunks of each text (without chunks: null), and polarity and
    compound: the mean with 0.3 and 0.2 of the finance boost of the whole text, from -1 to 1."""
    parts = df.select(id, model_boost(F.col(text)).alias("boost"), F.explode_outer(chunk_text(F.col(text), most)).alias("chunk"))
    parts = parts.withColumn("of_chunk", score(F.col("chunk")))
    out = parts.groupBy(id).agg(F.avg(F.when(F.col("chunk").isNotNull(), F.col("of_chunk"))).alias("score"), F.count("chunk").alias("n_chunks"), F.first("boost").alias("boost"))
    both = {name: F.when(F.col("n_chunks") == 0, 0.0).otherwise(clamp(F.col("score") + share * F.col("boost"), 1.0)) for name, share in (("polarity", 0.3), ("compound", 0.2))}
    return out.withColumns(both).drop("boost")


class _Part:
    """A container of a page: which paragraphs stand in it, and what else is counted there."""

    def __init__(self, tag: str, marks: str, start: int, counts: list[int], bad: bool):
        self.tag, self.marks, self.start, self.end, self.before, self.bad = tag, marks, start, start, counts, bad
        self.elements = self.links = self.images = self.linked = self.times = 0


class _Reader(HTMLParser):
    """Gathers paragraphs, the containers that they stand in, and JSON-LD texts."""

    LEFT_OUT = frozenset("script style nav header footer aside form noscript iframe svg button".split())
    HOLDERS = frozenset("article main section div body".split())
    BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote".split())
    VOID = frozenset("br img meta link input hr".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.path: list[str] = []
        self.open: list[_Part] = []
        self.parts: list[_Part] = []
        self.paragraphs: list[str] = []
        self.side: list[bool] = []  # of each paragraph: stands in a container named as no content
        self.counts = [0, 0, 0, 0, 0]  # elements, links, images, linked characters, time elements so far
        self.text: list[str] = []
        self.json: list[str] = []
        self.in_json = False

    def handle_starttag(self, tag, attrs):
        found = dict(attrs)
        if tag == "script":
            self.in_json = found.get("type") == "application/ld+json"
            self.json += [""] * self.in_json
        self.counts[0] += 1
        self.counts[1] += tag == "a"
        self.counts[2] += tag == "img"
        self.counts[4] += tag == "time"
        if tag in self.HOLDERS:
            self.flush()
            marks = f"{found.get('class') or ''} {found.get('id') or ''}{' role-main' * (found.get('role') == 'main')}".lower()
            bad = bool(self.open and self.open[-1].bad) or any(w in BAD for w in re.findall("[a-z]+", marks))
            self.open.append(_Part(tag, marks, len(self.paragraphs), self.counts.copy(), bad))
            self.parts.append(self.open[-1])
        elif tag in self.BLOCKS:
            self.flush()
        if tag not in self.VOID:
            self.path.append(tag)

    def handle_endtag(self, tag):
        if tag in self.BLOCKS or tag in self.HOLDERS:
            self.flush()
        if tag in self.HOLDERS and self.open:
            self.shut()
        if tag in self.path:
            while self.path.pop() != tag:
                pass

    def handle_data(self, data):
        if self.in_json and self.path and self.path[-1] == "script":
            self.json[-1] += data
        elif not self.LEFT_OUT.intersection(self.path):
            self.text.append(data)
            self.counts[3] += len(data) * ("a" in self.path)

    def shut(self):
        part = self.open.pop()
        part.end = len(self.paragraphs)
        part.elements, part.links, part.images, part.linked, part.times = (now - then for now, then in zip(self.counts, part.before, strict=True))

    def flush(self):
        text = " ".join("".join(self.text).split())
        self.text.clear()
        if text and "head" not in self.path:
            self.paragraphs.append(text)
            self.side.append(bool(self.open and self.open[-1].bad))

    def finish(self) -> None:
        self.close()
        self.flush()
        while self.open:
            self.shut()

    def of(self, part: _Part) -> list[str]:
        """Paragraphs of a container without those of containers inside it that are named as no content."""
        return [p for p, side in zip(self.paragraphs[part.start : part.end], self.side[part.start : part.end], strict=True) if not side]


# What in class names and ids speaks for and against a container, and their weights.
GOOD, BAD = ("article", "content", "post", "story", "entry", "main", "body"), ("comment", "sidebar", "nav", "menu", "ad", "footer", "header", "social")
BASIC_BAD = ("cookie", "privacy", "subscribe", "newsletter")


# Words that tell of a date; points of a container; bounds and factors of its density.
DATES = ("published", "updated", "posted", "ago", "am", "pm")
POINTS = {"length": 100, "paragraph": 10, "good paragraph": 15, "few paragraphs": -30, "good name": 25, "bad name": -30, "links": -40, "date": 15, "article": 50, "main": 30}
DENSE = {"least characters": 200, "good paragraphs": 1.5, "many links": 0.7}


def _container_score(part: _Part, paragraphs: list[str]) -> float:
    """Length, paragraphs, kind, names, links and dates of a container as one number."""
    size, low = sum(map(len, paragraphs)), " ".join(paragraphs).lower()
    counts = {
        "paragraph": len(paragraphs), "good paragraph": sum(50 < len(p) < 800 for p in paragraphs), "few paragraphs": size > 500 and len(paragraphs) < 3,
        "good name": sum(w in part.marks for w in GOOD), "bad name": sum(w in part.marks for w in BAD), "links": part.linked > 0.3 * size,
        "date": part.times > 0 or any(w in low for w in DATES), "article": part.tag == "article", "main": part.tag == "main",
    }
    return max(0, min(size // 10, POINTS["length"]) + sum(POINTS[k] * n for k, n in counts.items()))


def _density(part: _Part, paragraphs: list[str]) -> float:
    """Characters for each element, more for paragraphs of good length, less for many links and images."""
    size = sum(map(len, paragraphs))
    if size < DENSE["least characters"] or not part.elements:
        return 0.0
    good = DENSE["good paragraphs"] if 50 < size / len(paragraphs) < 500 else 1.0
    return size / part.elements * good * (DENSE["many links"] if part.links + part.images > 0.3 * part.elements else 1.0)


def _from_json(texts: list[str]) -> str:
    """Body (over 200 characters) or description (over 100) of the first article in JSON-LD."""
    for text in texts:
        try:
            found = json.loads(text)
        except ValueError:
            continue
        found = found[0] if isinstance(found, list) and found else found
        if isinstance(found, dict) and found.get("@type") in ("Article", "NewsArticle", "BlogPosting"):
            for name, least in (("articleBody", 200), ("description", 100)):
                if isinstance(found.get(name), str) and len(found[name]) > least:
                    return found[name]
    return ""


def article_text(page: str | None) -> str:
    """Text of the container that scores best, if it has 100 characters; else a JSON-LD article; else the
    longest semantic element; else the densest container; else good paragraphs, three at least; else all."""
    reader = _Reader()
    reader.feed(page or "")
    reader.finish()
    found = [(p, texts) for p in reader.parts if (texts := reader.of(p))]
    part, texts = max(found, key=lambda x: _container_score(*x), default=(None, []))  # the outer of equals, for it comes first
    if part is not None and _container_score(part, texts) > 0 and sum(map(len, texts)) >= 100:
        return " ".join(texts)
    if body := _from_json(reader.json):
        return body
    semantic = [texts for p, texts in found if p.tag in ("article", "main") or "role-main" in p.marks]
    if semantic:
        return " ".join(max(semantic, key=lambda texts: sum(map(len, texts))))
    part, texts = max(found, key=lambda x: _density(*x), default=(None, []))
    if part is not None and _density(part, texts) > 5:
        return " ".join(texts)
    good = [p for p in reader.paragraphs if len(p) > 40 and not any(w in p.lower() for w in BASIC_BAD)]
    return " ".join(good if len(good) >= 3 else reader.paragraphs)


def extract_article(html: Column) -> Column:
    @F.pandas_udf(T.StringType())
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(article_text)

    bounded_batches()
    return run(html)


#: Names that one automaton looks for at most; more are taken in blocks, each a walk over the passages.
NAMES = 5000


def match_passages(rows: DataFrame, companies: DataFrame, id: str = "id", keywords: tuple[str, ...] = PASSAGE) -> DataFrame:
    """id, at, symbol, title, passage: passages over 30 characters that hold the symbol of a company or the first
    word of its common name (in this case, anywhere), and a finance keyword in any case.

    ``rows`` has id, at and passage.  The names are a dimension: their number is checked, and
    they reach the driver a block of ``NAMES`` at a time.  Null and empty names name nothing.
    """
    rows = rows.where((F.length("passage") > 30) & any_of(F.lower("passage"), keywords))
    names = companies.select("symbol", F.explode(F.array("symbol", F.element_at(F.split("common_name", " "), 1))).alias("name")).where("name <> ''").distinct()
    blocks = -(-names.select("name").distinct().count() // NAMES)
    found = []
    for i in range(blocks):
        block = names.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == i)
        phrases = tuple(sorted(r["name"] for r in block.select("name").distinct().collect()))
        met = rows.withColumn("place", F.explode(phrases_met(F.col("passage"), phrases)))
        named = met.withColumn("name", F.get(F.array(*map(F.lit, phrases)), F.col("place")))
        found.append(named.join(F.broadcast(block), "name"))
    out = reduce(DataFrame.unionByName, found) if found else rows.withColumn("symbol", F.lit(None).cast("string")).limit(0)
    return out.select(id, "at", "symbol", F.substring("passage", 1, 100).alias("title"), "passage").distinct()


def find_passages(df: DataFrame, companies: DataFrame, id: str, html: str, keywords: tuple[str, ...] = PASSAGE) -> DataFrame:
    """:func:`match_passages` of the paragraphs of pages."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def passages(pages: pd.Series) -> pd.Series:
        def of(page):
            reader = _Reader()
            reader.feed(page or "")
            reader.finish()
            return [t for t in reader.paragraphs if len(t) > 30]

        return pages.map(of)

    bounded_batches()
    return match_passages(df.select(id, F.posexplode(passages(F.col(html))).alias("at", "passage")), companies, id, keywords)
