"""Main text of web pages by differencing with the nearest pages of the same host.

Pages are range-sorted by host and URL path, so a page's nearest neighbours by path stand
next to it; the pages at the ends of each range are also sent to the ranges beside it, so the number
of ranges changes no result.  The text lines of neighbours are aligned by their longest common
subsequence.  A shared line is a vote that it is the site's template; a host's votes are
counted, and the lines that most of their pages share with a neighbour are deleted from all of its pages.

Votes need care in two places.  Pages with copies of one article share its lines
too, so a neighbour that has most of the article is a copy and
tells nothing about it, and inside an article only its first and last lines are voted on; and template texts that
differ from page to page (advertisements, footers, menus) are left out by element name and class.  Hosts with one page have no
neighbour; for them the markup alone decides.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, bounded_batches, cut_lineage, size_checked, utf8

#: Bits of memory that an alignment of two pages keeps.
LCS_BITS = 1 << 28

#: Elements whose text is never main text, and those that end a block (fixed values).
SKIPPED = frozenset("nav footer aside form noscript template iframe button select option textarea label svg menu dialog head title object canvas video audio figure-ad".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul title".split()
)
#: Share of the article lines, or of all lines of a page without one, above which a neighbour is a copy.
COPY, WHOLE_COPY = 0.5, 0.8
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class, id or role that mark what is not main text (fixed values).
HINTS = frozenset(
    "ad ads advert advertisement adverts adbox banner sponsor sponsored promo promoted cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup sidebar side rail nav navbar navigation menu breadcrumb breadcrumbs footer masthead header topbar toolbar share sharing social related recommended recommendations comment comments commentlist disqus reply replies respond widget pagination pager search login form".split()
)
#: Words that make of a class name a state of the page, not a kind of content (fixed values).
STATES = frozenset("has is no not with without open closed enabled disabled on off active inactive".split())
#: Kinds of article elements that are no article when they are the whole class name (fixed values).
NO_ARTICLE = frozenset("ad advert advertisement sponsored promo related comment comments reply".split())
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg|textarea)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_MARK = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*.?true|display\s*:\s*none", re.I)
_WORDS = re.compile(r"[a-z]+")


def _marked(name: str, attributes: str, inside: bool) -> bool:
    """Whether class, id or role tell that an element is not main text."""
    if not attributes.strip():
        return False
    if _HIDDEN.search(attributes):
        return True
    for mark in _MARK.finditer(attributes):
        for kind in (mark[1] or mark[2] or mark[3] or "").lower().split():
            if name in ("article", "main"):
                if kind in NO_ARTICLE:
                    return True
                continue
            found = set(_WORDS.findall(kind))
            if not found & STATES and found & HINTS and not (inside and found & HINTS == {"header"}):
                return True
    return False


def blocks(page: str) -> list[tuple[str, bool, bool]]:
    """Text blocks in page order: text, whether inside an article, whether left out by markup.

    The first article (or main) element is one even inside an element whose class says
    otherwise.
    """
    out: list[tuple[str, bool, bool]] = []
    stack: list[tuple[str, int]] = []  # element, how many elements left out were around it
    opened: dict[str, int] = {}
    inside = skipped = 0
    by_name = 0  # elements left out by name, not by class
    met = False
    held: list[str] = []

    def end() -> None:
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                out.append((text, inside > 0, skipped > 0))

    def pop() -> None:
        nonlocal inside, skipped, by_name
        name, skipped = stack.pop()
        opened[name] -= 1
        inside -= name in ("article", "main")
        by_name -= name in SKIPPED

    at = 0
    for tag in _TAG.finditer(page):
        if tag.start() > at:
            held.append(html.unescape(page[at : tag.start()]))
        at = tag.end()
        name = (tag[3] or "").lower()
        if not name:
            continue
        if name == "br":
            held.append(" ")
        if name in BLOCKS:
            end()
        if tag[2]:
            if opened.get(name):
                while stack[-1][0] != name:
                    pop()
                pop()
        elif name not in VOID and not tag[4].endswith("/"):
            if name in BLOCKS:
                while any(x == "p" for x, _ in stack[-4:]):
                    pop()
            left_out = name in SKIPPED or (name == "header" and not inside) or (name not in ("html", "body") and _marked(name, tag[4], inside > 0))
            stack.append((name, skipped))
            opened[name] = opened.get(name, 0) + 1
            by_name += name in SKIPPED
            if left_out:
                skipped += 1
            elif name in ("article", "main"):
                if not met and not by_name:
                    skipped = 0
                met = met or not skipped
            inside += name in ("article", "main")
    if at < len(page):
        held.append(html.unescape(page[at:]))
    end()
    return out


def _rows(a: list[int], b: list[int], keep: bool) -> list[int]:
    """Bit-parallel longest common subsequence: after each of ``a`` (the last one only, unless ``keep``),
    bit j is 0 where b[: j + 1] has a longer one than b[:j]."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, rows = full, []
    for x in a:
        both = row & where.get(x, 0)
        row = ((row + both) | (row - both)) & full
        if keep:
            rows.append(row)
    return rows if keep else [row]


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of a longest common subsequence of ``a`` and each beginning of ``b``."""
    (row,) = _rows(a, b, False)
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def _subsequence(a: list[int], b: list[int], i: int = 0, j: int = 0) -> list[tuple[int, int]]:
    """Places (shifted by ``i`` and ``j``) of a longest common subsequence; memory of ``LCS_BITS`` at most."""
    if not a or not b:
        return []
    if len(a) * len(b) > LCS_BITS and len(a) > 1:
        half = len(a) // 2
        cut = int(np.argmax(_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]))
        return _subsequence(a[:half], b[:cut], i, j) + _subsequence(a[half:], b[cut:], i + half, j + cut)
    rows, found, x, y = _rows(a, b, True), [], len(a), len(b)
    while x and y:
        if a[x - 1] == b[y - 1]:
            x, y = x - 1, y - 1
            found.append((i + x, j + y))
        elif rows[x - 1] >> (y - 1) & 1:
            y -= 1
        else:
            x -= 1
    return found[::-1]


def common_lines(a: list, b: list) -> tuple[set[int], set[int]]:
    """Places in ``a`` and ``b`` of a longest common subsequence of lines."""
    number = {line: i for i, line in enumerate(set(a) & set(b))}
    left, right = ([i for i, line in enumerate(x) if line in number] for x in (a, b))
    found = _subsequence([number[a[i]] for i in left], [number[b[j]] for j in right])
    return {left[i] for i, _ in found}, {right[j] for _, j in found}


#: Seed of the 64-bit hash that stands for a line.
_SEED = 10
#: Pages of a host that must share a line with a neighbour at least: lines outside an article, and inside one (all pages of a smaller host).
OUTSIDE, INSIDE, ALL = 2, 4, 3
#: Share of the pages with a line, on one host, that must share it with a neighbour, inside an article all at its beginning or all at its end.
OFTEN = 0.8


def shared_lines(article: list[bool], sizes: list[int], common: set[int]) -> tuple[set[int], set[int]]:
    """Places of the lines that a page shares with a neighbour and that may be template: outside an article or at
    its beginning, and at its end.

    ``common`` has the places of a longest common subsequence with the neighbour.  A neighbour with over ``COPY`` of the
    article's characters is a copy and tells nothing about the article; a page without an article
    element is compared as a whole (``WHOLE_COPY``).  Inside an article only what the two have in common at its very
    beginning or end counts: notices stand there, sentences of the text anywhere.
    """
    judged = [i for i, x in enumerate(article) if x]
    limit, whole = (COPY, judged) if judged else (WHOLE_COPY, list(range(len(article))))
    copy = sum(sizes[i] for i in whole if i in common) > limit * sum(sizes[i] for i in whole)
    if not judged:
        return (set() if copy else common), set()
    first, last = common.difference(judged), set()
    for run, found in () if copy else ((judged, first), (judged[::-1], last)):
        for i in run:
            if i not in common:
                break
            found.add(i)
    return first, last


_TEXT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
#: What tells pages apart: page_id and hashes of url and html; rows equal in these have equal texts.
_PAGE = ("page_id", "url_hash", "html_hash")
_LISTS = {"lines": pa.list_(pa.int64()), "inside": pa.list_(pa.bool_()), "sizes": pa.list_(pa.int32())}


def _free(page: str | None) -> list[tuple[str, bool]]:
    """Blocks that markup does not leave out, and whether they stand in an article."""
    return [(text, inside) for text, inside, out in blocks(page or "") if not out]


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's lines as hashes."""
    for batch in batches:
        found = [_free(page) for page in batch.column("html").to_pylist()]
        hashes = [[xxhash.xxh64_intdigest(t, _SEED) - 2**63 for t, _ in own] for own in found]
        lists = (hashes, [[x for _, x in own] for own in found], [[len(t) for t, _ in own] for own in found])
        kept = [c for c in batch.schema.names if c != "html"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(x, t) for x, t in zip(lists, _LISTS.values(), strict=True))], names=[*kept, *_LISTS])


_VOTE = pa.schema([("host", pa.string()), ("line", pa.int64()), ("inside", pa.bool_()), ("first", pa.bool_()), ("last", pa.bool_())])


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each different line of a page, and one with a null line for the page itself.

    Pages come sorted by key; each is held until the next has come.  Guests give out nothing.
    """
    held = None  # host, guest, page, places shared with the page before
    rows: list[list] = [[] for _ in _VOTE]

    def done(found, more: tuple[set[int], set[int]]) -> None:
        if found is not None and not found[1]:
            (_, host), _, (lines, inside, _), shared = found
            first, last = (x | y for x, y in zip(shared, more, strict=True))
            own: dict[tuple, tuple] = {(None, None): (False, False)}
            for i, line in enumerate(zip(lines, inside, strict=True)):  # a line that a page has twice is one vote
                before = own.get(line, (False, False))
                own[line] = (before[0] or i in first, before[1] or i in last)
            for line, vote in own.items():
                for column, value in zip(rows, (host, *line, *vote), strict=True):
                    column.append(value)

    none: tuple[set[int], set[int]] = (set(), set())
    for batch in batches:
        for part, host, guest, *page in zip(*(batch.column(c).to_pylist() for c in ("part", "host", "guest", *_LISTS)), strict=True):
            shared = after = none
            if held is not None and host and (part, host) == held[0] and not (guest and held[1]):
                before, mine = common_lines(held[2][0], page[0])
                shared, after = shared_lines(*page[1:], mine), shared_lines(*held[2][1:], before)
            done(held, after)
            held = ((part, host), guest, page, shared)
        yield batch_of(_VOTE, *rows)
        for column in rows:
            column.clear()
    done(held, none)
    yield batch_of(_VOTE, *rows)


def _ends(keys: DataFrame) -> list[str]:
    """The last key of each of as many ranges as there are shuffle partitions."""
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = keys.repartitionByRange(n, "key").groupBy(F.spark_partition_id()).agg(F.max("key").alias("key"))
    return sorted((r["key"] for r in ranges.collect()), key=str.encode)[:-1]


def _ranged(ends: list[str]):
    """Adds the range that each key falls into, by binary search."""
    bounds = [e.encode() for e in ends]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = [bisect_left(bounds, k) for k in utf8(batch.column("key"))]
            yield batch.append_column("part", pa.array(part, pa.int32()))

    return run


def _neighbours(pages: DataFrame) -> DataFrame:
    """``pages`` dealt to ranges of keys and sorted, each range with the page before and the page after it as guests."""
    ends = _ends(pages.select("key"))
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pages.schema.fields)
    rows = pages.mapInArrow(_ranged(ends), f"{columns}, part int")
    if ends:
        edges = rows.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last"))
        order = Window.orderBy("part")  # one row a range
        edges = edges.select("part", "first", "last", F.lag("part").over(order).alias("before"), F.lead("part").over(order).alias("after"))
        guests = edges.select(F.col("first").alias("of"), F.col("before").alias("to")).union(edges.select("last", "after")).where("to is not null").distinct()
        guests = F.broadcast(cut_lineage(guests))  # two rows a range
        guests = rows.join(guests, rows.key == guests["of"]).dropDuplicates(["key", "to"])
        rows = rows.withColumn("guest", F.lit(False)).unionByName(guests.withColumn("part", F.col("to")).withColumn("guest", F.lit(True)).drop("of", "to"))
    else:
        rows = rows.withColumn("guest", F.lit(False))
    return rows.repartitionByRange(len(ends) + 1, "part").sortWithinPartitions("part", "key", "guest")


def template_lines(pages: DataFrame) -> DataFrame:
    """host, line, inside: the lines that are a host's template, on whatever page they stand.

    Of the pages of the host that have the line (inside an article, or outside), over ``OFTEN`` must share it with a
    neighbour, and ``INSIDE`` or ``OUTSIDE`` of them at least.
    """
    votes = _neighbours(pages).select("part", "host", "guest", *_LISTS).mapInArrow(_votes, "host string, line long, inside boolean, first boolean, last boolean")
    votes = cut_lineage(votes.groupBy("host", "line", "inside").agg(F.count(F.lit(1)).alias("n"), F.greatest(F.count_if("first"), F.count_if("last")).alias("shared")))
    often = votes.where((F.col("shared") >= OUTSIDE) & (F.col("shared") > OFTEN * F.col("n")))
    hosts = votes.where("line is null").select("host", F.col("n").alias("pages"))
    least = F.when(F.col("inside"), F.greatest(F.lit(ALL), F.least(F.lit(INSIDE), F.col("pages")))).otherwise(OUTSIDE)
    return often.where("line is not null").join(hosts, "host").where(F.col("shared") >= least).select("host", "line", "inside")


def _deleted(pages: DataFrame) -> DataFrame:
    """``_PAGE`` and the places of the lines that go, for pages that lose some.

    Template goes; and on a host with a single page, which has no neighbour that could show what is template,
    what stands outside the article, if there is one.
    """
    template = size_checked(cut_lineage(template_lines(pages)))
    lines = pages.select(*_PAGE, "host", F.posexplode(F.arrays_zip("lines", "inside")).alias("place", "x"))
    lines = lines.select(*_PAGE, "host", "place", F.col("x.lines").alias("line"), F.col("x.inside").alias("inside"))
    gone = lines.join(template, ["host", "line", "inside"], "left_semi").select(*_PAGE, "place")
    mixed = pages.where(F.array_contains("inside", True) & F.array_contains("inside", False))
    single = pages.groupBy("host").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") == 1) | (F.col("host") == "")).select("host")
    alone = mixed.join(single, "host", "left_semi").select(*_PAGE, F.posexplode("inside").alias("place", "x")).where("not x").select(*_PAGE, "place")
    gone = gone.union(alone).groupBy(*_PAGE).agg(F.collect_set("place").alias("gone"))  # lines of one page
    return cut_lineage(gone.select(*(F.col(c).alias(f"gone_{c}") for c in _PAGE), "gone"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for page, gone in zip(batch.column("html").to_pylist(), batch.column("gone").to_pylist(), strict=True):
            left_out = set(gone or ())
            texts.append("\n".join(t for i, (t, _) in enumerate(_free(page)) if i not in left_out))
        yield batch_of(_TEXT, batch.column("page_id"), batch.column("url"), texts, [len(t) for t in texts])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages`` (page_id, url, html).

    Null and empty html give an empty text; a null or odd url has no host, hence no
    neighbours; repeated rows are copies, which never count as template; character
    references are decoded and white space inside a block is one space.  Columns beside these three are passed over.

    Pages are read twice.  The first time their lines become hashes, which are all that is dealt by host and
    path: a host of any size goes to many tasks.  What is template is decided for a host as a whole, so no line goes
    from one of its pages and stays on another (but for copies of an article and interior lines, see
    :func:`shared_lines`, which only vote).  What reaches the driver is one key a range.
    """
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumns({"url_hash": F.xxhash64("url"), "html_hash": F.xxhash64("html", F.lit(1))})
    url = F.coalesce("url", F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    number = F.lpad(F.hex(F.col("page_id").bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    keyed = rows.withColumns({"host": host, "key": F.concat(host, F.lit("\0"), path, F.lit("\0"), F.coalesce(number, F.lit("")), F.lit("\0"), F.hex("html_hash"))}).drop("url")
    columns = "page_id long, url_hash long, html_hash long, host string, key string, lines array<long>, inside array<boolean>, sizes array<int>"
    parsed = cut_lineage(keyed.select("page_id", "url_hash", "html_hash", "host", "key", "html").mapInArrow(_parsed, columns))
    gone = _deleted(parsed)
    same = (rows[c].eqNullSafe(gone[f"gone_{c}"]) for c in _PAGE)
    rows = rows.join(size_checked(gone), reduce(and_, same), "left")
    return rows.select("page_id", "url", "html", "gone").mapInArrow(_texts, "page_id long, url string, text string, n_chars long")
