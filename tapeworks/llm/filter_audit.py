"""What filters do to each other, in every order, by decision diagrams.

Each document has a failure mask, a bit for each filter it fails; masks are counted by part
(here the language) before anything else is done.  A part's counts become a decision
diagram: a level a filter, a low edge for documents that pass and a high edge for those
that fail, equal subdiagrams shared, each node with the counts below it.  Swapping
two adjacent levels rebuilds only the nodes above and at them; a walk of such
swaps visits every order, and in each the all-pass path from the root yields the steps.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD

#: ASCII white space, which ends a word.
_SPACE = " \t\n\x0b\x0c\r"
#: Parts that rows without a doc_id are dealt to when labels are joined.
SALTS = 1024
Conditions = Callable[[Column], dict[str, Column]]


def conditions(text: Column) -> dict[str, Column]:
    """When ``text`` fails each filter: A short, B repeated words, C capitals, D signs."""
    trimmed = F.btrim(text, F.lit(_SPACE))
    words = F.split(trimmed, WORD.replace("^", ""))
    blank = trimmed == ""
    n = F.when(blank, 0).otherwise(F.size(words))
    distinct = F.when(blank, 0).otherwise(F.size(F.array_distinct(words)))
    return {
        "A": n < 200,
        "B": 100 * distinct < 50 * n,
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def failure_counts(docs: DataFrame, labels: DataFrame, fails: Conditions = conditions, part: str = "lang") -> DataFrame:
    """part, mask, n, good, toxic: documents of each failure mask, a bit for each of ``fails``.

    The bit after those of ``fails`` is set where a smaller doc_id has the same text.  Null
    texts and parts are empty strings; a row without doc_id is nobody's copy and has no label;
    repeated rows count each; of several labels of a document one that says 1 is enough.

    Copies of a text are counted by (text, part, label) before they meet, so a text of any
    number of copies is a few rows when its smallest doc_id is sought.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = fails(F.col("__text"))
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(found.values())), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("__text"))
    rows = rows.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("__text", 256)).alias("digest"))
    salt = F.when(F.col("doc_id").isNull(), 1 + F.pmod(F.xxhash64("digest", "part"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    rows = rows.withColumns({"key": F.coalesce("doc_id", F.lit(0)), "salt": salt})
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("key")).agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(d) for c, d in (("quality", "good"), ("toxic", "toxic"))))
    rows = rows.join(marks.withColumn("salt", F.lit(0)), ["key", "salt"], "left").fillna(False, ["good", "toxic"])

    same = ["digest", "part", "mask", "good", "toxic"]
    rows = rows.groupBy("key", "salt", "doc_id", *same).agg(F.count(F.lit(1)).alias("n"))
    numbered = F.col("doc_id").isNotNull()
    copies = rows.groupBy(*same).agg(F.sum("n").alias("n"), F.min(F.when(numbered, F.struct("doc_id", "n"))).alias("first"), F.sum(F.when(numbered, 0).otherwise(F.col("n"))).alias("unnumbered"))
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))  # a row for each part and label
    originals = F.col("unnumbered") + F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0)
    copies = copies.withColumn("originals", originals)
    bit = 1 << len(found)
    kinds = F.inline(F.array(F.struct(F.col("mask").alias("of"), F.col("originals").alias("k")), F.struct(F.col("mask").bitwiseOR(F.lit(bit)).alias("of"), (F.col("n") - F.col("originals")).alias("k"))))
    kinds = copies.select("part", "good", "toxic", kinds).where("k > 0")
    sums = {"n": F.col("k"), "good": F.when(F.col("good"), F.col("k")).otherwise(0), "toxic": F.when(F.col("toxic"), F.col("k")).otherwise(0)}
    return kinds.groupBy("part", F.col("of").alias("mask")).agg(*(F.sum(v).alias(k) for k, v in sums.items()))


class Diagram:
    """Counts by failure mask as a shared decision diagram over filters in an order.

    Nodes are numbered; each distinct pair of children is one node.  Weights are tuples of
    counts, a node's those of all masks below it.
    """

    def __init__(self, counts: dict[int, tuple[int, ...]], filters: int):
        self.order, self.children, self.weights = list(range(filters)), [], []
        self._known: dict[tuple, int] = {}
        self._nothing = tuple(0 for _ in next(iter(counts.values()), (0,)))
        self.root = self._built(counts, 0, 0)

    def _node(self, key: tuple, children: tuple[int, int] | None, weight: tuple[int, ...]) -> int:
        if key not in self._known:
            self._known[key] = len(self.children)
            self.children.append(children)
            self.weights.append(weight)
        return self._known[key]

    def _joined(self, low: int, high: int) -> int:
        return self._node((low, high), (low, high), tuple(map(sum, zip(self.weights[low], self.weights[high], strict=True))))

    def _built(self, counts: dict[int, tuple[int, ...]], level: int, mask: int) -> int:
        if level == len(self.order):
            weight = counts.get(mask, self._nothing)
            return self._node(("leaf", weight), None, weight)
        return self._joined(self._built(counts, level + 1, mask), self._built(counts, level + 1, mask | 1 << level))

    def swap(self, level: int) -> None:
        """Exchange the filters of ``level`` and the next one."""
        done: dict[int, int] = {}

        def swapped(node: int, above: int) -> int:
            if node not in done:
                low, high = self.children[node]
                if above:
                    done[node] = self._joined(swapped(low, above - 1), swapped(high, above - 1))
                else:
                    (ll, lh), (hl, hh) = self.children[low], self.children[high]
                    done[node] = self._joined(self._joined(ll, hl), self._joined(lh, hh))
            return done[node]

        self.root = swapped(self.root, level)
        self.order[level : level + 2] = self.order[level + 1], self.order[level]

    def steps(self) -> list[tuple[int, tuple[int, ...], tuple[int, ...]]]:
        """Filter, what it keeps and what it removes at each step of the all-pass path."""
        node, out = self.root, []
        for which in self.order:
            low, high = self.children[node]
            out.append((which, self.weights[low], self.weights[high]))
            node = low
        return out


def adjacent_swaps(n: int) -> list[int]:
    """Levels to swap with the next one, one after another, to meet all orders of ``n`` once."""
    if n < 2:
        return []
    out: list[int] = []
    for i, inner in enumerate([*adjacent_swaps(n - 1), None]):
        out += range(n - 2, -1, -1) if i % 2 == 0 else range(n - 1)  # the last one walks to the front, or back
        if inner is not None:
            out.append(inner + 1 if i % 2 == 0 else inner)
    return out


def all_orders(counts: dict[int, tuple[int, int, int]], filters: str) -> list[tuple]:
    """filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley of every order."""
    diagram = Diagram(counts, len(filters))
    orders = [(tuple(diagram.order), diagram.steps())]
    for level in adjacent_swaps(len(filters)):
        diagram.swap(level)
        orders.append((tuple(diagram.order), diagram.steps()))
    failing, alone, shapley = {}, {}, dict.fromkeys(range(len(filters)), 0)
    for _, steps in orders:
        failing[steps[0][0]], alone[steps[-1][0]] = steps[0][2][0], steps[-1][2][0]
        for which, _, removed in steps:
            shapley[which] += removed[0]
    return [
        ("".join(filters[i] for i in order), step, kept[0], removed[0], failing[which] - removed[0], alone[which], removed[1], removed[2], shapley[which])
        for order, steps in orders
        for step, (which, kept, removed) in enumerate(steps, 1)
    ]


_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
_SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COUNTS)


def _ordered(filters: str):
    types = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * len(_COUNTS)]
    names = ["part", "filter_order", "step", *_COUNTS]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        counts = {mask: (n, good, toxic) for mask, n, good, toxic in zip(*(table.column(c).to_pylist() for c in ("mask", "n", "good", "toxic")), strict=True)}
        rows = [(key[0].as_py(), *row) for row in all_orders(counts, filters)]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return run


def audit(docs: DataFrame, labels: DataFrame, fails: Conditions = conditions, filters: str = "ABCDE", part: str = "lang") -> DataFrame:
    """One row per part, order of ``filters`` (a letter each) and step, zeros included.

    ``fails`` gives the conditions of all filters but the last, which fails copies.  See
    :func:`failure_counts` for nulls, empty texts and repeated rows; an empty table has no
    parts, hence no rows.  A part reaches its task as one row a mask, however many documents it has.
    """
    counts = failure_counts(docs, labels, fails, part)
    return counts.groupBy("part").applyInArrow(_ordered(filters), _SCHEMA)
