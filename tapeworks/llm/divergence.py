"""Divergence of sources within a language, by three-dimensional cube partitioning.

Groups are (language, source); a language keeps the terms that enough of its documents
have, and each group gives each kept term an integer probability.  Pairs of groups are
compared in cells (group block, group block, term block): each cell gets the two
slices of the groups it owns, replicated from the table of counts, adds up its pairs'
divergences over its terms, and the partial sums are reduced along the term axis.
No task holds more than two blocks of groups over one block of terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, bounded_batches, cut_lineage, size_checked, utf8

LEAST_DOCS, TOP, SCALE = 10, 10, 1_000_000_000
#: Groups and terms of one side of a cell.
GROUPS, TERMS = 64, 4096
#: Different (group, term) counts that a worker holds before it gives them out.
HELD = 500_000
#: One document, above any number of occurrences that a worker holds.
_DOC = 1 << 40
#: Upper case to lower case, and whatever is no part of a term to a space.
_FOLD = bytes(i if i >= 0x80 or 0x61 <= i <= 0x7A else i + 32 if 0x41 <= i <= 0x5A else 0x20 for i in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and characters beyond ASCII; A-Z in lower case."""
    return text.translate(_FOLD).split()


_PARTIAL = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by group; a null term stands for the group itself."""
    held: dict[tuple, dict[bytes, int]] = {}  # occurrences, and documents above them

    def out() -> pa.RecordBatch:
        columns: list[list] = [[] for _ in _PARTIAL]
        for (lang, source), counts in held.items():
            terms, both = pa.array([None, *counts], pa.binary()), pa.array([0, *counts.values()], pa.int64())
            rows = pa.scalar(lang), pa.scalar(source), terms.cast(pa.string()), pc.bit_wise_and(both, _DOC - 1), pc.shift_right(both, 40)
            for column, x in zip(columns, rows, strict=True):
                column.append(pa.repeat(x, len(terms)) if isinstance(x, pa.Scalar) else x)
        held.clear()
        return batch_of(_PARTIAL, *(pa.concat_arrays(c) if c else [] for c in columns))

    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), utf8(batch.column("text")), strict=True):
            counts = held.setdefault((lang, source), {})
            for term, n in Counter(terms(text)).items():
                counts[term] = counts.get(term, 0) + n + _DOC
        if sum(map(len, held.values())) > HELD:
            yield out()
    yield out()


def group_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences of each term in each group, and documents with it.

    Null texts, languages and sources are empty strings; repeated rows count each.  A row
    with a null term stands for each group, so groups without terms are there too.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    partial = rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _probability(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * kept)) in whole numbers of any size."""
    whole = lambda c: c.cast("decimal(20,0)")
    scaled, below = F.lit(SCALE).cast("decimal(10,0)") * whole(n + 2), whole(total + 2 * kept)
    return F.when(kept == 0, F.lit(0)).otherwise(F.lit(1) + F.call_function("div", scaled, below))


def _divergence(p: Column, q: Column) -> Column:
    """floor((p - q) ** 2 / (p + q)), below 2 ** 63 for probabilities up to SCALE + 1."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _cell(key: tuple, table: pa.Table) -> pa.Table:
    """Partial divergences of a cell's pairs of groups over its terms."""
    _, a, b, _ = (k.as_py() for k in key)
    block, group, term, p = (table.column(c).combine_chunks() for c in ("own", "source", "term", "p"))
    block, p, absent = np.asarray(block), np.asarray(p), np.asarray(term.is_null())
    kept = np.asarray(table.column("slice_terms"))
    names, of = np.unique(np.array(group.to_pylist(), object)[absent], return_inverse=True)  # each group has one such row
    base, side = np.empty(len(names), np.int64), np.empty(len(names), np.int64)
    base[of], side[of] = p[absent], block[absent]
    place = {name: i for i, name in enumerate(names.tolist())}
    codes = term.dictionary_encode()
    width, slice_terms = len(codes.dictionary), int(kept[absent].max(initial=0))
    dense = np.repeat(base[:, None], width, axis=1)
    rows = np.flatnonzero(~absent)
    dense[[place[group[i].as_py()] for i in rows.tolist()], np.asarray(codes.indices.fill_null(0))[rows]] = p[rows]
    left, right = np.flatnonzero(side == a), np.flatnonzero(side == b)
    out: list[tuple] = []
    for i in left.tolist():
        others = right[right > i] if a == b else right
        square, both = (dense[i] - dense[others]) ** 2, dense[i] + dense[others]
        sums = (square // np.maximum(both, 1)).sum(axis=1)
        gap, pair = base[i] - base[others], base[i] + base[others]
        sums += (slice_terms - width) * (gap**2 // np.maximum(pair, 1))  # terms that none of the cell's groups has
        out += [(names[i], names[j], int(s)) for j, s in zip(others.tolist(), sums, strict=True)]
    lang = [key[0].as_py()] * len(out)
    x, y, s = zip(*out, strict=True) if out else ([], [], [])
    return pa.table([pa.array(lang, pa.string()), pa.array(x, pa.string()), pa.array(y, pa.string()), pa.array(s, pa.int64())], names=["lang", "x", "y", "value"])


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, groups_a_block: int = GROUPS, terms_a_block: int = TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source is from the others of its language.

    Part ``pair`` has every other source of the language, ``term`` the ``top`` terms that the
    source has more often than its language.  Ranks run from 1 by value, then by item.
    Nulls are empty strings; a group without terms counts like any other; a language
    without kept terms has pairs of value 0; an empty table gives no rows.
    """
    # a term's rows, one a source, meet once: there its language's counts are added up and rare terms go
    counts = group_terms(docs)
    of_term = Window.partitionBy("lang", "term")
    counts = counts.withColumns({"lang_n": F.sum("n").over(of_term), "lang_docs": F.sum("docs").over(of_term), "leads": F.min("source").over(of_term) == F.col("source")})
    counts = cut_lineage(counts.where(F.col("term").isNull() | (F.col("lang_docs") >= least_docs)).select("lang", "source", "term", "n", "lang_n", "leads"))
    groups, own = counts.where("term is null").select("lang", "source"), counts.where("term is not null")
    leading = lambda c: F.sum(F.when(F.col("leads"), c).otherwise(0))
    sizes = own.groupBy("lang").agg(leading(F.lit(1)).alias("v"), leading(F.col("lang_n")).alias("lang_total"))
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("g")).join(sizes, "lang", "left").fillna(0, ["v", "lang_total"])
    langs = langs.withColumns({"group_blocks": F.ceil(F.col("g") / groups_a_block).cast("int"), "term_blocks": F.greatest(F.lit(1), F.ceil(F.col("v") / terms_a_block)).cast("int")})
    langs = size_checked(cut_lineage(langs))
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").fillna(0, ["total"]).join(langs, "lang")
    groups = cut_lineage(groups.withColumn("own", F.pmod(F.xxhash64("source"), "group_blocks").cast("int")))
    block = F.pmod(F.xxhash64("term"), "term_blocks").cast("int")
    own = own.join(size_checked(groups), ["lang", "source"])
    own = own.withColumns({"p": _probability(F.col("n"), F.col("total"), F.col("v")), "c": block})

    # terms: the largest of each source
    q = _probability(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    rarer = own.withColumn("q", q).where("n > 0 and p > q").select("lang", "source", F.col("term").alias("item"), _divergence(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out_terms = rarer.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    # pairs: slices go to the cells that own them
    slices = own.groupBy("lang", "c").agg(leading(F.lit(1)).alias("slice_terms"))
    none = _probability(F.lit(0), F.col("total"), F.col("v"))
    absent = groups.withColumns({"c": F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1)), "term": F.lit(None).cast("string"), "p": none})
    absent = absent.join(slices, ["lang", "c"], "left").fillna(0, ["slice_terms"])
    columns = ["lang", "source", "own", "group_blocks", "c", "term", "p", "slice_terms"]
    rows = absent.select(*columns).union(own.withColumn("slice_terms", F.lit(0).cast("long")).select(*columns))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("group_blocks") - 1)))
    rows = rows.withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")}).drop("other", "group_blocks")
    cells = rows.groupBy("lang", "a", "b", "c").applyInArrow(_cell, "lang string, x string, y string, value long")
    pairs = cells.groupBy("lang", "x", "y").agg(F.sum("value").alias("value"))
    both = F.inline(F.array(F.struct(F.col("x").alias("source"), F.col("y").alias("item")), F.struct(F.col("y").alias("source"), F.col("x").alias("item"))))
    out_pairs = pairs.select("lang", both, "value").withColumn("rank", F.row_number().over(order))

    columns = ["lang", "source", "part", "item", "value", "rank"]
    return out_pairs.withColumn("part", F.lit("pair")).select(*columns).union(out_terms.withColumn("part", F.lit("term")).select(*columns))
