"""Exponentially weighted means, the one recursion that no window frame expresses.

``y = (1 - alpha) * y_before + alpha * x``, seeded by the mean of the first ``n`` values that
are not null.  Rows are dealt by series and sorted; a worker streams through them and carries
only the running values, so a series of any length takes constant memory.

A long series is cut into chunks (:mod:`.chunked`) and scanned in two levels.  The recursion over a run of rows is
an affine map of what it starts from, so each chunk is summed up as that map (and the
few values that a seed may still need); the maps of a series are composed in order, one row a chunk, which
tells what every chunk starts from; then all chunks are streamed at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunked import CHUNK, is_cut, size_checked
from .dedup import cut_lineage


@dataclass(frozen=True)
class Mean:
    """Column ``out`` is the weighted mean of ``source`` over a span of ``n``."""

    out: str
    source: str
    n: int
    wilder: bool = False

    @property
    def alpha(self) -> float:
        return 1 / self.n if self.wilder else 2 / (self.n + 1)


def _means(values: np.ndarray, n: int, alpha: float, state: tuple[int, float]) -> tuple[np.ndarray, tuple[int, float]]:
    """Means (NaN before the seed) of ``values`` (NaN: null) from ``state``, and the state after them."""
    valid = ~np.isnan(values)
    x, (seen, y) = values[valid], state
    out = np.full(len(x) + 1, np.nan)  # out[0]: what a null before the first value repeats
    if seen >= n:
        out[0] = y
    ahead = min(max(n - seen, 0), len(x))
    if ahead:
        y = float(np.add.accumulate(np.concatenate(([y], x[:ahead])))[-1])
        if seen + ahead == n:
            y = out[ahead] = y / n
    if len(x) > ahead:
        carried = pd.Series(np.concatenate(([y], x[ahead:])))
        out[ahead + 1 :] = carried.ewm(alpha=alpha, adjust=False).mean().to_numpy()[1:]
        y = float(out[-1])
    return out[np.cumsum(valid)], (seen + len(x), y)


def run_mean(values: list, n: int, alpha: float, state: tuple[int, float]) -> tuple[list, tuple[int, float]]:
    """Means of ``values`` from ``state`` (values seen, sum before the seed or mean after)."""
    out, state = _means(np.array(values, np.float64), n, alpha, state)
    return [None if math.isnan(y) else y for y in out.tolist()], state


def _summary(values: np.ndarray, n: int, alpha: float) -> list[float]:
    """A run of values as numbers: how many are not null, the mean that they make of 0, the first ``n`` of them."""
    x = values[~np.isnan(values)]
    if not len(x):
        return [0.0, 0.0]
    y = pd.Series(np.concatenate(([0.0], x))).ewm(alpha=alpha, adjust=False).mean().to_numpy()[-1]
    return [float(len(x)), float(y), *x[:n].tolist()]


def _composed(summary: list[float], n: int, alpha: float, state: tuple[int, float]) -> tuple[int, float]:
    """The state after a run of values, from its summary and the state before it."""
    m, y, head = int(summary[0]), summary[1], summary[2:]
    seen, before = state
    ahead = min(max(n - seen, 0), m)
    for x in head[:ahead]:
        before += x
    if seen < n and seen + ahead == n:
        before /= n
    if m > ahead:
        # the values that went into the seed have no part in the recursion
        y -= sum(alpha * (1 - alpha) ** (m - 1 - i) * x for i, x in enumerate(head[:ahead]))
        before = (1 - alpha) ** (m - ahead) * before + y
    return seen + m, before


def _cuts(batch: pa.RecordBatch, columns: list[str]) -> list[int]:
    """Where runs of equal ``columns`` begin, and the end."""
    new = np.zeros(batch.num_rows - 1, bool)
    for k in columns:
        codes = np.asarray(batch.column(k).dictionary_encode(null_encoding="encode").indices)
        new |= codes[1:] != codes[:-1]
    return [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]


def _inputs(batch: pa.RecordBatch, means: list[Mean]) -> dict[str, np.ndarray]:
    return {m.source: batch.column(m.source).cast(pa.float64()).to_numpy(zero_copy_only=False) for m in means}


def _starts(dealt: DataFrame, means: list[Mean], keys: list[str]) -> DataFrame:
    """keys, chunk, start: what each chunk's first row starts from; two numbers a mean."""
    of_keys = [dealt.schema[k] for k in keys]
    parts = T.StructType([*of_keys, T.StructField(CHUNK, T.IntegerType()), T.StructField("sums", T.ArrayType(T.ArrayType(T.DoubleType())))])
    begun = T.StructType([*of_keys, T.StructField(CHUNK, T.IntegerType()), T.StructField("start", T.ArrayType(T.DoubleType()))])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # a chunk that goes on in the next batch gives several rows, in order of ``at``
            if not batch.num_rows:
                continue
            cuts, inputs = _cuts(batch, [*keys, CHUNK]), _inputs(batch, means)
            sums = [[_summary(inputs[m.source][a:b], m.n, m.alpha) for m in means] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            first = pa.array(cuts[:-1])
            at = pc.cast(batch.column("__at").take(first), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(first) for k in [*keys, CHUNK]), pa.array(sums, pa.list_(pa.list_(pa.float64()))), at], names=[*keys, CHUNK, "sums", "at"])

    def composed(_: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([(CHUNK, "ascending"), ("at", "ascending")])
        states, starts, known = [(0, 0.0)] * len(means), [], set()
        firsts = []
        for i, (chunk, sums) in enumerate(zip(table.column(CHUNK).to_pylist(), table.column("sums").to_pylist(), strict=True)):
            if chunk not in known:
                known.add(chunk)
                firsts.append(i)
                starts.append([float(x) for state in states for x in state])
            states = [_composed(s, m.n, m.alpha, state) for s, m, state in zip(sums, means, states, strict=True)]
        out = table.take(pa.array(firsts, pa.int64())).select([*keys, CHUNK])
        return out.append_column("start", pa.array(starts, pa.list_(pa.float64())))

    numbered = dealt.withColumn("__at", F.monotonically_increasing_id())
    sums = numbered.mapInArrow(summed, T.StructType([*parts.fields, T.StructField("at", T.LongType())]))
    starts = cut_lineage(sums.groupBy(*keys).applyInArrow(composed, begun))
    return cut_lineage(starts.withColumnRenamed("start", "__start"))


def ewm(df: DataFrame, means: list[Mean], keys: list[str], order: str, dealt: bool = False) -> DataFrame:
    """``df`` with a double column for each of ``means``; a null input repeats the last mean.

    ``dealt``: the rows are still as an earlier call has dealt and sorted them (only narrow steps followed).
    A ``df`` that is cut into chunks (without halo rows) is scanned chunk by chunk.
    """
    groups, narrow = keys, df
    if is_cut(df):
        groups, dealt = [*keys, CHUNK], False
        narrow = df.repartition(*groups).sortWithinPartitions(*groups, order)
        starts = size_checked(_starts(narrow, means, keys))
        df = df.join(starts, [*keys, CHUNK], "left").select(df["*"], "__start")
    kept = [f for f in df.schema.fields if f.name != "__start"]
    schema = T.StructType(kept + [T.StructField(m.out, T.DoubleType()) for m in means])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, states = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            cuts, inputs = _cuts(batch, groups), _inputs(batch, means)
            columns = [np.empty(batch.num_rows) for _ in means]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                owner = tuple(batch.column(k)[a].as_py() for k in groups)
                if owner != key:
                    start = batch.column("__start")[a].as_py() if "__start" in batch.schema.names else None
                    key, states = owner, {m.out: (int(start[2 * i]), start[2 * i + 1]) for i, m in enumerate(means)} if start else {}
                for column, m in zip(columns, means, strict=True):
                    column[a:b], states[m.out] = _means(inputs[m.source][a:b], m.n, m.alpha, states.get(m.out, (0, 0.0)))
            names = [f.name for f in kept]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(c, from_pandas=True) for c in columns)], names=[*names, *(m.out for m in means)])

    rows = df if dealt else df.repartition(*groups).sortWithinPartitions(*groups, order)
    return rows.mapInArrow(run, schema)
