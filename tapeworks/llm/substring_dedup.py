"""Exact removal of long repeated word sequences by super-k-mer partitioning.

A window is ``k`` consecutive words of one text.  Its minimiser is the smallest hash of
the ``m``-word sequences inside it, so equal windows have equal minimisers.  Consecutive
windows with the same minimiser travel as one packed string to the minimiser's bucket;
there the windows of all strings are sorted and equal neighbours counted.

Steps, each a Spark job over all rows:

1. count the places of minimisers (long integers only) and keep those found at two or
   more: a window that repeats has such a minimiser, so nothing is lost;
2. find the places of these minimisers, gathered by text, and cut the packed strings
   from the texts; of equal texts one speaks for all;
3. sort each bucket and count; the verdicts go back to the texts as ranges of windows.
   Minimisers met more often than ``hot`` times have no bucket: equal runs are added up
   before and after they move, then equal windows of the different runs, so a frequent
   passage never meets in one task.

Windows are compared by their words.  Texts, and runs and windows without a bucket on their
way back, are named by 128-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, batch_of, bounded_batches, slices, utf8

WINDOW, MINIMISER, HOT, LONGEST_RUN = 35, 8, 1000, 256

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, made once for a worker."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(21, int(n).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"][:n], _powers["down"][:n]


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash and the number of its text for each word of ``texts``."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[:-1], out=total[1:])
    value = (total[ends] - total[starts]) * down[starts]
    value ^= value >> np.uint64(29)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    value ^= value >> np.uint64(32)
    ends_of_texts = np.cumsum([len(t) + 1 for t in texts])
    return value, np.searchsorted(ends_of_texts, starts, side="right")


def super_kmers(texts: list[bytes], k: int, m: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that share a minimiser: (minimiser, text, first word, windows).

    Last comes the hash of every ``m``-word sequence of ``texts``.
    """
    words, text = _word_hashes(texts)
    n = len(words) - k + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none, none.view(np.uint64)
    grams = np.zeros(len(words) - m + 1, np.uint64)
    for j in range(m):
        grams = grams * np.uint64(0x100000001B3) + words[j : j + len(grams)]
    grams ^= grams >> np.uint64(31)
    grams *= np.uint64(0x94D049BB133111EB)
    grams ^= grams >> np.uint64(30)
    least, width, span = grams, 1, k - m + 1
    while width < span:  # smallest of ``span`` neighbours, by doubling
        step = min(width, span - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    at = np.flatnonzero(text[:n] == text[k - 1 :])
    if not len(at):
        return none, none, none, none, grams
    value, owner = least[at], text[at]
    new = np.ones(len(at), bool)
    new[1:] = (value[1:] != value[:-1]) | (at[1:] != at[:-1] + 1)
    heads = np.flatnonzero(new)
    place = np.arange(len(at)) - np.repeat(heads, np.diff(np.append(heads, len(at))))
    heads = np.flatnonzero(place % LONGEST_RUN == 0)
    first_word = np.searchsorted(text, owner[heads], side="left")
    return value[heads].view(np.int64), owner[heads], at[heads] - first_word, np.diff(np.append(heads, len(at))), grams


def repeated_ranges(strings: list[bytes], counts: list[int], k: int) -> list[list[int]]:
    """For each packed string, the offsets of windows that occur elsewhere too."""
    found: list[list[int]] = [[] for _ in strings]
    windows = []
    for i, string in enumerate(strings):
        words = string.split(b" ")
        windows.extend((b" ".join(words[j : j + k]), i, j) for j in range(len(words) - k + 1))
    windows.sort()
    a = 0
    while a < len(windows):
        b, times = a, 0
        while b < len(windows) and windows[b][0] == windows[a][0]:
            times += counts[windows[b][1]]
            b += 1
        if times > 1:
            for _, i, j in windows[a:b]:
                found[i].append(j)
        a = b
    return found


_COUNT = pa.schema([("mini", pa.int64()), ("n", pa.int64())])
_PLACE = pa.schema([("mini", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("at", pa.int32()), ("n_win", pa.int32())])
_STRING = pa.schema([("bucket", pa.int64()), ("string", pa.binary()), ("h1", pa.int64()), ("h2", pa.int64()), ("at", pa.int32()), ("copies", pa.int32())])
_RUN = pa.schema([("run_p", pa.int64()), ("run_q", pa.int64()), ("string", pa.binary()), ("copies", pa.int64())])
_RUN_AT = pa.schema([("run_p", pa.int64()), ("run_q", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("at", pa.int32())])
_WINDOW = pa.schema([("p", pa.int64()), ("q", pa.int64()), ("string", pa.binary()), ("copies", pa.int64())])
_OFFSET = pa.schema([("p", pa.int64()), ("q", pa.int64()), ("run_p", pa.int64()), ("run_q", pa.int64()), ("offset", pa.int32())])
_FOUND = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("start", pa.int32()), ("last", pa.int32())])
_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _minimiser_counts(k: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column("text"))
            for a, b in slices(texts):
                mini, _, _, _, grams = super_kmers(texts[a:b], k, m)
                mini, grams = np.unique(mini.view(np.uint64)), np.sort(grams)
                n = np.searchsorted(grams, mini, side="right") - np.searchsorted(grams, mini, side="left")
                yield batch_of(_COUNT, mini.view(np.int64), n)

    return run


def _minimiser_places(k: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column("text"))
            for a, b in slices(texts):
                mini, owner, at, n, _ = super_kmers(texts[a:b], k, m)
                keys = (batch.column(c).slice(a, b - a).take(pa.array(owner, pa.int64())) for c in ("h1", "h2"))
                yield batch_of(_PLACE, mini, *keys, at, n)

    return run


def _spoken(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Joined words, where they start, the text's keys and copies, and its places, row by row."""
    keys = [batch.column(c).to_pylist() for c in ("h1", "h2", "copies")]
    lists = batch.column("places")
    flat, cuts = lists.flatten(), np.asarray(lists.offsets) - lists.offsets[0].as_py()
    at, n_win = (np.asarray(flat.field(c)) for c in ("at", "n_win"))
    bucket, cold = np.asarray(flat.field("bucket").fill_null(0)), np.asarray(flat.field("bucket").is_valid())
    for i, text in enumerate(utf8(batch.column("text"))):
        words = text.split()
        starts = np.concatenate(([0], np.cumsum([len(w) + 1 for w in words]))).tolist()
        own = slice(cuts[i], cuts[i + 1])
        yield b" ".join(words), starts, [c[i] for c in keys], (at[own], n_win[own], bucket[own], cold[own])


def _packed_strings(k: int):
    """Rows of the runs that have a bucket, each a string of all words that its windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [[] for _ in _STRING], 0
            for joined, starts, (h1, h2, copies), (at, n_win, bucket, cold) in _spoken(batch):
                for a, n, key in zip(at[cold].tolist(), n_win[cold].tolist(), bucket[cold].tolist(), strict=True):
                    string = joined[starts[a] : starts[a + n + k - 1] - 1]
                    held += len(string)
                    for column, x in zip(rows, (key, string, h1, h2, a, copies), strict=True):
                        column.append(x)
                if held > SLICE_BYTES:
                    yield batch_of(_STRING, *rows)
                    rows, held = [[] for _ in _STRING], 0
            yield batch_of(_STRING, *rows)

    return run


def _named(string: bytes) -> tuple[int, int]:
    """The 128-bit name of a string."""
    return xxhash.xxh64_intdigest(string, 1) - 2**63, xxhash.xxh64_intdigest(string, 2) - 2**63


def _single_runs(k: int, schema: pa.Schema):
    """Rows of the runs without a bucket: with their words to be counted, or with their text's keys to be told."""
    count = schema is _RUN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[] for _ in schema]
            for joined, starts, (h1, h2, copies), (at, n_win, _, cold) in _spoken(batch):
                for a, n in zip(at[~cold].tolist(), n_win[~cold].tolist(), strict=True):
                    string = joined[starts[a] : starts[a + n + k - 1] - 1]
                    for column, x in zip(rows, (*_named(string), *((string, copies) if count else (h1, h2, a))), strict=True):
                        column.append(x)
                if len(rows[0]) > 5000:
                    yield batch_of(schema, *rows)
                    rows = [[] for _ in schema]
            yield batch_of(schema, *rows)

    return run


def _run_windows(k: int, schema: pa.Schema):
    """Rows of the windows of different runs: with their words and the run's copies, or with the run's name and their place in it."""
    count = schema is _WINDOW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[] for _ in schema]
            for run_p, run_q, string, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                starts = [0, *(m + 1 for m, c in enumerate(string) if c == 32), len(string) + 1]
                for offset in range(len(starts) - k):
                    window = string[starts[offset] : starts[offset + k] - 1]
                    for column, x in zip(rows, (*_named(window), *((window, copies) if count else (run_p, run_q, offset))), strict=True):
                        column.append(x)
                if len(rows[0]) > 5000:
                    yield batch_of(schema, *rows)
                    rows = [[] for _ in schema]
            yield batch_of(schema, *rows)

    return run


def _ranges(offsets: list[int]) -> list[tuple[int, int]]:
    """Numbers as ranges (first, last)."""
    at = np.sort(offsets)
    heads = np.flatnonzero(np.concatenate(([True], np.diff(at) > 1)))
    return list(zip(at[heads].tolist(), at[np.append(heads[1:], len(at)) - 1].tolist(), strict=True))


def _sorted_buckets(k: int):
    """Counts the windows of each bucket; the rows come sorted by bucket and string.

    A bucket has no more strings than its minimiser has places, so it is bounded.
    """

    def flush(strings: dict[bytes, list], rows: list[list]) -> None:
        counts = [sum(owners.values()) for owners in strings.values()]
        for owners, offsets in zip(strings.values(), repeated_ranges(list(strings), counts, k), strict=True):
            for first, last in _ranges(offsets) if offsets else ():
                for h1, h2, at in owners:
                    for column, x in zip(rows, (h1, h2, at + first, at + last), strict=True):
                        column.append(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, strings, rows = None, {}, [[] for _ in _FOUND]
        for batch in batches:
            for key, string, h1, h2, at, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != bucket:
                    flush(strings, rows)
                    bucket, strings = key, {}
                owners = strings.setdefault(string, {})
                owners[h1, h2, at] = owners.get((h1, h2, at), 0) + copies
            if len(rows[0]) > 5000:
                yield batch_of(_FOUND, *rows)
                rows = [[] for _ in _FOUND]
        flush(strings, rows)
        yield batch_of(_FOUND, *rows)

    return run


def _without_windows(k: int, digest: bool):
    schema = _DIGEST if digest else _KEPT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            lists = batch.column("ranges")
            cuts, flat = np.asarray(lists.offsets) - lists.offsets[0].as_py(), lists.flatten()
            start, last = (np.asarray(flat.field(c)) for c in ("start", "last"))
            for i, (doc, text) in enumerate(zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), strict=True)):
                words, own, removed = text.split(), slice(cuts[i], cuts[i + 1]), 0
                if cuts[i + 1] > cuts[i]:
                    drop = np.zeros(len(words) + 1, np.int64)
                    np.add.at(drop, start[own], 1)
                    np.add.at(drop, last[own] + k, -1)
                    keep = np.cumsum(drop)[:-1] == 0
                    removed = int((~keep).sum())
                    kept = b" ".join(compress(words, keep.tolist()))
                else:
                    kept = b" ".join(words)
                for column, x in zip(out, (doc, len(words), removed, hashlib.sha256(kept).hexdigest() if digest else kept.decode()), strict=True):
                    column.append(x)
            yield batch_of(schema, *out)

    return run


def remove_repeated_windows(docs: DataFrame, k: int = WINDOW, m: int = MINIMISER, hot: int = HOT, digest: bool = False) -> DataFrame:
    """Drop every word that a window of ``k`` words covers whose words start anywhere else too.

    ``docs``: doc_id long, text string; other columns are not looked at.  Returns a row for
    each input row: doc_id, n_words, n_removed and kept_text (words joined by one space), or
    kept_sha256 in its place if ``digest``.  Null and empty texts have no words; a text under
    ``k`` words loses none; an empty table gives an empty one; repeated rows are copies of
    each other and lose their windows; a null doc_id stays null.
    """
    bounded_batches(docs.sparkSession)
    keys = ["h1", "h2"]
    # plain columns where no cast is needed: a renamed one would keep Spark from seeing that texts are dealt alike
    doc_id, text = (F.col(c) if docs.schema[c].dataType.simpleString() == kind else F.col(c).cast(kind).alias(c) for c, kind in (("doc_id", "bigint"), ("text", "string")))
    docs = docs.select(doc_id, text).select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text")
    counts = docs.select("text").mapInArrow(_minimiser_counts(k, m), _ddl(_COUNT)).groupBy("mini").agg(F.sum("n").alias("n")).where("n > 1")
    places = docs.select("h1", "h2", "text").mapInArrow(_minimiser_places(k, m), _ddl(_PLACE)).join(counts, "mini")

    # of equal texts one speaks for all
    speakers = docs.groupBy(*keys).agg(F.min("doc_id").alias("speaker"), F.least(F.count(F.lit(1)), F.lit(2)).cast("int").alias("copies"))
    bucket = F.when(F.col("n") <= hot, F.col("mini")).alias("bucket")
    by_text = places.groupBy(*keys).agg(F.collect_set(F.struct("at", "n_win", bucket)).alias("places")).join(speakers, keys)
    # a difference, not an equality: so texts are dealt by their keys alone here and below, once
    speaks = F.coalesce(F.col("doc_id") - F.col("speaker"), F.lit(0)) == 0
    spoken = docs.join(by_text, keys).where(speaks).select("text", "h1", "h2", "copies", "places")
    cold = spoken.where(F.exists("places", lambda p: p.bucket.isNotNull()))
    single = spoken.where(F.exists("places", lambda p: p.bucket.isNull()))

    strings = cold.mapInArrow(_packed_strings(k), _ddl(_STRING)).repartition("bucket").sortWithinPartitions("bucket", "string")
    found = strings.mapInArrow(_sorted_buckets(k), _ddl(_FOUND))
    found = found.select(*keys, F.array(F.struct("start", "last")).alias("ranges"))

    name = ["run_p", "run_q"]
    runs = single.mapInArrow(_single_runs(k, _RUN), _ddl(_RUN)).groupBy(*name, "string").agg(F.sum("copies").alias("copies"))
    windows = runs.mapInArrow(_run_windows(k, _WINDOW), _ddl(_WINDOW)).groupBy("p", "q", "string").agg(F.sum("copies").alias("n")).where("n > 1").select("p", "q").distinct()
    offsets = runs.mapInArrow(_run_windows(k, _OFFSET), _ddl(_OFFSET)).join(windows, ["p", "q"]).groupBy(*name).agg(F.collect_set("offset").alias("offsets"))
    told = single.mapInArrow(_single_runs(k, _RUN_AT), _ddl(_RUN_AT)).join(offsets, name)
    told = told.select(*keys, F.transform("offsets", lambda o: F.struct((F.col("at") + o).alias("start"), (F.col("at") + o).alias("last"))).alias("ranges"))
    ranges = found.union(told).groupBy(*keys).agg(F.flatten(F.collect_set("ranges")).alias("ranges"))
    rows = docs.join(ranges, keys, "left").select("doc_id", "text", F.coalesce("ranges", F.array().cast("array<struct<start:int,last:int>>")).alias("ranges"))
    return rows.mapInArrow(_without_windows(k, digest), _ddl(_DIGEST if digest else _KEPT))
