"""Near-duplicate groups by SimHash with pivot distance tables.

A fingerprint has a bit set where over half of a text's shingle hashes have it.  The
Hamming distances of each fingerprint to a fixed list of reference fingerprints (pivots)
are worked out once.  By the triangle inequality two fingerprints within ``r`` bits differ
by ``r`` at most in each of these distances; a pair whose largest coordinate difference is
over ``r`` is discarded, and survivors are verified bit by bit.

Distances to random pivots lie close together, so they discard pairs but do not find
them.  Pairs are therefore met by sections: the 64 bits are cut into six, and of two
fingerprints within 4 bits two sections at least are equal (4 differences spoil 4 sections
at most), so each fingerprint is dealt under the 15 pairs of its sections.  More rows take
more and finer sections (seven by threes, eight by fours), so buckets stay small.  Inside
a bucket only the edges of a spanning forest are given out, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations
from operator import and_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, batch_of, bounded_batches, cut_lineage, private, size_checked, utf8

SEED, RADIUS, PIVOTS = 42, 4, 16
_REFERENCES = np.random.default_rng(2024).integers(0, 2**63, PIVOTS, dtype=np.uint64) * np.uint64(2) + np.random.default_rng(2025).integers(0, 2, PIVOTS, dtype=np.uint64)


def fingerprint(text: bytes, n: int) -> int:
    """SimHash of the ``n``-word shingles of ``text`` (A-Z lower-cased), repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = min(n, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<i8")[0])


_PRINT = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_DEALT = pa.schema([("bucket", pa.int64()), ("fp", pa.int64()), ("pivots", pa.binary())])


def _fingerprints(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t, n) for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.int64())], schema=_PRINT)

    return run


def fingerprints(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) for each row; no words: 0."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


def _sections(radius: int, equal: int) -> list[np.uint64]:
    """Masks of each ``equal`` of the 64 bits' ``radius + equal`` sections."""
    cuts = np.linspace(0, 64, radius + equal + 1).round().astype(int)
    masks = [np.uint64((1 << int(b)) - (1 << int(a))) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return [np.bitwise_or.reduce(x) for x in combinations(masks, equal)]


def equal_sections(rows: int, radius: int) -> int:
    """How many sections make a key that tells ``rows`` fingerprints apart."""
    equal = 2
    while equal < 5 and 64 * equal // (radius + equal) < np.log2(max(rows, 2)) - 4:
        equal += 1
    return equal


def _pivot_table(prints: np.ndarray) -> np.ndarray:
    return np.bitwise_count(prints[:, None] ^ _REFERENCES[None, :]).astype(np.uint8)


def _deal(radius: int, equal: int):
    masks = _sections(radius, equal)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.asarray(batch.column("fp")).view(np.uint64)
            table = pa.array([row.tobytes() for row in _pivot_table(prints)], pa.binary())
            for i, mask in enumerate(masks):
                key = (prints & mask) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(32)
                key = key * np.uint64(2 * i + 1) + np.uint64(i)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("fp"), table], schema=_DEALT)

    return run


def _near(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs are within ``radius``: pivot table first, then the bits of survivors."""
    near = np.abs(px.astype(np.int16) - py.astype(np.int16)).max(axis=-1) <= radius
    at = np.flatnonzero(near)
    near[at] = np.bitwise_count((x[at] if np.ndim(x) else x) ^ y[at]) <= radius
    return near


def forest(prints: np.ndarray, pivots: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that connect what is connected within one bucket, fewer than its members."""
    edges, left = [], np.arange(len(prints))
    while len(left):
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            i = stack.pop()
            near = _near(prints[i], prints[left], pivots[i], pivots[left], radius)
            edges += [(i, j) for j in left[near].tolist()]
            stack += left[near].tolist()
            left = left[~near]
    return edges


def _bucket_edges(radius: int, small: int = 16):
    def of(keys: np.ndarray, prints: np.ndarray, pivots: np.ndarray) -> pa.RecordBatch | None:
        heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.append(heads, len(keys)))
        left, right = [], []
        inside = np.repeat(sizes <= small, sizes)
        for step in range(1, small):
            at = np.flatnonzero((keys[step:] == keys[:-step]) & inside[step:])
            if not len(at):
                break
            near = _near(prints[at], prints[at + step], pivots[at], pivots[at + step], radius)
            left.append(at[near])
            right.append(at[near] + step)
        for head, size in zip(heads[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
            found = forest(prints[head : head + size], pivots[head : head + size], radius)
            left.append(np.array([head + a for a, _ in found], np.int64))
            right.append(np.array([head + b for _, b in found], np.int64))
        if not left:
            return None
        p, q = (prints.view(np.int64)[np.concatenate(x)] for x in (left, right))
        return batch_of(_EDGE, np.minimum(p, q), np.maximum(p, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = (np.asarray(batch.column("bucket")), np.asarray(batch.column("fp")).view(np.uint64), np.frombuffer(b"".join(batch.column("pivots").to_pylist()), np.uint8).reshape(-1, PIVOTS))
            held = new if held is None else tuple(np.concatenate(x) for x in zip(held, new, strict=True))
            last = int(np.searchsorted(held[0], held[0][-1], side="left"))
            if last and (out := of(*(x[:last] for x in held))) is not None:
                yield out
            held = tuple(x[last:] for x in held)  # the last bucket may go on
        if held is not None and (out := of(*held)) is not None:
            yield out

    return run


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges a < b between distinct fingerprints; their components are those of all links.

    ``prints``: one column fp of distinct fingerprints.
    """
    equal = equal_sections(prints.count(), radius)
    dealt = prints.select("fp").mapInArrow(_deal(radius, equal), "bucket long, fp long, pivots binary")
    buckets = dealt.repartition("bucket").sortWithinPartitions("bucket", "fp")
    return buckets.mapInArrow(_bucket_edges(radius), "a long, b long").distinct()


def components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """node, root: the smallest node that each node of ``edges`` (a, b) is connected with.

    Large-star and small-star steps take turns until nothing changes; each turn is written
    to the shared folder by ``keep``.  A node's neighbours are never gathered: minima are aggregated
    and joined back.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        side = both.where("v > u" if large else "v < u").join(least, "u")
        out = side.select(F.col("v").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.union(least.select("u", "m"))
        return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def sign(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = sign(edges)
    while before[0]:
        for large in (True, False):  # a plan and a table each: nested, one would hold the other four times
            edges = keep(star(edges, large))
        after = sign(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 5, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of ``docs``.

    Fingerprints that differ in ``radius`` bits at most are linked; component_id is the
    smallest doc_id that links lead to (null doc_ids are passed over; null only if no member
    has one).  Texts under ``shingle`` words are one shingle; null, empty and blank texts
    have fingerprint zero and are linked like others.  Repeated rows are members each.
    """
    if not 0 <= radius <= 8:
        raise ValueError("radius must be from 0 to 8")
    prints = cut_lineage(fingerprints(docs, shingle))
    nodes = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(nodes, radius))
    nodes = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    groups = nodes.join(least, "root").select(F.col("fp").alias("group_fp"), "component_id")
    out = prints.join(groups, prints.fp == groups.group_fp)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


LANES, SIMILARITY = 4, 0.8
#: Texts meet under ``BANDS`` keys of ``ROWS`` least shingle hashes each.
BANDS, ROWS = 28, 5
#: Standard deviations above the expected number of differing bits at which a pair is still looked at.
DEVIATIONS = 4.5
#: Sets of fewer shingles are compared whatever their bits, which say little about them.
SMALL_SET = 32
#: Links of one text that one task looks up at most.
LINKS_A_TASK = 1000
#: Members of a family that meet in one block at least and at most, and the blocks it has before they grow.
BLOCK, LARGEST_BLOCK, BLOCKS = 256, 2048, 32
#: Shingles that one step of a comparison of two blocks counts.
COLUMNS = 4096
#: Texts of a family whose fingerprints are the references of a comparison of two blocks.
REFERENCES = 64
_FACTORS = np.random.default_rng(7).integers(0, 2**31, (BANDS * ROWS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
#: Bytes of a packed text before its shingles.
_HEAD = LANES * 8


def shingle_set(text: bytes, n: int) -> np.ndarray:
    """Sorted hashes of the distinct ``n``-word shingles of ``text``; fewer words are one shingle."""
    words = text.lower().split()
    n = max(1, min(n, len(words)))
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words] or [1]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(starts) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)], np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """``BANDS`` keys, each made of the least of the set's hashes under ``ROWS`` orders.

    Two sets of Jaccard similarity s share a key with probability s ** ROWS; of pairs at
    0.8 all but 1 in 60,000 share one of 28.
    """
    low, small = np.full(BANDS * ROWS, 2**32 - 1, np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    for first in range(0, len(small), 4096):
        low = np.minimum(low, (small[None, first : first + 4096] * _FACTORS).min(axis=1))
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in low.reshape(BANDS, ROWS).T.astype(np.uint64):
        keys = (keys ^ row) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def wide_print(hashes: np.ndarray) -> np.ndarray:
    """SimHash of ``LANES * 64`` bits of a shingle set."""
    lanes = []
    for i in range(LANES):
        mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15 + 2 * i * 0x632BE5A6)
        mixed ^= mixed >> np.uint64(32)
        bits = np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        lanes.append(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes), bitorder="little"))
    return np.concatenate(lanes).view(np.uint64)


def packed(hashes: np.ndarray) -> bytes:
    """Fingerprint and shingle set."""
    return wide_print(hashes).tobytes() + hashes.tobytes()


def _unpacked(rows: list) -> tuple[np.ndarray, list[np.ndarray]]:
    """Fingerprints and shingle sets of packed texts."""
    prints = np.frombuffer(b"".join(bytes(x[:_HEAD]) for x in rows), np.uint64).reshape(len(rows), LANES)
    return prints, [np.frombuffer(x, np.uint64, offset=_HEAD) for x in rows]


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int16)


def most_bits(similarity: float) -> int:
    """Differing bits of two texts of that Jaccard similarity, ``DEVIATIONS`` above the mean."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(LANES * 64 * share + DEVIATIONS * np.sqrt(LANES * 64 * share * (1 - share)))


def _within(prints: np.ndarray, x: np.ndarray, y: np.ndarray, limit: int) -> np.ndarray:
    """Which pairs of ``x`` and ``y`` (places in ``prints``) are within ``limit`` bits.

    Texts spread over the family are the references; a pair is discarded where its distances
    to one of them differ by more than ``limit``, and the bits of what is left are compared.
    """
    references = prints[np.linspace(0, len(prints) - 1, min(REFERENCES, len(prints))).astype(int)]
    table = _distances(prints[:, None], references[None])
    out, of_y = np.zeros((len(x), len(y)), bool), table[y]
    for i, k in enumerate(x.tolist()):
        out[i] = np.abs(of_y - table[k]).max(axis=1) <= limit
        left = np.flatnonzero(out[i])
        out[i, left] = _distances(prints[y[left]], prints[k]) <= limit
    return out


_SIGNED = pa.schema([("doc_id", pa.int64()), ("text_p", pa.int64()), ("text_q", pa.int64()), ("digest", pa.binary()), ("keys", pa.list_(pa.int64()))])


#: What tells rows apart: doc_id and 128 bits of the text.
_ROW = ("doc_id", "text_p", "text_q")


def _signatures(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, n) for t in utf8(batch.column("text"))]
            keys = pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * BANDS, np.concatenate([band_keys(x) for x in sets] or [np.zeros(0, np.int64)]))
            yield batch_of(_SIGNED, *(batch.column(c) for c in _ROW), [xxhash.xxh3_128_digest(x.tobytes(), SEED) for x in sets], keys)

    return run


def _packed_texts(n: int):
    schema = pa.schema([("digest", pa.binary()), ("packed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, n) for t in utf8(batch.column("text"))]
            yield batch_of(schema, [xxhash.xxh3_128_digest(x.tobytes(), SEED) for x in sets], [packed(x) for x in sets])

    return run


def _compared(similarity: float):
    """Of rows (a, b, of_a, of_b) those that may be of one family, and whether they are linked.

    One of the two is the reference of its bucket.  A pair is discarded by its bits at the least similarity of
    two texts that are both like a third one; what is left is compared by its sets.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_())])
    limit = most_bits(max(2 * similarity - 1, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (_unpacked([v.as_buffer() for v in batch.column(c)]) for c in ("of_a", "of_b"))
            small = np.array([min(len(s), len(t)) < SMALL_SET for s, t in zip(x[1], y[1], strict=True)])
            near = np.flatnonzero(small | (_distances(x[0], y[0]) <= limit))
            linked = []
            for i in near.tolist():
                s, t = x[1][i], y[1][i]
                common = len(np.intersect1d(s, t, assume_unique=True)) if min(len(s), len(t)) >= similarity * max(len(s), len(t)) - 1e-9 else 0
                linked.append(common > 0 and common >= similarity * (len(s) + len(t) - common) - 1e-9)
            yield batch_of(schema, batch.column("a").take(pa.array(near)), batch.column("b").take(pa.array(near)), linked)

    return run


def looked_up(edges: DataFrame, texts: DataFrame, compare: Callable, keep: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """a, b, linked of the edges (a, b) that ``compare`` gives out; ``texts`` has node, packed.

    A text with many links is looked up in parts of ``LINKS_A_TASK`` links, each with its
    own copy of the text, so no task holds all links of one text.
    """
    parts = edges.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / LINKS_A_TASK).cast("int").alias("parts"))
    copies = texts.join(parts, texts.node == parts.a).select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("packed").alias("of_a"))
    keyed = edges.join(parts, "a").select("a", "b", F.pmod(F.hash("b"), F.col("parts")).alias("part"))
    pairs = keyed.join(texts.select(F.col("node").alias("b"), F.col("packed").alias("of_b")), "b").join(copies, ["a", "part"])
    return keep(pairs.select("a", "b", "of_a", "of_b").mapInArrow(compare, "a long, b long, linked boolean"))


def _looked_up(edges: DataFrame, texts: DataFrame, similarity: float, keep: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """:func:`looked_up` by bits, then shingle sets."""
    return looked_up(edges, texts, _compared(similarity), keep)


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of ``left`` shares with each of ``right``."""
    out = np.zeros((len(left), len(right)), np.float32)
    shared = np.intersect1d(np.concatenate(left), np.concatenate(right))
    flat = []
    for sets in (left, right):
        row, value = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets)
        at = np.minimum(np.searchsorted(shared, value), max(len(shared) - 1, 0))
        known = shared[at] == value if len(shared) else np.zeros(len(value), bool)
        order = np.argsort(at[known], kind="stable")
        flat.append((row[known][order], at[known][order]))
    for first in range(0, len(shared), COLUMNS):
        width, tables = min(COLUMNS, len(shared) - first), []
        for (row, at), sets in zip(flat, (left, right), strict=True):
            a, b = np.searchsorted(at, (first, first + width))
            table = np.zeros((len(sets), width), np.float32)
            table[row[a:b], at[a:b] - first] = 1
            tables.append(table)
        out += tables[0] @ tables[1].T
    return out


def _joined(similarity: float):
    """Links (a, b) between the groups of two blocks of a family.

    Distances to references and bits discard pairs; the sets of the rest are counted together.
    """
    limit = most_bits(similarity)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        _, p, q = (x.as_py() for x in key)
        node, group, block = (np.asarray(table.column(c)) for c in ("node", "group", "block"))
        prints, sets = _unpacked(table.column("packed").to_pylist())
        size = np.array([len(s) for s in sets], np.float64)
        x, y = np.flatnonzero(block == p), np.flatnonzero(block == q)
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(x) and len(y):
            apart = group[x][:, None] != group[y][None, :]
            near = ((np.minimum(size[x][:, None], size[y][None, :]) < SMALL_SET) | _within(prints, x, y, limit)) & apart
            rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
            if len(rows):
                x, y, near = x[rows], y[columns], near[np.ix_(rows, columns)]
                common = overlaps([sets[i] for i in x], [sets[i] for i in y])
                like = near & (common > 0) & (common >= similarity * (size[x][:, None] + size[y][None, :] - common) - 1e-9)
                i, j = np.nonzero(like)
                # one link of two groups is enough
                _, at = np.unique(np.stack([np.minimum(group[x[i]], group[y[j]]), np.maximum(group[x[i]], group[y[j]])]), axis=1, return_index=True)
                a, b = node[x[i[at]]], node[y[j[at]]]
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def linked_in_families(seen: DataFrame, texts: DataFrame, join: Callable, keep: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """Links that ``join`` finds between the groups within each family, a component of the pairs looked at.

    A bucket's texts are looked at against one of them only.  Where not all of a
    family are linked that way, its largest group is the core and the others
    are outsiders: they are dealt to blocks, and each block of outsiders meets each block of
    the family in a task.  Pairs inside the core are never looked at.
    """
    families = components(seen.select("a", "b"), keep).select(F.col("node").alias("of"), F.col("root").alias("family"))
    families = families.union(families.select("family", "family").distinct())
    groups = components(seen.where("linked").select("a", "b"), keep).select(F.col("node").alias("in_group"), F.col("root").alias("group"))
    members = keep(families.join(groups, families.of == groups.in_group, "left").select("family", F.col("of").alias("node"), F.coalesce("group", "of").alias("group")))
    counts = members.groupBy("family", "group").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("family").agg(F.sum("n").alias("n"), F.max(F.struct("n", "group")).alias("core"))
    sizes = sizes.where("n > 2 and n > core.n").select("family", F.col("core.group").alias("core"), F.col("core.n").alias("n_core"), "n")
    block = F.greatest(F.lit(BLOCK), F.least(F.lit(LARGEST_BLOCK), F.ceil(F.col("n") / BLOCKS)))
    sizes = sizes.select("family", "core", F.ceil((F.col("n") - F.col("n_core")) / block).cast("int").alias("outer"), F.ceil(F.col("n_core") / block).cast("int").alias("inner"))
    rest = members.join(sizes, "family").withColumn("is_core", F.col("group") == F.col("core")).withColumn("turn", F.xxhash64("node"))
    rest = rest.withColumn("block", F.when(F.col("is_core"), F.col("outer") + F.pmod("turn", "inner")).otherwise(F.pmod("turn", "outer")).cast("int"))
    rest = rest.join(texts, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("outer") - 1 + F.when(F.col("is_core"), 0).otherwise(F.col("inner")))))
    pairs = rest.select("family", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "node", "group", "packed")
    return keep(pairs.groupBy("family", "p", "q").applyInArrow(join, "a long, b long"))


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = SIMILARITY, keep: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """doc_id, component_id: groups of texts linked by a Jaccard similarity of ``similarity``.

    Texts with a Jaccard similarity of 0.8 differ in 15 % of their SimHash bits, so 64 bits
    within 4 miss most of them, and sections of the bits that such pairs share are too
    short to tell texts apart.  Here pairs meet by least shingle hashes (:func:`band_keys`); each text
    is looked at against one text of each bucket, and families that this leaves in several
    groups are compared block by block.  There the fingerprints of texts of the family are the references: a pair is discarded
    by the largest difference of its distances to them, then by the bits of the 256-bit
    fingerprints themselves, and verified on the shingle sets.  Texts with equal sets are
    one node, so copies are never compared with each other.
    Null and empty texts are one group; component_id is the smallest doc_id of a group
    (null if none has one); repeated rows are members each.  ``keep`` writes what later steps build on.
    """
    return _grouped(docs, shingle, similarity, keep).select("doc_id", "component_id")


def _with_row_keys(docs: DataFrame) -> DataFrame:
    """doc_id, text and the rest of ``_ROW``."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(doc_id.alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_p"), F.xxhash64(F.lit(1), text).alias("text_q"))


def _grouped(docs: DataFrame, shingle: int, similarity: float, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``_ROW``, group (a number) and component_id for each row of ``docs``."""
    bounded_batches(docs.sparkSession)
    docs = _with_row_keys(docs)
    prints = keep(docs.mapInArrow(_signatures(shingle), "doc_id long, text_p long, text_q long, digest binary, keys array<long>"))
    nodes = prints.groupBy("digest").agg(F.min("doc_id").alias("first"), F.first("keys").alias("keys"))
    nodes = keep(nodes.withColumn("node", F.monotonically_increasing_id()))
    dealt = nodes.select(F.explode("keys").alias("key"), "node")
    shared = dealt.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key", "low")
    edges = dealt.join(shared, "key").where("low < node").select(F.col("low").alias("a"), F.col("node").alias("b"))
    edges = keep(edges.distinct())

    ends = edges.select(F.explode(F.array("a", "b")).alias("end")).distinct()
    named = keep(nodes.join(ends, nodes.node == ends.end, "left_semi").select("node", "first", F.col("digest").alias("of_digest")))
    of_ids = size_checked(keep(named.select(F.col("first").alias("of_id")).distinct()))
    texts = docs.join(of_ids, docs.doc_id.eqNullSafe(of_ids.of_id), "left_semi").mapInArrow(_packed_texts(shingle), "digest binary, packed binary")
    texts = keep(texts.join(named, texts.digest == named.of_digest).select("node", "packed").dropDuplicates(["node"]))
    seen = _looked_up(edges, texts, similarity, keep)
    found = seen.where("linked").select("a", "b").union(linked_in_families(seen, texts, _joined(similarity), keep))

    roots = components(found, keep).withColumnRenamed("node", "in_root")
    nodes = nodes.join(roots, nodes.node == roots.in_root, "left").select("digest", "first", F.coalesce("root", "node").alias("root"))
    least = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    groups = nodes.join(least, "root").select(F.col("digest").alias("group_digest"), F.col("root").alias("group"), "component_id")
    return prints.join(groups, prints.digest == groups.group_digest).select(*_ROW, "group", "component_id")


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """One row of ``docs`` for each group of similar texts.

    It is the row with the smallest doc_id; of several with that doc_id, that whose text has the
    smallest hash, and of rows equal in both any one.  A row with a null doc_id stays only where
    no member of its group has one.  Null, empty and blank texts are one group.
    """
    scratch = Scratch(docs.sparkSession)
    try:
        rows = _grouped(docs, shingle, similarity, scratch.keep)
        rows = scratch.keep(rows.groupBy("group", *_ROW).agg(F.count(F.lit(1)).alias("n")))
        order = F.struct(F.col("doc_id").isNull().alias("unnumbered"), *_ROW)
        chosen = rows.groupBy("group").agg(F.min_by(F.struct(*_ROW, "n"), order).alias("row")).select("group", "row.*")
        chosen = chosen.select(F.col("group").alias("chosen_group"), *(F.col(c).alias(f"chosen_{c}") for c in _ROW), "n")
        same = [rows["group"] == chosen["chosen_group"], *(rows[c].eqNullSafe(chosen[f"chosen_{c}"]) for c in _ROW)]
        gone = rows.join(chosen, reduce(and_, same), "left_anti").select(*(F.col(c).alias(f"gone_{c}") for c in _ROW))
        gone = cut_lineage(gone)
        repeated = cut_lineage(chosen.where("n > 1").select(*(F.col(f"chosen_{c}").alias(f"gone_{c}") for c in _ROW)))
    finally:
        scratch.drop()
    keys = [private(docs, c) for c in _ROW]
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    keyed = docs.withColumns(dict(zip(keys, (doc_id, F.xxhash64(text), F.xxhash64(F.lit(1), text)), strict=True)))

    def met(table: DataFrame, how: str) -> DataFrame:
        return keyed.join(size_checked(table), reduce(and_, (keyed[k].eqNullSafe(table[f"gone_{c}"]) for k, c in zip(keys, _ROW, strict=True))), how)

    if repeated.isEmpty():
        return met(gone, "left_anti").drop(*keys)
    once = met(repeated, "left_semi").dropDuplicates(keys)
    return met(gone.union(repeated), "left_anti").unionByName(once).drop(*keys)
