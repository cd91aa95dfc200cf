"""Near-duplicate groups by MinHash and a join of inverted lists over signature coordinates.

A text's signature has a least hash for each of ``COORDINATES`` orders of its shingles; two
texts of Jaccard similarity s agree in a coordinate with probability s.  Each text is
posted under its (coordinate, value) pairs, and texts that collide in ``least_matches`` of them
or more are looked at.  Such pairs are found with prefixes: of a text's values, ordered
from rare to frequent, all but the last ``least_matches - 1`` are its prefix, and two texts with that many
collisions share a value within their prefixes.  So the most frequent values (common passages,
templates) post no lists unless a text has hardly anything else; values that no other text
has are skipped altogether.  Inside a list collisions are counted on part of the
signatures first and on the rest where the threshold can still be met.

A list gives out a spanning forest of its pairs above the threshold, never all of them.  The forests make families;
of each text the pairs with most collisions are verified on the full sets, and where that leaves a family in
several groups, the groups are compared with each other block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, batch_of, bounded_batches, cut_lineage, size_checked, utf8
from .simhash import SEED, components, linked_in_families, looked_up, overlaps, shingle_set

SHINGLE, PERCENT, COORDINATES = 3, 85, 64
#: Chance at most that a pair of the least similarity collides too seldom to be looked at.
MISSED = 1e-6
#: Coordinates that are compared before the rest of a signature is.
FIRST = 32
#: Candidates of each text that are verified before families are compared as a whole.
BEST = 3
#: Texts of one list that meet in one task; longer lists are dealt in chunks, and chunk meets chunk.
CHUNK = 4096
_FACTORS = np.random.default_rng(13).integers(0, 2**63, (COORDINATES, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TURNS = np.random.default_rng(31).integers(0, 2**63, COORDINATES, dtype=np.uint64)
#: Bytes of a packed text before its shingles: 32 bits of each coordinate.
_HEAD = COORDINATES * 4


def least_matches(percent: int = PERCENT, missed: float = MISSED) -> int:
    """The most collisions that all but ``missed`` of pairs at ``percent`` similarity have."""
    s, below = percent / 100, 0.0
    for t in range(COORDINATES + 1):
        below += math.comb(COORDINATES, t) * s**t * (1 - s) ** (COORDINATES - t)
        if below > missed:
            return t
    return COORDINATES


def word_set(text: bytes, n: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles of ``text``; no words: none."""
    return shingle_set(text, n) if text.split(None, 1) else np.zeros(0, np.uint64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """A 64-bit value for each coordinate, whose last bits tell the coordinate."""
    low = np.full(COORDINATES, 2**64 - 1, np.uint64)
    for first in range(0, len(hashes), 4096):
        low = np.minimum(low, (hashes[None, first : first + 4096] * _FACTORS).min(axis=1))
    low = (low ^ _TURNS) * np.uint64(0x9E3779B97F4A7C15)
    low ^= low >> np.uint64(32)
    return (low & ~np.uint64(COORDINATES - 1)) | np.arange(COORDINATES, dtype=np.uint64)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("keys", pa.list_(pa.int64()))])
_POSTED = pa.schema([("key", pa.int64()), ("p", pa.int32()), ("q", pa.int32()), ("node", pa.int64()), ("sig", pa.binary())])
_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("matches", pa.int32())])


def _signed(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [word_set(t, n) for t in utf8(batch.column("text"))]
            digests = [xxhash.xxh3_128_digest(s.tobytes(), SEED) if len(s) else None for s in sets]
            yield batch_of(_SIGNED, batch.column("doc_id"), [len(s) for s in sets], digests, [signature(s).view(np.int64) if len(s) else None for s in sets])

    return run


def _packed(n: int):
    schema = pa.schema([("digest", pa.binary()), ("packed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for t in utf8(batch.column("text")) if len(s := word_set(t, n))]
            yield batch_of(schema, [xxhash.xxh3_128_digest(s.tobytes(), SEED) for s in sets], [signature(s).astype(np.uint32).tobytes() + s.tobytes() for s in sets])

    return run


def _unpacked(rows: list) -> tuple[np.ndarray, list[np.ndarray]]:
    """Signatures and shingle sets of packed texts."""
    heads = np.frombuffer(b"".join(bytes(x[:_HEAD]) for x in rows), np.uint32).reshape(len(rows), COORDINATES)
    return heads, [np.frombuffer(x, np.uint64, offset=_HEAD) for x in rows]


def colliding(own: np.ndarray, others: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of those ``others`` that agree with ``own`` in ``least`` coordinates, and in how many; 0 agrees with nothing.

    A signature that the first coordinates have left too far behind is skipped.
    """
    known = own != 0
    n = ((others[:, :FIRST] == own[:FIRST]) & known[:FIRST]).sum(axis=1)
    at = np.flatnonzero(n >= least - (COORDINATES - FIRST))
    n = n[at] + ((others[at, FIRST:] == own[FIRST:]) & known[FIRST:]).sum(axis=1)
    return at[n >= least], n[n >= least]


def forest(signatures: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Edges (and their collisions) that connect what collisions connect within one list, fewer than its members."""
    edges, left = [], np.arange(len(signatures))
    while len(left):
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            i = stack.pop()
            at, n = colliding(signatures[i], signatures[left], least)
            edges += [(i, j, m) for j, m in zip(left[at].tolist(), n.tolist(), strict=True)]
            stack += left[at].tolist()
            left = np.delete(left, at)
    return edges


def _dealt(chunk: int, least: int):
    """A row for each list that a text's prefix posts it to, with the part of the signature that others share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists, node = batch.column("shared"), np.asarray(batch.column("node"))
            sizes = np.asarray(lists.value_lengths())
            flat = lists.flatten()
            n, key = np.asarray(flat.field("n")), np.asarray(flat.field("key"))
            row = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            table = np.zeros((len(sizes), COORDINATES), np.uint32)
            table[row, key & (COORDINATES - 1)] = key.astype(np.uint32)
            at = np.flatnonzero(place <= sizes[row] - least)  # the prefix
            parts = -(-n[at] // chunk)
            other = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            at, parts = np.repeat(at, parts), np.repeat(parts, parts)
            turn = (node[row[at]].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            own = turn.astype(np.int64) % parts
            packed = pa.array([x.tobytes() for x in table], pa.binary()).take(pa.array(row[at]))
            yield batch_of(_POSTED, key[at], np.minimum(own, other), np.maximum(own, other), node[row[at]], packed)

    return run


def _listed(least: int, small: int = 16):
    """Edges (a, b) of each list and their collisions; lists come one after another."""

    def of(heads: np.ndarray, node: np.ndarray, sig: np.ndarray) -> pa.RecordBatch | None:
        sizes = np.diff(np.append(heads, len(node)))
        number = np.repeat(np.arange(len(heads)), sizes)
        inside, left, right, matches = np.repeat(sizes <= small, sizes), [], [], []
        for step in range(1, small):
            at = np.flatnonzero((number[step:] == number[:-step]) & inside[step:])
            if not len(at):
                break
            n = ((sig[at] == sig[at + step]) & (sig[at] != 0)).sum(axis=1)
            left.append(at[n >= least])
            right.append(left[-1] + step)
            matches.append(n[n >= least])
        for head, size in zip(heads[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
            found = np.array(forest(sig[head : head + size], least), np.int64).reshape(-1, 3)
            left.append(found[:, 0] + head)
            right.append(found[:, 1] + head)
            matches.append(found[:, 2])
        if not left:
            return None
        x, y = (node[np.concatenate(z)] for z in (left, right))
        return batch_of(_EDGE, np.minimum(x, y), np.maximum(x, y), np.concatenate(matches))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("key", "p", "q")], axis=1)
            new = (lists, np.asarray(batch.column("node")), np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, COORDINATES))
            held = new if held is None else tuple(np.concatenate(x) for x in zip(held, new, strict=True))
            heads = np.flatnonzero(np.concatenate(([True], (held[0][1:] != held[0][:-1]).any(axis=1))))
            last = int(heads[-1])  # the last list may go on
            if last and (out := of(heads[:-1], held[1][:last], held[2][:last])) is not None:
                yield out
            held = tuple(x[last:] for x in held)
        if held is not None and (out := of(np.zeros(1, np.int64), *held[1:])) is not None:
            yield out

    return run


def candidates(nodes: DataFrame, least: int, chunk: int = CHUNK) -> DataFrame:
    """a, b, matches: edges a < b between nodes (node, keys) that connect all pairs with ``least`` collisions."""
    tokens = nodes.select("node", F.explode("keys").alias("key"))
    counts = tokens.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")  # summed before it moves
    shared = tokens.join(counts, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("shared"))
    posted = shared.where(F.size("shared") >= least).mapInArrow(_dealt(chunk, least), "key long, p int, q int, node long, sig binary")
    lists = posted.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "node")
    return lists.mapInArrow(_listed(least), "a long, b long, matches int").distinct()


def _alike(common: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of ``x`` and ``y`` shingles with ``common`` ones are that similar, in whole numbers."""
    common = np.asarray(common).astype(np.int64)
    return (common > 0) & (100 * common >= percent * (x + y - common))


def _compared(percent: int):
    """Rows (a, b, of_a, of_b) with whether the full sets are linked."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (_unpacked([v.as_buffer() for v in batch.column(c)])[1] for c in ("of_a", "of_b"))
            common = [len(np.intersect1d(s, t, assume_unique=True)) if 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)) else 0 for s, t in zip(x, y, strict=True)]
            sizes = (np.array([len(s) for s in z], np.int64) for z in (x, y))
            yield batch_of(schema, batch.column("a"), batch.column("b"), _alike(np.array(common, np.int64), *sizes, percent))

    return run


def _joined(percent: int, least: int):
    """Links (a, b) between the groups of two blocks of a family: collisions, then the full sets."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        _, p, q = (x.as_py() for x in key)
        node, group, block = (np.asarray(table.column(c)) for c in ("node", "group", "block"))
        signatures, sets = _unpacked(table.column("packed").to_pylist())
        size = np.array([len(s) for s in sets], np.int64)
        x, y = np.flatnonzero(block == p), np.flatnonzero(block == q)
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        near = np.zeros((len(x), len(y)), bool)
        for i, k in enumerate(x.tolist()):
            apart = np.flatnonzero(group[y] != group[k])
            near[i, apart[colliding(signatures[k], signatures[y[apart]], least)[0]]] = True
        rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        if len(rows):
            x, y, near = x[rows], y[columns], near[np.ix_(rows, columns)]
            like = near & _alike(overlaps([sets[i] for i in x], [sets[i] for i in y]), size[x][:, None], size[y][None, :], percent)
            i, j = np.nonzero(like)
            # one link of two groups is enough
            _, at = np.unique(np.stack([np.minimum(group[x[i]], group[y[j]]), np.maximum(group[x[i]], group[y[j]])]), axis=1, return_index=True)
            a, b = node[x[i[at]]], node[y[j[at]]]
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``.

    Texts whose sets of distinct shingles have a Jaccard similarity of ``percent`` / 100 at least are linked;
    component_id is the smallest doc_id that links lead to, and kept says whether it is the row's own.
    A text of fewer words is one shingle; null, empty and blank texts have none and are their own
    component.  Rows with equal sets are one node, so copies are never compared; repeated
    rows are members each.  Null doc_ids are passed over (null only if no member has one).
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    scratch = Scratch(docs.sparkSession)
    try:
        return cut_lineage(_grouped(docs, shingle, percent, chunk, scratch))
    finally:
        scratch.drop()


def _grouped(docs: DataFrame, shingle: int, percent: int, chunk: int, scratch: Scratch) -> DataFrame:
    """:func:`near_duplicates`; ``scratch`` keeps what later steps build on."""
    keep = scratch.keep
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = keep(docs.mapInArrow(_signed(shingle), "doc_id long, n_shingles long, digest binary, keys array<long>"))
    nodes = signed.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("first"), F.first("keys").alias("keys"))
    nodes = keep(nodes.withColumn("node", F.monotonically_increasing_id()))
    whole, signed = signed, keep(signed.drop("keys"))
    scratch.release(whole)  # nodes have the keys
    least = least_matches(percent)
    edges = keep(candidates(nodes, least, chunk))

    ends = edges.select(F.explode(F.array("a", "b")).alias("end")).distinct()
    named = keep(nodes.join(ends, nodes.node == ends.end, "left_semi").select("node", "first", F.col("digest").alias("of_digest")))
    of_ids = size_checked(keep(named.select(F.col("first").alias("of_id")).distinct()))
    texts = docs.join(of_ids, docs.doc_id.eqNullSafe(of_ids.of_id), "left_semi").mapInArrow(_packed(shingle), "digest binary, packed binary")
    texts = keep(texts.join(named, texts.digest == named.of_digest).select("node", "packed").dropDuplicates(["node"]))
    # each text's best candidates are verified first; all candidates make families, whose groups are compared next
    both = edges.select("a", "b", "matches", F.col("a").alias("of")).union(edges.select("a", "b", "matches", F.col("b")))
    best = Window.partitionBy("of").orderBy(F.desc("matches"), F.xxhash64("a", "b"))
    likely = keep(both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= BEST).select("a", "b").distinct())
    seen = looked_up(likely, texts, _compared(percent), keep)
    seen = seen.union(edges.select("a", "b", F.lit(False)))
    found = seen.where("linked").select("a", "b").union(linked_in_families(seen, texts, _joined(percent, least), keep))

    roots = components(found, keep).withColumnRenamed("node", "in_root")
    nodes = nodes.join(roots, nodes.node == roots.in_root, "left").select("digest", "first", F.coalesce("root", "node").alias("root"))
    smallest = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    groups = nodes.join(smallest, "root").select(F.col("digest").alias("group_digest"), F.col("component_id").alias("group_id"))
    out = signed.join(groups, signed.digest == groups.group_digest, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("group_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
