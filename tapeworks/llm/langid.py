"""Language identification by prediction by partial matching (PPM).

Each language has a byte context tree of orders 0 to 3.  The probability of a byte comes
from the longest context that was seen with it; each shorter step costs the escape
probability of the longer context, q / (n + q) for n bytes of q kinds (method C, with
exclusion).  Statistics are frozen after training, so a byte's exact code length depends
on itself and the three bytes before it only.  The trees of all languages share one set of
hash tables of the byte sequences seen: a sequence has its code length in each language, and
a context the cost of escaping from it.  The language with the shortest code wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, slices, bounded_batches, utf8

#: Bound of the sample that trains: about so many different labelled texts a language.
TRAIN_ROWS = 2000
ORDER = 3
#: Code lengths that one vectorised step holds.
STEP = 1 << 20
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def _folded() -> np.ndarray:
    """Byte to byte: A-Z lower, digits one class, other ASCII white space."""
    fold = np.arange(256, dtype=np.uint8)
    fold[:128] = 32
    fold[97:123] = np.arange(97, 123)
    fold[65:91] = np.arange(97, 123)
    fold[48:58] = 48
    return fold


_FOLD = _folded()


def held_out(doc_id: str = "doc_id") -> Column:
    """True for rows that training must not see: crc32 of doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes of ``texts``, each after three spaces, and where each text starts."""
    data = _FOLD[np.frombuffer(b"   " + b"   ".join(texts), np.uint8)]
    starts = np.cumsum([3] + [len(t) + 3 for t in texts[:-1]])
    return data, starts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
    for batch in batches:
        by_lang: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), utf8(batch.column("text")), strict=True):
            by_lang.setdefault(lang, []).append(text)
        for lang, texts in by_lang.items():
            for a, b in slices(texts):
                d = _grams(texts[a:b])[0].astype(np.int64)
                gram, n = np.unique(d[:-3] << 24 | d[1:-2] << 16 | d[2:-1] << 8 | d[3:], return_counts=True)
                yield batch_of(schema, [lang] * len(gram), gram, n)


def _hashed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """An open hash table of distinct 32-bit keys: keys and their places by slot, and the shift."""
    shift = 31 - int(len(keys)).bit_length()
    slot = (keys.astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(shift)
    order = np.argsort(slot, kind="stable")
    at = np.arange(len(keys)) + np.maximum.accumulate(slot[order].astype(np.int64) - np.arange(len(keys)))
    held, place = np.zeros(max(1 << (32 - shift), int(at[-1]) + 1 if len(at) else 0) + 1, np.uint32), None
    place = np.full(len(held), -1, np.int32)
    held[at], place[at] = keys[order], order
    return held, place, shift


def _find(table: tuple[np.ndarray, np.ndarray, int], keys: np.ndarray) -> np.ndarray:
    """The place of each key, -1 where there is none."""
    held, place, shift = table
    slot = ((keys * np.uint32(0x9E3779B1)) >> np.uint32(shift)).astype(np.int64)
    out = place[slot]
    left = np.flatnonzero((held[slot] != keys) & (out >= 0))
    while len(left):
        slot[left] += 1
        out[left] = place[slot[left]]
        left = left[(held[slot[left]] != keys[left]) & (out[left] >= 0)]
    return out


class Model:
    """Frozen context trees of several languages.

    Level k has the sequences of k + 1 bytes seen in any language: ``bits`` is a
    sequence's code length of its last byte after the others, ``back`` the cost of escaping from
    it as a context.  A sequence that no language has seen costs the escape of its
    context (nothing where the context itself is new) and the code of its last k bytes.
    """

    def __init__(self, langs: list[str], grams: np.ndarray, counts: np.ndarray, owners: np.ndarray):
        self.langs = langs
        keys = [np.unique(grams)]
        for k in range(ORDER, 0, -1):
            keys.insert(0, np.unique(np.concatenate([keys[0] & ((1 << 8 * k) - 1), keys[0] >> 8])))
        suffix = [np.searchsorted(keys[k - 1], keys[k] & ((1 << 8 * k) - 1)) for k in range(1, ORDER + 1)]
        context = [np.searchsorted(keys[k - 1], keys[k] >> 8) for k in range(1, ORDER + 1)]
        self.bits = [np.empty((len(x), len(langs)), np.float32) for x in keys]
        self.back = [np.zeros((len(x), len(langs)), np.float32) for x in keys[:-1]]
        self.new_byte = np.empty(len(langs), np.float32)
        for lang in range(len(langs)):
            mine = owners == lang
            seen = [np.bincount(np.searchsorted(keys[-1], grams[mine]), weights=counts[mine], minlength=len(keys[-1]))]
            for k in range(ORDER, 0, -1):
                seen.insert(0, np.bincount(suffix[k - 1], weights=seen[0], minlength=len(keys[k - 1])))
            for k, n in enumerate(seen):
                of = context[k - 1] if k else np.zeros(len(n), np.int64)
                size = len(keys[k - 1]) if k else 1
                lower = self.bits[k - 1][suffix[k - 1], lang].astype(np.float64) if k else np.full(len(n), 8.0)
                total, kinds, taken = (np.bincount(of, weights=w, minlength=size) for w in (n, n > 0, (n > 0) * np.exp2(-lower)))
                with np.errstate(divide="ignore", invalid="ignore"):
                    escape = np.where(total > 0, -np.log2(kinds / (total + kinds) / np.maximum(1 - taken, 1e-6)), 0)
                    own = np.where(n > 0, -np.log2(n / (total + kinds)[of]), escape[of] + lower)
                self.bits[k][:, lang] = own
                if k:
                    self.back[k - 1][:, lang] = escape
                else:
                    self.new_byte[lang] = escape[0] + 8
        self.tables = [_hashed(x) for x in keys]

    def code(self, keys: np.ndarray, level: int = ORDER) -> np.ndarray:
        """Code length of the last byte of each sequence of ``level`` + 1 bytes, in each language."""
        at = _find(self.tables[level], keys)
        out = self.bits[level][at]
        new = np.flatnonzero(at < 0)
        if len(new) and level:
            context = _find(self.tables[level - 1], keys[new] >> np.uint32(8))
            escape = self.back[level - 1][context]
            escape[context < 0] = 0
            out[new] = escape + self.code(keys[new] & np.uint32((1 << 8 * level) - 1), level - 1)
        elif len(new):
            out[new] = self.new_byte
        return out

    def totals(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text in each language."""
        data, starts = _grams(texts)
        ends = starts + np.array([len(t) for t in texts])
        d = data.astype(np.uint32)
        sums = np.zeros((len(texts), len(self.langs)))
        step = max(4096, STEP // len(self.langs))
        for first in range(3, len(d), step):
            last = min(first + step, len(d))
            key = d[first - 3 : last - 3] << 24 | d[first - 2 : last - 2] << 16 | d[first - 1 : last - 1] << 8 | d[first:last]
            upto = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(self.code(key), axis=0, dtype=np.float64)])
            a, b = np.searchsorted(ends, first, side="right"), np.searchsorted(starts, last, side="left")
            sums[a:b] += upto[np.clip(ends[a:b] - first, 0, last - first)] - upto[np.clip(starts[a:b] - first, 0, last - first)]
        return sums


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """Context trees from labelled rows that are not held out; None without such rows.

    About ``rows`` different texts of each language are taken by their hash, all if there
    are fewer; equal texts of a language count once.  What reaches the driver is one row a
    language, and the counts of this sample.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(held_out().alias("held"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    docs = docs.where(~F.col("held") & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("text").alias("h"))
    totals = docs.groupBy("lang").agg(F.approx_count_distinct("h").alias("texts")).collect()
    if not totals:
        return None
    rates = spark.createDataFrame([(r["lang"], min(1.0, rows / r["texts"])) for r in totals], "lang string, rate double")
    docs = docs.join(F.broadcast(rates), "lang").where(F.pmod("h", F.lit(1_000_000)) < F.col("rate") * 1_000_000)
    docs = docs.groupBy("lang", "h", F.xxhash64(F.lit(1), "text").alias("h2")).agg(F.first("text").alias("text"))
    counts = docs.select("lang", "text").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = counts.toArrow().combine_chunks()
    langs = sorted(r["lang"] for r in totals)
    owner = np.asarray(pc.index_in(found.column("lang"), pa.array(langs)), np.int64)
    return Model(langs, np.asarray(found.column("gram")), np.asarray(found.column("n"), np.float64), owner)


def score_texts(model: Model | None, texts: list[bytes]) -> tuple[list[str], list[float]]:
    """The language of each text and its probability."""
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if model is None:
        return langs, scores
    for a, b in slices(texts):
        sums = model.totals(texts[a:b])
        best = sums.argmin(axis=1)
        share = 1 / np.exp2(-np.minimum(sums - sums.min(axis=1, keepdims=True), 1000)).sum(axis=1)
        for i in range(a, b):
            if _LETTER.search(texts[i].decode("utf-8", "replace")) is not None:
                langs[i], scores[i] = model.langs[best[i - a]], float(share[i - a])
    return langs, scores


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs``; looks at the text only.

    score is the probability of the language among those learned, each as likely before.
    Null texts and those without a letter are ``und`` with score 0, and all are if there is
    no model; repeated rows get equal answers; a null doc_id stays null, not held out.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    held = spark.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = score_texts(held.value, utf8(batch.column("text")))
            yield batch_of(schema, batch.column("doc_id"), batch.column("held_out"), langs, scores)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """:func:`predict` by a model trained on ``docs``' own labelled rows."""
    return predict(docs, train(docs))


def keep_identified(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known with ``least_score`` at least.

    Null texts and texts without letters go; where no row is labelled, nothing can be
    learned and every row with a letter stays.
    """
    model = train(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = score_texts(held.value, utf8(batch.column("text")))
            yield batch.filter(pa.array([lang != UNKNOWN and s >= least_score for lang, s in zip(langs, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
