"""Which of many phrases a text holds, by one walk over it.

The phrases become an Aho-Corasick automaton: a trie whose missing edges follow the longest
proper suffix that is a trie path, written out as one table (state, kind of byte) -> state, and
the phrases that end in each state.  A worker walks a batch of texts together: they are cut into windows
of equal length that overlap by the longest phrase, and all windows take their next
byte in one step, so the cost is a table look-up a byte whatever the number of phrases.
"""

from __future__ import annotations

from collections import deque
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import bounded_batches

#: Bytes of a window, and of the windows that one walk takes together.
WINDOW, TOGETHER = 512, 8 << 20


class Automaton:
    """Finds which of ``phrases`` (not empty) occur in texts, compared byte by byte."""

    def __init__(self, phrases: tuple[str, ...]):
        coded = [p.encode() for p in phrases]
        if not all(coded):
            raise ValueError("a phrase must not be empty")
        self.longest = max(map(len, coded), default=1)
        used = sorted(set(b"".join(coded)))
        self.kinds = np.zeros(256, np.int32)  # 0: a byte of no phrase
        self.kinds[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        trie: list[dict[int, int]] = [{}]
        ends: list[set[int]] = [set()]
        for number, phrase in enumerate(coded):
            state = 0
            for kind in self.kinds[list(phrase)].tolist():
                if kind not in trie[state]:
                    trie[state][kind] = len(trie)
                    trie.append({})
                    ends.append(set())
                state = trie[state][kind]
            ends[state].add(number)
        table = np.zeros((len(trie), width), np.int32)
        suffix, queue = [0] * len(trie), deque([0])
        while queue:
            state = queue.popleft()
            if state:
                table[state] = table[suffix[state]]
                ends[state] |= ends[suffix[state]]
            for kind, after in trie[state].items():
                suffix[after] = int(table[state, kind]) if state else 0
                queue.append(after)
            for kind, after in trie[state].items():
                table[state, kind] = after
        self.width, self.table = width, (table * width).ravel()  # states are kept as row offsets
        self.first = np.cumsum([0, *map(len, ends)])
        self.ended = np.array([p for found in ends for p in sorted(found)], np.int64)
        self.ending = np.repeat(np.array([bool(found) for found in ends]), width)
        self.phrases = len(coded)

    def met(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Text and phrase of each distinct pair met, in order of both."""
        found, first, held = [np.zeros(0, np.int64)], 0, 0
        for i, text in enumerate(texts):
            if held and held + len(text) > TOGETHER:
                found.append(self._walk(texts[first:i], first))
                first, held = i, 0
            held += len(text)
        found.append(self._walk(texts[first:], first))
        pairs = np.concatenate(found)
        return pairs // max(self.phrases, 1), pairs % max(self.phrases, 1)

    def _walk(self, texts: list[bytes], base: int) -> np.ndarray:
        data = np.frombuffer(b"".join(texts), np.uint8)
        lengths = np.array([len(t) for t in texts], np.int64)
        starts = np.cumsum(lengths) - lengths
        counts = -(-lengths // WINDOW)
        owner = np.repeat(np.arange(len(texts)), counts)
        begin = starts[owner] + WINDOW * (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts))
        length = np.minimum(WINDOW + self.longest - 1, starts[owner] + lengths[owner] - begin)
        order = np.argsort(-length, kind="stable")  # windows that are over drop off the end
        owner, begin, length = owner[order], begin[order], length[order]
        kinds = self.kinds[data]
        state, found = np.zeros(len(owner), np.int32), [np.zeros(0, np.int64)]
        active = len(owner)
        for step in range(int(length[0]) if len(length) else 0):
            while active and length[active - 1] <= step:
                active = int(np.searchsorted(-length, -step, side="left"))
            state = self.table[state[:active] + kinds[begin[:active] + step]]
            at = np.flatnonzero(self.ending[state])
            found.append(owner[at] * len(self.ending) + state[at])
        pairs = np.unique(np.concatenate(found))
        text, last = pairs // len(self.ending), pairs % len(self.ending) // self.width
        n = self.first[last + 1] - self.first[last]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.unique((np.repeat(text, n) + base) * self.phrases + self.ended[np.repeat(self.first[last], n) + within])


@lru_cache(maxsize=64)
def _finder(phrases: tuple[str, ...]):
    automaton = Automaton(phrases)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(texts: pd.Series) -> pd.Series:
        text, phrase = automaton.met([t.encode() if t else b"" for t in texts])
        return pd.Series(np.split(phrase.astype(np.int32), np.searchsorted(text, np.arange(1, len(texts)))), index=texts.index)

    return run


def phrases_met(text: Column, phrases: tuple[str, ...]) -> Column:
    """Places (from 0, ascending) in ``phrases`` of those that ``text`` holds; null and empty texts hold none."""
    bounded_batches()
    return _finder(tuple(phrases))(text)


def holds_any(met: Column, phrases: tuple[str, ...], wanted: tuple[str, ...]) -> Column:
    """Whether one of ``wanted`` is among ``met``, places in ``phrases``."""
    places = {p: i for i, p in enumerate(phrases)}
    return F.arrays_overlap(met, F.array(*(F.lit(places[p]) for p in wanted)))


def weight_met(met: Column, weights: list[float]) -> Column:
    """The sum of the weights of the places ``met``."""
    table = F.array(*map(F.lit, weights))
    return F.aggregate(met, F.lit(0.0), lambda a, i: a + F.get(table, i))
