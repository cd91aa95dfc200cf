"""Quality rules: a threshold table compiled into one projection of counts and ratios.

Everything is built-in expressions.  Ratios are compared by multiplication of whole
numbers, so no rounding decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let

SYMBOLS = "#*$%&|<>"
#: Frequent function words of the languages covered (fixed values).
STOP_WORDS = tuple(
    "the of and to in is that for with was on as are be this at by it from an "
    "der die das und den von zu mit ist des im für auf ein eine nicht dem "
    "le la les de des et un une du que est dans pour pas qui au sur il "
    "el los las y en una del por con para no se lo su al".split()
)
#: Name, the count that is judged, its share of another count: lowest and highest, in percent
#: (None: no bound).
THRESHOLDS = (
    ("short", "n_words", None, 50, None),
    ("word_length", "word_chars", "n_words", 200, 1500),
    ("symbols", "n_symbols", "n_words", None, 10),
    ("exclamations", "n_exclaims", "n_words", None, 25),
    ("stop_words", "n_stop_words", "n_words", 5, None),
    ("repeated_lines", "n_dup_lines", "n_lines", None, 30),
    ("repeated_words", "n_repeat_words", "n_words", None, 50),
)


def stop_forms() -> list[str]:
    """Stop words as they are written: lower case, capitalised, upper case."""
    return list(dict.fromkeys(form for w in STOP_WORDS for form in (w, w.capitalize(), w.upper())))


#: Low bits of a packed window that hold its place; longer texts take the plain way.
PLACE_BITS = 20
_PLACE = (1 << PLACE_BITS) - 1


def _met_again(rows: Column, key) -> Column:
    """The elements of sorted ``rows`` whose key a neighbour has too."""
    return F.filter(rows, lambda x, i: F.coalesce(key(x) == key(F.get(rows, i + 1)), F.lit(False)) | F.coalesce(key(x) == key(F.get(rows, i - 1)), F.lit(False)))


def _plain_places(hashes: Column) -> Column:
    """Places of the windows whose hash is met again, by sorting hashes with places."""
    rows = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(rows, lambda r: F.array_sort(_met_again(r, lambda x: x["h"])["i"]))


def _packed_places(hashes: Column) -> Column:
    """The same by sorting single numbers: the hash's high bits and the place.

    Where two different hashes agree in the high bits, null.
    """
    high = lambda x: F.shiftright(x, PLACE_BITS)
    place = lambda x: x.bitwiseAND(F.lit(_PLACE)).cast("int")
    packed = F.sort_array(F.transform(hashes, lambda h, i: h.bitwiseAND(F.lit(~_PLACE)).bitwiseOR(i.cast("long"))))

    def checked(met: Column) -> Column:
        wrong = lambda x, i: (high(x) == high(F.get(met, i + 1))) & (F.get(hashes, place(x)) != F.get(hashes, place(F.get(met, i + 1))))
        return F.when(F.size(F.filter(met, lambda x, i: F.coalesce(wrong(x, i), F.lit(False)))) == 0, F.sort_array(F.transform(met, place)))

    return let(let(packed, lambda p: _met_again(p, high)), checked)


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more among ``words``.

    The windows' hashes are sorted with their places; neighbours with equal hashes mark
    places, and the marked places in order say how many words they cover.  Linear but for
    the two sorts, and nothing leaves the row.
    """
    size = F.size(words)
    three = F.transform(
        F.when(size >= 3, F.sequence(F.lit(0), size - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )

    def covered(at: Column) -> Column:
        reach = F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3))))
        return F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x)

    places = let(three, lambda h: F.coalesce(F.when(F.size(h) <= _PLACE, _packed_places(h)), _plain_places(h)))
    return let(places, covered)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules judge, for each row; null texts count as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id"), text.alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)))
    return rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        (F.length("text") - F.length(F.replace("text", F.lit("!"), F.lit("")))).cast("long").alias("n_exclaims"),
        F.size(F.filter("words", lambda w: w.isin(*stop_forms()))).cast("long").alias("n_stop_words"),
    )


def verdict(thresholds=THRESHOLDS) -> Column:
    """True where no rule of the table is broken."""
    kept = F.lit(True)
    for _, count, whole, low, high in thresholds:
        value = F.col(count) if whole is None else F.col(count) * 100
        scale = F.lit(1) if whole is None else F.col(whole)
        if low is not None:
            kept = kept & (value >= scale * low)
        if high is not None:
            kept = kept & (value <= scale * high)
    return kept


def judge(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """Counts of :func:`measures` with base_failed and kept for each row of ``docs``.

    base_failed: under 50 words, or over half of the words repeat in three-word windows.
    Null, empty and blank texts have no words and fail; repeated rows get equal answers; an
    empty table gives an empty one; a null doc_id stays null.
    """
    rows = measures(docs)
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(thresholds))
