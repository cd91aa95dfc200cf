"""Mixing sources to target weights by weighted fair queueing.

Each document gets a place in its source's shuffled queue.  A copy's virtual finish time
is the words of its source up to its end, divided by the source's target.  Copies
range-sorted by that time interleave the sources in proportion, and the mix is truncated
where the words so far make up the total budget.  What is cut there is cut between words:
each word has a finish time too, and the budget ends with one word of the global order, so
a long document at the cut does not shift the shares.  A source whose target is above its
size starts a second pass through its queue.

All steps are DataFrame operations.  A source may hold any share of the rows: queues are
cut by the leading hex digits of the shuffle key, words are added up by (source, digits)
before anything moves, and running sums are taken within such a cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut_lineage, private

WEIGHTS, SHARE, MOST, SALT_DIGITS = (3.0, 1.0, 2.0), 1.5, 2, 3


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target from source, source_size (one row for each source).

    Sources by code point, null last, get the ``weights`` in turn.  Targets share ``share``
    times all sizes by weight; none is above ``most`` times its source's size, and what is
    cut there goes to the others by weight.  The table of sources is one row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    every = Window.partitionBy(F.lit(1))
    by_fill = Window.orderBy("fill", F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = totals.withColumn("weight", pick).withColumn("cap", (F.col("source_size") * most).cast("double"))
    rows = rows.withColumn("budget", F.sum("source_size").over(every) * F.lit(share)).withColumn("fill", F.col("cap") / F.col("weight"))
    rows = rows.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    level = F.min_by(F.when(F.col("level") <= F.col("fill"), F.col("level")), F.when(F.col("level") <= F.col("fill"), F.col("fill"))).over(every)
    return rows.select("source", "source_size", F.least("cap", F.coalesce(level, F.lit(0.0)) * F.col("weight")).alias("target"))


def served(goals: DataFrame, most: int = MOST) -> DataFrame:
    """``goals`` (of :func:`targets`) with served: the words of each source up to the cut.

    Words finish at n / target.  At time 1 each source has given its target, rounded down,
    and what the budget then lacks (less than a word a source) is filled by the next words in
    the order of their finish times.
    """
    every, base = Window.partitionBy(F.lit(1)), F.floor("target").cast("long")
    rows = goals.withColumn("base", base).withColumn("next", F.when(F.col("base") < F.col("source_size") * most, F.try_divide(F.col("base") + 1, F.col("target"))))
    rows = rows.withColumn("lacking", F.floor(F.round(F.sum("target").over(every), 3)).cast("long") - F.sum("base").over(every))
    place = F.row_number().over(Window.orderBy(F.col("next").asc_nulls_last(), F.col("source").asc_nulls_last()))
    rows = rows.withColumn("place", place)
    return rows.select("source", "source_size", "target", (F.col("base") + ((F.col("place") <= F.col("lacking")) & F.col("next").isNotNull()).cast("long")).alias("served"))


def schedule(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, salt_digits: int = SALT_DIGITS) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text, source): its copies in the mix.

    Returns doc_id, source, size, source_size, target and copies, an array of (pass, finish,
    taken): virtual finish time and the words that the mix takes.  A copy that finishes after
    the cut counts with the words up to there.  Null and empty texts have size 0 and are
    never taken; the null source is one source; repeated rows queue one by one; the order is
    the md5 of doc_id, ties by size.
    """
    sized = cut_lineage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words().alias("size")))
    sized = sized.withColumn("turn", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("cut", F.substring("turn", 1, salt_digits))
    cuts = sized.groupBy("source", "cut").agg(F.sum("size").alias("cut_size"))
    goals = served(targets(cuts.groupBy("source").agg(F.sum("cut_size").alias("source_size")), weights, share, most), most)
    earlier = Window.partitionBy("source").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    cuts = cuts.withColumn("offset", F.coalesce(F.sum("cut_size").over(earlier), F.lit(0))).drop("cut_size")
    cuts = cuts.join(goals.withColumnRenamed("source", "goal_source"), F.col("source").eqNullSafe(F.col("goal_source")))
    cuts = cuts.select(F.col("source").alias("cut_source"), F.col("cut").alias("cut_cut"), "offset", "source_size", "target", (F.col("served") / F.col("target")).alias("until"), "served")
    queue = sized.join(cuts, F.col("source").eqNullSafe(F.col("cut_source")) & (F.col("cut") == F.col("cut_cut")))
    inside = Window.partitionBy("source", "cut").orderBy("turn", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    queue = queue.withColumn("ends", F.col("offset") + F.sum("size").over(inside))

    def copy(number: int) -> Column:
        end = F.col("ends") + F.col("source_size") * number
        finish = F.try_divide(end, F.col("target"))
        before_cut = F.greatest(F.lit(0), F.col("served") - (end - F.col("size")))
        taken = F.when(finish <= F.col("until"), F.col("size")).otherwise(F.least(F.col("size"), before_cut)).cast("long")
        return F.struct(F.lit(number + 1).alias("pass"), finish.alias("finish"), taken.alias("taken"))

    copies = F.filter(F.array(*(copy(i) for i in range(most))), lambda c: c.taken > 0)
    return queue.select("doc_id", "source", "size", "source_size", "target", "ends", copies.alias("copies"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The copies that the mix takes, globally sorted by virtual finish time.

    doc_id, source, pass, finish, taken; a document in both passes has two rows.
    """
    rows = schedule(docs, **how).select("doc_id", "source", F.explode("copies").alias("c"))
    return rows.select("doc_id", "source", "c.pass", "c.finish", "c.taken").orderBy("finish", "doc_id", "pass")


def taken_words(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken (words over all passes), in mixing order."""
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c.taken)
    first = F.get(F.col("copies.finish"), 0)
    rows = schedule(docs, **how).select("doc_id", "size", "source_size", "target", taken.alias("taken"), first.alias("finish"))
    return rows.orderBy(F.col("finish").asc_nulls_last(), "doc_id")


def first_words(text: Column, n: Column) -> Column:
    """``text`` up to the end of its ``n``-th word, white space as it is."""
    pieces = F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    blank_first = F.when(text.rlike(r"\A[\x20\x09-\x0D]"), F.lit(1)).otherwise(F.lit(0))
    return F.regexp_replace(F.array_join(F.slice(pieces, F.lit(1), (n + blank_first).cast("int")), ""), r"[\x20\x09-\x0D]+\z", "")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The words that the mix takes: each row of ``docs`` once for each pass that takes words of it.

    The text of a copy that the budget cuts is cut after its last taken word, n_chars (if
    there is such a column) says its new length; other columns stay.  Repeated rows have their own copies.
    """
    same = ["doc_id", "source", "size"]
    own = {c: private(docs, c) for c in (*same, "row", "copy")}
    # keys without nulls, so that numbering rows and joining deal texts the same way, once
    values = {own["doc_id"]: F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), own["source"]: F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))}
    alike = Window.partitionBy(*(own[c] for c in same))
    plan = schedule(docs, **how).withColumns({**values, own["size"]: F.col("size")})
    plan = plan.withColumn(own["row"], F.row_number().over(alike.orderBy("ends")))
    plan = plan.select(*(F.col(own[c]).alias(f"{own[c]}_of") for c in (*same, "row")), F.col("copies").alias(f"{own['copy']}_of"))
    rows = docs.withColumns({**values, own["size"]: n_words()})
    rows = rows.withColumn(own["row"], F.row_number().over(alike.orderBy(F.xxhash64("text"))))
    met = [rows[own[c]] == plan[f"{own[c]}_of"] for c in (*same, "row")]
    rows = rows.join(plan, met).withColumn(own["copy"], F.explode(f"{own['copy']}_of"))
    taken, text = F.col(own["copy"])["taken"], F.col("text").cast("string")
    cut = F.when(taken < F.col(own["size"]), first_words(text, taken)).otherwise(text)
    changed = {"text": cut, "n_chars": F.when(taken < F.col(own["size"]), F.length(cut)).otherwise(F.col("n_chars")).cast("long") if "n_chars" in docs.columns else None}
    return rows.select(*(changed[c].alias(c) if changed.get(c) is not None else c for c in docs.columns))
