"""Duplicates among articles: by key, by URL or title, by similar titles.

Greedy rules (an article goes only if an earlier one that *stays* is its duplicate) are not
connected components, but stay within them: components are sought first, and each is gone through
once in order of id.
"""

from __future__ import annotations

import tempfile
from functools import reduce

import pyarrow as pa
from pyspark.ml.feature import HashingTF, MinHashLSH
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a table of ids that may be broadcast.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one where it is unset on one machine (master local)."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    named = named or "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the folder of :func:`shared_dir`."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def dedupe_by_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by ``order``."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), order).alias("row")).select("row.*")


def duplicate_report(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Rows, distinct keys and duplicates for each ``by``."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(by).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("new"), (F.sum("n") - F.count(F.lit(1))).alias("duplicates"))


def title_words(title: Column) -> Column:
    words = F.split(F.lower(F.trim(F.regexp_replace(title, r"[ \t\n\r\f\x0B]+", " "))), " ")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def similar_pairs(df: DataFrame, group: str, id: str, words: str, threshold: float = 0.8) -> DataFrame:
    """Pairs a < b of ``id`` in one ``group`` whose word sets have a Jaccard similarity above
    ``threshold``; group, a, b, similarity.

    Exact by prefix filtering: words are ordered from rare to frequent, and two such sets
    share a word among the first ``n - ceil(threshold * n) + 1``.  Equal sets are one
    candidate, so copies do not multiply: they are linked through their first member.
    """
    sets = df.select(group, id, F.array_sort(words).alias("w")).where(F.size("w") > 0)
    firsts = sets.groupBy(group, "w").agg(F.min(id).alias("first"))
    rarity = firsts.select(group, F.explode("w").alias("word")).groupBy(group, "word").agg(F.count(F.lit(1)).alias("df"))
    exploded = firsts.select(group, "first", F.size("w").alias("n"), F.explode("w").alias("word")).join(rarity, [group, "word"])
    place = F.row_number().over(Window.partitionBy(group, "first").orderBy("df", "word"))
    heads = exploded.withColumn("at", place).where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1).select(group, "word", "first", "n")
    x, y = heads.alias("x"), heads.alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in (group, "word")]
    pairs = x.join(y, same + [F.col("x.first") < F.col("y.first"), F.col("x.n") >= F.col("y.n") * threshold, F.col("y.n") >= F.col("x.n") * threshold])
    pairs = pairs.select(F.col(f"x.{group}").alias(group), F.col("x.first").alias("a"), F.col("y.first").alias("b")).distinct()
    left = firsts.select(F.col("first").alias("a"), F.col("w").alias("wa"))
    right = firsts.select(F.col("first").alias("b"), F.col("w").alias("wb"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("wa", "wb"))
    both = both.withColumn("similarity", shared / (F.size("wa") + F.size("wb") - shared)).where(F.col("similarity") > threshold)
    return both.select(group, "a", "b", "similarity")


def lsh_candidates(firsts: DataFrame, group: str, threshold: float = 0.8, tables: int = 64, rows: int = 4, features: int = 1 << 20, seed: int = 42) -> DataFrame:
    """Pairs a < b of ``first`` whose word sets ``w`` share a key in one of ``tables`` min-hash tables of Spark ML.

    Words are hashed together with their group.  A key is made of ``rows`` hashes, so sets that merely share
    frequent words seldom meet.
    """
    named = firsts.select("first", F.size("w").alias("n"), F.transform("w", lambda x: F.concat_ws("\0", F.col(group).cast("string"), x)).alias("terms"))
    vectors = HashingTF(inputCol="terms", outputCol="bits", numFeatures=features, binary=True).transform(named)
    model = MinHashLSH(inputCol="bits", outputCol="hashes", numHashTables=tables * rows, seed=seed).fit(vectors)
    keys = lambda hashes: F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda t: F.xxhash64(t, F.slice(hashes, t * rows + 1, F.lit(rows))))
    held = F.transform(F.array("hashes"), keys)  # of one, so the hashes are worked out once a row
    heads = cut_lineage(model.transform(vectors).select("first", "n", F.explode(F.flatten(held)).alias("key")))
    x, y = heads.alias("x"), heads.alias("y")
    near = [F.col(f"{s}.n") >= F.col(f"{o}.n") * (threshold - 1e-9) for s, o in ("xy", "yx")]
    met = x.join(y, [F.col("x.key") == F.col("y.key"), F.col("x.first") < F.col("y.first"), *near])
    return met.select(F.col("x.first").alias("a"), F.col("y.first").alias("b")).distinct()


def similar_pairs_lsh(df: DataFrame, group: str, id: str, words: str, threshold: float = 0.8, tables: int = 64, rows: int = 4, features: int = 1 << 20, seed: int = 42) -> DataFrame:
    """:func:`similar_pairs` with candidates by :func:`lsh_candidates`, for very many titles.

    Pairs are verified exactly; a pair may be missed with probability (1 - similarity ** rows) ** tables at
    most (3e-15 at 0.8).  Equal sets are one candidate, and sets too small to be similar to any other are none.
    """
    sets = df.select(group, id, F.array_sort(words).alias("w")).where(F.size("w") > 0)
    firsts = sets.groupBy(group, "w").agg(F.min(id).alias("first"))
    firsts = cut_lineage(firsts.where(F.size("w") * (1 - threshold) > threshold - 1e-9))  # of smaller sets, one word more is too much
    pairs = lsh_candidates(firsts, group, threshold, tables, rows, features, seed)
    left = firsts.select(group, F.col("first").alias("a"), F.col("w").alias("wa"))
    right = firsts.select(F.col(group).alias("__g"), F.col("first").alias("b"), F.col("w").alias("wb"))
    both = pairs.join(left, "a").join(right, "b").where(F.col(group).eqNullSafe(F.col("__g")))
    shared = F.size(F.array_intersect("wa", "wb"))
    return both.select(group, "a", "b", (shared / (F.size("wa") + F.size("wb") - shared)).alias("similarity")).where(F.col("similarity") > threshold)


def equal_to_first(df: DataFrame, group: str, id: str, words: str) -> DataFrame:
    """a, b: the first of each set of equal words, and each later one."""
    sets = df.select(group, id, F.array_sort(words).alias("w")).where(F.size("w") > 0)
    firsts = sets.groupBy(group, "w").agg(F.min(id).alias("a"))
    return sets.join(firsts, [group, "w"]).where(F.col(id) > F.col("a")).select("a", F.col(id).alias("b"))


def title_classes(df: DataFrame, group: str, id: str, words: str, threshold: float = 0.8) -> DataFrame:
    """id, group, class_id, links for each row: the first row of its equal sets, and with how
    many other classes :func:`similar_pairs` pairs that.  An empty set is a class of its own.
    """
    pairs = similar_pairs(df, group, id, words, threshold)
    degrees = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    members = equal_to_first(df, group, id, words).select(F.col("b").alias(id), F.col("a").alias("class_id"))
    out = df.select(id, group).join(members, id, "left").withColumn("class_id", F.coalesce("class_id", id)).join(degrees, "class_id", "left")
    return out.select(id, group, "class_id", F.coalesce("links", F.lit(0)).cast("long").alias("links"))


#: Rows of a component that one task resolves; larger ones are resolved in rounds.
COMPONENT_ROWS = 1_000_000


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that each node of the edges (a, b) is connected with.

    Edges are drawn towards the smallest neighbour, larger ends and smaller ends in turn, until every node hangs
    on its root; a chain of n links takes about log n turns.
    """

    def drawn(edges: DataFrame, larger: bool) -> DataFrame:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = both.where("v > u" if larger else "v < u").join(least, "u").select("v", "m")
        out = out if larger else out.union(least.select("u", "m"))
        return cut_lineage(out.where("v <> m").select(F.greatest("v", "m").alias("a"), F.least("v", "m").alias("b")).distinct())

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while (now := state(edges)) != before:
        before, edges = now, drawn(drawn(edges, True), False)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def _by_size(rows: DataFrame, root: str, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of components with ``most`` rows at most, and of larger ones (None: there are none)."""
    large = cut_lineage(rows.groupBy(root).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(F.col(root).alias("large")))
    if large.isEmpty():
        return rows, None
    large = F.broadcast(large) if large.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else large
    return rows.join(large, rows[root] == large["large"], "left_anti"), rows.join(large, rows[root] == large["large"], "left_semi")


def _resolved(table: pa.Table) -> pa.Table:
    """What goes of one component, from its edges."""
    before: dict = {}
    for a, b in zip(table.column("a").to_pylist(), table.column("b").to_pylist(), strict=True):
        before.setdefault(b, []).append(a)
    gone: set = set()
    for b in sorted(before):
        if not gone.issuperset(before[b]):
            gone.add(b)
    return pa.table([pa.array(sorted(gone), table.schema.field("b").type)], names=["b"])


def greedy_drops(edges: DataFrame, most: int = COMPONENT_ROWS) -> DataFrame:
    """id of what goes, from edges (a earlier than b): a column ``b`` of distinct ids.

    Components are sought first; then each is gone through once in order of id.  One with more than ``most`` edges
    is resolved in rounds instead.
    """
    edges = cut_lineage(edges.select("a", "b").distinct())
    if edges.isEmpty():
        return edges.select("b")
    roots = components(edges).select(F.col("node").alias("of"), "root")
    rows = cut_lineage(edges.join(roots, edges.a == roots.of).select("a", "b", "root"))
    small, large = _by_size(rows, "root", most)
    out = small.groupBy("root").applyInArrow(_resolved, T.StructType([edges.schema["b"]]))
    return out if large is None else out.union(_drops_in_rounds(large.select("a", "b")))


def _drops_in_rounds(edges: DataFrame) -> DataFrame:
    """:func:`greedy_drops`: what has no earlier neighbour stays, what has one that stays goes, and so on."""
    edges, drops = cut_lineage(edges), []
    while not edges.isEmpty():
        kept = edges.select("a").join(edges.select(F.col("b").alias("a")), "a", "left_anti").distinct()
        gone = cut_lineage(edges.join(kept, "a", "left_semi").select("b").distinct())
        drops.append(gone)
        rest = edges.join(kept, "a", "left_anti").join(gone, "b", "left_anti")
        edges = cut_lineage(rest.join(gone.select(F.col("b").alias("a")), "a", "left_anti"))
    return reduce(DataFrame.union, drops).distinct()


def dedupe_similar_titles(df: DataFrame, group: str, id: str, title: Column, threshold: float = 0.8) -> DataFrame:
    """Rows whose title is not similar to that of an earlier row that stays.

    Rows with equal word sets fare alike: all but the first go, and the first goes if it is
    similar to one that stays.  Two empty titles are never similar.
    """
    rows = df.withColumn("__w", title_words(title))
    near = similar_pairs(rows, group, id, "__w", threshold).select("a", "b")
    gone = greedy_drops(near).union(equal_to_first(rows, group, id, "__w").select("b")).distinct()
    return df.join(gone.select(F.col("b").alias(id)), id, "left_anti")


def _taken_first(table: pa.Table) -> pa.Table:
    """What goes of one component, from its rows (id, value) in order of id."""
    values: dict = {}
    for id, value in zip(table.column("id").to_pylist(), table.column("value").to_pylist(), strict=True):
        values.setdefault(id, set()).add(value)
    taken, gone = set(), []
    for id in sorted(values):
        if taken.isdisjoint(values[id]):
            taken |= values[id]
        else:
            gone.append(id)
    return pa.table([pa.array(gone, table.schema.field("id").type)], names=["id"])


def _taken_in_rounds(left: DataFrame) -> DataFrame:
    """:func:`_taken_first` of rows (id, value): what is first of all its values stays, and takes these from all others; and so on."""
    left, drops = cut_lineage(left), []
    while not left.isEmpty():
        firsts = left.groupBy("value").agg(F.min("id").alias("first"))
        stays = left.join(firsts, "value").groupBy("id").agg(F.max(F.col("id") > F.col("first")).alias("later")).where("not later").select("id")
        stays = cut_lineage(stays)
        taken = left.join(stays, "id", "left_semi").select("value").distinct()
        drops.append(cut_lineage(left.join(taken, "value", "left_semi").select("id").distinct().join(stays, "id", "left_anti")))
        left = cut_lineage(left.join(stays, "id", "left_anti").join(drops[-1], "id", "left_anti"))
    return reduce(DataFrame.union, drops)


def dedupe_url_or_title(df: DataFrame, group: str, id: str, url: str, title: Column, most: int = COMPONENT_ROWS) -> DataFrame:
    """Rows whose URL and title (if not empty) equal no earlier row's of the group that stays.

    Rows that share values, directly or through others, are a component, gone through once in order of id; those of
    more than ``most`` rows are resolved in rounds.
    """
    rows = df.select(group, F.col(id).alias("id"), F.explode(F.array(F.struct(F.lit("u").alias("k"), F.col(url).alias("v")), F.struct(F.lit("t").alias("k"), F.lower(title).alias("v")))).alias("x"))
    rows = rows.where(F.coalesce("x.v", F.lit("")) != "").select("id", F.md5(F.to_json(F.struct(group, "x.k", "x.v"))).alias("value")).distinct()
    many = rows.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where("n > 1").select("value", "first")
    left = cut_lineage(rows.join(many, "value"))
    if left.isEmpty():
        return df
    roots = components(left.select(F.col("id").alias("a"), F.col("first").alias("b")).where("a <> b")).select(F.col("node").alias("of"), "root")
    left = cut_lineage(left.join(roots, left.id == roots.of).select("id", "value", "root"))
    small, large = _by_size(left, "root", most)
    gone = small.groupBy("root").applyInArrow(_taken_first, T.StructType([left.schema["id"]]))
    gone = gone if large is None else gone.union(_taken_in_rounds(large.select("id", "value")))
    return df.join(gone.withColumnRenamed("id", id), id, "left_anti")


def score_distinct(df: DataFrame, text: str, score) -> DataFrame:
    """``df`` with ``score``, worked out once for each distinct text."""
    distinct = df.select(F.col(text).alias("__t")).distinct().withColumn("score", score(F.col("__t")))
    return df.join(distinct, df[text].eqNullSafe(distinct["__t"]), "left").drop("__t")
