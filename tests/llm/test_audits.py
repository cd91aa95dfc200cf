"""Divergence and filter audits and MinHash groups against brute force."""

import random
import re
from collections import Counter, defaultdict
from itertools import combinations, permutations

import numpy as np
import pytest

from tapeworks.llm import divergence, filter_audit, minhash, simhash


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_divergence(rows, least=10, top=10):
    lower = {c: chr(c + 32) for c in range(65, 91)}
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        group = (lang or "", source or "")
        groups.add(group)
        found = [w.translate(lower) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        counts[group].update(found)
        docs[group[0]].update(set(found))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]
        p = {}
        for other in [s for g, s in groups if g == lang] + [None]:
            own = sum((c for (g, s), c in counts.items() if g == lang and other in (None, s)), Counter())
            below = sum(own[t] for t in kept) + 2 * len(kept)
            p[other] = {t: 1 + 10**9 * (own[t] + 2) // below for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        pairs = [(other, sum(f(p[source][t], p[other][t]) for t in kept)) for other in p if other not in (None, source)]
        own = [(t, f(p[source][t], p[None][t])) for t in kept if counts[lang, source][t] and p[source][t] > p[None][t]]
        for part, found, most in (("pair", pairs, None), ("term", own, top)):
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, i) for i, (item, value) in enumerate(found[:most], 1)]
    return sorted(out)


def some_docs(n, seed):
    rng = random.Random(seed)
    vocabulary = [a + b for a in "ka lo mi né pu Ra si".split() for b in "x y' z9 ß w".split()]
    out = []
    for i in range(n):
        lang, source = rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "d", "é", None])
        out.append((i, " ".join(rng.choices(vocabulary[: 10 + 5 * (len(source or "") + i % 5)], k=rng.randrange(40))), lang, source))
    return out


@pytest.mark.parametrize("blocks", [(64, 4096), (2, 3)])
def test_divergence(make_docs, odd_docs, blocks):
    rows = some_docs(400, 1) + [(900, "only here", "xx", "s"), (901, "... 12 --", "yy", "s"), (902, None, "yy", "t")]
    got = divergence.audit(make_docs(rows), groups_a_block=blocks[0], terms_a_block=blocks[1]).collect()
    assert sorted(map(tuple, got)) == brute_divergence(rows)
    assert {(r["source"], r["value"]) for r in got if r["lang"] == "yy"} == {("s", 0), ("t", 0)}
    got = divergence.audit(make_docs(odd_docs), least_docs=1, groups_a_block=blocks[0], terms_a_block=blocks[1]).collect()
    assert sorted(map(tuple, got)) == brute_divergence(odd_docs, least=1)
    assert divergence.audit(make_docs([])).collect() == []


def test_probabilities_of_large_counts(spark):
    """Counts of a very large corpus neither overflow nor lose digits."""
    from pyspark.sql import functions as F

    n, total, kept = 3 * 10**15 + 7, 9 * 10**15 + 1, 10**6
    row = spark.range(1).select(divergence._probability(F.lit(n), F.lit(total), F.lit(kept)).alias("p"), divergence._divergence(F.lit(10**9 + 1).cast("long"), F.lit(3).cast("long")).alias("f")).first()
    assert row["p"] == 1 + 10**9 * (n + 2) // (total + 2 * kept)
    assert row["f"] == (10**9 - 2) ** 2 // (10**9 + 4)


def test_a_worker_gives_out_counts_before_they_pile_up(spark, make_docs, monkeypatch):
    rows = some_docs(100, 3)
    whole = sorted(map(tuple, divergence.audit(make_docs(rows), least_docs=2).collect()))
    batch = make_docs(rows).select("lang", "source", "text").fillna("").toArrow().to_batches()
    monkeypatch.setattr(divergence, "HELD", 5)
    parts = list(divergence._counted(x.slice(i, 1) for x in batch for i in range(x.num_rows)))
    assert len(parts) > 10
    assert sum(sum(p.column("n").to_pylist()) for p in parts) == sum(len(divergence.terms((t or "").encode())) for _, t, *_ in rows)
    assert whole == brute_divergence(rows, least=2)


def brute_audit(rows, labels):
    first = {}
    for doc, text, *_ in rows:
        if doc is not None:
            first[text or ""] = min(first.get(text or "", doc), doc)
    masks = defaultdict(list)
    for doc, text, lang, _ in rows:
        t, w = text or "", words(text)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": doc is not None and doc > first[t]}
        masks[lang or ""].append(({k for k, v in fails.items() if v}, (doc, 1) in labels["quality"], (doc, 1) in labels["toxic"]))
    out = []
    for part, docs in masks.items():
        shapley, steps = Counter(), []
        for order in permutations("ABCDE"):
            left = docs
            for i, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                shapley[f] += len(gone)
                failing = sum(f in x[0] for x in docs)
                steps.append((part, "".join(order), i, len(left), len(gone), failing - len(gone), sum(x[0] == {f} for x in docs), sum(x[1] for x in gone), sum(x[2] for x in gone), f))
        out += [(*s[:-1], shapley[s[-1]]) for s in steps]
    return sorted(out)


def test_filter_audit(spark, make_docs, odd_docs):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["aa", "Bb", "c#", "dd"] + [f"w{i}" for i in range(rng.choice([2, 400]))]) for _ in range(rng.choice([5, 199, 200, 300]))) for _ in range(40)]
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""]), "s") for i in range(150)] + [(3, texts[0], "en", "s"), (3, texts[0], "en", "s"), (None, texts[1], "de", "s"), (None, texts[1], "de", "s")]
    marks = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 150, 2)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1), (9999, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    known = {c: {(m[0], m[i]) for m in marks if m[0] is not None} for i, c in ((1, "quality"), (2, "toxic"))}
    for docs in (rows, odd_docs):
        got = filter_audit.audit(make_docs(docs), labels.withColumnRenamed("quality", "Quality")).collect()
        assert sorted(map(tuple, got)) == brute_audit(docs, known)
    assert filter_audit.audit(make_docs([]), labels).collect() == []
    assert len(filter_audit.audit(make_docs(rows[:3]), labels.limit(0)).collect()) % 600 == 0


def test_diagram_meets_every_order_once():
    for n in range(1, 6):
        order, seen = list(range(n)), set()
        for level in [None, *filter_audit.adjacent_swaps(n)]:
            if level is not None:
                order[level], order[level + 1] = order[level + 1], order[level]
            seen.add(tuple(order))
        assert seen == set(permutations(range(n))) and len(filter_audit.adjacent_swaps(n)) == len(seen) - 1


def test_diagram_shares_equal_parts():
    """Where a filter says nothing about the others, its two subdiagrams are one."""
    counts = {m: (1, 0, 0) for m in range(16)}
    assert len(filter_audit.Diagram(counts, 4).children) == 5
    assert filter_audit.all_orders(counts, "WXYZ")[0] == ("WXYZ", 1, 8, 8, 0, 1, 0, 0, sum(16 // 2 ** (i + 1) * 6 for i in range(4)))


def brute_groups(rows, n=3, percent=85):
    sets = []
    for _, text, *_ in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        common = len(sets[i] & sets[j])
        if common and 100 * common >= percent * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i, (doc, *_) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((doc, len(sets[i]), least.get(find(i)), doc == least.get(find(i))) for i, (doc, *_) in enumerate(rows)), key=repr)


def families(seed, members, edits):
    """Texts that are edits of a few base texts, pairs on both sides of the threshold, and passages in common."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for base in range(3):
        text = [f"b{base}w{i}" for i in range(150)] + passage
        for _ in range(members):
            own = list(text)
            for _ in range(rng.randrange(edits)):
                own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own).upper() if rng.random() < 0.2 else " ".join(own), "en", "s"))
    rows += [(1000 + i, " ".join(passage + [f"o{i}x{j}" for j in range(30)]), "en", "s") for i in range(100)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk", [4096, 16])
def test_minhash_groups(make_docs, chunk):
    rows = families(2, 60, 16)
    got = minhash.near_duplicates(make_docs(rows), chunk=chunk).collect()
    assert sorted(map(tuple, got), key=repr) == brute_groups(rows)
    sizes = Counter(r["component_id"] for r in got)
    assert len(sizes) > 100 and max(sizes.values()) > 20


def test_minhash_odd(make_docs, odd_docs):
    rows = odd_docs + [(20, "ONE", "en", "a"), (21, "two words", "en", "a"), (22, "Two\tWords", "en", "a"), (None, " ".join(f"w{i % 977}x{i // 977}" for i in range(19_990)), "en", "a")]
    got = sorted(map(tuple, minhash.near_duplicates(make_docs(rows)).collect()), key=repr)
    want = brute_groups(rows)
    assert got == sorted(((d, n, d if n == 0 else c, True if n == 0 else k) for d, n, c, k in want), key=repr)
    assert minhash.near_duplicates(make_docs([])).collect() == []
    with pytest.raises(ValueError):
        minhash.near_duplicates(make_docs([]), percent=20)


def test_minhash_copies_are_never_compared(make_docs):
    """20,000 copies of one text are one node."""
    text = " ".join(f"w{i}" for i in range(100))
    got = minhash.near_duplicates(make_docs([(i, text, "en", "s") for i in range(20_000)], clash=False))
    assert got.groupBy("component_id").count().collect()[0]["count"] == 20_000


def test_pairs_at_the_threshold_collide(spark):
    """Of 2,000 pairs of exactly 0.85 all have the collisions asked for, and few at 0.4 do."""
    rng, least = np.random.default_rng(1), minhash.least_matches()
    for share, most in ((0.85, 2000), (0.4, 20)):
        found = 0
        for _ in range(2000):
            total, common = 200, round(200 * share)
            values = rng.integers(0, 2**63, total, dtype=np.uint64)
            apart = (total - common) // 2
            x, y = (minhash.signature(v) for v in (values[: common + apart], np.concatenate((values[:common], values[common + apart :]))))
            found += (x == y).sum() >= least
        assert found == 2000 if share == 0.85 else found <= most


def test_keep_one_keeps_one_row_a_group(spark, make_docs):
    """Repeated doc_ids are rows of their own: equal rows, and one id with two texts."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(80)) for x in "abc")
    rows = [(1, a, "en", "s")] * 3 + [(2, b, "en", "s"), (3, a, "en", "s"), (3, c, "en", "s")]
    got = simhash.keep_one(make_docs(rows)).select("doc_id", "text").collect()
    assert sorted(map(tuple, got)) == sorted([(1, a), (2, b), (3, c)])
    rows = [(None, a, "en", "s"), (None, a, "en", "s"), (5, a, "de", "s"), (None, b, "en", "s"), (None, b, None, None), (7, None, "en", "s"), (7, "", "en", "s"), (8, " ", "en", "s")]
    got = simhash.keep_one(make_docs(rows)).select("doc_id", "text").collect()
    assert sorted(((r[0], (r[1] or "").strip()) for r in got), key=repr) == sorted([(5, a), (None, b), (7, "")], key=repr)
    names = set(make_docs([]).columns)
    assert set(simhash.keep_one(make_docs(rows)).columns) == names
