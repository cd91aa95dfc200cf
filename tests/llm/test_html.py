"""Whole extraction against a sequential one."""

import random
from collections import Counter, defaultdict

from tapeworks.llm import html_extract

PAGES = "page_id long, url string, html string"


def plain_common(a, b):
    """Places of a longest common subsequence by the textbook table, the latest one."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def brute_extract(rows):
    """Text of each page, one host after the other."""
    hosts = defaultdict(list)
    for page_id, url, page in rows:
        host = url.split("/")[2]
        hosts[host].append((url.split("/", 3)[3], page_id, [(t, a) for t, a, out in html_extract.blocks(page) if not out]))
    texts = {}
    for found in hosts.values():
        found.sort()
        votes, seen = Counter(), Counter()
        places = [(set(), set()) for _ in found]
        for i in range(len(found) - 1):
            a, b = ([t for t, _ in found[k][2]] for k in (i, i + 1))
            left, right = html_extract.common_lines(a, b)
            assert len(left) == len(right) == plain_common(a, b)
            for k, common in ((i, left), (i + 1, right)):
                own, (first, last) = found[k][2], places[k]
                article = [p for p, (_, x) in enumerate(own) if x]
                whole = article or range(len(own))
                copy = sum(len(own[p][0]) for p in whole if p in common) > (0.5 if article else 0.8) * sum(len(own[p][0]) for p in whole)
                if article or not copy:
                    first |= {p for p in common if p not in article}
                if article and not copy:
                    head = next((n for n, p in enumerate(article) if p not in common), len(article))
                    tail = next((n for n, p in enumerate(article[::-1]) if p not in common), len(article))
                    first |= set(article[:head])
                    last |= set(article[len(article) - tail :])
        for (_, _, own), ends in zip(found, places, strict=True):
            seen.update(set(own))
            for side in (0, 1):
                votes.update({(x, side) for p, x in enumerate(own) if p in ends[side]})
        least = max(3, min(4, len(found)))
        bad = {x for (x, _), n in votes.items() if n > 0.8 * seen[x] and n >= (least if x[1] else 2)}
        for _, page_id, own in found:
            alone = len(found) == 1 and any(x for _, x in own)
            texts[page_id] = "\n".join(t for t, x in own if (t, x) not in bad and not (alone and not x))
    return texts


def test_whole_extraction(spark):
    rng = random.Random(2)
    pool = [f"Common sentence {i} that many articles have" for i in range(12)]
    rows = []
    for host in range(12):
        for i in range(rng.choice([1, 2, 15, 40])):
            own = [rng.choice(pool) if rng.random() < 0.4 else f"Own sentence {rng.randrange(10**6)} of page {i}" for _ in range(rng.randrange(1, 9))]
            if rng.random() < 0.1 and rows:
                own = ["Copied article of long ago", *pool[:3]]
            parts = [f"<p>Section {i // 5} notice"] * (host % 2) + [f"<p>{t}" for t in own] + ["<p>All rights reserved"] * (host % 3 == 0)
            body = "".join(parts)
            page = f"<div>Site {host}</div><article>{body}</article><div>Bottom of {host}</div>" if host % 4 else f"<div>Site {host}</div>{body}"
            rows.append((len(rows), f"http://h{host}/a/{i:03}", page))
    want = brute_extract(rows)
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.extract(spark.createDataFrame(rows, PAGES).repartition(5)).collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()}
    assert any("notice" in page and "notice" not in want[i] for i, _, page in rows)


def test_no_line_goes_from_some_pages_only(spark):
    """A sentence that neighbours share by chance stays everywhere; the host's notice goes everywhere."""
    rng = random.Random(3)
    pool = [f"Sentence {i}" for i in range(8)]
    rows = [(i, f"http://h/{i:04}", "<article><p>Notice of the house" + "".join(f"<p>{t}" for t in [f"Title {i}", *rng.choices(pool, k=6), f"End {i}"]) + "</article>") for i in range(200)]
    got = {r["page_id"]: r["text"].split("\n") for r in html_extract.extract(spark.createDataFrame(rows, PAGES)).collect()}
    for i, _, page in rows:
        lines = [t for t, *_ in html_extract.blocks(page)]
        assert got[i] == lines[1:]


def test_extra_columns_and_repeated_rows(spark):
    from pyspark.sql import functions as F

    rows = [(1, "http://h/1", "<article><p>one</article>")] * 3 + [(1, "http://h/1", "<article><p>two</article>"), (None, "http://h/2", None), (2, None, "<p>three")]
    pages = spark.createDataFrame(rows, PAGES)
    for name in ("host", "key", "line", "gone", "text", "part", "guest", "n_chars"):
        pages = pages.withColumn(name, F.lit("x"))
    got = Counter((r["page_id"], r["text"]) for r in html_extract.extract(pages).collect())
    assert got == Counter({(1, "one"): 3, (1, "two"): 1, (None, ""): 1, (2, "three"): 1})
