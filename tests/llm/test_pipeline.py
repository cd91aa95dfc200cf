import hashlib
import math
import random
import re
from collections import Counter

import public_tokenizers
import tokenizers

import corpus_pipeline


def test_stages_and_run(spark, make_docs, odd_docs, tmp_path):
    base = " ".join(f"der w{i} und" for i in range(100))
    rows = odd_docs + [(20 + i, f"{base}\nkopf", "de", "a") for i in range(3)] + [(40 + i, " ".join(f"the a{j * i} of" for j in range(80)) + "\nhead", "en", "b") for i in range(1, 20)]
    make_docs(rows, clash=False).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [r["doc_id"] for r in got]
    assert len({20, 21, 22} & set(ids)) <= 1 and not {1, 2, 3, 8} & set(ids)
    assert len({40 + i for i in range(1, 20)} & set(ids)) > 10


def brute_pipeline(rows):
    """Counter of (doc_id, n_tokens, ids_sha256, decoded_sha256), one document after the other."""
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    pages, seen = Counter(), Counter()
    for source, text in {(s, t) for _, t, _, s in rows}:
        pages[source] += 1
        seen.update({(source, x.strip(" ")) for x in text.split("\n") if x.strip(" ")})
    bad = {k for k, n in seen.items() if n >= 5 and n > 0.02 * pages[k[0]]}
    docs = [(d, "\n".join(x for x in t.split("\n") if (s, x.strip(" ")) not in bad), s) for d, t, _, s in rows]
    sets = []
    for _, t, _ in docs:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common >= 0.8 * (len(sets[i]) + len(sets[j]) - common):
                group = [group[j] if g == group[i] else g for g in group]
    docs = [x for x, g in zip(docs, group, strict=True) if x[0] == min(y[0] for y, h in zip(docs, group, strict=True) if h == g)]
    queues = {}
    for d, t, s in sorted(docs, key=lambda x: hashlib.md5(str(x[0]).encode()).hexdigest()):
        queues.setdefault(s, []).append((d, t, len(t.split())))
    size = {s: sum(n for *_, n in q) for s, q in queues.items()}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(size))}
    target, budget, open_sources = {}, 1.5 * sum(size.values()), set(size)
    while open_sources:  # who would get over twice its size gets that, the others share the rest
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_sources)
        full = {s for s in open_sources if level * weight[s] >= 2 * size[s]}
        target |= {s: 2.0 * size[s] for s in full} if full else {s: level * weight[s] for s in open_sources}
        open_sources = open_sources - full if full else set()
    taken = {s: math.floor(target[s] + 1e-9) for s in size}
    lacking = math.floor(round(sum(target.values()), 3)) - sum(taken.values())
    for _, s in sorted(((taken[s] + 1) / target[s], s) for s in size if taken[s] < 2 * size[s])[:lacking]:
        taken[s] += 1
    out = Counter()
    tokens = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens.no_truncation()
    for s, queue in queues.items():
        left = taken[s]
        for d, t, n in queue * 2:
            if (m := min(n, left)) > 0:
                end = [x.end() for x in re.finditer(r"[^\x20\x09-\x0D]+", t)][m - 1]
                ids = tokens.encode(t if m == n else t[:end], add_special_tokens=False).ids
                text = tokens.decode(ids, skip_special_tokens=False)
                out[d, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
            left -= m
    return out


def test_run_equals_brute_force(spark, make_docs, tmp_path):
    rng = random.Random(6)
    words = {"en": "the of and in river stone house over under walk".split(), "de": "der die und ist fluss haus stein weg über nicht".split()}
    text = lambda lang, n: "\n".join(" ".join(rng.choice(words[lang]) + str(rng.randrange(300)) for _ in range(9)) for _ in range(n))
    rows = []
    for i in range(120):
        lang, source = ("en", "de")[i % 2], ("a", "b", "c", "d")[i * i % 4 + (i % 3 == 0)]
        rows.append((i, f"site {source} menu\n{text(lang, rng.randrange(3, 20))}", lang, source))
    for i in range(120, 150):  # copies, near copies
        d, t, lang, source = rows[i * 3 % 100]
        w = t.split(" ")
        if i % 3:
            w[len(w) // 2] = "changed"
        rows.append((i, " ".join(w), lang, rng.choice("abcd") if i % 2 else source))
    rows += [(200, "12 34 !", "en", "a"), (201, "", "en", "b"), (202, None, None, None)]
    make_docs(rows, clash=False).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r[c] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == brute_pipeline(rows) and sum(got.values()) > 100


def test_copies_are_one_page_of_their_source(spark, make_docs):
    """A tenth of the source is copies of one article, which stays whole but for the site's own line."""
    article = "\n".join(f"line {i} of the article" for i in range(12))
    rows = [(i, f"site line\nown words {i}", "en", "a") for i in range(90)] + [(100 + i, f"site line\n{article}", "en", "a") for i in range(10)]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.boilerplate_lines(spark, make_docs(rows, clash=False), "").collect()}
    assert got == {i: f"own words {i}" for i in range(90)} | {100 + i: article for i in range(10)}


def test_empty(spark, make_docs, tmp_path):
    make_docs([], clash=False).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_queries_need_nothing_else():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and sum(n.startswith("op") for n in names) == 13
    assert set(__spark_entry__.oracle_sql()) <= set(names)
