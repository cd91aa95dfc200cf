"""Operators against brute force on small tables, and on odd rows."""

import base64
import cmath
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from tapeworks.llm import bpe, html_extract, langid, line_dedup, media, mixing, quality, simhash, substring_dedup, warc


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def invented(n, seed, size=40):
    rng = random.Random(seed)
    return [" ".join(rng.choice("ka lo mi ne pu ra si to vu ze".split()) + str(rng.randrange(size)) for _ in range(rng.randrange(1, 200))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(make_docs):
    texts = invented(60, 1)
    passage = " ".join(texts[0].split() + texts[1].split())[:900]
    texts += [t + " " + passage + " end" for t in texts[2:12]] + texts[:5] + ["word " * 90]
    rows = [(i, t, ("en", "de")[i % 2], f"s{i % 4}") for i, t in enumerate(texts)]
    return rows, make_docs(rows)


def brute_removed(rows, k):
    split = [words(t) for _, t, *_ in rows]
    seen = Counter(tuple(w[i : i + k]) for w in split for i in range(len(w) - k + 1))
    out = []
    for (doc, *_), w in zip(rows, split, strict=True):
        keep = [True] * len(w)
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                keep[i : i + k] = [False] * k
        kept = b" ".join(x for x, y in zip(w, keep, strict=True) if y)
        out.append((doc, len(w), keep.count(False), kept.decode()))
    return out


def by_id(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("hot", [1, 1000])
def test_substring_dedup(corpus, hot):
    rows, df = corpus
    got = substring_dedup.remove_repeated_windows(df, hot=hot).collect()
    assert by_id(got) == by_id(brute_removed(rows, 35))
    assert sum(r["n_removed"] for r in got) > 500


def test_substring_dedup_odd(make_docs, odd_docs):
    got = substring_dedup.remove_repeated_windows(make_docs(odd_docs)).collect()
    assert by_id(got) == by_id(brute_removed(odd_docs, 35))
    assert substring_dedup.remove_repeated_windows(make_docs([])).collect() == []


@pytest.mark.parametrize("hot", [1, 1000])
def test_substring_dedup_of_one_text_many_times(make_docs, hot):
    """Work grows with the rows, not with their pairs: one id and text 10,000 times, beside other texts that share a passage."""
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(1, text, "en", "s")] * 10_000 + [(2, "own start " + " ".join(f"w{i}" for i in range(100, 140)) + " own end", "en", "s"), (3, " ".join(f"v{i}" for i in range(100)), "en", "s")]
    got = Counter(map(tuple, substring_dedup.remove_repeated_windows(make_docs(rows, clash=False), hot=hot).collect()))
    assert got == Counter({(1, 400, 400, ""): 10_000, (2, 44, 40, "own start own end"): 1, (3, 100, 0, rows[-1][1]): 1})


def test_media(make_docs, odd_docs):
    df = make_docs(odd_docs)
    table = media.write_media(df)
    stored = {(r["doc_id"], r["n_bytes"]): r["media"] for r in table.collect()}
    for r in media.media_features(table).collect():
        payload = media.from_wav(stored[r["doc_id"], r["n_bytes"]])
        assert len(payload) == r["payload_bytes"] and len(payload) % 64 == 0 and payload
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["pairs"] == sorted(r["pairs"]) and r["pairs"]
    texts = sorted((t or "").encode() for _, t, *_ in odd_docs)
    assert sorted(media.from_wav(r["media"])[: r["n_bytes"]] for r in table.collect()) == texts
    digests = media.media_features(table, digest=True).collect()
    same = [r["feature"] for r in digests if r["doc_id"] in (6, 7)]
    assert len(set(same)) == 1 and len(same) == 3
    assert media.media_features(media.write_media(make_docs([]))).collect() == []


def test_peaks_find_a_tone():
    t = np.arange(4096)
    tone = (128 + 100 * np.sin(2 * np.pi * t * 40 / 256)).astype(np.uint8).tobytes()
    first = {(c >> 12) & 0xFF for c in media.peak_pairs(tone).tolist()}
    assert 40 in first


def brute_pairs(samples):
    """Spectral peaks and their pairs by sums over single samples."""
    x = [b - 128 for b in samples]
    starts = [0]
    while starts[-1] + 256 < len(x):
        starts.append(starts[-1] + 128)
    window = [0.5 - 0.5 * math.cos(2 * math.pi * i / 255) for i in range(256)]
    table = []
    for s in starts:
        frame = [(x[s + i] if s + i < len(x) else 0) * window[i] for i in range(256)]
        table.append([round(abs(sum(v * cmath.exp(-2j * math.pi * f * i / 256) for i, v in enumerate(frame))), 3) for f in range(129)])
    found = []
    for t, row in enumerate(table):
        for low, high in ((1, 9), (9, 17), (17, 33), (33, 65), (65, 129)):
            top = max(row[low:high])
            sides = [max(table[u][low:high]) if 0 <= u < len(table) else -1 for u in (t - 1, t + 1)]
            if top > 1.5 * sum(row[low:high]) / (high - low) and top >= sides[0] and top > sides[1]:
                found.append((t, row.index(top, low, high)))
    out = []
    for t, f in found:
        later = [(u, g) for u, g in found if u > t][:3]
        out += [t << 20 | f << 12 | g << 4 | u - t for u, g in later if u - t <= 12]
    return sorted(out or [t << 20 | f << 12 for t, f in found])


def test_peak_pairs_equal_brute_force():
    texts = [media.padded(t.encode()) for t in [*invented(6, 21), "", "a", "ab" * 90]]
    for text in texts:
        assert media.peak_pairs(text[:1024]).tolist() == brute_pairs(text[:1024])
    long = texts[0] * 40
    assert media.peaks(long)[1].tolist() == media.peaks(long, block=3)[1].tolist()


def test_the_last_samples_count():
    rng = random.Random(4)
    head = bytes(rng.randrange(97, 123) for _ in range(256))
    tails = [bytes(rng.randrange(97, 123) for _ in range(64)) for _ in range(30)]
    assert len({media.peak_pairs(head + t).tobytes() for t in tails}) > 20


def test_silence_has_few_peaks():
    assert len(media.peaks(bytes([128]) * 4096)[0]) == 0
    noise = np.random.default_rng(1).integers(0, 256, 40_960, dtype=np.uint8).tobytes()
    assert len(media.peaks(noise)[0]) < 0.5 * 5 * 320


def test_mixing(make_docs, odd_docs, corpus):
    rows, df = corpus
    got = mixing.taken_words(df).collect()
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(words(t))
    taken = Counter()
    source = {d: s for d, _, _, s in rows}
    for r in got:
        assert r["size"] == len(words(rows[r["doc_id"]][1])) and r["source_size"] == sizes[source[r["doc_id"]]]
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    budget, level = 1.5 * sum(sizes.values()), {}
    weights = dict(zip(sorted(sizes), (3, 1, 2, 3), strict=True))
    low, high = 0.0, float(budget)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(2 * sizes[s], mid * weights[s]) for s in sizes) < budget else (low, mid)
    for s in sizes:
        level[s] = min(2 * sizes[s], high * weights[s])
        assert abs(taken[s] - level[s]) <= 1.5
    assert [tuple(r) for r in mixing.taken_words(df).collect()] == [tuple(r) for r in got]
    finish = [r["finish"] for r in mixing.mix(df).collect()]
    assert finish == sorted(finish)
    odd = mixing.taken_words(make_docs(odd_docs)).collect()
    assert len(odd) == len(odd_docs) and mixing.taken_words(make_docs([])).collect() == []
    assert mixing.mixed_documents(make_docs(odd_docs)).columns == make_docs(odd_docs).columns


def test_mixed_documents_ship_the_words_taken(make_docs, odd_docs):
    """Each copy has the words that the mix takes of it, also of repeated ids, and columns that clash stay."""
    rows = odd_docs + [(50, f" lead {i} " + "some words\n here  " * (5 + i), "en", ("a", "b", "d")[i % 3]) for i in range(12)]
    df = clashing(make_docs(rows))
    out = mixing.mixed_documents(df)
    got, want = Counter(), Counter()
    for r in out.collect():
        assert r["n_chars"] == len(r["text"]) and r["times"] == "own times" and r["row"] == "own row"
        got[r["doc_id"], len(words(r["text"]))] += 1
        assert any(t is not None and t.startswith(r["text"]) for d, t, *_ in rows if d == r["doc_id"])
    for r in mixing.mix(df).collect():
        want[r["doc_id"], r["taken"]] += 1
    assert out.columns == df.columns and got == want


def test_language_id(make_docs, odd_docs):
    rng = random.Random(3)
    parts = {"en": "the and ing th er on at", "de": "der ung ich sch ein äu ß", "fr": "les eau oui é è que"}
    rows = []
    for i in range(300):
        lang = ("en", "de", "fr")[i % 3]
        rows.append((i, " ".join("".join(rng.choice(parts[lang].split()) for _ in range(rng.randrange(1, 4))) for _ in range(40)), lang, "s"))
    got = {r["doc_id"]: r for r in langid.identify(make_docs(rows)).collect()}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert [i for i in got if got[i]["held_out"]] and all(got[i]["held_out"] == (i in set(held)) for i in got)
    assert np.mean([got[i]["lang_pred"] == rows[i][2] for i in held]) >= 0.98
    model = langid.train(make_docs(rows))
    odd = langid.predict(make_docs(odd_docs), model).collect()
    assert len(odd) == len(odd_docs)
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in odd if r["doc_id"] in (1, 2, 3, 8))
    assert all(0 <= r["score"] <= 1 for r in odd)
    assert {r["lang_pred"] for r in langid.identify(make_docs([(1, "abc", None, None)])).collect()} == {"und"}
    kept = langid.keep_identified(make_docs(rows + [(900, "123", "en", "s"), (901, None, "en", "s")]))
    assert kept.count() == 300 and kept.columns == make_docs(rows).columns


def counted(texts):
    d = langid._grams(texts)[0].astype(np.int64)
    gram, n = np.unique(d[:-3] << 24 | d[1:-2] << 16 | d[2:-1] << 8 | d[3:], return_counts=True)
    return gram, n.astype(float)


def brute_probability(data, context, symbol):
    """PPM by method C with exclusion, counted afresh from the folded bytes ``data`` (three spaces first)."""
    if context is None:
        return 1 / 256
    k = len(context)
    n = Counter(data[i] for i in range(3, len(data)) if data[i - k : i] == context)
    lower = lambda s: brute_probability(data, context[1:] if k else None, s)
    total, kinds = sum(n.values()), len(n)
    if not total:
        return lower(symbol)
    if symbol in n:
        return n[symbol] / (total + kinds)
    return kinds / (total + kinds) * lower(symbol) / (1 - sum(map(lower, n)))


def test_code_lengths_equal_brute_force():
    train = ["Abracadabra, abra!".encode(), "Ελλάς 你好 abba".encode()]
    gram, n = counted(train)
    model = langid.Model(["x"], gram, n, np.zeros(len(n), int))
    data = bytes(langid._grams(train)[0])
    for text in (train[0], train[1], b"cad abra zebra", "λάθος 你们".encode(), b""):
        folded = b"   " + bytes(langid._grams([text])[0][3:])
        want = sum(-np.log2(brute_probability(data, folded[i - 3 : i], folded[i])) for i in range(3, len(folded)))
        assert np.isclose(model.totals([text])[0, 0], want, atol=1e-3)
    contexts = [data[i : i + 3] for i in range(0, 20)] + [b"zzz", b"xab"]
    keys = np.array([[int.from_bytes(c + bytes([s]), "big") for s in range(256)] for c in contexts], np.uint32)
    assert np.allclose(np.exp2(-model.code(keys.ravel())[:, 0].reshape(keys.shape)).sum(axis=1), 1, atol=1e-4)


def test_blocks_do_not_change_code_lengths(monkeypatch):
    texts = [t.encode() for t in invented(40, 3)] + [b"", b"x" * 20_000]
    gram, n = counted(texts[:20])
    model = langid.Model(["x", "y"], np.concatenate([gram, gram[::2]]), np.concatenate([n, n[::2]]), np.repeat([0, 1], [len(n), len(n[::2])]))
    whole = model.totals(texts)
    monkeypatch.setattr(langid, "STEP", 1)
    assert np.allclose(model.totals(texts), whole) and np.allclose(np.vstack([model.totals([t]) for t in texts]), whole)


def test_many_languages_and_scripts(make_docs):
    """Forty labelled languages of several scripts are all learned; a language of one text copied many times too."""
    rng = random.Random(8)
    alphabets = [[chr(base + rng.randrange(24)) for _ in range(9)] for base in (0x61, 0x3B1, 0x430, 0x5D0, 0x627, 0x905, 0xE01, 0x10D0) for _ in range(5)]
    text = lambda a: " ".join("".join(rng.choice(a) for _ in range(rng.randrange(2, 7))) for _ in range(60))
    rows = [(i, text(alphabets[i % 40]), f"l{i % 40:02}", "s") for i in range(1200)] + [(i, "zq qz " * 40, "copied", "s") for i in range(2000, 5000)]
    df = make_docs(rows, clash=False)
    model = langid.train(df, rows=20)
    assert len(model.langs) == 41
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(df, model).where("held_out").collect()}
    assert np.mean([got[d] == lang for d, _, lang, _ in rows if d in got]) > 0.97 and "copied" in got.values()


PAGES = "page_id long, url string, html string"


def test_warc(spark, tmp_path):
    big = "".join(random.Random(1).choice("abcdefgh é") for _ in range(700_000))
    rows = [(1, "http://a/1", "x" * 10), (2, None, None), (3, "http://a/3 b\r\nX: y", "x" * 10), (4, "u", big), (5, "u", big), (6, "", ""), (None, "n", "only"), (7, "u", "x" * 10), (7, "u", "x" * 10)]
    df = spark.createDataFrame(rows, PAGES)
    manifest = warc.archive(df, f"file://{tmp_path}/w")
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    expected = []
    for p, _, h in rows:
        data = (h or "").encode()
        refers = first.get(h or "") if first.get(h or "") != p else None
        expected.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if refers is not None else "response", refers))
    assert by_id(warc.digests(manifest).collect()) == by_id(expected)
    chunks = [r for r in warc.read_archives(manifest).collect() if r["page_id"] == 4]
    chunks.sort(key=lambda r: r["chunk_no"])
    assert len(chunks) > 2 and b"".join(bytes(r["chunk"]) for r in chunks) == big.encode()
    assert chunks[0]["digest_so_far"] == base64.b32encode(hashlib.sha1(bytes(chunks[0]["chunk"])).digest()).decode()
    assert warc.digests(warc.archive(spark.createDataFrame([], PAGES), f"file://{tmp_path}/e")).collect() == []
    for path in (tmp_path / "w").glob("*.warc.gz"):  # a changed byte is found out
        path.write_bytes(gzip.compress(gzip.decompress(path.read_bytes()).replace(b"x" * 10, b"x" * 9 + b"y")))
    with pytest.raises(Exception, match="the header says"):
        warc.digests(manifest).collect()


def brute_quality(text):
    w = [x.decode() for x in words(text)]
    text = text or ""
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


@pytest.mark.parametrize("bits", [20, 3])
def test_quality(make_docs, odd_docs, corpus, monkeypatch, bits):
    """Also with so few bits that most texts take the plain way."""
    monkeypatch.setattr(quality, "PLACE_BITS", bits)
    monkeypatch.setattr(quality, "_PLACE", (1 << bits) - 1)
    for rows in (corpus[0], odd_docs):
        df = make_docs(rows)
        got = quality.judge(df).collect()
        want = Counter((d, *brute_quality(t)) for d, t, *_ in rows)
        assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
        for r in got:
            assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
            assert not (r["kept"] and r["base_failed"])
    assert quality.judge(make_docs([])).collect() == []


def test_hashes_that_agree_in_high_bits(spark):
    """Such hashes are told apart, also where they alternate with real repeats."""
    top = 5 << 40
    hashes = [top + 1, top + 2, top + 1, top + 3, 7, top + 4, 9, 7]
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(hashes, [(x % 1000) << 30 for x in hashes])], "a array<long>, b array<long>")
    got = row.select(quality._packed_places(F.col("a")).alias("x"), quality._plain_places(F.col("a")).alias("y"), quality._packed_places(F.col("b")).alias("z")).first()
    assert got["x"] is None and got["y"] == [0, 2, 4, 7] and got["z"] == [0, 2, 4, 7]


def test_stop_words_count_by_their_share(make_docs):
    few, many = "the of " + " ".join(f"word{i}" for i in range(80)), " ".join(f"the word{i}" for i in range(40))
    got = {r["doc_id"]: (r["n_stop_words"], r["kept"]) for r in quality.judge(make_docs([(1, few, "en", "s"), (2, many, "en", "s")])).collect()}
    assert got == {1: (2, False), 2: (40, True)}


def brute_components(prints, radius):
    ids = [i for i, _ in prints]
    root = {k: k for k in range(len(ids))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= radius:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return {i: min((x for x in groups[find(i)] if ids[i] is not None or True and x is not None), key=lambda x: (x is None, x), default=None) for i in range(len(ids))}


def brute_print(text, n):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(make_docs, odd_docs, corpus):
    rng = random.Random(5)
    base = invented(8, 9)
    near = []
    for t in base:
        for _ in range(6):
            w = t.split()
            w[rng.randrange(len(w))] = "changed"
            near.append(" ".join(w))
    for rows in ([(i, t, "en", "s") for i, t in enumerate(base + near + [base[0].upper()])], odd_docs):
        prints = [(d, brute_print(t, 4)) for d, t, *_ in rows]
        want = brute_components(prints, 4)
        got = simhash.near_duplicates(make_docs(rows), shingle=4).collect()
        assert Counter(map(tuple, got)) == Counter((d, f"{p:016x}", want[i]) for i, (d, p) in enumerate(prints))
    assert simhash.near_duplicates(make_docs([])).collect() == []


def test_forest_joins_what_links_join():
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 2**63, 3, dtype=np.uint64)
    prints = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for c in centre]))
    edges = simhash.forest(prints, simhash._pivot_table(prints), 4)
    assert len(edges) < len(prints)
    assert all(bin(int(prints[a]) ^ int(prints[b])).count("1") <= 4 for a, b in edges)


def test_keep_one(make_docs):
    base = " ".join(f"w{i}" for i in range(300))
    near = base.replace("w150 ", "other ")
    rows = [(3, near, "en", "s"), (2, base, "en", "s"), (5, " ".join(f"v{i}" for i in range(300)), "en", "s"), (6, base, "en", "s"), (7, None, None, None), (8, "", None, None)]
    kept = simhash.keep_one(make_docs(rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 5, 7]
    assert simhash.keep_one(make_docs([])).collect() == []


def test_similar_groups(make_docs, odd_docs):
    """Groups equal those of all pairs at 0.8, and pairs a little below stay apart."""
    rng = random.Random(11)
    rows = list(odd_docs)
    for base in range(12):
        w = [f"b{base}n{i}" for i in range(400)]
        for k in range(8):  # k changed words: similarity (396 - 5k) / (396 + 5k)
            changed = list(w)
            for at in range(k):
                changed[7 + at * 31] = f"x{base}k{k}n{at}"
            rows.append((100 + 10 * base + k, " ".join(changed), "en", "s"))
        for k in (13, 14, 15):
            other = [f"y{base}k{k}n{at // 31}" if at % 31 == 7 else x for at, x in enumerate(w)]
            other[200 : 200 + k] = [f"z{base}k{k}n{i}" for i in range(k)]
            rows.append((400 + 10 * base + k, " ".join(other), "en", "s"))
    rng.shuffle(rows)
    sets = [set(simhash.shingle_set((t or "").encode(), 5).tolist()) for _, t, *_ in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common >= 0.8 * (len(sets[i]) + len(sets[j]) - common):
                group = [group[j] if g == group[i] else g for g in group]
    first = {g: min((d for (d, *_), x in zip(rows, group, strict=True) if x == g and d is not None), default=None) for g in group}
    got = simhash.similar_groups(make_docs(rows)).collect()
    assert Counter(map(tuple, got)) == Counter((d, first[g]) for (d, *_), g in zip(rows, group, strict=True))
    assert len(set(first.values())) > 40


def test_near_copies_among_siblings(make_docs):
    """2,000 texts about 0.72 like each other, and 150 pairs of them with a copy of 0.82 to 0.9."""
    rng = random.Random(31)
    base = [f"b{i}" for i in range(404)]

    def changed(text, n, mark):
        out = list(text)
        for k, place in enumerate(sorted(rng.sample(range(40), n))):
            out[4 + place * 10 + rng.randrange(6)] = f"{mark}x{k}"
        return out

    siblings = [changed(base, 7, f"s{i}") for i in range(2000)]
    copies = [changed(siblings[i * 13], 4 + i % 5, f"c{i}") for i in range(150)]
    sets = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    like = [len(a & b) / len(a | b) for a, b in ((sets(siblings[i * 13]), sets(c)) for i, c in enumerate(copies))]
    rows = [(i, " ".join(w), "en", "a") for i, w in enumerate(siblings + copies)]
    group = dict(simhash.similar_groups(make_docs(rows, clash=False)).collect())
    lost = [i for i, s in enumerate(like) if s >= 0.8 and group[i * 13] != group[2000 + i]]
    assert sum(s >= 0.8 for s in like) > 140 and not lost
    assert len(set(group.values())) > 1900  # the family itself stays apart


def test_pivots_discard_no_near_pair():
    """What the references leave, compared by bits, are all pairs within the limit."""
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, (5, 4), dtype=np.uint64)
    flips = np.packbits(rng.random((300, 256)) < rng.choice([0.02, 0.1, 0.3], (300, 1)), axis=1).view(np.uint64)
    prints = base[rng.integers(0, 5, 300)] ^ flips
    x, y = np.arange(0, 120), np.arange(100, 300)
    want = np.bitwise_count(prints[x][:, None] ^ prints[y][None]).sum(axis=-1) <= 64
    assert (simhash._within(prints, x, y, 64) == want).all() and 0 < want.sum() < want.size


@pytest.mark.parametrize("similarity", [0.8, 0.85, 0.9])
def test_recall_near_the_threshold(make_docs, similarity):
    """Pairs at and a little over a similarity, among texts that share half their words with both: none is lost."""
    rng = random.Random(int(similarity * 100))
    rows, pairs, n = [], [], 120
    for base in range(100):
        w = [f"b{base}n{i}" if i % 2 else f"all{i}" for i in range(n)]
        changed, k = list(w), 0
        sets = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
        while True:  # change words as long as the pair stays similar enough
            more = list(changed)
            more[rng.randrange(n)] = f"x{base}k{k}"
            a, b = sets(w), sets(more)
            if len(a & b) / len(a | b) < similarity:
                break
            changed, k = more, k + 1
        rows += [(2 * base, " ".join(w), "en", "s"), (2 * base + 1, " ".join(changed), "en", "s")]
        pairs.append(2 * base)
    group = dict(simhash.similar_groups(make_docs(rows, clash=False)).collect())
    assert all(group[p] == group[p + 1] == p for p in pairs)


def test_hot_text_is_looked_up_in_parts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LINKS_A_TASK", 3)
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 2**63, 40, dtype=np.uint64)
    sets = {i: np.sort(hashes[i : i + 20]) for i in range(12)}
    edges = spark.createDataFrame([(0, i) for i in range(1, 12)], "a long, b long")
    table = spark.createDataFrame([(k, bytearray(simhash.packed(v))) for k, v in sets.items()], "node long, packed binary")
    got = simhash._looked_up(edges, table, 0.8).where("linked").collect()
    assert sorted(r["b"] for r in got) == [1, 2]  # 19 of 21 and 18 of 22 are shared


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (205, 200), (200, 210)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[101] == 100 and got[205] == got[210] == 200


def brute_lines(rows, ratio, least):
    pages, seen = Counter(), Counter()
    for _, t, _, s in rows:
        pages[s] += 1
        seen.update({(s, x.strip(" ")) for x in (t or "").split("\n") if x.strip(" ") and t is not None})
    out = []
    for d, t, _, s in rows:
        lines = t.split("\n") if t is not None else []
        kept = [x for x in lines if not x.strip(" ") or not (seen[s, x.strip(" ")] >= least and seen[s, x.strip(" ")] > pages[s] * ratio)]
        out.append((d, "\n".join(kept) if t is not None else None, len(lines), len(lines) - len(kept)))
    return out


def clashing(df):
    """``df`` with columns named like those that operators make up."""
    from pyspark.sql import functions as F

    for name in ("bad", "part", "site", "large_site", "kept", "kept_of", "_kept", "times", "mix_id", "row", "copy", "ends", "copies", "__part", "__site", "gone_id", "first_id"):
        df = df.withColumn(name, F.lit(f"own {name}"))
    return df


@pytest.mark.parametrize("shuffled", [False, True])
def test_line_dedup(make_docs, odd_docs, monkeypatch, shuffled):
    if shuffled:
        monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(line_dedup, "PART_PAGES", 3)
    rows = [(i, f"head line\nown {i}\n{'often' if i % 3 else ' rare %d' % i}\nfoot ", "en", ("a", None)[i % 2]) for i in range(40)] + odd_docs
    df = clashing(make_docs(rows))
    got = line_dedup.remove_boilerplate(df, ratio=0.3, least_pages=4)
    assert set(got.columns) == {*df.columns, "kept_text", "n_lines", "n_removed"} and got.select("bad", "part", "site", "large_site").distinct().count() == 1
    assert by_id(tuple(r) for r in got.select("doc_id", "kept_text", "n_lines", "n_removed").collect()) == by_id(brute_lines(rows, 0.3, 4))
    assert line_dedup.remove_boilerplate(make_docs([])).collect() == []


def test_bpe(make_docs, odd_docs, corpus):
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    own.no_padding()
    own.no_truncation()
    for rows in (corpus[0], odd_docs):
        df = make_docs(rows)
        want = [(d, own.encode(t or "", add_special_tokens=False).ids) for d, t, *_ in rows]
        encoded = bpe.encode(df)
        assert by_id((r["doc_id"], list(r["ids"])) for r in encoded.collect()) == by_id(want)
        texts = [(d, own.decode(ids, skip_special_tokens=False)) for d, ids in want]
        assert by_id(bpe.decode(encoded).collect()) == by_id(texts)
        digests = [(d, len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for (d, i), (_, t) in zip(want, texts, strict=True)]
        assert by_id(bpe.round_trip(df).collect()) == by_id(digests)
    assert bpe.encode(make_docs([])).collect() == []


def test_decode_odd_ids(spark):
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [(1, [320, None, 999_999, -1, 49407]), (None, None), (2, []), (2, [])]
    got = bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<long>")).collect()
    assert by_id(got) == by_id([(1, own.decode([320, 999_999, 49407], skip_special_tokens=False)), (None, ""), (2, ""), (2, "")])
    assert bpe.decode(spark.createDataFrame([], "doc_id long, ids array<long>")).collect() == []


def test_bpe_on_odd_strings():
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(2)
    mine = bpe.tokenizer(bpe.VOCABULARY)
    letters = "abcXYZ 's'll''12٣ÄßİΣς  ́é你🙂<|endoftext|>|<>\x00\x1c\t\n"
    for _ in range(500):
        s = "".join(rng.choice(letters) for _ in range(rng.randrange(40))) + rng.choice(["", "<|startoftext|>", "<|EndOfText|>"])
        want = own.encode(s, add_special_tokens=False).ids
        assert np.frombuffer(mine.encode(s), "<u4").tolist() == want, s
        assert mine.decode(mine.encode(s)) == own.decode(want, skip_special_tokens=False)


def page(main, other=""):
    return f"<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><a href='/x'>Menu</a></nav><div class='ad'>Buy {other}</div>{main}<footer>&copy; site</footer></body></html>"


def test_html(spark):
    rows = [
        (1, "http://h/a/1", page("<article><h1>Head &amp; more</h1><p>One\n two&nbsp;x<p><b>three</b> <!-- no -->four<div class='comments'><p>me too</p></div></article>")),
        (2, "http://h/a/2", page("<article><h1>Head &amp; more</h1><p>One\n two&nbsp;x<p><b>three</b> four</article>")),
        (3, "http://h/a/3", page("<div>Site slogan</div><div><p>Own words of page three</p></div>")),
        (4, "http://h/a/4", page("<div>Site slogan</div><div><p>Other words of page four, longer</p></div>")),
        (5, None, None), (6, "", ""), (7, "odd", "<p>cut &am"), (8, "http://g/", "<p>a < b &lt;i&gt;<p>c"), (8, "http://g/", "<p>a < b &lt;i&gt;<p>c"),
    ]
    got = Counter((r["page_id"], r["text"], r["n_chars"]) for r in html_extract.extract(spark.createDataFrame(rows, PAGES)).collect())
    text = "Head & more\nOne two x\nthree four"
    want = [(1, text), (2, text), (3, "Own words of page three"), (4, "Other words of page four, longer"), (5, ""), (6, ""), (7, "cut &am"), (8, "a < b <i>\nc"), (8, "a < b <i>\nc")]
    assert got == Counter((i, t, len(t)) for i, t in want)
    assert html_extract.extract(spark.createDataFrame([], PAGES)).collect() == []


def test_html_shared_lines_decide(spark):
    """A notice inside the article goes, a lead outside stays, copies keep their article."""
    own = ["<p>First words of one", "<p>Quite other words of two", "<p>Third text, as long as the others"]
    rows = [(i, f"http://h/a/{i}", f"<p>Slogan<p>Lead {i}<article><p>Read our notice{text}</article>") for i, text in enumerate(own)]
    rows += [(i, f"http://k/{i}", "<p>Slogan<article><p>A copy of<p>one text</article>") for i in (10, 11)]
    rows += [(20, "http://l/", "<p>Slogan<article><p>Alone</article>")]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, PAGES)).collect()}
    want = {i: f"Lead {i}\n{text[3:]}" for i, text in enumerate(own)} | {10: "A copy of\none text", 11: "A copy of\none text", 20: "Alone"}
    assert got == want


def test_html_is_the_same_at_any_number_of_ranges(spark):
    """Every page meets both neighbours, wherever ranges are cut; without them the notices would stay."""
    rows = [(i, f"http://h{i // 40}/{i:03}", f"<p>Slogan<article><p>Notice {i // 2 % 7}<p>" + f"own words of page {i} " * 9 + "</article>") for i in range(120)] + [(500, None, "<p>x")] * 5
    pages = spark.createDataFrame(rows, PAGES)
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (1, 2, 97):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(Counter((r["page_id"], r["text"]) for r in html_extract.extract(pages).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2] and sum(found[0].values()) == len(rows)
    assert not any("Slogan" in t or "Notice" in t for _, t in found[0])


def test_html_class_names(spark):
    """States of a page in class names leave the text, kinds of content go."""
    rows = [
        (1, "http://a/", "<article class='post comments-open'><p>main one</article>"),
        (2, "http://b/", "<div class='content has-sidebar'><p>main two</div><div class='sidebar-left'>no</div>"),
        (3, "http://c/", "<div class='banner'><article><h1>main</h1><div class='entry-header'>three</div><div class='ad-slot'>no</div></article></div><article class='comment'>no</article>"),
        (4, "http://d/", "<main><p>main four</main><div id=comments><article><p>no</article></div>"),
        (5, "http://e/", "<div>" * 30_000 + "deep" + "</b>" * 30_000),
    ]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {1: "main one", 2: "main two", 3: "main\nthree", 4: "main four", 5: "deep"}


def test_lines_repeated_in_both_pages_are_aligned_fast():
    left, right = html_extract.common_lines(["x"] * 20_000 + ["y"], ["x"] * 20_000)
    assert len(left) == len(right) == 20_000


def test_common_lines(monkeypatch):
    rng = random.Random(4)
    for _ in range(100):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        monkeypatch.setattr(html_extract, "LCS_BITS", rng.choice([1, 9, 1 << 28]))
        left, right = html_extract.common_lines(a, b)
        assert len(left) == len(right) == table[-1][-1]
        assert [a[i] for i in sorted(left)] == [b[j] for j in sorted(right)]
