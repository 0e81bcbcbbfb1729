"""Operators over small tables with nulls, ties, repeated rows, clashing columns and nothing at all."""

import collections
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsignal.llm import decontaminate, embeddings, language, minhash, mixing, quality, suffix_dedup, tokens, toxicity, warc
from docsignal.llm.common import Scratch, components

public = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double"
WORDS = "the and of that which would river stone light paper under green morning window table letter among silver winter garden".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS)[:3] for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(0)
    base = [prose(rng, rng.randint(30, 120)) for _ in range(30)]
    out = [(k, t, "en", f"s{k % 3}", len(t), 0.5) for k, t in enumerate(base)]
    words = base[0].split()
    words[40:41] = ["changed"]
    out += [(100, base[0], "en", "s0", 1, None), (101, " ".join(words), "en", None, 1, None), (102, None, None, "s1", None, None), (103, "", "en", "s2", 0, None), (104, "one", "en", "s2", 0, None), (104, "one", "en", "s2", 0, None), (None, base[1], "en", "s1", 0, None), (105, base[2] + "\n" + base[3] + "\n" + base[3], "en", "s1", 0, None), (106, "ab" * 400, "en", "s9", 0, None), (107, prose(rng, 6000), "en", "s1", 0, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_tokens(spark, docs, rows, none, tmp_path):
    m = tokens.write_shards(spark, docs, f"file://{tmp_path}/t", tokens.tokenizer_path())
    got = sorted(tokens.read_shards(m).collect(), key=lambda r: r.start)
    enc = tokens.Encoder(tokens.tokenizer_path())
    assert [r.doc_id for r in got] == sorted([r[0] for r in rows], key=lambda k: (k is not None, k))
    want = collections.Counter((k, enc.whole(t or "").astype("<u4").tobytes() + b"\2\0\0\0") for k, t, *_ in rows)
    assert collections.Counter((r.doc_id, bytes(r.ids)) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens * 4 == len(r.ids)
        at += r.n_tokens
    flat = np.concatenate([np.frombuffer(r.ids, "<u4") for r in got])
    spots = [0, len(flat) // 2, len(flat) - 1]
    assert tokens.token_at(spark, m, spots) == flat[spots].tolist()
    assert tokens.read_shards(tokens.write_shards(spark, none, f"file://{tmp_path}/e", tokens.tokenizer_path())).count() == 0


def test_other_tokenizer(spark, docs, rows, tmp_path):
    path = public.path("word_bpe_49k.json")
    got = tokens.read_shards(tokens.write_shards(spark, docs, f"file://{tmp_path}/w", path)).where("doc_id = 1").first()
    enc = tokens.Encoder(path)
    assert not enc.plain and np.frombuffer(got.ids, "<u4")[:-1].tolist() == enc.whole(rows[1][1]).tolist()


def test_decontamination(spark, docs, rows, none):
    items = [("a", " ".join(rows[4][1].split()[3:25])), ("b", "One"), ("c", None), ("d", ""), (None, rows[5][1][:300]), ("e", rows[6][1]), ("e", rows[6][1])]
    bench = spark.createDataFrame(items, "item_id string, text string")
    for block in (20, 100_000):
        got = decontaminate.find_contamination(spark, docs, bench, block_words=block).collect()
        truth = collections.Counter((k, n, h, tuple(x)) for (k, *_), (n, h, x) in zip(rows, decontaminate.brute_force([r[1] for r in rows], items)))
        assert collections.Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == truth
    assert sum(n > 0 for _, _, n, _ in truth) >= 4
    assert decontaminate.find_contamination(spark, none, bench).count() == 0
    clean = decontaminate.find_contamination(spark, docs, bench.limit(0)).agg(F.sum("n_hit")).first()[0]
    assert clean == 0


def test_remove_spans(spark, none):
    passage = " ".join(f"w{k}" for k in range(13))
    long = " ".join(f"z{k}" for k in range(400))
    df = spark.createDataFrame([(1, f"Keep, {long}. {passage}! End", "en", "s", 1, None), (2, passage, "en", "s", 1, None), (3, "Clean  text\n", "en", "s", 1, None), (4, None, None, None, None, None)], DOCS)
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = {r.doc_id: r.text for r in decontaminate.remove_spans(spark, df, bench).collect()}
    assert got == {1: f"Keep, {long}. ! End", 3: "Clean  text\n", 4: None}
    assert decontaminate.remove_spans(spark, none, bench).count() == 0


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def truth_targets(sizes, share=1.5, most=2, weights=(5, 2, 1)):
    """Iterated resharing, as a plain loop."""
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        part = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if part[s] > most * sizes[s]]
        if not over:
            return out | part
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
            open_.remove(s)
    return out


def test_mixing(spark, docs, rows, none):
    got = mixing.mix(spark, docs, bins=4).collect()
    again = mixing.mix(spark, docs.repartition(7), bins=4).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    sizes = collections.Counter()
    for _, t, _, s, *_ in rows:
        sizes[s] += size(t)
    want = truth_targets(sizes)
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    for s, n in want.items():
        # whole documents: what is open is less than any document left out
        part = [r for r in got if r.source == s and r.size]
        top = {len(bin(r.size)): max(x.copies for x in part if len(bin(x.size)) == len(bin(r.size))) for r in part}
        open_ = [r.size for r in part if r.copies < top[len(bin(r.size))]]
        assert abs(taken[s] - n) <= max(0.005 * n, min([max(size(t) for _, t, _, x, *_ in rows if x == s), *open_])) + 1, (s, taken[s], n)
    assert mixing.mix(spark, none).count() == 0
    copies = mixing.apply_mix(docs, mixing.mix(spark, docs, bins=4))
    assert copies.columns == docs.columns and copies.count() == sum(r.copies for r in got)


def test_mixing_unequal_weights(spark):
    """A document twice as heavy is taken twice as often, over seeds."""
    df = spark.createDataFrame([(k, "w " * 10, None, "s", 1, 1.0 if k % 2 else 2.0) for k in range(40)], DOCS)
    n = collections.Counter()
    for seed in range(6):
        for r in mixing.mix(spark, df, share=0.3, seed=seed, weight="score", bins=8, fill=0).where("taken > 0").collect():
            n[r.doc_id % 2] += 1
    assert sum(n.values()) == 6 * 12 and 1.3 < n[0] / n[1] < 3.2


def test_mixing_inclusion_frequencies(spark):
    """As registered: over many sources of the same documents, each size is taken about as often as its weight says, at fixed size."""
    rng = random.Random(2)
    sizes = [rng.choice([3, 12, 60, 200, 700]) for _ in range(700)]
    sources = 24
    df = spark.createDataFrame([(1000 * s + k, "w " * n, None, f"s{s:03}", 1, 0.0) for s in range(sources) for k, n in enumerate(sizes)], DOCS)
    got = mixing.mix(spark, df).collect()
    target = {r.source: r.target for r in got}
    for level in sorted(set(target.values())):
        group = [s for s, t in target.items() if t == level]
        # expected copies by brute force: the level of the weights at which they give the target
        lo, hi = 0.0, 10.0
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(n * min(2, mid * n.bit_length()) for n in sizes) < level else (lo, mid)
        for n in sorted(set(sizes)):
            copies = [r.copies for r in got if r.target == level and r.size == n]
            rate = min(2, lo * n.bit_length())
            p = max(0.0, rate - int(rate + 1e-9))
            assert set(copies) <= {int(rate + 1e-9), int(rate + 1e-9) + 1}
            assert abs(sum(copies) / len(copies) - rate) <= 4 * (p * (1 - p) / len(copies)) ** 0.5 + 0.02, (level, n, sum(copies) / len(copies), rate)
        for s in group:
            taken = sum(r.taken for r in got if r.source == s)
            assert abs(taken - level) <= max(0.005 * level, max(sizes))


def test_mixing_same_text_in_two_sources(spark):
    """A row finds the copies of its own source."""
    df = spark.createDataFrame([(1, "a b c", None, "s0", 1, 0.0), (1, "a b c", None, "s1", 1, 0.0), (2, "d e f " * 50, None, "s1", 1, 0.0)], DOCS)
    m = mixing.mix(spark, df)
    n = {(r.doc_id, r.source): r.copies for r in m.collect()}
    got = collections.Counter((r.doc_id, r.source) for r in mixing.apply_mix(df, m).collect())
    assert got == collections.Counter({k: v for k, v in n.items() if v})


def truth_components(rows, link=85):
    return collections.Counter(truth_rows(rows, link))


def truth_rows(rows, link=85):
    os.sys.path.insert(0, os.path.dirname(__file__))
    from test_core import truth_shingles

    sets = [truth_shingles(t) for _, t, *_ in rows]
    up = list(range(len(rows)))

    def root(x):
        return x if up[x] == x else root(up[x])

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= link * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    out = []
    for i in range(len(rows)):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((rows[i][0], len(sets[i]), min(ids) if ids else None))
    return out


def test_minhash(spark, docs, rows, none):
    os.sys.path.insert(0, os.path.dirname(__file__))
    got = minhash.near_duplicates(spark, docs, chunk=2, block=2).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == truth_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert minhash.near_duplicates(spark, none).count() == 0
    left = minhash.deduplicate(spark, docs)
    assert left.columns == docs.columns and sorted(str(r.doc_id) for r in left.collect()) == sorted({str(r.doc_id) for r in got if r.kept})


def test_clashing_names(spark, rows):
    """Columns named like those the operators use inside stay as they are."""
    names = ["d", "h", "n", "k", "c1", "bucket", "dk", "at", "size", "target", "key", "label", "stats", "pivot", "ranges", "items", "n_tokens"]
    df = spark.createDataFrame([(*r, *(["x"] * len(names))) for r in rows], DOCS + "".join(f", {n} string" for n in names))
    bench = spark.createDataFrame([("a", rows[4][1])], "item_id string, text string")
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    for out in (minhash.deduplicate(spark, df), mixing.apply_mix(df, mixing.mix(spark, df)), decontaminate.remove_spans(spark, df, bench), toxicity.score(spark, df, toxicity.train(spark, df, labels)), quality.score(spark, df, quality.train(spark, df, labels)), language.predict(spark, df, language.train(spark, df))):
        assert set(df.columns) <= {*out.columns, "stats"}
        assert {r.h for r in out.select("h").distinct().collect()} == {"x"}
    assert suffix_dedup.remove_repeats(spark, df).count() == len(rows)


def test_minhash_family(spark):
    """Near copies of near copies, most pairs below the threshold: components need links beyond a pivot."""
    os.sys.path.insert(0, os.path.dirname(__file__))
    rng = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(len(w))] = f"x{rng.random()}"
        rows.append((k, " ".join(w), "en", "s", 1, None))
    got = minhash.near_duplicates(spark, spark.createDataFrame(rows, DOCS), chunk=8, block=8).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == truth_components(rows)


def test_minhash_few_links_take_no_rounds(spark, monkeypatch):
    """Few links need no tables of rounds, each with a file a partition; more links go through those to the same components."""
    rng = random.Random(8)
    long = [[f"w{k}x{i}" for i in range(140)] for k in range(2)]
    rows = [(k, " ".join(long[k % 2][k : k + 60]), "en", "s", 1, None) for k in range(80)] + [(200 + k, prose(rng, 40), "en", "s", 1, None) for k in range(5)]
    rng.shuffle(rows)
    df, save, saved = spark.createDataFrame(rows, DOCS), Scratch.save, []
    monkeypatch.setattr(Scratch, "save", lambda self, df, name, *a, **k: (saved.append(name), save(self, df, name, *a, **k))[1])
    tables = []
    for most in (1 << 18, 0):
        monkeypatch.setattr(minhash, "DRIVER_LINKS", most, raising=False)
        saved.clear()
        got = minhash.near_duplicates(spark, df, chunk=8, block=8).collect()
        assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == truth_components(rows)
        tables.append(len(saved))
    assert tables[0] <= 15 < tables[1]


def test_near_duplicate_stage_links_at_80(spark):
    """One changed word leaves 40 of 50 shingles common in texts of 49 words, 45 of 55 in 54 words and 39 of 49 in 48 words."""
    import corpus_pipeline

    for link in (80, 85):
        bands, size = minhash.banding(link)
        assert bands * size == 2 * minhash.PERMS and 1 - (1 - (link / 100) ** size) ** bands > 0.9999
    rows = []
    for k in range(30):
        words = [f"w{k}x{i}" for i in range((49, 54, 48)[k % 3])]
        rows += [(2 * k, " ".join(words), "en", "s", 1, None), (2 * k + 1, " ".join([*words[:20], "changed", *words[21:]]), "en", "s", 1, None)]
    df = spark.createDataFrame(rows, DOCS)
    want = {d for d, *_ in rows if d % 2 == 0 or d // 2 % 3 == 2}
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()} == want
    assert {r.doc_id for r in minhash.deduplicate(spark, df).collect()} == want
    assert minhash.deduplicate(spark, df, 85).count() == len(rows)


def test_minhash_patterned_words(spark):
    """Long words of one pattern, which weak hashes confuse, share nothing."""
    from test_core import thue_morse

    rows = [(k, t) for k, t in enumerate([thue_morse(10), thue_morse(10, True), thue_morse(12), thue_morse(12, True), "x " + thue_morse(11), "x " + thue_morse(11, True)])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in minhash.near_duplicates(spark, df).collect()} == set(range(6))
    assert minhash.deduplicate(spark, df).count() == 6
    kept = suffix_dedup.remove_repeats(spark, df).collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans) for r in sorted(kept, key=lambda r: r.doc_id)] == [x[:3] for x in suffix_dedup.brute_force([t for _, t in rows])]
    items = [("a", rows[0][1]), ("b", rows[3][1])]
    hits = decontaminate.find_contamination(spark, df, spark.createDataFrame(items, "item_id string, text string")).collect()
    assert {r.doc_id: r["items"] for r in hits if r.n_hit} == {0: ["a"], 3: ["b"]}


def test_minhash_null_and_repeated_ids(spark):
    """Texts follow their class: ids that are null or the same for many texts add no rows and no wrong links."""
    rng = random.Random(6)
    family = [prose(rng, 60) for _ in range(40)]
    rows = [(None, family[k % 40] + (" tail" if k % 3 else "")) for k in range(3000)] + [(7, t + " more") for t in family] + [(8, family[0]), (8, family[0]), (9, None), (9, None)]
    rows = [(d, t, "en", "s", 1, 0.0) for d, t in rows]
    df = spark.createDataFrame(rows, DOCS)
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark, df).collect())
    distinct = sorted({(d, t) for d, t, *_ in rows}, key=str)
    want = collections.Counter()
    by = {(d, t): (d, n, c) for (d, t), (d, n, c) in zip(distinct, truth_rows([(d, t) for d, t in distinct]))}
    for d, t, *_ in rows:
        want[by[d, t]] += 1
    assert got == want
    left = minhash.deduplicate(spark, df).collect()
    assert collections.Counter(r.doc_id for r in left) == {7: 40, 9: 2} and sum(n for _, n in collections.Counter((r.doc_id, r.text) for r in left if r.text).items()) == 40


def test_helper_names_stay(spark):
    names = ["class", "CLASS_", "one", "doc", "many", "copies", "copy", "__id", "__hash", "__n", "__copy", "k", "doc_key", "component_id", "n_shingles"]
    rows = [(1, "a b c", "s", *["x"] * len(names)), (2, "a b c", "s", *["x"] * len(names)), (2, "a b c", "s", *["x"] * len(names)), (None, "q", None, *["x"] * len(names))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string" + "".join(f", `{n}` string" for n in names))
    left = minhash.deduplicate(spark, df)
    assert left.columns == df.columns and sorted(str(r.doc_id) for r in left.collect()) == ["1", "None"]
    assert mixing.apply_mix(df, mixing.mix(spark, df)).columns == df.columns


def test_components(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(40)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        return x if up[x] == x else root(up[x])

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.comp for r in components(spark, spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark, spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_warc(spark, tmp_path):
    pages = [(1, "http://a", "<p>same"), (5, "http://b", "<p>same"), (3, None, "<p>same"), (2, "http://c", None), (4, "http://d", ""), (6, "u", "é" * 100_000), (None, "n", "<p>same"), (7, "x", "only")]
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, payload string")
    m = warc.write_archives(spark, df.repartition(2), f"file://{tmp_path}/w", archive_mb=1)
    got = warc.read_archives(m, step=100).collect()
    import base64
    import hashlib

    top = {}
    for k, _, h in pages:
        top[h or ""] = max(top.get(h or "", -1), k if k is not None else -1)
    count = collections.Counter(h or "" for _, _, h in pages)
    want = []
    for k, _, h in pages:
        h = h or ""
        revisit = count[h] > 1 and k != top[h]
        want.append((k, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "revisit" if revisit else "response", top[h] if revisit else None))
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == collections.Counter(want)
    for r in got:
        assert (r.payload is None) == (r.record_type == "revisit")
    small = warc.read_archives(warc.write_archives(spark, df, f"file://{tmp_path}/s", least_bytes=5))
    assert sorted(r.page_id for r in small.where("record_type = 'revisit'").collect() if r.page_id) == [1, 3]
    assert warc.read_archives(warc.write_archives(spark, df.limit(0), f"file://{tmp_path}/e")).count() == 0


def test_suffix(spark, docs, rows, none):
    got = suffix_dedup.remove_repeats(spark, docs)
    got = got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("s")).collect()
    want = collections.Counter((r[0], *t) for r, t in zip(rows, suffix_dedup.brute_force([r[1] for r in rows])))
    assert collections.Counter(tuple(r) for r in got) == want
    assert sum(1 for r in got if r.n_removed) >= 6
    assert suffix_dedup.remove_repeats(spark, none).count() == 0


def test_suffix_edits(spark):
    """Shared passages cut at all places, low variety, repeats within one text."""
    rng = random.Random(9)
    shared = prose(rng, 120)
    rows = []
    for k in range(40):
        a, b = sorted(rng.sample(range(len(shared)), 2))
        rows.append((k, prose(rng, 20) + shared[a:b] + rng.choice(["", "é", shared[a : a + 210], "ab" * 150, "abcdefg " * 60]) + prose(rng, rng.randint(0, 20)), "en", "s", 1, None))
    truth = collections.Counter((r[0], *t) for r, t in zip(rows, suffix_dedup.brute_force([r[1] for r in rows])))
    for hot in (suffix_dedup.HOT, 3000, 0):  # by bytes, both ways, by identifiers
        got = suffix_dedup.remove_repeats(spark, spark.createDataFrame(rows, DOCS), hot)
        got = collections.Counter(tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect())
        assert got == truth


def test_suffix_long_text_in_pieces(spark, monkeypatch):
    rng = random.Random(2)
    part = prose(rng, 2000)
    rows = [(1, part + prose(rng, 60_000) + part[:5000], "en", "s", 1, None), (2, "x" + part[100:900], "en", "s", 1, None)]
    got = suffix_dedup.remove_repeats(spark, spark.createDataFrame(rows, DOCS)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert collections.Counter(tuple(r) for r in got) == collections.Counter((r[0], *t) for r, t in zip(rows, suffix_dedup.brute_force([r[1] for r in rows])))


def usable(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 16))
    rows = [(k, [float(np.float32(v)) for v in base[k % 40] + rng.normal(size=16) * 0.05], k % 3) for k in range(200)]
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] * 16, 1), (203, [None] * 16, 1), (204, rows[0][1], None), (205, rows[0][1], 0), (206, rows[0][1], 0), (206, rows[0][1], 0), (207, [], 1), (208, [2 * v for v in rows[1][1]], 1), (None, rows[2][1], 2), (209, [1e308] * 16, 1), (210, [1e308] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for kw in ({}, {"cell": 4, "most_shard": 1000}, {"cell": 12, "most_shard": 6}):
        res = embeddings.near_duplicates(spark, df, **kw)
        got = res.collect()
        good = [k is not None and lab is not None and usable(v) for k, v, lab in rows]
        x = np.array([embeddings.unit(np.array(v, float)[None])[0] if g else np.zeros(16) for (_, v, _), g in zip(rows, good)])
        near = (x @ x.T >= 0.93) & np.array([[g and h and a[2] == b[2] for b, h in zip(rows, good)] for a, g in zip(rows, good)])
        np.fill_diagonal(near, False)
        links = collections.Counter()
        for r in got:
            links[r.vec_id] += r.n_links
        want = collections.Counter()
        for (k, *_), n in zip(rows, near.sum(1)):
            want[k] += int(n)
        if "cell" not in kw:
            assert links == want
        assert sum(links.values()) >= 0.97 * sum(want.values()) and all(links[k] <= want[k] for k in want)
        for r in got:
            assert r.kept == (r.vec_id == r.component_id)
        by = {r.vec_id: r.component_id for r in got}
        assert by[206] == by[205] == by[0] == 0 and by[200] == 200 and by[204] == 204
    found, true = embeddings.recall(df, embeddings.near_duplicates(spark, df), every=10)
    assert found >= 0.9 * true > 0
    assert embeddings.near_duplicates(spark, df.limit(0)).count() == 0


def test_toxicity(spark, none):
    rng = random.Random(1)
    rows = [(k, prose(rng, 40) + (" gromble flarg " if k % 4 == 0 else " "), None, "s", 1, 0.0) for k in range(400)]
    df = spark.createDataFrame(rows + [(900, None, None, None, None, None), (901, "", None, None, None, None)], DOCS).withColumn("toxic_score", F.lit(9.0))
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(400)] + [(3, 0, 5), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    m = toxicity.train(spark, df, labels)
    scored = toxicity.score(spark, df, m)
    assert scored.columns == [*df.columns, "toxic_score_"] and {r.toxic_score for r in scored.select("toxic_score").distinct().collect()} == {9.0}
    out = {r.doc_id: r.toxic_score_ for r in scored.collect()}
    assert min(v for k, v in out.items() if k % 4 == 0 and k < 400) > 0.7 > max(v for k, v in out.items() if k % 4 and k < 400)
    assert 0 <= out[900] == out[901] < 0.7
    assert toxicity.score(spark, none, m).count() == 0
    assert toxicity.score(spark, df, toxicity.train(spark, df, labels.limit(0))).count() == 402


def test_quality(spark, none):
    rng = random.Random(1)
    junk = lambda: "\n".join([prose(rng, 5).upper() + "!!"] * 8)
    rows = [(k, junk() if k % 3 == 0 else prose(rng, 60), None, "s", 1, 0.0) for k in range(300)] + [(900, None, None, None, None, None), (901, "", None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(300)], "doc_id long, quality int, toxic int")
    f = quality.train(spark, df, labels)
    out = {r.doc_id: r.quality_score for r in quality.score(spark, df, f).collect()}
    assert max(v for k, v in out.items() if k % 3 == 0 and k < 300) < 0.3 < min(v for k, v in out.items() if k % 3 and k < 300)
    assert out[900] == out[901]
    assert quality.score(spark, none, f).count() == 0
    assert quality.score(spark, df, quality.train(spark, df, labels.limit(0))).count() == 302


def test_language(spark, none):
    rng = random.Random(1)
    other = ["zvok", "brda", "hlavn", "krasn", "mesto", "voda"]
    rows = [(k, prose(rng, 40) if k % 2 else " ".join(rng.choice(other) + rng.choice(other) for _ in range(40)), "en" if k % 2 else "xx", "s", 1, 0.0) for k in range(200)]
    rows += [(900, None, "en", None, None, None), (901, "123 !?", "en", None, None, None), (902, "日本", None, None, None, None), (903, "a", None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    f = language.train(spark, df)
    assert f.langs == ["en", "xx"]
    out = {r.doc_id: (r.lang_pred, r.lang_score) for r in language.predict(spark, df, f).collect()}
    assert all(out[k][0] == ("en" if k % 2 else "xx") and out[k][1] > 0.8 for k in range(200))
    assert out[900] == out[901] == ("und", 0.0) and out[902][0] in f.langs and 0 <= out[903][1] <= 1
    assert language.predict(spark, none, f).count() == 0
    empty = language.train(spark, none)
    assert {r.lang_pred for r in language.predict(spark, df, empty).collect()} == {"und"}


def test_scores_of_repeated_rows_ties_and_clashes(spark):
    """One labelled id on thousands of rows is learnt from once; equal texts score alike; a caller's columns stay."""
    rng = random.Random(3)
    rows = [(k, prose(rng, 30) + (" gromble" if k % 4 == 0 else ""), "en" if k % 2 else "xx") for k in range(200)]
    hot = next(k for k in range(200) if zlib.crc32(str(k).encode()) % 3 != 1)
    rows += [(hot, prose(rng, 5) + f" {k}", "en") for k in range(3000)] + [(1000 + k, rows[k % 7][1], None) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for name in ("toxic_score", "quality_score", "stats", "lang_pred", "lang_score", "label", "terms"):
        df = df.withColumn(name, F.lit("mine"))
    labels = spark.createDataFrame([(k, int(k % 4 > 0), int(k % 4 == 0)) for k in range(200)] * 2, "doc_id long, quality int, toxic int")
    sample, _ = toxicity.sample_labels(labels, "toxic", 3, 1, 1000)
    assert toxicity.sampled_documents(df, sample).count() > 3000
    for out in (toxicity.score(spark, df, toxicity.train(spark, df, labels)), quality.score(spark, df, quality.train(spark, df, labels)), language.predict(spark, df, language.train(spark, df))):
        assert out.columns[: len(df.columns)] == df.columns and len(out.columns) - len(df.columns) in (1, 2)
        got = out.collect()
        assert len(got) == len(rows) and all(r.toxic_score == r.lang_pred == r.stats == "mine" for r in got)
        by = {}
        for r in got:
            assert by.setdefault(r.text, tuple(r)[len(df.columns) :]) == tuple(r)[len(df.columns) :]


def plain_toxicity(m, text):
    """A text's score by loops over its words and their pairs."""
    from docsignal.llm import common

    def bucket(word, prefix=False):
        data = np.frombuffer(word, np.uint8)
        h = common.span_hashes(data, np.array([0]), np.array([len(data)]))
        return int((common.mix64(h ^ np.uint64(0x5BF03635)) if prefix else h)[0]) >> (64 - toxicity.BITS)

    words = re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").encode())
    have = sorted({b for w in set(words) for b in [bucket(w)] + ([bucket(w[:4], True)] if len(w) >= 6 else []) if m.slot[b] >= 0})
    z = m.b + sum(m.w[m.slot[b]] for b in have) + sum(float(m.v[m.slot[a]] @ m.v[m.slot[b]]) for i, a in enumerate(have) for b in have[:i])
    return 1 / (1 + np.exp(-max(-40, min(40, z))))


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline(spark):
    import corpus_pipeline as p

    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == docs.columns, name
            docs = Scratch(spark, "t").save(out, name)
            kept.append(docs)
    tok, enc = out.collect(), tokens.Encoder(tokens.tokenizer_path())
    last = kept[-1].collect()
    assert collections.Counter((r.doc_id, r.n_tokens) for r in tok) == collections.Counter((r.doc_id, len(enc.whole(r.text)) + 1) for r in last)
    a, b = kept[0].collect(), kept[1].collect()
    machine = toxicity.train(spark, spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    whole = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert {r.doc_id for r in a} == {r.doc_id for r in whole if plain_toxicity(machine, r.text) < 0.7}
    truth = truth_components([(r.doc_id, r.text) for r in a], minhash.NEAR_OF_100)
    assert sorted(r.doc_id for r in b) == sorted({c for (_, _, c) in truth})
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = decontaminate.find_contamination(spark, kept[1], spark.createDataFrame(items, "item_id string, text string")).collect()
    gone = {r.doc_id for r in hits if r.n_hit and 20 * r.n_hit >= r.n_words}
    assert {r.doc_id for r in kept[2].collect()} == {r.doc_id for r in b} - gone
    # the mix: copies by the level at which a source's documents, weighed by the digits of their size, give its target
    sources, copies = collections.defaultdict(list), collections.Counter(r.doc_id for r in last)
    for r in kept[2].collect():
        sources[r.source].append((r.doc_id, size(r.text)))
    for s, target in truth_targets({s: sum(n for _, n in x) for s, x in sources.items()}).items():
        lo, hi = 0.0, 10.0
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(n * min(2, mid * max(1, n.bit_length())) for _, n in sources[s]) < target else (lo, mid)
        for d, n in sources[s]:
            rate = min(2, lo * max(1, n.bit_length()))
            assert copies[d] in {int(rate + 1e-6), int(rate + 1e-6) + 1}
        assert abs(sum(copies[d] * n for d, n in sources[s]) - target) <= max([0.005 * target, *(n for _, n in sources[s])])
    again = sorted(tuple(r) for r in p.run(spark, SF).collect())
    assert again == sorted(tuple(r) for r in tok)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_toxicity_query_equals_brute_force(spark):
    """op2 against loops over words and pairs of words."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    m = toxicity.train(spark, docs, labels)
    got = {r.doc_id: r for r in toxicity.op2(spark, SF).collect()}

    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        x = got[r.doc_id]
        assert x.score == pytest.approx(plain_toxicity(m, r.text), abs=1e-9)
        assert x.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and x.predicted == int(x.score >= 0.7)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_quality_query_equals_brute_force(spark):
    """op8 against trees walked node by node over the statistics of each text alone."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    f = quality.train(spark, docs, labels)
    got = {r.doc_id: r for r in quality.op8(spark, SF).collect()}
    inner = f.feature.shape[1]
    for r in docs.collect():
        raw = np.frombuffer((r.text or "").encode(), np.uint8)
        stats = quality.statistics(raw, np.array([0, len(raw)]))[0]
        z = f.base
        for t in range(len(f.feature)):
            at = 0
            while at < inner:
                at = 2 * at + (2 if stats[f.feature[t, at]] > f.threshold[t, at] else 1)
            z += f.leaf[t, at - inner]
        x = got[r.doc_id]
        assert x.score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)
        assert x.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and x.predicted == int(x.score >= 0.3)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_language_query_equals_brute_force(spark):
    """op9 against sets of the n-grams of the fitted documents, without filters."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in language.op9(spark, SF).collect()}

    def grams(text):
        b = re.sub(rb"[^A-Za-z\x80-\xff]", b" ", (text or "").encode()).lower()
        return [b[k : k + 4] for k in range(len(b) - 3) if b"  " not in b[k : k + 4]]

    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows}
    fitted = [r for r in rows if r.lang is not None and r.text is not None and not held[r.doc_id]]
    langs = sorted({r.lang for r in fitted})
    df = {k: collections.Counter(g for r in fitted if r.lang == k for g in set(grams(r.text))) for k in langs}
    least = {k: max(1, int(np.ceil(language.OFTEN * sum(r.lang == k for r in fitted)))) for k in langs}
    same = n = 0
    for r in rows:
        x, g = got[r.doc_id], grams(r.text)
        assert x.held_out == held[r.doc_id] and (x.lang_pred in langs or x.lang_pred == "und")
        if not any(c.isalpha() for c in r.text or ""):
            assert (x.lang_pred, x.score) == ("und", 0.0)
        elif g:
            want = max(langs, key=lambda k: sum((y in df[k]) + (df[k][y] >= least[k]) for y in g))
            n, same = n + 1, same + (want == x.lang_pred)
            assert x.score == pytest.approx(sum(y in df[x.lang_pred] for y in g) / len(g), abs=0.02)
    assert n > 100 and same >= 0.99 * n


def test_embeddings_of_large_shards(spark):
    """More nodes than a shard holds, half of them in one dense group: cells are split again, the group is searched block by block."""
    rng = np.random.default_rng(5)
    dense = rng.normal(size=24) + rng.normal(size=(3500, 24)) * 0.16
    near = np.repeat(rng.normal(size=(900, 24)), 4, 0) + rng.normal(size=(3600, 24)) * 0.1
    x = embeddings.unit(np.concatenate([dense, near]))
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(4)
    out = embeddings.near_duplicates(spark, df, most_shard=1500).cache()
    found, true = embeddings.recall(df, out)
    assert found >= 0.9 * true > 1000
    got = {r.vec_id: r for r in out.collect()}
    sim = x @ x.T >= 0.93
    np.fill_diagonal(sim, False)
    want = sim.sum(1)
    n = np.array([got[k].n_links for k in range(len(x))])
    assert (n <= want).all() and n[:3500].sum() >= 0.95 * want[:3500].sum() and n[3500:].sum() >= 0.95 * want[3500:].sum()


def test_very_long_texts(spark, tmp_path):
    """A text of several megabytes is used whole by every operator: what lies at its end counts."""
    rng = random.Random(12)
    words = [rng.choice(WORDS) + rng.choice(WORDS)[:3] for _ in range(3000)]
    long = " ".join(rng.choice(words) for _ in range(500_000))
    passage = " ".join(f"item{k}" for k in range(20))
    rows = [(1, long + " " + passage, "en", "s", 1, 0.0), (2, "short " + passage, "en", "s", 1, 0.0), (3, long + " " + passage + " and more", "en", "s", 1, 0.0)]
    df = spark.createDataFrame(rows, DOCS)
    hit = {r.doc_id: (r.n_words, r.n_hit) for r in decontaminate.find_contamination(spark, df, spark.createDataFrame([("a", passage)], "item_id string, text string")).collect()}
    assert hit == {1: (500_020, 20), 2: (21, 20), 3: (500_022, 20)}
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(spark, df).collect()} == {1: 1, 2: 2, 3: 1}
    m = tokens.write_shards(spark, df, f"file://{tmp_path}/t", tokens.tokenizer_path())
    enc = tokens.Encoder(tokens.tokenizer_path())
    assert {r.doc_id: np.frombuffer(r.ids, "<u4")[:-1].tolist() for r in tokens.read_shards(m).where("doc_id > 1").collect()} == {k: enc.whole(t).tolist() for k, t, *_ in rows[1:]}
    kept = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(spark, df).collect()}
    shared = len(rows[0][1])
    assert kept == {1: (shared, shared), 2: (len(rows[1][1]), 0), 3: (len(rows[2][1]), shared)}
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    for out in (toxicity.score(spark, df, toxicity.train(spark, df, labels)), quality.score(spark, df, quality.train(spark, df, labels)), language.predict(spark, df, language.train(spark, df))):
        assert all(0 <= r[-1] <= 1 for r in out.collect())
    assert {r.doc_id: r.size for r in mixing.mix(spark, df).collect()} == {1: 500_020, 2: 21, 3: 500_022}


def test_tokens_of_hot_ids(spark, tmp_path):
    """Null ids, or one id on most rows, are dealt to several parts, and the order of starts stays that of (doc_id, checksum)."""
    rows = [(None, f"null {k % 700}") for k in range(3000)] + [(7, f"seven {k}") for k in range(4000)] + [(k, f"own {k}") for k in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    m = tokens.write_shards(spark, df, f"file://{tmp_path}/t", tokens.tokenizer_path())
    shards = m.orderBy("shard").collect()
    assert [r.shard for r in shards] == list(range(len(shards))) and len(shards) >= 4 and max(r.documents for r in shards) < 5000
    got = sorted(tokens.read_shards(m).collect(), key=lambda r: r.start)
    key = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert key == sorted(key) and len(got) == len(rows)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    enc = tokens.Encoder(tokens.tokenizer_path())
    assert collections.Counter((r.doc_id, bytes(r.ids)) for r in got) == collections.Counter((k, np.append(enc.whole(t), 2).astype("<u4").tobytes()) for k, t in rows)
    total = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert tokens.write_shards(spark, total.where("doc_id < 0"), f"file://{tmp_path}/n", tokens.tokenizer_path()).count() == 0
