"""Functions of the training-data operators without Spark, against plain Python."""

import io
import collections
import random
import re
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest

from docsignal.llm import common, decontaminate, embeddings, language, minhash, quality, suffix_dedup, tokens, toxicity, warc

public = pytest.importorskip("public_tokenizers")


def buffers(texts):
    raw = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])


@pytest.mark.parametrize(("flags", "pattern"), [(common.NOT_SPACE, rb"[^\x20\x09-\x0D]+"), (common.ALNUM, rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")])
def test_word_spans(flags, pattern):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aB9 \t\n.é_/日") for _ in range(rng.randint(0, 12))) for _ in range(200)]
    data, off = buffers(texts)
    s, e, d = common.word_spans(data, off, flags)
    got = [(int(k), data[a:b].tobytes()) for a, b, k in zip(s, e, d)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in re.findall(pattern, t.encode())]
    h = common.span_hashes(data, s, e, piece=16)
    assert (h == common.span_hashes(data, s, e)).all()
    fold = {}
    for (_, w), x in zip(got, h.tolist()):
        assert fold.setdefault(w.lower(), x) == x
    assert len(set(fold.values())) == len(fold)


def test_text_slices():
    col = pa.array(["ab", None, "", "é" * 50, "c"])
    for c in (col, col.slice(1), pa.chunked_array([col])):
        want = [t or "" for t in c.to_pylist()]
        got = []
        for i, j, data, off in common.text_slices(c, 8):
            got += [data[a:b].tobytes().decode() for a, b in zip(off, off[1:])]
            assert j - i == len(off) - 1
        assert got == want
    assert list(common.text_slices(pa.array([], pa.string()))) == []


def test_token_pieces_equal_whole_texts():
    enc, rng = tokens.Encoder(public.path("byte_bpe_50k.json"), most=300), random.Random(1)
    marks = ["a", "B", "é", " ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "'d", "1", "23", ".", "!?", "-", "x", "the", "×", "€", "\x1f", "日", "<|endoftext|>"]
    for rep in range(40):
        texts = ["".join(rng.choice(marks[: 19 if rep % 2 else None]) for _ in range(rng.randint(0, 25))) for _ in range(40)]
        data, off = buffers(texts)
        flat, sizes = enc.encode(data, off)
        cut = np.concatenate([[0], np.cumsum(sizes)])
        for k, t in enumerate(texts):
            assert np.array_equal(enc.whole(t), flat[cut[k] : cut[k + 1]]), repr(t)


def test_added_tokens_as_a_plain_tokenizer():
    """Against a tokenizer of its own, with nothing set; strings over the border of two texts are not such tokens."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = ["one doc" + end + "next", "plain text", end, "", end + end + " x", "a <|endof", "text|> b", "é " + end, "<|endoftext|", ">", "日" + end, "no such token"]
    enc = tokens.Encoder(public.path("byte_bpe_50k.json"))
    data, off = buffers(texts)
    flat, sizes = enc.encode(data, off)
    cut = np.concatenate([[0], np.cumsum(sizes)])
    for k, t in enumerate(texts):
        assert flat[cut[k] : cut[k + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids, t
    assert 50256 in flat


@pytest.mark.parametrize("width", [1, 4, 7, 8, 11, 16])
def test_codes(width):
    v = np.random.default_rng(width).integers(0, 70_000, 3000).astype(np.uint32)
    v[:5] = [0, 1, 255, 256, 65_536]
    s = tokens.Shard(tokens.encode_shard([7, None, 9], np.array([1000, 0, 2000]), v, width))
    at = np.random.default_rng(0).permutation(3000)
    assert (s[at] == v[at]).all() and (s.range(0, 3000) == v).all() and (s.range(17, 2999) == v[17:2999]).all()
    assert (s.document(2) == v[1000:]).all() and len(s.document(1)) == 0 and s.nulls.tolist() == [0, 1, 0]
    empty = tokens.Shard(tokens.encode_shard([], np.zeros(0, np.int64), np.zeros(0, np.uint32), width))
    assert empty.documents == 0 and len(empty.range(0, 0)) == 0
    with pytest.raises(ValueError):
        tokens.Shard(b"x" * 64)


def test_automaton_equals_brute_force(tmp_path):
    rng = random.Random(2)
    words = ["a", "b", "c", "É"]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    for window in (2, 3, 5):
        for _ in range(60):
            items = [(str(k), make(rng.randint(0, 9))) for k in range(rng.randint(1, 5))] + [(None, make(4)), ("x", None)]
            texts = [make(rng.randint(0, 30)) for _ in range(4)] + [None, ""]
            cut = rng.randint(0, len(items))
            uris = write_items(tmp_path, items[:cut], items[cut:], window)
            for resident in (decontaminate.RESIDENT, 1):
                scan = decontaminate.Scanner(uris, window, resident)
                for text, (n, hits, names), (s, _, _, hit, found) in zip(texts, decontaminate.brute_force(texts, items, window), scan.scan([buffers([t]) for t in texts])):
                    assert (len(s), int(hit.sum())) == (n, hits), (text, items)
                    assert sorted(x for x in found.get(0, ()) if x is not None) == names


def write_items(folder, *blocks):
    *blocks, window = blocks
    uris = []
    for items in blocks:
        path = folder / f"{len(list(folder.iterdir()))}.npz"
        np.savez(path, **decontaminate.build_block(items, window))
        uris.append(f"file://{path}")
    return uris


def test_automaton_compares_bytes(tmp_path, monkeypatch):
    """Words that share a hash only make runs longer that are walked."""
    monkeypatch.setattr(decontaminate, "span_hashes", lambda data, s, e: np.ones(len(s), np.uint64))
    scan = decontaminate.Scanner(write_items(tmp_path, [("a", "one two " + thue_morse(11))], 3), 3)
    texts = ["one two " + thue_morse(11), "one two " + thue_morse(11, True)]
    assert [hit.sum() for _, _, _, hit, _ in scan.scan([buffers([t]) for t in texts])] == [3, 0]


def test_many_blocks_load_once(tmp_path):
    """What stays resident is loaded once; clean text loads nothing."""
    rng = random.Random(5)
    items = [[(f"{b}-{k}", " ".join(f"w{b}x{rng.randint(0, 200)}" for _ in range(20))) for k in range(20)] for b in range(12)]
    scan = decontaminate.Scanner(write_items(tmp_path, *items, 13), 13)
    clean = [buffers([" ".join(f"v{rng.randint(0, 500)}" for _ in range(2000))])] * 20
    scan.scan(clean)
    assert scan.loads == 0 and scan.fits
    for _ in range(3):
        (_, _, _, hit, found), = scan.scan([buffers([items[3][4][1] + " " + items[9][0][1]])])
        assert hit.all() and found == {0: {"3-4", "9-0"}}
    assert scan.loads == len(items)


def test_fm_learns_a_pair():
    """Neither term tells the label, the pair does; a linear model cannot separate this."""
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(2000):
        a, b = rng.integers(0, 2, 2)
        rows.append(np.array(([1] if a else []) + ([2] if b else []) + [3], np.int64))
        y.append(float(a and b))
    y = np.array(y)
    m = toxicity.fit(rows, y, np.ones(len(y)), epochs=60)
    doc, bucket = np.repeat(np.arange(4), [1, 2, 2, 3]), np.array([3, 1, 3, 2, 3, 1, 2, 3])
    p = toxicity.sigmoid(m.logits(doc, bucket, 4))
    assert p[3] > 0.9 and p[:3].max() < 0.3
    z = m.b + sum(m.w[m.slot[k]] for k in (1, 2, 3) if m.slot[k] >= 0)
    used = [m.slot[k] for k in (1, 2, 3) if m.slot[k] >= 0]
    z += sum(float(m.v[i] @ m.v[j]) for n, i in enumerate(used) for j in used[n + 1 :])
    assert abs(m.logits(np.zeros(3, np.int64), np.array([1, 2, 3]), 1)[0] - z) < 1e-9
    assert toxicity.fit([], np.zeros(0), np.zeros(0)).logits(doc, bucket, 4).shape == (4,)


@pytest.mark.parametrize("noise", [0, 30])
def test_fm_learns_terms_without_a_marginal(noise):
    """Exclusive or: each of two terms is as frequent with either label."""
    rng = np.random.default_rng(1)
    rows, y = [], []
    for _ in range(3000):
        a, b = rng.integers(0, 2, 2)
        rows.append(np.array(([1] if a else []) + ([2] if b else []) + [3] + sorted(rng.choice(np.arange(10, 410), noise, replace=False)), np.int64))
        y.append(float(a != b))
    y = np.array(y)
    m = toxicity.fit(rows, y, np.ones(len(y)))
    assert {1, 2} <= set(np.flatnonzero(m.slot >= 0))
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    assert ((m.logits(doc, np.concatenate(rows), len(rows)) > 0) == (y > 0)).mean() > 0.98


def test_fm_learns_an_insult_next_to_a_group():
    """The insult tells something, the group nothing; only both together are toxic."""
    rng = np.random.default_rng(4)
    rows, y = [], []
    for k in range(4000):
        insult, group, other = rng.random(3) < (0.2, 0.3, 0.3)
        insult |= group and rng.random() < 0.1
        toxic = insult and group
        rows.append(np.array(sorted(({1} if insult else set()) | ({2} if group else set()) | ({3} if other else set()) | set(rng.choice(np.arange(10, 210), 12).tolist())), np.int64))
        y.append(float(toxic))
    y = np.array(y)
    m = toxicity.fit(rows, y, np.ones(len(y)))
    doc, bucket = np.array([0, 1, 2, 2, 3, 3, 3]), np.array([1, 2, 1, 2, 1, 2, 3])
    p = toxicity.sigmoid(m.logits(doc, bucket, 4))
    assert p[2] > 0.7 and p[3] > 0.7 and p[:2].max() < 0.3


def test_trees_learn_and_traverse():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    f = quality.fit(x[:2000], y[:2000], np.ones(2000), trees=60)
    assert (((f.logits(x[2000:]) > 0) == (y[2000:] > 0.5)).mean()) > 0.95

    def slow(row):
        z = f.base
        for feature, threshold, leaf in zip(f.feature, f.threshold, f.leaf):
            at = 0
            while at < len(feature):
                at = 2 * at + 1 + int(row[feature[at]] > threshold[at])
            z += leaf[at - len(feature)]
        return z

    assert np.allclose(f.logits(x[:20]), [slow(r) for r in x[:20]])
    assert quality.fit(x[:0], y[:0], y[:0]).logits(x[:3]).shape == (3,)


def test_statistics():
    texts = ["One two.\nOne two.\nxx", "", None, "SHOUT!! LOUD!!", "a | b | c"]
    x = dict(zip(quality.NAMES, quality.statistics(*buffers(texts)).T))
    assert x["log_words"].tolist() == [np.log1p(n) for n in (5, 0, 0, 2, 5)]
    assert x["repeated_lines"].tolist() == [1 / 3, 0, 0, 0, 0]
    assert x["bang"][3] == 4 / 14 and x["bar"][4] == 2 / 9 and x["distinct_words"][0] == 3 / 5
    alone = np.concatenate([quality.statistics(*buffers([t])) for t in texts])
    assert np.allclose(alone, quality.statistics(*buffers(texts)))


def test_grams_and_filters():
    texts = ["Hello  wor", "ab", None, "é!"]
    doc, g = language.grams(*buffers(texts))
    got = {(int(d), int(x).to_bytes(4, "little")) for d, x in zip(doc, g)}
    want = set()
    for i, t in enumerate(texts):
        b = bytes(c if chr(c).isascii() and chr(c).isalpha() or c > 127 else 32 for c in (t or "").encode().lower())
        want |= {(i, b[k : k + 4]) for k in range(len(b) - 3) if b"  " not in b[k : k + 4]}
    assert got == want
    table = np.zeros((1, 1 << language.BITS), np.uint8)
    for at in language.positions(g[doc == 0]):
        table[0, at] |= 2
    f = language.Filters(["x", "y"], table)
    total, own = f.counts(doc, g, 4)
    assert own[0, 1] == pytest.approx(total[0], rel=1e-3) and own[0, 0] == 0


def test_filters_equal_sets(monkeypatch):
    """Masks name every language that has an n-gram; corrected counts come near the true ones; long texts in pieces give the same."""
    rng = random.Random(3)
    langs = [f"l{k:02}" for k in range(11)]
    vocab = {k: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(30)] for k in langs}
    text = {k: " ".join(rng.choice(vocab[k]) for _ in range(400)) for k in langs}
    seen = {k: set(language.grams(*buffers([t]))[1].tolist()) for k, t in text.items()}
    table = np.zeros((2, 1 << language.BITS), np.uint8)
    for i, k in enumerate(langs):
        for at in language.positions(np.array(sorted(seen[k]), np.uint32)):
            table[i // 8, at] |= 1 << i % 8
    f = language.Filters(langs, table, table)
    tests = [text[k][::3] + text[k] for k in langs] + [" ".join(text.values())]
    data, off = buffers(tests)
    doc, g = language.grams(data, off)
    hits = f.hits(table, doc, g, len(tests))
    true = np.array([[sum(x in seen[k] for x in g[doc == d].tolist()) for k in langs] for d in range(len(tests))])
    assert (hits >= true).all() and (f.counts(doc, g, len(tests))[1] >= true - 1e-9 - 0.02 * np.bincount(doc)[:, None]).all() and (f.counts(doc, g, len(tests))[1] <= true + 0.02 * np.bincount(doc)[:, None]).all()
    assert f.decide(data, off)[0][: len(langs)].tolist() == list(range(len(langs)))
    whole = f.decide(*buffers(tests[-1:]))
    monkeypatch.setattr(language, "PIECE", 100)
    again = f.decide(*buffers(tests[-1:]))
    assert whole[0] == again[0] and whole[1] == pytest.approx(again[1])


def test_statistics_in_pieces(monkeypatch):
    texts = ["Some Words, and more! " * 50, "x"]
    want = quality.statistics(*buffers(texts[:1]))
    monkeypatch.setattr(quality, "PIECE", 64)
    assert np.allclose(want, quality.statistics(*buffers(texts[:1]))) and np.allclose(want[0], quality.statistics(*buffers(texts))[0])


def truth_shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_shingles_and_signature():
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abCDé") for _ in range(rng.randint(0, 20))) for _ in range(100)] + [None]
    sets = [np.unique(minhash.shingles(*buffers([t]))[1]) for t in texts]
    truth = [truth_shingles(t) for t in texts]
    assert [len(s) for s in sets] == [len(t) for t in truth]
    full = [k for k, s in enumerate(sets) if len(s)]
    both = minhash.common([sets[k] for k in full], [sets[k] for k in full], piece=16)
    assert (both == [[len(truth[a] & truth[b]) for b in full] for a in full]).all()
    x = np.concatenate([sets[k] for k in full])
    sig = minhash.signature(x, np.concatenate([[0], np.cumsum([len(sets[k]) for k in full])[:-1]]))
    y = sets[full[0]] * minhash.A[3] + minhash.B[3]
    assert sig[0, 3] == y.min() and sig[0, minhash.PERMS + 3] == y.max()


def test_min_max_estimate_is_unbiased():
    rng, err = np.random.default_rng(0), []
    for _ in range(60):
        pool = rng.integers(0, 2**63, 400, dtype=np.uint64)
        a, b = pool[:300], pool[100:]
        sig = minhash.signature(np.concatenate([a, b]), np.array([0, 300]))
        err.append((sig[0] == sig[1]).mean() - 0.5)
    assert abs(np.mean(err)) < 0.02


def test_runs_cover_all_windows():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab ") for _ in range(rng.choice([0, 150, 199, 200, 201, 700]))) for _ in range(20)] + ["x" * 900, "abc" * 300]
    data, off = buffers(texts)
    doc, at, n, bucket, name, _, _, _ = suffix_dedup.find_runs(data, off)
    seen = [0] * len(texts)
    for d, c in zip(doc, n):
        seen[d] += int(c)
    assert seen == [max(0, len(t) - 199) for t in texts]


def test_identifiers_are_content():
    data = np.frombuffer(("q" * 50 + "abcdefghij" * 60 + thue_morse(9) + thue_morse(9, True)).encode(), np.uint8)
    p = np.arange(len(data) - 199)
    for lane in (0, 1):
        g = suffix_dedup.identifiers(data, lane)
        w = suffix_dedup.chain(g, p, (40, 80, 120, 160), lane)
        assert len(g) == len(data) - 39
        for a, k in ((g, 40), (w, 200)):
            by = {}
            for i in range(len(a)):
                assert by.setdefault(data[i : i + k].tobytes(), a[i]) == a[i]
            assert len(set(by.values())) == len(by)


@pytest.mark.parametrize("pack", [20, 4])
def test_refinement_equals_counts(monkeypatch, pack):
    """Buckets of bytes, packed and not, against counting every string."""
    monkeypatch.setattr(suffix_dedup, "PACK", pack)
    rng = random.Random(11)
    base = "".join(rng.choice("abc ") for _ in range(600))
    for _ in range(12):
        texts = []
        for _ in range(rng.randint(1, 6)):
            a, b = sorted(rng.sample(range(len(base)), 2))
            texts.append(rng.choice(["", "x", "ab" * 200]) + base[a:b] + rng.choice(["", "yy", base[a : a + 220]]))
        data, off = buffers(texts)
        seen = collections.Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
        want = [i + 200 <= len(t) and seen[t[i : i + 200]] > 1 for t in texts for i in range(len(t))]
        assert suffix_dedup.repeated_windows(data, off).tolist() == want


def test_zip_reader_and_writer():
    out = io.BytesIO()
    z = warc.ZipWriter(out)
    z.member("a/b.bin", b"hello world")
    z.member("é", b"")
    z.close()
    raw = out.getvalue()
    with zipfile.ZipFile(io.BytesIO(raw)) as std:
        assert std.namelist() == ["a/b.bin", "é"] and std.read("a/b.bin") == b"hello world" and std.testzip() is None
    r = warc.ZipReader(io.BytesIO(raw), len(raw))
    assert r.read("a/b.bin") == b"hello world" and r.read("a/b.bin", 6, 3) == b"wor" and r.read("é") == b""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as std:
        std.writestr("plain", b"x" * 100)
        std.writestr("packed", b"x" * 100, zipfile.ZIP_DEFLATED)
        std.comment = b"note PK\5\6 inside"
    r = warc.ZipReader(io.BytesIO(out.getvalue()), len(out.getvalue()))
    assert r.read("plain") == b"x" * 100
    with pytest.raises(ValueError):
        r.read("packed")
    with pytest.raises(ValueError):
        warc.ZipReader(io.BytesIO(b"no archive"), 10)


def test_records():
    r = warc.parse(zlib.decompress(warc.gz(warc.record(5, "http://h/a\r\nX: y", b"a\r\n\r\nb", "D", None, False)), 31))
    assert r["body"] == b"a\r\n\r\nb" and r["warc-type"] == "response" and "x" not in r
    r = warc.parse(warc.record(None, None, b"abc", "D", 9, True))
    assert r["body"] == b"" and r["http"]["content-length"] == "3" and r["warc-refers-to"] == "<urn:page:9>"


def test_graph_search_finds_links():
    rng = np.random.default_rng(0)
    base = embeddings.unit(rng.normal(size=(60, 32)))
    x = embeddings.unit(np.repeat(base, 8, 0) + rng.normal(size=(480, 32)) * 0.04)
    adj = embeddings.build_graph(x)
    assert max(map(len, adj)) <= embeddings.DEGREE
    got = {tuple(p) for p in embeddings.range_search(x, adj)}
    i, j = np.nonzero(np.triu(x @ x.T >= 0.93, 1))
    want = set(zip(i.tolist(), j.tolist()))
    assert got <= want and len(got) >= 0.97 * len(want)
    tree = embeddings.forest(np.array(sorted(want)), len(x))
    assert len(tree) < len(x)
    for n in (1, 2):
        assert len(embeddings.range_search(x[:n], embeddings.build_graph(x[:n]))) in (0, 1)


def prune_one(x, point, pool):
    """The rule of robust pruning, a candidate at a time."""
    dist = lambda a, b: np.sqrt(max(0, 2 - 2 * x[a] @ x[b]))
    out = []
    for p in sorted(set(pool) - {point}, key=lambda p: -(x[p] @ x[point])):
        if len(out) < embeddings.DEGREE and all(embeddings.ALPHA * dist(q, p) > dist(point, p) for q in out):
            out.append(p)
    return out


def test_graph_is_pruned_in_blocks(monkeypatch):
    """The graph is that of pruning members one by one, in a few calls for all of them; one hub has far more reverse edges than others."""
    rng = np.random.default_rng(2)
    x = embeddings.unit(np.concatenate([np.repeat(rng.normal(size=(40, 16)), 15, 0) + rng.normal(size=(600, 16)) * 0.3, np.ones((1, 16))]))
    x[:300] = embeddings.unit(x[:300] + 0.8 * x[600])
    n, calls, prune = len(x), [], embeddings.robust_prune
    monkeypatch.setattr(embeddings, "robust_prune", lambda *a: calls.append(1) or prune(*a))
    adj = embeddings.build_graph(x)
    assert len(calls) <= 12
    sim = x @ x.T - 3 * np.eye(n)
    want = [prune_one(x, p, np.argsort(-sim[p])[: embeddings.POOL].tolist()) for p in range(n)]
    back = [set(a) for a in want]
    for p, a in enumerate(want):
        for q in a:
            back[q].add(p)
    assert max(map(len, back)) > 3 * embeddings.DEGREE
    for p in range(n):
        assert sorted(adj[p].tolist()) == sorted(back[p] if len(back[p]) <= embeddings.DEGREE else prune_one(x, p, back[p])), p


def test_search_takes_each_cosine_once(monkeypatch):
    """A member that several others lead to in one step is compared with the query once."""
    rng = np.random.default_rng(3)
    x = embeddings.unit(np.repeat(rng.normal(size=(10, 16)), 30, 0) + rng.normal(size=(300, 16)) * 0.1)
    adj, rows, einsum = embeddings.build_graph(x), [], np.einsum
    monkeypatch.setattr(np, "einsum", lambda how, a, b: rows.append(np.hstack([a, b])) or einsum(how, a, b))
    for others in (None, x[::7]):
        rows.clear()
        pairs = embeddings.range_search(x, adj, others=others, batch=400)
        met = np.concatenate(rows[:-1])  # the last call verifies
        assert len(met) and len(np.unique(met, axis=0)) == len(met)
        sim = x @ x.T if others is None else others @ x.T
        true = np.argwhere((np.triu(sim, 1) if others is None else sim) >= embeddings.LINK).tolist()
        assert len(pairs) >= 0.97 * len(true) and set(map(tuple, pairs.tolist())) <= set(map(tuple, true))


def thue_morse(k, flip=False):
    a, b = ("b", "a") if flip else ("a", "b")
    for _ in range(k):
        a, b = a + b, b + a
    return a


def test_hashes_of_patterned_strings_differ():
    """Words that any polynomial modulo 2^64 maps to one value."""
    for k in (10, 11, 12):
        data, off = buffers([thue_morse(k), thue_morse(k, True)])
        for lane in (0, 1):
            assert len(set(common.span_hashes(data, off[:-1], off[1:], lane=lane).tolist())) == 2
        assert common.same_spans(data, off[:-1], off[1:], data, off[[0, 0]], off[[1, 1]]).tolist() == [True, False]


def test_tokens_of_words_that_share_a_hash(monkeypatch):
    """Whatever the hash does, ids are those of the tokenizer."""
    monkeypatch.setattr(tokens, "span_hashes", lambda data, s, e, fold=True: np.zeros(len(s), np.uint64) + (e - s).astype(np.uint64) % 3)
    texts = ["one two six ten", thue_morse(11), thue_morse(11, True), "six one, ten", ""]
    enc = tokens.Encoder(tokens.tokenizer_path())
    flat, sizes = enc.encode(*buffers(texts))
    assert flat.tolist() == [x for t in texts for x in enc.whole(t).tolist()] and sizes.tolist() == [len(enc.whole(t)) for t in texts]


class Only:
    """A tokenizer of which only the methods named may be called; counts the calls."""

    def __init__(self, model, *names):
        self.model, self.names, self.calls = model, names, 0

    def __getattr__(self, name):
        assert name in self.names, name
        self.calls += 1
        return getattr(self.model, name)


def test_new_words_are_one_call_of_the_library():
    """Pre-tokens of any kind, with a blank before them or not, are encoded together; the tokenizer itself only sees the text that is compared."""
    text = "".join(chr(c) for c in [*range(0x1C), *range(0x20, 0x80), *range(0xC0, 0x100)] if c not in (0xD7, 0xF7))
    texts = ["one", text, " ".join(text), "\n".join(text), "We'll 12 34\t5  x\n\n y...z  ", "don't 'twas I'd've '' 's", ""]
    enc = tokens.Encoder(tokens.tokenizer_path())
    full = enc.model
    enc.model, enc.bare = Only(full, "encode"), Only(enc.bare, "encode_batch_fast")
    flat, sizes = enc.encode(*buffers(texts))
    assert enc.bare.calls == 1 and enc.model.calls == 1
    want = [full.encode(t, add_special_tokens=False).ids for t in texts]
    assert sizes.tolist() == [len(x) for x in want] and flat.tolist() == [i for x in want for i in x]


def test_a_bare_model_whose_tokens_do_not_fit():
    """Tokens that run over a pre-token's end, here for want of the blanks between them: each is encoded alone by the tokenizer itself."""
    from tokenizers import pre_tokenizers

    enc = tokens.Encoder(tokens.tokenizer_path())
    enc.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    texts = ["one two six ten", "six, one 12 é", ""]
    flat, sizes = enc.encode(*buffers(texts))
    assert flat.tolist() == [x for t in texts for x in enc.whole(t).tolist()] and sizes.tolist() == [len(enc.whole(t)) for t in texts]


def test_ranged_probes_read_little():
    import io

    class Counted(io.BytesIO):
        got = 0

        def read(self, n=-1):
            self.got += n
            return super().read(n)

    values = np.random.default_rng(1).integers(0, 1 << 18, 50_000)
    for width in (4, 8, 11):
        raw = tokens.encode_shard([1, None], np.array([20_000, 30_000]), values, width)
        f = Counted(raw)
        s = tokens.RangedShard(f)
        for p in (0, 1, 511, 512, 49_999, 20_000, 12_345):
            assert s[p] == values[p]
        assert f.got < 7 * 5 * 100 + 400


def test_exact_sets(monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["a", "A", "é", "ß"]) for _ in range(rng.randint(0, 40))) for _ in range(60)] + [None, "", "one", thue_morse(11), thue_morse(11, True), thue_morse(11) + " b"]
    truth = [truth_shingles(t) for t in texts]
    for clash in (False, True):
        if clash:
            monkeypatch.setattr(minhash, "span_hashes", lambda data, s, e, fold=True: (e - s).astype(np.uint64))
            monkeypatch.setattr(minhash, "mix64", lambda x: x % np.uint64(7))
        sets = minhash.exact_sets(pa.array(texts))
        for a, x in zip(truth, sets):
            for b, y in zip(truth, sets):
                assert len(np.intersect1d(x, y)) == len(a & b)
