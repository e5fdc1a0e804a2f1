"""Operators on documents against plain Python, with odd rows in every table."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from keystrata.llm import mixing, packing, quality, repeats, simhash, weighted
from keystrata.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, _text string, n int"


def words(n, seed, alphabet="abcdefghij"):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, repeated rows, ids that tie, and columns whose names clash with inner ones."""
    long = words(9000, 1)
    rows = [(1, None, None, "x", 1), (2, "", "b", None, None), (3, " \t\n", "a", "x", 1), (4, "One two", "a", "x", 1), (5, "one TWO", "a", "x", 1), (None, "no id here at all", "b", "x", 1), (7, long, None, "x", 1), (8, long[:-9], None, "x", 1), (9, words(60, 2), "c", "x", 1), (9, words(60, 3), "c", "x", 1), (10, words(60, 2), "c", "x", 1), (10, words(60, 2), "c", "x", 1), (11, "é 😀 " * 40, "c", "x", 1)]
    rows += [(20 + i, words(5 + 13 * i, 40 + i), "abc"[i % 3], "x", i) for i in range(12)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# Packing


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    rng = random.Random(4)
    plain, wide = [chr(c) for c in range(1, 256)], [chr(c) for c in [*range(0x370, 0x400), *range(0x2000, 0x2070), 0x300, 0x1F600, 0xAC00]]
    texts = ["".join(rng.choice(plain if k % 2 else wide + plain[60:120]) for _ in range(50)) for k in range(600)]
    texts += ["", " ", "it's we'll I'D o'x ''s don't've 12a3", "a<|endoftext|>b", "x" * 500, "a\0b \0 c\0", None]
    import public_tokenizers

    for path, by_words in ((packing.word_tokenizer(), True), (public_tokenizers.path("byte_bpe_50k.json"), False)):
        tokenizer, encoder = Tokenizer.from_file(path), packing.WordEncoder(path, block=2000)
        got = encoder.encode(pa.array(texts))
        assert encoder.by_words == by_words
        assert [np.frombuffer(b, "<u4").tolist() for b in got] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 30), max_size=25), st.sampled_from([60, 64, 97]))
def test_plan_fills_bins_without_gaps(counts, capacity):
    bins, placed = {}, sorted(packing.plan_packing(counts, capacity))
    for i, (length, first, start, per, offset) in enumerate(placed):
        end = placed[i + 1][1] if i + 1 < len(placed) and placed[i + 1][0] == length else counts[length]
        for r in range(first, end):
            bins.setdefault(start + (r - first) // per, []).append((offset + (r - first) % per * length, length))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity and sum(3 * n > capacity for _, n in items) <= 2
    assert sum(map(len, bins.values())) == sum(counts.values())
    total = sum(k * v for k, v in counts.items())
    assert len(bins) <= 1.5 * total / capacity + 2 or len(bins) <= sum(v for k, v in counts.items() if 2 * k > capacity) + total / capacity + 2


def test_packing(docs, none):
    items = packing.tokenize(docs, packing.word_tokenizer(), capacity=256).persist()
    got = packing.pack(items, capacity=256, order=("doc_id", "piece", "ids_crc32")).collect()
    assert len(got) == items.count()
    assert {"source", "_text", "n"} <= set(got[0].asDict())
    by = {}
    for r in got:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for rows in by.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 256
    assert [r.ids for r in got if r.doc_id == 1] == [[0]]
    assert packing.pack(packing.tokenize(none, packing.word_tokenizer())).count() == 0


def test_packing_leaves_what_does_not_fit(spark):
    items = spark.createDataFrame([(1, 0, 5), (2, 0, None), (3, 0, 0), (4, 0, 99), (5, 0, 5)], "doc_id int, piece int, length long")
    got = {r.doc_id: (r.sequence_id, r.offset) for r in packing.pack(items, capacity=10).collect()}
    assert got[2] == got[3] == got[4] == (None, None)
    assert {got[1][1], got[5][1]} == {0, 5} and got[1][0] == got[5][0]


# Mixing


def simple_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not full:
            return out | {s: weight[s] * level for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    sizes = Counter()
    for r in got:
        assert r.size == len(WORD.findall(r.text or ""))
        sizes[r.source] += r.size
    want = simple_targets(sizes)
    taken, most = Counter(), Counter()
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert r.taken in (r.size * r.epochs, r.size * (r.epochs + 1)) and r.taken <= 2 * r.size
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], 2 * r.size)
    assert all(abs(taken[s] - want[s]) <= most[s] / 2 + 1e-6 for s in want)
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix(none).count() == 0


def test_mixing_takes_the_least_keys(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 4), "abcd"[i % 4 % 3]) for i in range(400)], "doc_id long, text string, source string")
    rows = mixing.mix(docs).withColumn("key", -mixing.F.log(mixing.uniform(mixing.F.col("doc_id"), 17)) / mixing.quality_weight(mixing.F.col("text"))).collect()
    for s in "abc":
        own = [r for r in rows if r.source == s]
        picked, rest = [r.key for r in own if r.picked], [r.key for r in own if not r.picked]
        assert not picked or not rest or max(picked) <= min(rest)


# SimHash


def simple_hash(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simple_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_fingerprints_and_components(docs, none):
    got = simhash.near_duplicates(docs).collect()
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1) for r in got) == Counter((i, simple_hash(t)) for i, t in texts)
    prints = sorted({r.fp for r in got})
    group = simple_components(prints, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    least = {}
    for r in got:
        if r.doc_id is not None:
            least[group[r.fp]] = min(least.get(group[r.fp], 1 << 60), r.doc_id)
    assert all(r.component_id == least.get(group[r.fp]) for r in got)
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("dense", [2, 16])
def test_links_reach_what_brute_force_reaches(spark, monkeypatch, dense):
    monkeypatch.setattr(simhash, "DENSE", dense)
    rng, prints = random.Random(dense), {0, -1, 1 << 62, -(1 << 63)}
    for _ in range(40):
        p = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            prints.add(p - (1 << 64) if p >> 63 else p)
            for _ in range(rng.randint(1, 4)):
                p ^= 1 << rng.randrange(64)
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    got = {r.node: r.root for r in components(simhash.near_links(frame)).collect()}
    want = simple_components(sorted(prints), lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    assert {p: got.get(p, p) for p in prints} == want


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(50)] + [(5000, 5000), (5001, 5002), (5002, 5001)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(50)}, 5001: 5001, 5002: 5001}


def test_keep_one(spark, docs, none):
    base = words(300, 77).split()
    family = [(100 + k, " ".join(w if i != 13 * k + 5 else f"new{k}" for i, w in enumerate(base)), "a", None, k) for k in range(6)]
    half = (200, " ".join(base[:150] + words(150, 78).split()), "a", None, 0)
    rows = docs.union(spark.createDataFrame([*family, half], SCHEMA))
    got = simhash.keep_one(rows)
    assert got.columns == rows.columns
    kept = Counter(r.doc_id for r in got.collect())
    assert [i for i in kept if i and 100 <= i < 106] == [100] and kept[200] == 1
    assert max(kept[i] for i in (1, 9, 10)) <= 2 and kept[10] == 0 and kept[9] == 2  # 10 repeats a text of 9
    assert kept[1] == 1 and kept[2] == kept[3] == 0 and kept[5] == 0
    assert simhash.keep_one(none).count() == 0


@pytest.mark.parametrize("block", [1 << 20, 9000])
def test_large_cells_connect_what_brute_force_connects(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng, texts = random.Random(block), []
    for seed, edits in ((31, 120), (32, 60)):  # edits are 0.85 like their base, but not like each other
        base = words(400, seed).split()
        texts.append(" ".join(base))
        for k in range(edits):
            at = set(rng.sample(range(5, 395, 6), 6))
            texts.append(" ".join(f"new{k}" if i in at else w for i, w in enumerate(base)))
    texts += [words(400, 33), "", "one two"]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} if t else set() for t in texts]
    nodes = rng.sample(range(-(10**9), 10**9), len(texts))
    of = dict(zip(nodes, sets))
    alike = lambda a, b: bool(of[a] & of[b]) and len(of[a] & of[b]) >= 0.8 * len(of[a] | of[b])
    table = spark.createDataFrame(list(zip(nodes, texts)), "node long, text string")
    prints = table.select("node", simhash.sampled_prints(table.text, 5, 14, 4).alias("p")).select("node", "p.*")
    links, large, sets = simhash.similar_links(prints, lambda some: table.join(some, "node"))
    rest = simhash.links_of_large_cells(large, components(links), sets, 0.8)
    links = links.union(rest).collect()
    assert all(alike(r.a, r.b) for r in links)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = simple_components(sorted(nodes), alike)
    assert {p: got.get(p, p) for p in nodes} == want and len(set(want.values())) == 5


# Weighted sampling


def test_draws_estimate_generalised_jaccard():
    sampler, rng = weighted.Sampler(512), random.Random(3)
    for _ in range(5):
        a = Counter(rng.choice("abcdefghijklmnop") * 3 for _ in range(300))
        b = a + Counter(rng.choice("efghqrst") * 3 for _ in range(rng.randint(1, 200)))
        want = sum((a & b).values()) / sum((a | b).values())
        got = (sampler.sign(" ".join(a.elements())) == sampler.sign(" ".join(b.elements()))).mean()
        assert abs(got - want) < 0.09


@pytest.mark.parametrize("more", [0, 300])
def test_edited_texts(spark, docs, none, more):
    odd = [(None, words(1 + i % 9, i // 2), "s", None, i) for i in range(more)] + [(v, "least and most", "s", None, 0) for v in (-(1 << 63), (1 << 63) - 1)[: more]]
    docs = docs.union(spark.createDataFrame(odd, SCHEMA))
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0), _signed(r.text)))
    got = weighted.edited_by_next(docs).collect()
    want = []
    for k, r in enumerate(rows):
        old, new = r.text or "", rows[(k + 1) % len(rows)].text or ""
        n = len(old) // 3
        edited = old[: len(old) - n] + new[:n]
        s = weighted._sampler(weighted.SAMPLES)
        a, b, c = s.sign(old), s.sign(edited), s.sign(new)
        want.append((r.doc_id, len(old), hashlib.sha256(edited.encode()).hexdigest(), weighted.shown(a), weighted.shown(b), (a == b).mean(), (a == c).mean()))
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(tuple(float(x) if isinstance(x, np.floating) else x for x in w)) for w in want)
    assert weighted.edited_by_next(none).count() == 0
    one = weighted.edited_by_next(docs.where("doc_id = 4")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def _signed(text):
    v = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return v - (1 << 64) if v >> 63 else v


def test_many_words_and_a_full_memory(monkeypatch):
    monkeypatch.setattr(weighted, "KEPT", 64)
    small = weighted.Sampler(16)
    monkeypatch.undo()
    large, text = weighted.Sampler(16), words(500, 9)
    monkeypatch.setattr(weighted, "KEPT", 64)
    assert (small.sign(text) == large.sign(text)).all()


# Quality


def test_quality_learns_from_others_only(spark, docs, none):
    rng = random.Random(8)
    rows = []
    for i in range(500):
        clean = words(80, i)
        junk = " ".join(w + rng.choice(["###", "%%%", "&&&"]) for w in clean.split()) if i % 4 == 0 else clean
        rows.append((i, (clean + " " if i % 8 == 0 else "") + junk))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1) for i in range(500)] + [(3, None), (None, 1), (1, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.classify(table, labels).collect()}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    held = [i for i, r in got.items() if r.held_out]
    assert np.mean([got[i].predicted == (i % 4 != 0) for i in held]) > 0.95
    flipped = labels.withColumn("quality", quality.F.when(quality.held_out(quality.F.col("doc_id")), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    assert {r.doc_id: r.score for r in quality.classify(table, flipped).collect()} == {i: r.score for i, r in got.items()}
    odd = quality.classify(docs, labels).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert quality.classify(none, labels).count() == 0
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}


@pytest.mark.parametrize("fetch, step", [(1 << 25, 1 << 14), (1000, 50)])
def test_fitting_sees_all_passages(spark, monkeypatch, fetch, step):
    seen, fit = [], quality.AttentionModel.fit

    def watched(self, x, owner, y):
        seen.append((np.array(x), owner, y))
        return fit(self, x, owner, y)

    monkeypatch.setattr(quality.AttentionModel, "fit", watched)
    monkeypatch.setattr(quality, "FETCH", fetch)
    monkeypatch.setattr(quality, "STEP", step)
    texts = [words(n, n) for n in (5, 9000, 64, 65, 2500)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    quality.fit_model(table, spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, quality int"))
    ((x, owner, y),) = seen
    got = {tuple(map(bytes, x[owner == k])) + (y[k],) for k in range(5)}
    want = set()
    for i, text in enumerate(texts):
        want.add(tuple(bytes(p) for part, _ in quality.bags([text]) for p in part.astype(np.float32)) + (i % 2,))
    assert got == want and len(owner) == 1 + 141 + 1 + 2 + 40


def test_parts_do_not_change_who_is_scored(monkeypatch):
    model, text = quality.AttentionModel(), words(3000, 5)
    whole = model.score([text, "a"])
    monkeypatch.setattr(quality, "PART", 2000)
    cut = model.score([text, "a"])
    assert abs(whole[0] - cut[0]) < 0.05 and whole[1] == pytest.approx(cut[1])


def test_gradients():
    model, rng = quality.AttentionModel(hidden=5, gate=3), np.random.default_rng(1)
    x, of, y, w = rng.normal(size=(9, quality.FEATURES)), np.array([0, 0, 0, 1, 1, 2, 2, 2, 2]), np.array([1.0, 0, 1]), np.ones(3)

    def loss():
        h, _, _, e = model._forward(x)
        z = np.array([(e[of == k, None] * h[of == k]).sum(0) / e[of == k].sum() for k in range(3)])
        p = quality._sigmoid(z @ model.p["c"] + model.p["b"])
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for name, g in model._gradients(x, of, y, w).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        keep = model.p[name][at]
        model.p[name][at] = keep + 1e-5
        up = loss()
        model.p[name][at] = keep - 1e-5
        down = loss()
        model.p[name][at] = keep
        assert g[at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-8)


# Repeats


def simple_repeats(texts, length):
    seen = Counter()
    raw = [(t or "").encode() for t in texts]
    for b in raw:
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        cover = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                cover[i] += 1
                cover[i + length] -= 1
        gone = np.cumsum(cover)[: len(b)] > 0
        out.append((len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


def passages_and_edits(seed):
    rng = random.Random(seed)
    passages = [words(n, n) for n in (20, 40, 70, 90, 140)]
    texts = [" ".join(rng.choice([words(rng.randint(1, 60), rng.random()), rng.choice(passages), rng.choice(passages)[rng.randint(0, 60) :]]) for _ in range(rng.randint(1, 5))) for _ in range(40)]
    base = words(400, 12)
    texts += [base[:k] + "Z" + base[k + 1 :] for k in rng.sample(range(len(base)), 25)]
    return texts + ["x" * 900, "ab" * 400, "A line. " * 300 + words(90, 5) + "A line. " * 60, "A line. " * 51, words(4000, 6) + passages[4]]


@pytest.mark.parametrize("batch, hot, length, finer", [(7, 50_000, 400, 200), (8192, 50_000, 400, None), (16, 2, 400, 200), (8192, 50_000, 90, None), (8192, 50_000, 200, 300)])
def test_repeats(spark, docs, none, monkeypatch, batch, hot, length, finer):
    monkeypatch.setattr(repeats, "BATCH", batch)
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "BLOCK", 5000)
    rows = [(i, t, "s", None, i) for i, t in enumerate(passages_and_edits(batch))]
    table = docs.union(spark.createDataFrame(rows, SCHEMA))
    got = repeats.remove_repeats(table, length=length, finer=finer).collect()
    order = table.collect()
    texts = [r.text for r in order]
    want = Counter((r.doc_id, *w) for r, w in zip(order, simple_repeats(texts, length)))
    assert Counter((r.doc_id, r.n_bytes, sum(s.stop - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in got) == want
    if finer:
        want = Counter((r.doc_id, *w[:3]) for r, w in zip(order, simple_repeats(texts, finer)))
        assert Counter((r.doc_id, r.n_bytes, sum(s.stop - s.start for s in r.finer_spans), len(r.finer_spans)) for r in got) == want
    assert repeats.remove_repeats(none, finer=finer).count() == 0


def test_runs_of_few_words_stay(spark):
    texts = passages_and_edits(4)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    runs = lambda rows, name: {r.doc_id: [(s.start, s.stop) for s in r[name]] for r in rows}
    long = lambda found: {i: [(s, e) for s, e in x if len(texts[i].encode()[s:e].split()) >= 60] for i, x in found.items()}
    plain = repeats.remove_repeats(table, length=400, finer=200).collect()
    some = repeats.remove_repeats(table, length=400, words=60, finer=200, finer_words=60).collect()
    for name in ("spans", "finer_spans"):
        assert runs(some, name) == long(runs(plain, name)) != runs(plain, name)
    assert all(len(r.kept) == r.n_bytes - sum(s.stop - s.start for s in r.spans) for r in some)


def test_an_index_takes_batch_after_batch(spark, tmp_path):
    texts = passages_and_edits(5)
    texts += texts[:2] + [None, ""]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    index, seen = repeats.RepeatIndex(spark, f"file://{tmp_path}/index", length=200), []
    for k, (lo, hi) in enumerate(((0, 30), (30, 31), (31, 60), (60, 99))):
        got = index.add(table.where(table.doc_id.between(lo, hi - 1))).collect()
        seen += texts[lo:hi]
        want = {i: w[:3] for i, w in enumerate(simple_repeats(seen, 200))}
        assert {r.doc_id: (r.n_bytes, sum(s.stop - s.start for s in r.spans), len(r.spans)) for r in got} == {i: want[i] for i in range(lo, min(hi, len(texts)))}
        assert index.levels() == [[(0, 0)], [(0, 1)], [(0, 1), (2, 2)], [(0, 3)]][k]
    (tmp_path / "index/levels/2-2").mkdir()  # as a merge leaves it that is cut short
    (tmp_path / "index/levels/2-2/_SUCCESS").touch()
    assert index.levels() == [(0, 3)] and index.add(table.limit(0)).count() == 0


def contexts_of(texts, length):
    raw = [t.encode() for t in texts]
    data, starts = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    at, _ = repeats.anchors(data, starts, length)
    doc = np.searchsorted(starts, at, side="right") - 1
    before = np.minimum(at - starts[doc], length - repeats.GRAM)
    return before, [raw[d][p - b - starts[d] : p + length - starts[d]] for d, p, b in zip(doc, at, before)]


def test_family_needs_the_order_and_not_the_batches(monkeypatch):
    before, texts = contexts_of(passages_and_edits(3), 200)
    one = repeats.SuffixFamily(200)
    one.add(before, texts)
    assert len(one.levels) == 1 and (one.left >= 0).sum() > 100
    many, rng = repeats.SuffixFamily(200), np.random.default_rng(1)
    for some in np.split(rng.permutation(len(texts)), np.sort(rng.integers(0, len(texts), 30))):
        at = np.concatenate([at, some]) if len(many.after) else some
        many.add(before[some], [texts[i] for i in some])
    assert len(many.levels) < 12 and all(many.after[i] <= many.after[j] for v in many.levels for i, j in zip(v, v[1:]))
    assert (many.left[:, np.argsort(at)] == one.left).all() and (many.right[:, np.argsort(at)] == one.right).all()
    monkeypatch.setattr(repeats.SuffixFamily, "_sorted", lambda self, numbers: numbers)
    odd = repeats.SuffixFamily(200)
    odd.add(before, texts)
    assert (odd.left != one.left).any()


def test_kept_text_has_no_broken_characters(spark):
    a = "é" * 300
    table = spark.createDataFrame([(1, "x" + a + "yy"), (2, a + "z")], "doc_id long, text string")
    got = {r.doc_id: r.kept for r in repeats.remove_repeats(table, as_text=True).collect()}
    assert got == {1: "xyy", 2: "z"}
