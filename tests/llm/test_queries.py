"""The registered queries on whole small tables: against their SQL, or against plain versions of the same contract."""

import hashlib
import math
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
import xxhash

from keystrata.llm import audio, packing, registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


def table(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def result(spark):
    made = {}

    def of(number):
        name = next(n for n in QUERIES if n.startswith(f"op{number}_"))
        if name not in made:
            made[name] = QUERIES[name](spark, SF).toPandas()
        return made[name]

    return of


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(result, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = result(int(name[2:].split("_")[0])), con.execute(SQL[name]).df()
    plain = lambda v: None if pd.isna(v) else int(v) if isinstance(v, float) and math.isfinite(v) and v == int(v) else v
    rows = lambda f: Counter(tuple(map(plain, r)) for r in f[sorted(f.columns)].astype(object).itertuples(index=False, name=None))
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_packing(result):
    from tokenizers import Tokenizer

    tokenizer, got = Tokenizer.from_file(packing.word_tokenizer()), result(1)
    want = {}
    for d in table("documents"):
        ids = tokenizer.encode(d["text"] or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[d["doc_id"], k] = at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want and len(got) == len(want)
    for _, rows in got.sort_values("offset").groupby("sequence_id"):
        assert (rows.offset == rows.length.cumsum() - rows.length).all() and rows.length.sum() <= 2048
    room = []  # plain best-fit, longest first
    for n in sorted(got.length, reverse=True):
        fits = [r for r in room if r >= n]
        if fits:
            room.remove(min(fits))
        room.append((min(fits) if fits else 2048) - n)
    assert got.sequence_id.nunique() <= len(room) + 1


def test_simhash(result):
    lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    prints = {}
    for d in table("documents"):
        words = (d["text"] or "").encode().translate(lower).split()
        shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints[d["doc_id"]] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = {i: (f"{p:016x}", find(i)) for i, p in prints.items()}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in result(3).itertuples()} == want


def test_document_fingerprints(result):
    docs = sorted(table("documents"), key=lambda d: -d["doc_id"])
    got = {r.doc_id: r for r in result(4).itertuples()}
    by_text = {}
    for d, after in zip(docs, docs[1:] + docs[:1]):
        text, r = d["text"] or "", got[d["doc_id"]]
        k = len(text) // 3
        edited = text[: len(text) - k] + (after["text"] or "")[:k]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
        a, b, c = (Counter(t.split()) for t in (text, edited, after["text"] or ""))
        for other, near in ((b, r.near_edited), (c, r.near_next)):
            like = (a & other).total() / max(1, (a | other).total())
            assert abs(like - near) < 0.3 and 0 <= near <= 1
    assert len(got) == len(docs)


def test_extraction(result):
    import re
    from html.parser import HTMLParser

    class Words(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.skip, self.found = 0, []

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style", "title", "template", "noscript")

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style", "title", "template", "noscript")

        def handle_data(self, data):
            if self.skip <= 0:
                self.found += data.split()

    got = {r.page_id: r.text for r in result(5).itertuples()}
    assert len(got) == len(table("pages"))
    for p in table("pages"):
        html = p["html"] or ""
        if re.search(r"hidden|display\\s*:|visibility|<(select|dialog|svg|math|audio|video|iframe|object|canvas|textarea)", html, re.I):
            continue
        other = Words()
        other.feed(html)
        letters = lambda words: Counter(re.sub(r"[\\W_]", "", "".join(words)))
        want, have = letters(other.found), letters(got[p["page_id"]].split())
        assert not want - have, p["page_id"]


def test_audio(result):
    prints, got = {}, {r.vec_id: r for r in result(6).itertuples()}
    rows = {r["vec_id"]: r["embedding"] for r in table("embeddings")}
    for i, v in rows.items():
        prints[i] = audio.fingerprint(audio.render(v))
        assert got[i].fingerprint == "".join(f"{x:08x}" for x in prints[i]) and got[i].n_frames == len(prints[i])
    asked = [i for i in rows if i % 20 == 0]
    right = 0
    for i in asked:
        q = audio.fingerprint(audio.render(rows[i], 0.5, 0.05, i))
        least = min((audio.bit_error(q, p, o)[0], m) for m, p in prints.items() for o in range(0, 16))
        right += (got[i].match_class == got[least[1]].class_id) if least[0] <= audio.MAX_ERROR else pd.isna(got[i].match_class)
    assert right >= 0.9 * len(asked)


def test_quality(result):
    got, texts = result(7), {d["doc_id"]: d["text"] for d in table("documents")}
    assert sorted(got.doc_id) == sorted(texts) and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    assert (got.predicted == (got.score >= 0.7)).all()
    labels = {r["doc_id"]: r["quality"] for r in table("labels")}
    held = got[got.held_out & got.doc_id.isin(list(labels))]
    y, s = np.array([labels[i] for i in held.doc_id]), held.score.to_numpy()
    if 0 < y.sum() < len(y):
        assert np.mean([a > b for a in s[y == 1] for b in s[y == 0]]) > 0.8
