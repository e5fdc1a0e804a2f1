"""Exact repeated byte strings by a logarithmic family of suffix arrays.

Which bytes are covered by a string of ``length`` bytes that also starts somewhere else, in any document?

1. Sampled suffixes. In every window of ``base`` bytes (the least of the lengths asked for) the position with the least
   hash of its first ``GRAM`` bytes (the leftmost of equal ones) is an anchor. Equal windows have equal anchors at the same
   place, so only suffixes that start at anchors are indexed, about one in 70 bytes, and no repeat is missed. A longer
   window is met at the anchor of its first ``base`` bytes: one set of anchors serves all lengths.
2. An anchor's context is what its windows can reach: up to ``base - GRAM`` bytes before and the greatest length after it,
   within the document. Equal contexts of a document make one row (a run of a repeated line has few). Grams that occur
   once are settled (nothing repeats), and so are grams of one context and contexts that occur twice or more (all of it
   repeats); bytes travel only for one occurrence of each other context.
3. The index. Contexts are dealt out by gram. Each task takes them in batches; a batch gets a suffix array (its suffixes
   sorted), is merge-scanned against every level of the index, and becomes a level itself; levels of equal size merge,
   so there are logarithmically many. The common prefixes of neighbours in the merged order give the runs that share a
   gram and how far each suffix agrees with others to the right; the same order of the reversed left sides gives how far
   to the left. Where that does not settle a run at once, classes of both orders are compared for each offset that a
   suffix can still match at: no pairs are listed.
4. All matched windows of an anchor contain it, so they form one span. Spans go back to their documents and are merged.

Null texts are empty; texts shorter than ``length`` have no windows; equal rows (same id and text) repeat each other like
any other two; extra columns pass through; an empty table gives an empty result. Grams and equal contexts are told apart
by 64-bit hashes; suffixes are compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm.common import bytes_of, fresh, release, stash, text_or_empty

#: Bytes of an anchor's gram; bytes of text hashed at a time; rows of a batch of the index; contexts for each task.
GRAM, BLOCK, BATCH, SHARD = 32, 1 << 20, 8192, 40_000
#: Distinct contexts of one gram beyond which its windows are counted over all tasks rather than met in one.
HOT = 50_000
BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` bytes from each position."""
    n = len(data) - GRAM + 1
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data),), "<u8", padded.data, 0, (1,))
    h = np.zeros(n, np.uint64)
    for k in range(0, GRAM, 8):
        h += eight[k : k + n]
        h *= BASE
        h ^= h >> np.uint64(29)
    return _mix(h)


def anchors(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor positions and gram hashes; ``starts`` are the bounds of texts, which no window crosses."""
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h, width = gram_hashes(data), length - GRAM + 1
    v = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    m = len(v)
    tiles = np.concatenate([v, np.full(-m % width, np.uint64(2**64 - 1))]).reshape(-1, width)
    up = np.minimum.accumulate(tiles, axis=1).ravel()[:m]
    down = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].ravel()[:m]
    n = m - width + 1
    least = (np.minimum(down[:n], up[width - 1 :]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    size = np.diff(starts)
    has = size >= length
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, starts[:-1][has], 1)
    np.add.at(steps, starts[1:][has] - length + 1, -1)
    inside = np.cumsum(steps[:n]) > 0
    first = inside.copy()
    first[1:] &= ~(inside[:-1] & (least[1:] == least[:-1]))
    found = least[first]
    return found, h[found]


def _blocks(bounds: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """``first text, end text, from byte, to byte``: runs of whole texts, or overlapping parts of a long one."""
    i, n = 0, len(bounds) - 1
    while i < n:
        if bounds[i + 1] - bounds[i] > BLOCK:
            for at in range(int(bounds[i]), int(bounds[i + 1]) - length + 1, BLOCK):
                yield i, i + 1, at, min(int(bounds[i + 1]), at + BLOCK + length - 1)
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + BLOCK, side="right")) - 1)
        yield i, j, int(bounds[i]), int(bounds[j])
        i = j


def _runs(doc: np.ndarray, gram: np.ndarray, context: np.ndarray, at: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal contexts of a document as runs of overlapping spans: number of the first and the last anchor, and how many there are."""
    order = np.lexsort((at, context, gram, doc))
    d, g, c, p = doc[order], gram[order], context[order], at[order]
    other = np.ones(len(order), bool)
    other[1:] = (d[1:] != d[:-1]) | (g[1:] != g[:-1]) | (c[1:] != c[:-1])
    times = np.bincount(np.cumsum(other) - 1)[np.cumsum(other) - 1] if len(order) else np.zeros(0, np.int64)
    new = other.copy()
    new[1:] |= p[1:] - p[:-1] > reach[order][1:]
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(order)) - 1 if len(begin) else begin
    return order[begin], order[end], times[begin]


FOUND = "a long, b long, gram long, context long, lo long, hi long, before int, after int, times int"


def _find(base: int, longest: int):
    import xxhash

    names = [f.split()[0] for f in FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, reach = xxhash.xxh64_intdigest, base - GRAM
        for batch in batches:
            release()
            raw, bounds = bytes_of(batch.column("t"))
            data = np.frombuffer(raw, np.uint8)
            last = np.full(1, -1, np.int64)
            for i, j, lo, hi in _blocks(bounds, base):
                cut = np.clip(bounds[i : j + 1], lo, hi) - lo
                at, gram = anchors(data[lo:hi], cut, base)
                at = at + lo
                if lo != bounds[i]:  # a later part of a long text may find the last part's anchors again
                    new = ~np.isin(at, last)
                    at, gram = at[new], gram[new]
                last = at
                doc = np.searchsorted(bounds, at, side="right") - 1
                before, after = np.minimum(at - bounds[doc], reach), np.minimum(bounds[doc + 1] - at, longest)
                context = np.fromiter((digest(raw[p - b : p + a], b) for p, b, a in zip(at.tolist(), before.tolist(), after.tolist())), np.uint64, len(at))
                begin, end, times = _runs(doc, gram, context, at, before + np.minimum(after, base))
                rows = pa.array(doc[begin])
                ends = [at[k] - bounds[doc[k]] for k in (begin, end)]
                columns = [batch.column("a").take(rows), batch.column("b").take(rows), *(pa.array(x[begin].view(np.int64)) for x in (gram, context)), *map(pa.array, ends), *(pa.array(x.astype(np.int32)) for x in (before[begin], after[begin], times))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


CUT = "gram long, context long, a long, b long, lo long, before int, settled boolean, bytes binary"


def _cut(text_name: str, wanted_name: str):
    names, kinds = zip(*(f.split() for f in CUT.split(", ")))
    types = [{"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}[k] for k in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, bounds = bytes_of(batch.column(text_name))
            for i, wanted in enumerate(batch.column(wanted_name).to_pylist()):
                start, step = int(bounds[i]), 2000
                for k in range(0, len(wanted), step):
                    some = wanted[k : k + step]
                    cuts = [bytes(raw[start + w["lo"] - w["before"] : start + w["lo"] + w["after"]]) for w in some]
                    yield pa.RecordBatch.from_arrays([pa.array([w[n] for w in some], t) for n, t in zip(names[:-1], types)] + [pa.array(cuts, pa.binary())], names=names)

    return run


def _agree(rows: list[bytes]) -> np.ndarray:
    """Bytes that each row has in common with the one before it (0 for the first)."""
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    width = max(1, int(size.max(initial=0)))
    laid = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(-1, width)
    out = np.zeros(len(rows), np.int64)
    for at in range(1, len(rows), 1 << 14):  # some thousand rows at a time
        odd = laid[at : at + (1 << 14)] != laid[at - 1 : at - 1 + len(laid[at : at + (1 << 14)])]
        out[at : at + len(odd)] = np.where(odd.any(axis=1), odd.argmax(axis=1), width)
    out[1:] = np.minimum(out[1:], np.minimum(size[1:], size[:-1]))
    return out


class SuffixFamily:
    """Levels of sorted suffixes; a batch is scanned against all of them, then becomes one, and equal levels merge.

    For each of ``lengths`` and each suffix added, ``left`` and ``right`` tell how far around its anchor windows of that
    length reach that another suffix has too (``left`` is -1 if there are none).
    """

    def __init__(self, *lengths: int) -> None:
        self.lengths = lengths
        self.before: list[bytes] = []  # left sides, reversed
        self.after: list[bytes] = []
        self.heads = np.zeros(0, f"S{GRAM}")
        self.left, self.right = np.zeros((len(lengths), 0), np.int64), np.zeros((len(lengths), 0), np.int64)
        self.levels: list[np.ndarray] = []  # numbers of suffixes in order

    def _sorted(self, numbers: np.ndarray) -> np.ndarray:
        return np.array(sorted(numbers.tolist(), key=self.after.__getitem__), np.int64)

    def add(self, before: np.ndarray, texts: list[bytes]) -> None:
        first = len(self.after)
        self.before += [t[:b][::-1] for t, b in zip(texts, before.tolist())]
        self.after += [t[b:] for t, b in zip(texts, before.tolist())]
        self.heads = np.concatenate([self.heads, np.array([t[:GRAM] for t in self.after[first:]], f"S{GRAM}")])
        more = np.full((len(self.lengths), len(texts)), -1, np.int64)
        self.left, self.right = np.concatenate([self.left, more], axis=1), np.concatenate([self.right, more], axis=1)
        batch = self._sorted(np.arange(first, first + len(texts)))
        self._match(batch)
        for level in self.levels:
            self._match(self._merged(batch, level))
        self.levels.append(batch)
        while len(self.levels) > 1 and len(self.levels[-1]) >= len(self.levels[-2]):
            self.levels[-2:] = [self._sorted(np.concatenate(self.levels[-2:]))]  # two sorted runs: a linear merge

    def _merged(self, batch: np.ndarray, level: np.ndarray) -> np.ndarray:
        """Suffixes of both that have a gram of the other, in order."""
        new, old = self.heads[batch], self.heads[level]
        lo, hi = np.searchsorted(old, new, "left"), np.searchsorted(old, new, "right")
        steps = np.zeros(len(level) + 1, np.int64)
        np.add.at(steps, lo, 1)
        np.add.at(steps, hi, -1)
        return self._sorted(np.concatenate([level[np.cumsum(steps)[:-1] > 0], batch[hi > lo]]))

    def _match(self, rows: np.ndarray) -> None:
        """Match suffixes, given in order, with all others among them."""
        lcp = _agree([self.after[i] for i in rows])
        run = np.cumsum(lcp < GRAM) - 1
        several = np.bincount(run)[run] > 1 if len(run) else np.zeros(0, bool)
        rows, lcp, run = rows[several], lcp[several], run[several]
        n = len(rows)
        if not n:
            return
        starts = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
        # The same for the left sides, in their own order within each run.
        sides = [self.before[i] for i in rows]
        order = np.array(sorted(range(n), key=sides.__getitem__), np.int64)
        order = order[np.argsort(run[order], kind="stable")]
        llcp = _agree([sides[i] for i in order])
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        lcp[starts], llcp[starts] = -1, -1
        far = np.maximum(lcp, np.append(lcp[1:], -1))  # agreement with the closest other one
        lfar = np.maximum(llcp, np.append(llcp[1:], -1))[place]
        inner = np.ones(n, bool)
        inner[starts] = False
        big = np.int64(1 << 40)
        floor = np.minimum.reduceat(np.where(inner, lcp, big), starts) + np.minimum.reduceat(np.where(inner, llcp, big), starts)
        for k, length in enumerate(self.lengths):
            left, right = self.left[k], self.right[k]
            plain = floor[run] >= length  # all pairs of the run match
            one = rows[plain]
            left[one] = np.maximum(left[one], lfar[plain])
            right[one] = np.maximum(right[one], np.minimum(far[plain], length))
            open_ = np.flatnonzero(~plain & (far + lfar >= length))
            if not len(open_):
                continue
            least, most = np.maximum(0, length - far[open_]), lfar[open_]
            for at in range(int(least.min()), int(most.max()) + 1):
                some = open_[(least <= at) & (at <= most)]
                if len(some) < 2:
                    continue
                key = np.cumsum(lcp < length - at)[some] * (n + 1) + np.cumsum(llcp < at)[place[some]]
                by = np.argsort(key, kind="stable")
                same = key[by][1:] == key[by][:-1]
                hit = np.zeros(len(some), bool)
                hit[by[1:][same]] = hit[by[:-1][same]] = True
                hit = rows[some[hit]]
                left[hit], right[hit] = np.maximum(left[hit], at), np.maximum(right[hit], length - at)


def windows(texts: list[bytes], before: np.ndarray, length: int, reach: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each offset of a window before the anchor: the contexts that have it, and its hash in each."""
    n = len(texts)
    lead = reach - before
    size = np.fromiter(map(len, texts), np.int64, n)
    width = reach + length
    laid = b"".join((b"\0" * int(p) + t)[:width].ljust(width, b"\0") for t, p in zip(texts, lead))
    columns = _mix(np.frombuffer(laid, np.uint8).reshape(n, width).T.astype(np.uint64) + np.uint64(1))
    total = np.zeros((width + 1, n), np.uint64)
    for k in range(width):
        np.multiply(total[k], BASE, out=total[k + 1])
        total[k + 1] += columns[k]
    power = np.uint64(pow(int(BASE), length, 1 << 64))
    for k in range(reach + 1):
        there = np.flatnonzero((lead <= k) & (lead + size >= k + length))
        if len(there):
            yield reach - k, there, _mix(total[k + length][there] - total[k][there] * power)


def _hashed(lengths: tuple[int, ...], reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                gram, context = part.column("gram").to_numpy(), part.column("context").to_numpy()
                for k, length in enumerate(lengths):
                    for offset, there, keys in windows(part.column("bytes").to_pylist(), part.column("before").to_numpy(), length, reach):
                        which = [pa.array(np.full(len(there), x, np.int32)) for x in (k, offset)]
                        yield pa.RecordBatch.from_arrays([pa.array(gram[there]), pa.array(context[there]), *which, pa.array(keys.view(np.int64))], names=["gram", "context", "k", "offset", "hash"])

    return run


def _spans(lengths: tuple[int, ...]) -> str:
    return "a long, b long, " + ", ".join(f"s{k} long, e{k} long" for k in range(len(lengths)))


def _index(lengths: tuple[int, ...]):
    names = [f.split()[0] for f in _spans(lengths).split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, kept, waiting, held = SuffixFamily(*lengths), [], [], 0

        def flush() -> None:
            rows = pa.Table.from_batches(waiting)
            waiting.clear()
            kept.append(rows.select(["a", "b", "lo", "settled"]))
            family.add(rows.column("before").to_numpy(), rows.column("bytes").to_pylist())

        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                waiting.append(batch.slice(at, BATCH))
                held += waiting[-1].num_rows
                if held >= BATCH:
                    flush()
                    held = 0
        if waiting:
            flush()
        if kept:
            rows = pa.concat_tables(kept)
            hit = np.flatnonzero((family.left >= 0).any(axis=0) & ~rows.column("settled").to_numpy())
            at = rows.column("lo").to_numpy()[hit]
            ends = []
            for left, right in zip(family.left, family.right):
                none = left[hit] < 0
                ends += [pa.array(at - left[hit], mask=none), pa.array(at + right[hit], mask=none)]
            yield pa.RecordBatch.from_arrays([*(pa.array(rows.column(c).to_numpy()[hit]) for c in "ab"), *ends], names=names)
        release()

    return run


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def _apply(text_name: str, span_name: str, lengths: tuple[int, ...], words: tuple[int, ...], as_text: bool):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            release()
            raw, bounds = bytes_of(batch.column(text_name))
            all_spans, kept = [[] for _ in lengths], []
            for i, spans in enumerate(batch.column(span_name).to_pylist()):
                text = raw[bounds[i] : bounds[i + 1]]
                for k, out in enumerate(all_spans):
                    runs = _merge([(s[f"s{k}"], s[f"e{k}"]) for s in spans or [] if s[f"s{k}"] is not None])
                    out.append([(s, e) for s, e in runs if not words[k] or len(bytes(text[s:e]).split()) >= words[k]])
                at, parts = 0, []
                for s, e in all_spans[0][-1]:
                    parts.append(text[at:s])
                    at = e
                kept.append(b"".join([*parts, text[at:]]))
            names = [n for n in batch.schema.names if n not in (text_name, span_name)]
            columns = [batch.column(n) for n in names]
            rest = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
            shown = [pa.array([[{"start": s, "stop": e} for s, e in m] for m in x], kind) for x in all_spans]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(bounds)), shown[0], rest, *shown[1:]], names=[*names, "n_bytes", "spans", "kept", "finer_spans"][: len(names) + 2 + len(lengths)])

    return run


def _lengths(length: int, finer: int | None) -> tuple[int, ...]:
    lengths = (length,) if finer is None else (length, finer)
    if min(lengths) < 2 * GRAM:
        raise ValueError(f"lengths of {2 * GRAM} bytes or more")
    return lengths


def text_rows(docs: DataFrame) -> DataFrame:
    """``a, b, t``: 128 bits of hashes of id and text, and the text."""
    text = text_or_empty()
    return docs.select(F.xxhash64("doc_id", text).alias("a"), F.xxhash64(text, "doc_id", F.lit(1)).alias("b"), text.alias("t"))


def find_anchors(docs: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """The anchors of all texts, one row for the equal contexts of a document, as a table in the shared folder."""
    return stash(text_rows(docs).mapInArrow(_find(min(lengths), max(lengths)), FOUND), "repeats-anchors")


def remove_repeats(
    docs: DataFrame, *, length: int = 400, words: int = 0, finer: int | None = None, finer_words: int = 0, as_text: bool = False, earlier: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """``docs`` without ``text``, with ``n_bytes``, ``spans`` (removed runs, byte offsets) and ``kept``, reserved names.

    ``kept`` is bytes, or with ``as_text`` a string, from which the rest of a character that is cut in two is left out.
    With ``finer``, a lesser length, ``finer_spans`` (reserved too) tells which runs repeat at that length; they stay.
    Runs of fewer than ``words`` (``finer_words``) words, split at ASCII white space, do not count and stay.
    With ``earlier``, the anchors and text rows of other documents, what also starts in one of those repeats as well.
    """
    lengths = _lengths(length, finer)
    base = min(lengths)
    s_text, s_a, s_b, s_spans = fresh(docs, "text", "a", "b", "spans")
    rows = docs.withColumn(s_text, text_or_empty()).drop("text")
    rows = rows.withColumn(s_a, F.xxhash64("doc_id", s_text)).withColumn(s_b, F.xxhash64(s_text, "doc_id", F.lit(1)))

    own = find_anchors(docs, lengths)
    found = own if earlier is None else own.unionByName(earlier[0])
    grams = found.groupBy("gram").agg(F.sum("times").alias("all"), (F.min("context") != F.max("context")).alias("mixed"))
    grams = grams.where("`all` > 1").select("gram", "mixed")
    if earlier is not None:
        grams = grams.join(own.select("gram").distinct(), "gram", "left_semi")
    grams = stash(grams, "repeats-grams")
    repeated = stash(found.join(grams, "gram"), "repeats-repeated")

    # Contexts that differ from others of their gram: one occurrence of each is cut from its text and indexed.
    mixed = repeated.where("mixed")
    kinds = mixed.groupBy("gram", "context").agg(F.sum("times").alias("n"), F.min(F.struct("a", "b", "lo", "before", "after")).alias("one"))
    kinds = stash(kinds, "repeats-contexts")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(parts, 1 + kinds.count() // SHARD)
    wanted = kinds.select(F.col("one.a").alias(s_a), F.col("one.b").alias(s_b), F.struct("gram", "context", "one.a", "one.b", "one.lo", "one.before", "one.after", (F.col("n") > 1).alias("settled")).alias("w"))
    wanted = wanted.groupBy(s_a, s_b).agg(F.collect_list("w").alias("wanted"))
    # Both joins read the same exchange of the texts: same key, same columns, so texts cross the network once.
    dealt = rows.repartition(parts, s_a, s_b)
    keep = [c for c in docs.columns if c != "text"]
    if earlier is None:
        texts = dealt.join(wanted.hint("shuffle_hash"), [s_a, s_b])
    else:
        some = earlier[1].select(F.col("a").alias(s_a), F.col("b").alias(s_b), F.col("t").alias(s_text))
        texts = rows.select(s_a, s_b, s_text).unionByName(some).join(wanted.hint("shuffle_hash"), [s_a, s_b])
    (s_wanted,) = fresh(texts, "wanted")
    texts = texts.select(F.col(s_text).alias(s_text), F.col("wanted").alias(s_wanted), *(keep if earlier is None else []))
    cut = texts.mapInArrow(_cut(s_text, s_wanted), CUT)
    hot = stash(kinds.groupBy("gram").count().where(F.col("count") > HOT).select("gram"), "repeats-hot")
    if hot.isEmpty():
        met = cut.repartition(shards, "gram").mapInArrow(_index(lengths), _spans(lengths))
    else:  # a passage that very many documents share: its windows are counted, pre-aggregated in each task
        cut = stash(cut, "repeats-cut")
        met = cut.join(hot, "gram", "left_anti").repartition(shards, "gram").mapInArrow(_index(lengths), _spans(lengths))
        hashed = cut.join(hot, "gram", "left_semi").mapInArrow(_hashed(lengths, base - GRAM), "gram long, context long, k int, offset int, hash long")
        hashed = stash(hashed, "repeats-windows")
        window = ["gram", "k", "offset", "hash"]
        twice = hashed.groupBy(*window).agg(F.count(F.lit(1)).alias("times")).where("times > 1").select(*window)
        ends = [f(F.when(F.col("k") == k, F.col("offset"))).alias(f"{x}{k}") for k in range(len(lengths)) for x, f in (("s", F.max), ("e", F.min))]
        shared = hashed.join(stash(twice, "repeats-twice"), window).groupBy("gram", "context").agg(*ends)
        shared = shared.join(cut.where("not settled").select("gram", "context", "a", "b", "lo"), ["gram", "context"])
        spans = [e for k, n in enumerate(lengths) for e in ((F.col("lo") - F.col(f"s{k}")).alias(f"s{k}"), (F.col("lo") + n - F.col(f"e{k}")).alias(f"e{k}"))]
        met = met.unionByName(shared.select("a", "b", *spans))

    # Copies of a context match in all their windows, others in those that the index found.
    whole = []
    for k, n in enumerate(lengths):
        has = F.col("before") + F.col("after") >= n
        whole += [F.when(has, F.col("lo") - F.col("before")).alias(f"s{k}"), F.when(has, F.col("hi") + F.least("after", F.lit(n))).alias(f"e{k}")]
    copied = mixed.join(kinds.where("n > 1").select("gram", "context"), ["gram", "context"])
    spans = repeated.where("not mixed").select("a", "b", *whole).unionByName(copied.select("a", "b", *whole)).unionByName(met)
    each = F.struct(*[f"{x}{k}" for k in range(len(lengths)) for x in "se"])
    spans = spans.groupBy(F.col("a").alias(s_a), F.col("b").alias(s_b)).agg(F.collect_list(each).alias(s_spans))

    done = dealt.join(spans.hint("shuffle_hash"), [s_a, s_b], "left")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in done.select(*keep).schema)
    span = "array<struct<start:long,stop:long>>"
    kind = f"{schema}, n_bytes long, spans {span}, kept {'string' if as_text else 'binary'}" + (f", finer_spans {span}" if finer else "")
    return done.select(*keep, s_text, s_spans).mapInArrow(_apply(s_text, s_spans, lengths, (words, finer_words), as_text), kind)


class RepeatIndex:
    """An index of batches on a folder that all executors see: what a new batch repeats, of itself or of any before it.

    Each batch becomes a level, its anchors sorted by gram; a batch is matched with all levels by merge joins, and after
    it levels merge while the newest is as large as the one before it, so there are logarithmically many and each anchor is
    written as often. A level is named by the batches in it; one that another level contains is what an interrupted merge
    has left, and is not read. Texts are kept by batch, since contexts are cut from them when their grams meet.
    """

    def __init__(self, spark: SparkSession, path: str, *, length: int = 400, finer: int | None = None) -> None:
        self.spark, self.path, self.length, self.finer = spark, path.rstrip("/"), length, finer
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._files = hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def levels(self) -> list[tuple[int, int]]:
        """First and last batch of each level, in order."""
        found = [s.getPath().getParent().getName() for s in self._files.globStatus(self._path(f"{self.path}/levels/*/_SUCCESS")) or []]
        every = [tuple(map(int, name.split("-"))) for name in found]
        return sorted(x for x in every if not any(y != x and y[0] <= x[0] and x[1] <= y[1] for y in every))

    def _level(self, first: int, last: int) -> DataFrame:
        return self.spark.read.schema(FOUND).parquet(f"{self.path}/levels/{first}-{last}")

    def _write(self, anchors_: DataFrame, first: int, last: int) -> None:
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        anchors_.repartitionByRange(parts, "gram").sortWithinPartitions("gram", "context").write.mode("overwrite").parquet(f"{self.path}/levels/{first}-{last}")

    def add(self, docs: DataFrame, *, as_text: bool = False) -> DataFrame:
        """The result of ``remove_repeats`` for a new batch, which is part of the index from then on."""
        levels = self.levels()
        earlier = None
        if levels:
            texts = self.spark.read.schema("a long, b long, t string").parquet(*(f"{self.path}/texts/{k}" for k in range(levels[-1][1] + 1)))
            earlier = reduce(DataFrame.unionByName, [self._level(*x) for x in levels]), texts
        out = stash(remove_repeats(docs, length=self.length, finer=self.finer, as_text=as_text, earlier=earlier), "repeats-batch")
        number = levels[-1][1] + 1 if levels else 0
        text_rows(docs).write.mode("overwrite").parquet(f"{self.path}/texts/{number}")
        self._write(find_anchors(docs, _lengths(self.length, self.finer)), number, number)
        levels.append((number, number))
        while len(levels) > 1 and levels[-1][1] - levels[-1][0] >= levels[-2][1] - levels[-2][0]:
            old, new = levels[-2:]
            self._write(self._level(*old).unionByName(self._level(*new)), old[0], new[1])
            levels[-2:] = [(old[0], new[1])]
            for x in (old, new):
                self._files.delete(self._path(f"{self.path}/levels/{x[0]}-{x[1]}"), True)
        return out


#: Bytes of the shorter repeats that the query reports beside its contract, below those of 50 words, and their least words.
FINER, FINER_WORDS = 200, 50


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and ``n_repeated``: bytes in runs of ``FINER_WORDS`` words or more that strings of ``FINER``
    bytes cover which also start elsewhere."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeats(docs, finer=FINER, finer_words=FINER_WORDS)
    size = lambda spans: F.aggregate(spans, F.lit(0).cast("long"), lambda x, s: x + s["stop"] - s["start"])
    return out.select("doc_id", "n_bytes", size("spans").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), size("finer_spans").alias("n_repeated"))


def _spans_sql(length: int, name: str) -> str:
    """Maximal runs of bytes covered by strings of ``length`` bytes that start twice or more, as CTEs over ``d (rid, h)``."""
    return f"""
{name}_w AS (
  SELECT rid, p, count(*) OVER (PARTITION BY w) AS n FROM (
    SELECT rid, p, md5(substr(h, 2 * p + 1, {2 * length})) AS w FROM (SELECT rid, h, unnest(range(0, greatest(0, length(h) // 2 - {length - 1}))) AS p FROM d))
), {name}_s AS (
  SELECT rid, p, CASE WHEN p <= lag(p) OVER (PARTITION BY rid ORDER BY p) + {length} THEN 0 ELSE 1 END AS new FROM {name}_w WHERE n > 1
), {name} AS (
  SELECT rid, min(p) AS lo, max(p) + {length} AS hi FROM (SELECT *, sum(new) OVER (PARTITION BY rid ORDER BY p) AS run FROM {name}_s) GROUP BY rid, run
)"""


OP10_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), {_spans_sql(400, "longer")}, {_spans_sql(FINER, "short")},
finer AS (
  SELECT short.rid, lo, hi FROM short JOIN d USING (rid)
  WHERE len(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(substr(h, 2 * lo + 1, 2 * (hi - lo)), '(..)', '\\1 ', 'g'), '(20|09|0A|0B|0C|0D) ', '.', 'g'), '[0-9A-F]{{2}} ', 'x', 'g'), 'x+')) >= {FINER_WORDS}
), gaps AS (
  SELECT rid, h, start, least(until, length(h) // 2) AS until FROM (
    SELECT d.rid, d.h, coalesce(lag(hi) OVER (PARTITION BY d.rid ORDER BY lo), 0) AS start, lo AS until FROM d JOIN longer ON d.rid = longer.rid
    UNION ALL SELECT d.rid, d.h, coalesce((SELECT max(hi) FROM longer WHERE longer.rid = d.rid), 0), length(h) // 2 FROM d)
), kept AS (
  SELECT rid, sha256(from_hex(coalesce(string_agg(substr(h, 2 * start + 1, 2 * (until - start)), '' ORDER BY start), ''))) AS kept_sha256 FROM gaps GROUP BY rid
)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce((SELECT sum(hi - lo) FROM longer WHERE longer.rid = d.rid), 0) AS BIGINT) AS n_removed,
  (SELECT count(*) FROM longer WHERE longer.rid = d.rid) AS n_spans, kept_sha256, CAST(coalesce((SELECT sum(hi - lo) FROM finer WHERE finer.rid = d.rid), 0) AS BIGINT) AS n_repeated
FROM d JOIN kept USING (rid)
"""
