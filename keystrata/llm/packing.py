"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Lengths have at most ``capacity`` values, so the packing is planned on their histogram (2,048 rows, whatever the
corpus) and carried out by rank within a length. The plan: items above one third of the capacity pair greedily, each
with the largest partner that still fits, two per bin at most; smaller ones go, longest first, into the tightest gap
that holds them, and open new bins when none does. A run of equal lengths is placed in one step; each step cuts a gap
below the length placed, so a gap group is met O(log capacity) times and the plan stays at some ten thousand rows.

Ranks come from a window over ``(length, salt)``, with as many salts as keep a window at ``RANK_ROWS`` rows, and prefix
counts over the salts: a hot length is spread over tasks. Texts and ids never move.

Null and empty texts are the end id alone; longer documents than the capacity are cut, the last piece may be shorter;
rows with a null length, one below 1 or above the capacity get no sequence (null); ties and repeated rows are ranked
by whatever order columns are given, and are interchangeable beyond that; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keystrata.llm.common import bytes_of, fresh, release, stash

RANK_ROWS = 20_000
#: Bytes of text encoded at a time.
TEXT_BLOCK = 4 << 20
#: Words and parts of words whose ids a Python worker remembers, and the longest of them.
WORDS_KEPT, PARTS_KEPT, LONGEST_KEPT = 50_000, 400_000, 64
#: White space for ``str.split`` but not for the tokenizers' ``\s``.
SEPARATORS = "\x1c\x1d\x1e\x1f"
# The normaliser, the splitting and the mark of a word's end that ``WordEncoder`` follows in numpy.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTING = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": SPLITTING}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
WORD_END = "</w>"


class WordEncoder:
    """Ids of whole texts, as little-endian uint32 bytes, for a byte-level tokenizer whose tokens never span white space.

    Such a tokenizer lower-cases a text and splits it into contractions, runs of letters, single digits and runs of
    other signs; the text's ids are those of the parts, one after the other. Texts of ASCII and Western accented letters
    are split in numpy, some megabytes at a time; their distinct parts are found in Arrow, those not seen before go to
    the tokenizer's merges, thousands in a call, and ids are gathered by part number. Other texts go word by word through
    the whole tokenizer, and as a whole where they hold what looks like a special token or separators. A tokenizer that
    splits in any other way gets all texts as a whole.
    """

    #: Bytes outside ASCII and U+00C0 to U+00FF, or separators that only Python takes for white space.
    ODD = bytes(b in range(0x1C, 0x20) or b == 0xC2 or b > 0xC3 for b in range(256))
    #: 0 white space, 1 letters, 2 digits, 3 other signs.
    KIND = bytes(0 if b in b" \t\n\r\x0b\x0c" else 1 if chr(b).isalpha() or b > 127 else 2 if 48 <= b <= 57 else 3 for b in range(256))
    LOWER = bytes(range(256)).lower()

    def __init__(self, path: str, kept: int = PARTS_KEPT, block: int = TEXT_BLOCK) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        special = all(t["content"].startswith("<|") for t in rules["added_tokens"])
        self.by_words = special and (rules["normalizer"], rules["pre_tokenizer"], rules["model"].get("end_of_word_suffix")) == (NORMALIZER, PRE_TOKENIZER, WORD_END)
        self.kept, self.block = kept, block
        if not self.by_words:
            return
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.parts: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.other: dict[str, bytes] = {}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # a byte-level alphabet shows the other bytes by 256, 257, ...
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet = np.arange(256, dtype="<u4")
        self.alphabet[hidden] = 256 + np.arange(len(hidden))
        self.alphabet[32] = 32
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a part
        self.last[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _merge(self, parts: list[bytes]) -> list[bytes]:
        """Ids of distinct parts. Of those remembered, the ones met since the last turnover outlive the next."""
        if len(self.parts) > self.kept // 2:
            self.parts, self.older = {}, self.parts
        kept, older = self.parts, self.older
        out = list(map(kept.get, parts))
        missing = [i for i, known in enumerate(out) if known is None]
        new = []
        for i in missing:
            p = parts[i]
            known = older.get(p)
            if known is None:
                new.append(p)
            else:
                out[i] = kept[p] = known
        for at in range(0, len(new), 2000):
            some = new[at : at + 2000]
            shown = np.take(self.alphabet, np.frombuffer(b" ".join(some), np.uint8)).tobytes().decode("utf-32-le")
            ids = np.array(self.merges.encode_batch_fast([shown], add_special_tokens=False)[0].ids, "<u4")
            raw, cut = ids.tobytes(), [0, *(4 * np.flatnonzero(self.last[ids]) + 4).tolist()]
            kept.update(zip(some, (raw[s:e] for s, e in zip(cut, cut[1:]))))
        if new:
            for i in missing:
                if out[i] is None:
                    out[i] = kept[parts[i]]
        if new and max(map(len, new)) > LONGEST_KEPT:
            for p in new:
                if len(p) > LONGEST_KEPT:
                    del kept[p]
        return out

    def _split(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lower-cased bytes, which are not white space, and where parts start."""
        raw = data.tobytes()
        data = np.frombuffer(bytearray(raw.translate(self.LOWER)), np.uint8)
        kind = np.frombuffer(bytearray(raw.translate(self.KIND)), np.int8)
        wide = np.flatnonzero(data == 0xC3)
        upper = wide[(data[wide + 1] <= 0x9E) & (data[wide + 1] != 0x97)]
        signs = wide[(data[wide + 1] == 0x97) | (data[wide + 1] == 0xB7)]
        data[upper + 1] += 32
        kind[signs] = kind[signs + 1] = 3
        start = (kind == 1) | (kind == 3)
        start[1:] &= kind[1:] != kind[:-1]
        start |= kind == 2
        first = bounds[:-1][bounds[:-1] < bounds[1:]]
        start[first] = kind[first] > 0
        # A contraction is a part of its own where it does not end a run of signs.
        quote = np.flatnonzero((data == 39) & start)
        if len(quote):
            text_end = bounds[np.searchsorted(bounds, quote, side="right")]
            after = np.concatenate([data, np.zeros(2, np.uint8)])
            one, two = after[quote + 1], after[quote + 2]
            one, two = np.where(quote + 1 < text_end, one, 0), np.where(quote + 2 < text_end, two, 0)
            single = np.isin(one, list(b"stmd"))
            double = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
            for hit, size in ((quote[single], 2), (quote[double], 3)):
                start[hit + 1] = False
                rest = hit + size
                inside = rest[rest < len(data)]
                start[inside] |= kind[inside] == 1
        return data, kind > 0, start

    def _plain(self, data: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """Ids of the plain texts between ``bounds``."""
        if not len(data):
            return [b""] * (len(bounds) - 1)
        data, solid, start = self._split(data, bounds)
        at = np.flatnonzero(start)
        if not len(at):
            return [b""] * (len(bounds) - 1)
        data = data[solid]
        ends = np.append(np.flatnonzero(start[solid]), len(data)).astype(np.int32)
        parts = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
        _, until, every = parts.dictionary.buffers()
        every, cut = every.to_pybytes(), np.frombuffer(until, np.int32)[: len(parts.dictionary) + 1].tolist()
        ids = pa.array(self._merge([every[s:e] for s, e in zip(cut, cut[1:])]), pa.large_binary()).take(parts.indices)
        _, until, out = ids.buffers()
        cut = np.frombuffer(until, np.int64)[np.searchsorted(at, bounds)].tolist()
        out = memoryview(out)
        return [bytes(out[s:e]) for s, e in zip(cut, cut[1:])]

    def _odd(self, text: str) -> bytes:
        if "<|" in text or any(c in text for c in SEPARATORS):
            return self._whole([text])[0]
        words, kept = text.split(), self.other
        if len(kept) > WORDS_KEPT:
            kept.clear()
        new = list(set(words).difference(kept))
        kept.update(zip(new, self._whole(new)))
        out = b"".join(map(kept.__getitem__, words))
        for w in new:
            if len(w) > LONGEST_KEPT:
                del kept[w]
        return out

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        raw, ends = bytes_of(texts)
        every, at = np.frombuffer(raw, np.uint8), 0
        while at < len(texts) and not self.by_words:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + self.block, side="right")) - 1)
            yield from self._whole([bytes(raw[ends[i] : ends[i + 1]]).decode("utf-8", "surrogatepass") for i in range(at, to)])
            at = to
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + self.block, side="right")) - 1)
            lo, bounds = int(ends[at]), ends[at : to + 1] - ends[at]
            data = every[lo : int(ends[to])]
            bad = np.flatnonzero(np.frombuffer(data.tobytes().translate(self.ODD), np.bool_))
            if len(data):
                bad = np.concatenate([bad, np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))])  # "<|"
            odd = set((np.searchsorted(bounds, np.unique(bad), side="right") - 1).tolist())
            if odd:
                clear = [i for i in range(to - at) if i not in odd]
                data = np.concatenate([data[bounds[i] : bounds[i + 1]] for i in clear]) if clear else data[:0]
                sizes = [bounds[i + 1] - bounds[i] for i in clear]
                plain = iter(self._plain(data, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)))
            else:
                plain = iter(self._plain(data, bounds))
            for i in range(to - at):
                yield self._odd(bytes(raw[lo + bounds[i] : lo + bounds[i + 1]]).decode("utf-8", "surrogatepass")) if i in odd else next(plain)
            at = to


_ENCODERS: dict[tuple, WordEncoder] = {}


def pieces(text: Column, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = True, kept: int = PARTS_KEPT, block: int = TEXT_BLOCK) -> Column:
    """Array of ``piece, start, length, ids_crc32`` and, if asked for, ``ids``.

    ``kept`` and ``block`` trade a worker's memory (parts remembered, bytes encoded at a time) for time.
    """
    kind = "array<struct<piece:int,start:long,length:long,ids_crc32:long" + (",ids:array<int>" if with_ids else "") + ">>"

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        own = (tokenizer, kept, block)
        if own not in _ENCODERS:
            _ENCODERS[own] = WordEncoder(*own)
        encoder = _ENCODERS[own]
        cut, rows, ids = [0], [], []
        for buf in encoder.encode(texts):
            buf += int(end_id).to_bytes(4, "little")
            n = len(buf) // 4
            for piece, start in enumerate(range(0, n, capacity)):
                part = buf[4 * start : 4 * (start + capacity)]
                rows.append((piece, start, len(part) // 4, zlib.crc32(part)))
                if with_ids:
                    ids.append(part)
            cut.append(len(rows))
        release()
        columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
        names = ["piece", "start", "length", "ids_crc32"]
        if with_ids:
            flat = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
            ends = np.concatenate([[0], np.cumsum([len(p) // 4 for p in ids], dtype=np.int64)]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(ends), flat))
            names.append("ids")
        return pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays(columns, names))

    return run(text)


def tokenize(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = True, **memory: int) -> DataFrame:
    """One row per piece: the columns of ``docs`` but its text, and those of ``pieces`` (reserved names)."""
    (s_all,) = fresh(docs, "pieces")
    rows = docs.withColumn(s_all, pieces(F.col("text"), tokenizer, capacity, end_id, with_ids, **memory)).drop("text")
    keep = [c for c in rows.columns if c != s_all]
    return rows.select(*keep, F.inline(s_all))


def plan_packing(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """``length -> count`` to placements ``(length, first rank, first bin, items per bin, offset)``.

    The item of rank r in a placement that starts at rank f goes to bin ``first bin + (r - f) // per bin``, at
    ``offset + (r - f) % per bin * length``. Placements of a length are in order of rank.
    """
    left = dict(counts)
    rank: dict[int, int] = defaultdict(int)
    out: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []
    bins = 0

    def free(gap: int, first: int, n: int) -> None:
        if gap > 0 and n:
            if gap not in gaps:
                insort(sizes, gap)
            gaps.setdefault(gap, []).append((first, n))

    def put(length: int, n: int, first: int, per_bin: int, offset: int) -> None:
        out.append((length, rank[length], first, per_bin, offset))
        rank[length] += n
        left[length] -= n

    large = sorted(a for a in counts if 3 * a > capacity and counts[a])
    while large:
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        at = bisect_left(large, capacity - a + 1) - 1
        while at >= 0 and not left[large[at]]:
            large.pop(at)
            at -= 1
        b = large[at] if at >= 0 else 0
        if b == a and left[a] > 1:
            n = left[a] // 2
            put(a, 2 * n, bins, 2, 0)
        elif b and b != a:
            n = min(left[a], left[b])
            put(a, n, bins, 1, 0)
            put(b, n, bins, 1, a)
        elif b == a and at > 0 and any(left[x] for x in large[:at]):
            b = next(x for x in reversed(large[:at]) if left[x])
            n = 1
            put(a, n, bins, 1, 0)
            put(b, n, bins, 1, a)
        else:
            n, b = left[a], 0
            put(a, n, bins, 1, 0)
        free(capacity - a - b, bins, n)
        bins += n

    for s in sorted((s for s in counts if 3 * s <= capacity and counts[s]), reverse=True):
        while left[s]:
            at = bisect_left(sizes, s)
            if at == len(sizes):
                per = capacity // s
                full, rest = divmod(left[s], per)
                if full:
                    put(s, full * per, bins, per, 0)
                    free(capacity - per * s, bins, full)
                    bins += full
                if rest:
                    put(s, rest, bins, rest, 0)
                    free(capacity - rest * s, bins, 1)
                    bins += 1
                break
            gap = sizes[at]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                sizes.pop(at)
            per = gap // s
            full = min(n, left[s] // per)
            if full:
                put(s, full * per, first, per, capacity - gap)
                free(gap - per * s, first, full)
            rest = left[s] if full < n else 0
            if rest:
                put(s, rest, first + full, rest, capacity - gap)
                free(gap - rest * s, first + full, 1)
            free(gap, first + full + bool(rest), n - full - bool(rest))
    return out


def pack(items: DataFrame, *, capacity: int = 2048, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``items`` with ``sequence_id`` and ``offset`` added (reserved names). ``items`` is read twice: pass a table."""
    spark = items.sparkSession
    fits = F.col(length).between(1, capacity)
    counts = {int(r[0]): int(r[1]) for r in items.where(fits).groupBy(F.col(length).cast("int")).count().collect()}  # `capacity` rows at most
    placed = sorted(plan_packing(counts, capacity), key=lambda p: (p[0], p[1]))
    table = spark.sparkContext.broadcast(np.array(placed, np.int64).reshape(-1, 5).T.copy())
    salts = spark.sparkContext.broadcast(np.array([1 + counts.get(n, 0) // RANK_ROWS for n in range(capacity + 1)], np.int64))

    @F.pandas_udf("long")
    def salts_of(n: pd.Series) -> pd.Series:
        n = n.fillna(0).to_numpy(np.int64)
        return pd.Series(salts.value[np.where((n < 1) | (n >= len(salts.value)), 0, n)])

    @F.pandas_udf("sequence_id long, offset long")
    def place(n: pd.Series, r: pd.Series) -> pd.DataFrame:
        n, r = n.to_numpy(np.int64), r.to_numpy(np.int64)
        lengths, first, start, per, offset = table.value
        at = np.searchsorted((lengths << 44) + first, (n << 44) + r, side="right") - 1
        k = r - first[at]
        return pd.DataFrame({"sequence_id": start[at] + k // per[at], "offset": offset[at] + k % per[at] * n})

    s_salt, s_base, s_rank, s_at, s_len, s_with = fresh(items, "salt", "base", "rank", "at", "len", "with")
    spread = F.pmod(F.xxhash64(*order), salts_of(F.col(length).cast("long")))
    salted = items.where(fits).withColumn(s_salt, spread)
    sums = salted.groupBy(F.col(length).alias(s_len), F.col(s_salt).alias(s_with)).agg(F.count(F.lit(1)).alias(s_base))
    run = Window.partitionBy(s_len).orderBy(s_with)
    sums = stash(sums.withColumn(s_base, F.sum(s_base).over(run) - F.col(s_base)), "pack-bases")
    ranked = salted.withColumn(s_rank, F.row_number().over(Window.partitionBy(length, s_salt).orderBy(*order)))
    ranked = ranked.join(sums, (F.col(length) == F.col(s_len)) & (F.col(s_salt) == F.col(s_with)))
    ranked = ranked.withColumn(s_at, place(F.col(length).cast("long"), F.col(s_base) + F.col(s_rank) - 1))
    done = ranked.select(*items.columns, F.col(s_at)["sequence_id"].alias("sequence_id"), F.col(s_at)["offset"].alias("offset"))
    rest = items.where(~F.coalesce(fits, F.lit(False))).withColumn("sequence_id", F.lit(None).cast("long")).withColumn("offset", F.lit(None).cast("long"))
    return done.unionByName(rest)


def word_tokenizer() -> str:
    """The packing queries' tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = stash(tokenize(docs, word_tokenizer(), with_ids=False), "pieces")
    return pack(items, order=("doc_id", "piece", "ids_crc32"))
