"""URL filters: longest-match rules, and list membership by a cascade of Bloom filters.

The keys of the corpus (here: hosts) are known, so a list of some of them can be held exactly in filters alone. Level 0
encodes the listed keys; level 1 those of all other corpus keys that level 0 lets through; level 2 the listed ones that
level 1 lets through; and so on until a level lets through none that it should not. A key of the corpus is followed to
the first level that misses it, which tells its side. The answer is exact for every key of the universe, needs no join,
and takes a few bits a key.

Keys are dealt into shards by hash, each with its own cascade, built in one task. All shards together are broadcast
where their measured size is below ``BROADCAST``; beyond it, rows are judged in as many passes as blocks of shards of
that size, so memory is bounded at any scale and no hot host gathers in a task.

A null url or one without ``://`` has an empty host and path; the empty host is a key like any other; rows repeat freely;
extra columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm.common import fresh, stash

#: Keys to a shard, and bytes of filters that are broadcast at once.
SHARD_KEYS, BROADCAST = 500_000, 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct ``rule, verdict`` of the longest of ``(verdict, host, path)`` that fits a host or its parent domains and starts the path."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        best = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


class Filter:
    """A Bloom filter over pairs of 64-bit hashes."""

    def __init__(self, bits: int, hashes: int, seed: int, data: np.ndarray | None = None) -> None:
        self.bits, self.hashes, self.seed = bits, hashes, seed
        self.data = np.zeros((bits + 7) // 8, np.uint8) if data is None else data

    @classmethod
    def over(cls, keys: np.ndarray, rate: float, seed: int) -> Filter:
        rate = min(max(rate, 1e-9), 0.5)
        bits = max(64, int(np.ceil(-len(keys) * np.log(rate) / np.log(2) ** 2)))
        made = cls(bits, max(1, round(-np.log2(rate))), seed)
        for at in made._places(keys):
            np.bitwise_or.at(made.data, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return made

    def _places(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        salt = np.uint64((self.seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
        a, b = keys[:, 0] ^ salt, keys[:, 1] + salt
        for x in (a, b):
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(32)
        b |= np.uint64(1)
        for k in range(self.hashes):
            yield ((a + np.uint64(k) * b) % np.uint64(self.bits)).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for at in self._places(keys):
            found &= (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return found


class Cascade:
    """Alternating filters: even levels encode listed keys, odd ones the others that got through."""

    def __init__(self, levels: list[Filter]) -> None:
        self.levels = levels

    @classmethod
    def over(cls, listed: np.ndarray, others: np.ndarray) -> Cascade:
        levels: list[Filter] = []
        inside, outside = listed, others
        while len(inside):
            rate = 0.5 if levels else 0.7 * len(inside) / max(1, len(outside))
            levels.append(Filter.over(inside, rate, len(levels)))
            inside, outside = outside[levels[-1].has(outside)], inside
        return cls(levels)

    def has(self, keys: np.ndarray) -> np.ndarray:
        """True for listed keys, False for the others of the universe."""
        out, open_ = np.zeros(len(keys), bool), np.arange(len(keys))
        for n, level in enumerate(self.levels):
            through = level.has(keys[open_])
            out[open_[~through]] = n % 2 == 1
            open_ = open_[through]
        out[open_] = len(self.levels) % 2 == 1
        return out

    def to_bytes(self) -> bytes:
        return b"".join([struct.pack("<q", len(self.levels)), *(struct.pack("<qqq", x.bits, x.hashes, x.seed) + x.data.tobytes() for x in self.levels)])

    @classmethod
    def from_bytes(cls, raw: bytes) -> Cascade:
        (n,), at, levels = struct.unpack_from("<q", raw), 8, []
        for _ in range(n):
            bits, hashes, seed = struct.unpack_from("<qqq", raw, at)
            at += 24
            levels.append(Filter(bits, hashes, seed, np.frombuffer(raw, np.uint8, (bits + 7) // 8, at)))
            at += (bits + 7) // 8
        return cls(levels)


def _pairs(a, b) -> np.ndarray:
    return np.stack([np.asarray(a, np.int64), np.asarray(b, np.int64)], axis=1).view(np.uint64).copy()


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(key, F.lit(7))


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(11)), F.lit(shards)).cast("int")


def build_cascades(universe: DataFrame, shards: int) -> DataFrame:
    """Distinct ``key`` (not null) and ``listed`` -> one row ``shard, cascade`` for each shard that has keys."""
    a, b = _hashes(F.col("key"))
    keyed = universe.select(_shard(F.col("key"), shards).alias("shard"), a.alias("a"), b.alias("b"), "listed")
    dealt = keyed.repartition(shards, "shard").sortWithinPartitions("shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts)
            keys, listed = _pairs(t.column("a").to_numpy(), t.column("b").to_numpy()), t.column("listed").to_numpy()
            cascade = Cascade.over(keys[listed], keys[~listed])
            return pa.RecordBatch.from_arrays([pa.array([t.column("shard")[0].as_py()], pa.int32()), pa.array([cascade.to_bytes()])], names=["shard", "cascade"])

        now, parts = None, []
        for batch in batches:
            ids = batch.column("shard").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            for s, e in zip(edges, edges[1:]):
                if e > s:
                    if parts and ids[s] != now:
                        yield made(parts)
                        parts = []
                    now = ids[s]
                    parts.append(batch.slice(s, e - s))
        if parts:
            yield made(parts)

    return dealt.mapInArrow(run, "shard int, cascade binary")


def listed_by_cascade(rows: DataFrame, key: str, universe: DataFrame) -> DataFrame:
    """``rows`` with boolean ``listed`` (a reserved name): whether their key is listed in ``universe``, which must hold every key."""
    universe = stash(universe, "url-universe")
    shards = 1 + universe.count() // SHARD_KEYS
    cascades = stash(build_cascades(universe, shards), "url-cascades")
    sizes = cascades.agg(F.coalesce(F.sum(F.octet_length("cascade")), F.lit(0))).first()[0]
    blocks = 1 + sizes // BROADCAST
    sc = rows.sparkSession.sparkContext

    def judged(part: DataFrame, block: int) -> DataFrame:
        held = sc.broadcast({r["shard"]: bytes(r["cascade"]) for r in cascades.where(F.col("shard") % blocks == block).collect()})  # about BROADCAST bytes

        @F.pandas_udf("boolean")
        def has(shard: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
            out, of = np.zeros(len(a), bool), shard.to_numpy()
            for s in np.unique(of):
                if s in held.value:
                    own = of == s
                    out[own] = Cascade.from_bytes(held.value[s]).has(_pairs(a[own], b[own]))
            return pd.Series(out)

        a, b = _hashes(F.col(key))
        return part.withColumn("listed", has(_shard(F.col(key), shards), a, b))

    if blocks == 1:
        return judged(rows, 0)
    parts = [stash(judged(rows.where(_shard(F.col(key), shards) % blocks == k), k), "url-block") for k in range(blocks)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


#: The query's rules: verdict, host, path.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict`` added (reserved names).

    Where no rule fits, a page is blocked if its host is listed: if some page of that host is blocked by a rule.
    """
    (s_best,) = fresh(pages, "best")
    rows = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rows = rows.withColumn(s_best, longest_rule(F.col("host"), F.col("path"), rules))
    bad = F.coalesce(F.col(s_best)["verdict"] == "block", F.lit(False))
    universe = rows.groupBy(F.col("host").alias("key")).agg(F.max(bad).alias("listed"))
    rows = listed_by_cascade(rows, "host", universe)
    rows = rows.withColumn("rule", F.col(s_best)["rule"])
    rows = rows.withColumn("verdict", F.coalesce(F.col(s_best)["verdict"], F.when(F.col("listed"), "block").otherwise("allow")))
    return rows.drop("listed", s_best)


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = r"""
WITH p AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/') THEN 'org/'
  END AS rule FROM p
), listed AS (
  SELECT DISTINCT host FROM r WHERE rule IN ('example.org/en/1', 'example.org/es/', 'com/de/')
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
  WHEN rule IS NOT NULL THEN 'block'
  WHEN host IN (SELECT host FROM listed) THEN 'block'
  ELSE 'allow' END AS verdict
FROM r
"""
