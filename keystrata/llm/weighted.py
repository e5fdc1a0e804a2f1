"""Document fingerprints by consistent weighted sampling.

A text is a weighted set: its words, weighing as often as they occur. For each of ``SAMPLES`` samples a term of weight w
draws, from hashes of the term alone, r and c of the Gamma(2, 1) distribution and b of the uniform one, and sets
``t = floor(ln w / r + b)``, ``ln y = r (t - b)``, ``ln a = ln c - ln y - r``. The term of least ``a`` is the sample, together
with its t. Two texts have equal samples with a probability equal to their generalised Jaccard similarity, the sum of
the lesser weights over the sum of the greater ones. A fingerprint is 16 bits of each sample's hash, in hex.

The draws of a term and weight are the same everywhere, so workers remember them (``KEPT`` rows at most). Null and empty
texts, and texts of white space, have the fingerprint of zeros, like each other and nothing else; repeated rows have
equal fingerprints; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm.common import text_or_empty

SAMPLES, KEPT = 64, 150_000
GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((_mix(x) >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def draws(terms: np.ndarray, weights: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and weights of terms -> ``ln a`` and 16 bits of the hash of ``(term, t)``, a row of samples for each."""
    seed = _mix(terms[:, None] + GOLD * np.arange(1, samples + 1, dtype=np.uint64)[None, :])
    u = [_uniform(seed + np.uint64(k)) for k in range(1, 6)]
    r, c, b = -np.log(u[0] * u[1]), -np.log(u[2] * u[3]), u[4]
    t = np.floor(np.log(weights)[:, None] / r + b)
    a = np.log(c) - r * (t - b) - r
    bits = _mix(seed ^ (t.astype(np.int64).view(np.uint64) * GOLD)) >> np.uint64(48)
    return a.astype(np.float32), np.maximum(bits, 1).astype(np.uint16)


class Sampler:
    """Signatures of texts; remembers the draws of terms."""

    def __init__(self, samples: int = SAMPLES) -> None:
        self.samples, self.row = samples, {}
        self.least, self.bits = np.zeros((KEPT, samples), np.float32), np.zeros((KEPT, samples), np.uint16)

    def _rows(self, keys: list[tuple[bytes, int]]) -> np.ndarray:
        import xxhash

        new = [k for k in keys if k not in self.row]
        if new:
            if len(self.row) + len(new) > KEPT:
                self.row.clear()
                new = keys
            at = len(self.row)
            for s in range(0, len(new), 2048):
                some = new[s : s + 2048]
                terms = np.fromiter((xxhash.xxh64_intdigest(w) for w, _ in some), np.uint64, len(some))
                a, bits = draws(terms, np.array([n for _, n in some], np.float64), self.samples)
                self.least[at + s : at + s + len(some)], self.bits[at + s : at + s + len(some)] = a, bits
            self.row.update(zip(new, range(at, at + len(new))))
        return np.fromiter(map(self.row.__getitem__, keys), np.int64, len(keys))

    def sign(self, text: str | None) -> np.ndarray:
        counts = list(Counter((text or "").encode("utf-8", "surrogatepass").split()).items())
        if not counts:
            return np.zeros(self.samples, np.uint16)
        best = None
        for at in range(0, len(counts), KEPT // 4):  # a text of very many words, some at a time
            rows = self._rows(counts[at : at + KEPT // 4])
            block = self.least[rows]
            win = block.argmin(axis=0)
            a, bits = block[win, np.arange(self.samples)], self.bits[rows[win], np.arange(self.samples)]
            best = (a, bits) if best is None else (np.minimum(best[0], a), np.where(a < best[0], bits, best[1]))
        return best[1]


_SAMPLERS: dict[int, Sampler] = {}


def _sampler(samples: int) -> Sampler:
    if samples not in _SAMPLERS:
        _SAMPLERS[samples] = Sampler(samples)
    return _SAMPLERS[samples]


def shown(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def fingerprint(text: Column, samples: int = SAMPLES) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        sampler = _sampler(samples)
        return pd.Series([shown(sampler.sign(t)) for t in texts], dtype="object")

    return run(text)


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples of two fingerprints: an estimate of the texts' generalised Jaccard similarity."""
    at = F.sequence(F.lit(1), F.lit(4 * samples - 3), F.lit(4))
    same = F.filter(at, lambda i: F.substring(a, i, F.lit(4)) == F.substring(b, i, F.lit(4)))
    return F.size(same) / F.lit(float(samples))


def edited_by_next(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of ``doc_id, text`` and of the text whose last third is the start of the next document's.

    Next is by descending id (nulls last), equal ids by text hash; the last document is followed by the first. Rows are
    dealt out by ranges of ids (those without one by ranges of text hashes), each range in order as a stream, with a copy
    of the row that follows the range. Texts cross the network once.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("tie", F.xxhash64("text"))
    n, n_null = rows.agg(F.count(F.lit(1)), F.count_if(F.col("doc_id").isNull())).first()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges, null_ranges = (max(1, min(10_000, 8 * parts, k // 64)) for k in (n, n_null))
    ids = rows.where("doc_id is not null").select("doc_id")
    at = [k / ranges for k in range(1, ranges + 1)]
    cuts = ids.agg(F.percentile_approx("doc_id", at, 10 * ranges)).first()[0] or []  # at most 10,000 ids
    bounds = np.unique(np.array(cuts, np.int64))

    @F.arrow_udf("int")
    def range_of(ids: pa.Array, ties: pa.Array) -> pa.Array:  # 0 holds the greatest ids, the last ones those that are null
        none = ids.is_null().to_numpy(zero_copy_only=False)
        at = len(bounds) - np.searchsorted(bounds, ids.fill_null(0).to_numpy(), side="left")
        last = len(bounds) + 1 + (((ties.to_numpy() >> 32) + (1 << 31)) * null_ranges >> 32)
        return pa.array(np.where(none, last, at).astype(np.int32))

    dealt = rows.withColumn("range", range_of("doc_id", "tie"))
    # The first row of each range, in the order nulls last, ids down, hashes up.
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.bitwise_not("doc_id").alias("down"), "tie")
    firsts = sorted(dealt.groupBy("range").agg(F.min(order).alias("o")).collect(), key=lambda r: r["range"])  # a row for each range
    follows = {r["range"]: firsts[k - 1]["range"] for k, r in enumerate(firsts)}
    to = F.lit(None).cast("int")
    if follows:
        table = spark.createDataFrame([(r["range"], follows[r["range"]], r["o"]["none"], r["o"]["down"], r["o"]["tie"]) for r in firsts], "f_range int, f_to int, f_none boolean, f_down long, f_tie long")
        dealt = dealt.join(F.broadcast(table), F.col("range") == F.col("f_range"), "left")
        first = (F.col("doc_id").isNull() == F.col("f_none")) & F.bitwise_not("doc_id").eqNullSafe(F.col("f_down")) & (F.col("tie") == F.col("f_tie"))
        to = F.when(first, F.col("f_to"))
    own = F.struct(F.col("range"), F.lit(False).alias("after"))
    more = F.when(to.isNotNull(), F.array(own, F.struct(to.alias("range"), F.lit(True).alias("after")))).otherwise(F.array(own))
    sent = dealt.select("doc_id", "text", "tie", F.explode(more).alias("at")).select("doc_id", "text", "tie", "at.range", "at.after")
    sent = sent.repartition(parts, "range").sortWithinPartitions("range", "after", F.col("doc_id").desc_nulls_last(), "tie")
    kind = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _sampler(samples)
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = [f.split()[0] for f in kind.split(", ")]
        held = None
        for batch in batches:
            out = []
            for doc, text, where, after in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "range", "after"))):
                if after and (held is None or held[2] != where):
                    continue  # a copy of a copy
                mine = sampler.sign(text)
                if held is not None and held[2] == where:
                    old_doc, old, _, theirs = held
                    k = len(old) // 3
                    edited = old[: len(old) - k] + text[:k]
                    sign = sampler.sign(edited)
                    out.append((old_doc, len(old), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), shown(theirs), shown(sign), float((theirs == sign).mean()), float((theirs == mine).mean())))
                held = None if after else (doc, text, where, mine)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)

    return sent.mapInArrow(run, kind)


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_by_next(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
