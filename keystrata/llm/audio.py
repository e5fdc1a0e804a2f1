"""Chroma fingerprints of audio columns, and alignment of recordings.

A media column holds WAV files (PCM, one or more channels). Windows of the signal are folded into twelve pitch classes;
over the integral image of these frames sixteen rectangle filters compare neighbouring areas (earlier with later, lower
with higher, middle with outside), and each gives two bits in Gray code, so a frame position becomes a 32-bit integer.
Recordings are aligned by the histogram of offsets at which pairs of integers, ``STRIDE`` apart, are equal; the offset
with most votes is checked by the share of differing bits over the whole overlap.

Equal fingerprints are one entry of the index, so a group of copies is met once; pairs of integers (64 bits) are specific
to a recording, so the index join stays in proportion. Silence gives no pairs, and a pair that a held note repeats from
one position to the next counts once, where it begins. Matches need ``MIN_VOTES`` equal pairs at one offset.

Null, empty, broken or too short media have an empty fingerprint, which matches nothing; rows repeat freely; an empty
table gives an empty result.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm.common import stash

WINDOW_S, HOP_S, WIDTH, STRIDE, MIN_VOTES, MAX_ERROR = 0.256, 0.064, 16, 3, 2, 0.25
LOWEST, HIGHEST = 55.0, 1760.0


def _filters() -> list[tuple[int, int, int, int]]:
    """``kind, first pitch class, height, width``: sixteen by rule, kinds in turn, wider as they go."""
    return [(k % 4, (5 * k) % 8, 2 + (k // 4) % 3, 4 + 4 * (k % 4)) for k in range(16)]


FILTERS = _filters()


def samples_of(media: bytes | None) -> tuple[np.ndarray, int]:
    """Mono samples and rate of a WAV file; none if it can't be read."""
    try:
        with wave.open(io.BytesIO(media or b"")) as f:
            width, channels, rate, raw = f.getsampwidth(), f.getnchannels(), f.getframerate(), f.readframes(f.getnframes())
    except (wave.Error, EOFError, ValueError):
        return np.zeros(0), 1
    if width not in (1, 2, 4) or rate <= 0:
        return np.zeros(0), 1
    raw = raw[: len(raw) // (width * channels) * width * channels]
    x = np.frombuffer(raw, {1: np.uint8, 2: "<i2", 4: "<i4"}[width]).astype(np.float64).reshape(-1, channels).mean(1)
    return (x - 128 if width == 1 else x), rate


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Frames of twelve pitch classes, each frame of unit length (or zero if silent)."""
    size, hop = max(32, int(WINDOW_S * rate)), max(1, int(HOP_S * rate))
    if len(samples) < size:
        return np.zeros((0, 12))
    frequency = np.fft.rfftfreq(size, 1 / rate)
    use = np.flatnonzero((frequency >= LOWEST) & (frequency <= HIGHEST))
    note = np.round(12 * np.log2(frequency[use] / 440)).astype(int) % 12
    fold = np.zeros((len(use), 12))
    fold[np.arange(len(use)), note] = 1
    out = []
    starts = np.arange(0, len(samples) - size + 1, hop)
    for at in range(0, len(starts), 512):
        some = np.lib.stride_tricks.sliding_window_view(samples, size)[starts[at : at + 512]]
        out.append((np.abs(np.fft.rfft(some * np.hanning(size), axis=1)[:, use]) ** 2) @ fold)
    frames = np.concatenate(out)
    norm = np.sqrt((frames**2).sum(1, keepdims=True))
    return np.where(norm > 1e-6, frames / np.maximum(norm, 1e-12), 0)


def fingerprint(media: bytes | None) -> np.ndarray:
    """A uint32 for each position of the filters."""
    frames = chroma(*samples_of(media))
    n = len(frames) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(frames) + 1, 13))
    image[1:, 1:] = frames.cumsum(0).cumsum(1)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        at = np.arange(n)
        return image[at + t1, p1] - image[at + t0, p1] - image[at + t1, p0] + image[at + t0, p0]

    out = np.zeros(n, np.uint32)
    for kind, first, height, width in FILTERS:
        p0, p1, half = first, min(12, first + 2 * height), width // 2
        middle = (p0 + p1) // 2
        if kind == 0:
            a, b = area(0, half, p0, p1), area(half, width, p0, p1)
        elif kind == 1:
            a, b = area(0, width, p0, middle), area(0, width, middle, p1)
        elif kind == 2:
            a, b = area(0, half, p0, middle) + area(half, width, middle, p1), area(half, width, p0, middle) + area(0, half, middle, p1)
        else:
            third = width // 3
            a, b = area(third, 2 * third, p0, p1), area(0, third, p0, p1) + area(2 * third, 3 * third, p0, p1)
        value = np.log1p(np.maximum(a, 0)) - np.log1p(np.maximum(b, 0))
        level = (value > -0.15).astype(np.uint32) + (value > 0) + (value > 0.15)
        out = (out << np.uint32(2)) | (level ^ (level >> 1)).astype(np.uint32)
    return out


def fingerprints(media: Column) -> Column:
    """Array of integers for each value of a binary column."""

    @F.pandas_udf("array<long>")
    def run(files: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(m).astype(np.int64) for m in files], dtype="object")

    return run(media)


#: What the filters give over silence: all areas are equal.
SILENCE = 0x55555555


def bit_error(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[float, int]:
    """Share of differing bits where ``a`` lies over ``b`` from ``b[offset]`` on, and the overlap."""
    lo, hi = max(0, -offset), min(len(a), len(b) - offset)
    if hi <= lo:
        return 1.0, 0
    return float(np.bitwise_count(a[lo:hi] ^ b[lo + offset : hi + offset]).mean() / 32), hi - lo


def _keys(prints: DataFrame, name: str) -> DataFrame:
    pair = lambda i: F.struct(F.element_at("print", i).alias("x"), F.element_at("print", i + STRIDE).alias("y"))
    sounds = lambda p: (p["x"] != SILENCE) | (p["y"] != SILENCE)
    begins = lambda i: sounds(pair(i)) & ((i == 1) | (pair(i) != pair(F.greatest(i - 1, F.lit(1)))))
    at = F.explode(F.filter(F.sequence(F.lit(1), F.size("print") - F.lit(STRIDE)), begins)).alias(f"{name}_at")
    long = prints.where(F.size("print") > STRIDE).select(F.col("id").alias(name), "print", at)
    return long.select(name, f"{name}_at", F.xxhash64(pair(F.col(f"{name}_at"))).alias("key"))


def align(queries: DataFrame, index: DataFrame) -> DataFrame:
    """``id, print`` on both sides, ids unique -> each query's best ``match, offset, votes, error`` (null without one).

    ``offset`` is the position in the match at which the query starts.
    """
    met = _keys(queries, "q").join(_keys(index, "m"), "key")
    votes = met.groupBy("q", "m", (F.col("m_at") - F.col("q_at")).alias("offset")).agg(F.count(F.lit(1)).alias("votes")).where(F.col("votes") >= MIN_VOTES)
    best = votes.groupBy("q", "m").agg(F.max(F.struct("votes", (-F.abs("offset")).alias("near"), "offset")).alias("b"))
    best = best.select("q", "m", F.col("b.offset").alias("offset"), F.col("b.votes").alias("votes"))
    both = best.join(queries.select(F.col("id").alias("q"), F.col("print").alias("q_print")), "q").join(index.select(F.col("id").alias("m"), F.col("print").alias("m_print")), "m")

    @F.pandas_udf("double")
    def error(a: pd.Series, b: pd.Series, offset: pd.Series) -> pd.Series:
        return pd.Series([bit_error(np.asarray(x).astype(np.uint32), np.asarray(y).astype(np.uint32), int(o))[0] for x, y, o in zip(a, b, offset)], dtype="float64")

    checked = both.withColumn("error", error("q_print", "m_print", "offset")).where(F.col("error") <= MAX_ERROR)
    rank = F.min(F.struct("error", (-F.col("votes")).alias("v"), "m", "offset", "votes")).alias("b")
    found = checked.groupBy("q").agg(rank).select(F.col("q").alias("id"), F.col("b.m").alias("match"), F.col("b.offset").alias("offset"), F.col("b.votes").alias("votes"), F.col("b.error").alias("error"))
    return queries.select("id").join(found, "id", "left")


#: The query's recordings: sampling rate, seconds a note.
RATE, NOTE_S = 4000, 0.25


def render(vector: list[float] | None, cut: float = 0.0, noise: float = 0.0, seed: int = 0) -> bytes:
    """A vector as a WAV file: pairs of its components are the two voices of notes. ``cut`` seconds are left out at the
    start, ``noise`` is the amplitude of noise against that of a voice."""
    v = np.nan_to_num(np.asarray([0.0 if x is None else x for x in ([] if vector is None else vector)], np.float64))
    scale = np.sqrt((v**2).mean()) if len(v) and (v**2).any() else 1.0
    pitch = np.clip(np.round(18 + 8 * v / scale), 0, 36)
    t = np.arange(int(NOTE_S * RATE)) / RATE
    tone = np.sin(2 * np.pi * (110 * 2 ** (pitch / 12))[:, None] * t[None, :])
    x = tone[0 : len(v) // 2 * 2 : 2] + tone[1 : len(v) // 2 * 2 : 2]
    x = x.ravel()[int(cut * RATE) :]
    if noise:
        x = x + noise * np.random.default_rng(seed).standard_normal(len(x))
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(RATE)
        f.writeframes((np.clip(x, -4, 4) * 8000).astype("<i2").tobytes())
    return out.getvalue()


def op6_media_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings rendered from ``embeddings``; those of ids divisible by 20, cut and noisy, are sought among all.

    A row per vector: ``n_frames``, ``fingerprint`` (hex), ``class_id`` (least id of its fingerprint), and for queries the
    class found, the offset, the votes and the share of differing bits.
    """
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, vectors = part.column("vec_id").to_pylist(), part.column("embedding").to_pylist()
                own = [fingerprint(render(v)).astype(np.int64) for v in vectors]
                asked = [fingerprint(render(v, 0.5, 0.05, i)).astype(np.int64) if i is not None and i % 20 == 0 else None for i, v in zip(ids, vectors)]
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(own, pa.list_(pa.int64())), pa.array(asked, pa.list_(pa.int64()))], names=["vec_id", "print", "asked"])

    made = stash(rows.mapInArrow(run, "vec_id long, print array<long>, asked array<long>"), "audio-prints")
    made = made.withColumn("hex", F.array_join(F.transform("print", lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), ""))
    classes = stash(made.groupBy("print").agg(F.min("vec_id").alias("id")).where("id is not null"), "audio-classes")
    queries = stash(made.where("asked is not null").select(F.col("vec_id").alias("id"), F.col("asked").alias("print")).dropDuplicates(["id"]), "audio-queries")
    found = align(queries, classes)
    named = made.join(classes.select("print", F.col("id").alias("class_id")), "print", "left")
    out = named.join(found.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    return out.select("vec_id", F.size("print").cast("long").alias("n_frames"), F.col("hex").alias("fingerprint"), "class_id", F.col("match").alias("match_class"), F.col("offset").cast("long").alias("match_offset"), F.col("votes").alias("match_votes"), F.col("error").alias("match_error"))
