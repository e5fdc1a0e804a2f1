"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage of the whole text is described by counts (kinds of
bytes and their successions, word lengths, repeats within the passage and the document part), encoded by one hidden
layer, and weighed by gated attention, ``softmax(w . (tanh(V h) * sigmoid(U h)))``. The weighted sum of the encodings
gives the score. Labels exist for documents only; attention learns which passages decide.

The model is fitted in numpy on ``max_labelled`` labelled rows at most, those with the least hash of their id (a bound
for fitting alone), and on all passages of each: the driver keeps them in a file and reads some documents at a time.
Scoring reads each text once, in parts of ``PART`` bytes (attention sums are kept, so a text may be of any length), and
moves nothing.

Null and empty texts are one passage without words and get the score that the model gives it; several labels of one
document count by their mean; null labels are left out; without labels every score is 0.5; rows repeat freely; extra
columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm.common import release, stash, text_or_empty

PASSAGE, PART = 64, 1 << 19
#: Passages whose gradients are taken at once, and bytes of passages that the driver fetches at once.
STEP, FETCH = 1 << 14, 1 << 25


def _kinds() -> tuple[np.ndarray, int]:
    """A number for each byte: white space, line ends, letters by case, digits, each sign, bytes of other characters."""
    kind = np.zeros(256, np.int64)
    kind[list(b"\n\r")] = 1
    kind[list(range(97, 123))], kind[list(range(65, 91))], kind[list(range(48, 58))] = 2, 3, 4
    kind[128:192], kind[192:] = 5, 6
    signs = [b for b in range(33, 127) if not chr(b).isalnum()]
    kind[signs] = np.arange(7, 7 + len(signs))
    return kind, 7 + len(signs)


KIND, KINDS = _kinds()
SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
FEATURES = KINDS + 64 + 6


def describe(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Passages of the parts of text between ``bounds``: their features, and the part of each."""
    parts, n = len(bounds) - 1, len(data)
    size = np.diff(bounds)
    part = np.repeat(np.arange(parts), size)
    space = SPACE[data]
    start = ~space
    start[1:] &= space[:-1]
    first_bytes = bounds[:-1][size > 0]
    start[first_bytes] = ~space[first_bytes]
    word_at = np.flatnonzero(start)
    words = len(word_at)
    word_part = part[word_at]
    per_part = np.bincount(word_part, minlength=parts)
    first_word = np.concatenate([[0], np.cumsum(per_part)])
    passages = np.maximum(1, -(-per_part // PASSAGE))
    first_passage = np.concatenate([[0], np.cumsum(passages)])
    total = int(first_passage[-1])
    owner = np.repeat(np.arange(parts), passages)

    number = np.cumsum(start) - 1
    passage = first_passage[part] + np.maximum(number - first_word[part], 0) // PASSAGE
    kind = KIND[data]
    counts = np.bincount(passage * KINDS + kind, minlength=total * KINDS).reshape(total, KINDS).astype(np.float32)
    length = counts.sum(1, keepdims=True)
    coarse = np.minimum(kind, 7)
    inside = np.ones(max(0, n - 1), bool)
    inside &= passage[1:] == passage[:-1] if n else inside
    follow = np.bincount((passage[:-1] * 64 + coarse[:-1] * 8 + coarse[1:])[inside], minlength=total * 64).reshape(total, 64).astype(np.float32)

    more = np.zeros((total, 6), np.float32)
    if words:
        own = np.maximum(number, 0)
        place = (np.arange(n) - word_at[own]).astype(np.uint64)
        mixed = (data.astype(np.uint64) + np.uint64(1) + place * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed[space] = 0
        name = np.add.reduceat(mixed, word_at)
        of = first_passage[word_part] + (np.arange(words) - first_word[word_part]) // PASSAGE
        held = np.maximum(1, np.bincount(of, minlength=total)).astype(np.float32)

        def share(hit: np.ndarray) -> np.ndarray:
            return np.bincount(of, weights=hit, minlength=total).astype(np.float32) / held

        again = np.zeros(words, bool)
        again[1:] = (name[1:] == name[:-1]) & (word_part[1:] == word_part[:-1])
        more[:, 0] = share(again)
        more[:, 1] = share(_seen(name + of.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)))
        run = name.copy()
        for k in range(1, min(4, words)):
            run[: words - k] = run[: words - k] * np.uint64(0xD6E8FEB86659FD93) + name[k:]
        run = (run ^ (run >> np.uint64(31))) + word_part.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)
        whole = (np.arange(words) + 3 < first_word[word_part + 1]).astype(np.float32)
        more[:, 2] = share(_seen(run) * whole)
        letters = np.add.reduceat((~space).astype(np.int64), word_at)
        more[:, 3] = share(letters) / 10
        more[:, 4] = share(letters == 1)
        more[:, 5] = held / PASSAGE
    x = np.concatenate([np.sqrt(counts / np.maximum(length, 1)), np.sqrt(follow / np.maximum(length, 1)), more], axis=1)
    return x, owner


def _seen(keys: np.ndarray) -> np.ndarray:
    """1.0 where a key occurs more than once."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    hit = np.zeros(len(keys), np.float32)
    hit[order[1:][same]] = hit[order[:-1][same]] = 1
    return hit


def _parts(text: bytes) -> Iterator[bytes]:
    at = 0
    while len(text) - at > PART:
        cut = text.find(b" ", at + PART)
        cut = cut if 0 <= cut < at + 2 * PART else at + PART
        yield text[at:cut]
        at = cut
    yield text[at:]


def bags(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features of all passages of all texts, some parts at a time, and the number of the text of each passage."""
    held, of, size = [], [], 0
    for i, text in enumerate(texts):
        for piece in _parts((text or "").encode()):
            held.append(piece)
            of.append(i)
            size += len(piece)
            if size > PART:
                yield _bag(held, of)
                held, of, size = [], [], 0
    if held:
        yield _bag(held, of)


def _bag(held: list[bytes], of: list[int]) -> tuple[np.ndarray, np.ndarray]:
    x, owner = describe(np.frombuffer(b"".join(held), np.uint8), np.concatenate([[0], np.cumsum([len(h) for h in held])]).astype(np.int64))
    return x, np.array(of)[owner]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class AttentionModel:
    """Hidden layer, gated attention and output of a bag of passages."""

    def __init__(self, hidden: int = 32, gate: int = 16, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.p = {
            "E": rng.normal(0, FEATURES**-0.5, (FEATURES, hidden)), "e": np.zeros(hidden), "V": rng.normal(0, hidden**-0.5, (hidden, gate)),
            "U": rng.normal(0, hidden**-0.5, (hidden, gate)), "w": rng.normal(0, gate**-0.5, gate), "c": rng.normal(0, hidden**-0.5, hidden), "b": np.zeros(1),
        }
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        p = self.p
        h = np.tanh(((x - self.mean) / self.scale).clip(-8, 8) @ p["E"] + p["e"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        return h, t, s, np.exp((t * s) @ p["w"])

    def fit(self, x: np.ndarray, owner: np.ndarray, y: np.ndarray, epochs: int = 25, rate: float = 0.01, decay: float = 1e-4, size: int = 256, seed: int = 5) -> AttentionModel:
        """``owner`` ascending. Adam on the cross entropy, classes in balance."""
        rng, docs = np.random.default_rng(seed), len(y)
        blocks = range(0, len(x), STEP)
        self.mean = sum(x[at : at + STEP].sum(0, dtype=np.float64) for at in blocks) / len(x)
        self.scale = np.sqrt(sum(np.square(x[at : at + STEP] - self.mean).sum(0) for at in blocks) / len(x)) + 0.02
        starts = np.searchsorted(owner, np.arange(docs + 1))
        weight = np.where(y > 0.5, 0.5 / max(y.mean(), 0.05), 0.5 / max(1 - y.mean(), 0.05))
        m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(docs)
            for at in range(0, docs, size):
                pick = order[at : at + size]
                held = starts[pick + 1] - starts[pick]
                cuts = np.flatnonzero(np.diff((np.cumsum(held) - 1) // STEP)) + 1
                grads = {k: decay * v for k, v in self.p.items()}
                for some, lengths in zip(np.split(pick, cuts), np.split(held, cuts)):
                    rows = np.concatenate([np.arange(starts[d], starts[d + 1]) for d in some])
                    of = np.repeat(np.arange(len(some)), lengths)
                    for k, g in self._gradients(x[rows], of, y[some], weight[some]).items():
                        grads[k] = grads[k] + g * (len(some) / len(pick))
                step += 1
                for k, g in grads.items():
                    a, b = m[k]
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    self.p[k] = self.p[k] - rate * (1 - epoch / epochs) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradients(self, x: np.ndarray, of: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(y)
        v = ((x - self.mean) / self.scale).clip(-8, 8)
        h, t, s, e = self._forward(x)
        starts = np.searchsorted(of, np.arange(n))
        den = np.add.reduceat(e, starts)
        a = e / den[of]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        d = weight * (_sigmoid(z @ p["c"] + p["b"]) - y) / n
        dz = d[:, None] * p["c"]
        da = (dz[of] * h).sum(1)
        dh = a[:, None] * dz[of]
        ds = a * (da - np.add.reduceat(a * da, starts)[of])
        dt, dg = ds[:, None] * p["w"] * s * (1 - t * t), ds[:, None] * p["w"] * t * s * (1 - s)
        dh = (dh + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        return {"E": v.T @ dh, "e": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * s).T @ ds, "c": z.T @ d, "b": d.sum(keepdims=True)}

    def score(self, texts: list[str]) -> np.ndarray:
        top, den = np.zeros((len(texts), len(self.p["c"]))), np.zeros(len(texts))
        for x, of in bags(texts):
            h, _, _, e = self._forward(x)
            np.add.at(den, of, e)
            np.add.at(top, of, e[:, None] * h)
        return _sigmoid(top / den[:, None] @ self.p["c"] + self.p["b"])


def fit_model(docs: DataFrame, labels: DataFrame, max_labelled: int = 8_000) -> AttentionModel | None:
    """``labels``: ``doc_id, quality``. At most ``max_labelled`` of them are used, those of least hash."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(known), "doc_id")  # max_labelled rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, held, size = 0, [[]], 0  # the passages of row ``at`` and those after it
            for x, of in bags(batch.column("text").to_pylist()):
                if size > FETCH and len(held) > 1:  # all rows but the last are whole
                    yield _bagged(batch.slice(at, len(held) - 1), held[:-1])
                    at, held, size = at + len(held) - 1, held[-1:], sum(map(len, held[-1]))
                for i in np.unique(of):
                    held += [[] for _ in range(i - at - len(held) + 1)]
                    held[i - at].append(x[of == i].astype(np.float32).tobytes())
                    size += len(held[i - at][-1])
            if batch.num_rows:
                yield _bagged(batch.slice(at), held)
            release()

    kind = rows.schema["doc_id"].dataType.simpleString()
    found = stash(rows.mapInArrow(run, f"doc_id {kind}, y double, bag binary").dropDuplicates(["doc_id"]), "quality-bags")
    size = found.agg(F.sum(F.octet_length("bag"))).first()[0]
    if not size:
        return None
    with tempfile.TemporaryFile() as file:
        y, n = [], []
        for row in found.repartition(1 + size // FETCH, "doc_id").sortWithinPartitions("doc_id").toLocalIterator():
            file.write(row.bag)
            y.append(row.y)
            n.append(len(row.bag) // (4 * FEATURES))
        file.flush()
        x = np.memmap(file, np.float32, "r", shape=(sum(n), FEATURES))
        return AttentionModel().fit(x, np.repeat(np.arange(len(n)), n), np.array(y))


def _bagged(rows: pa.RecordBatch, bag: list[list[bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("y"), pa.array([b"".join(b) for b in bag], pa.binary())], names=["doc_id", "y", "bag"])


def score(text: Column, model: AttentionModel | None) -> Column:
    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        out = pd.Series(model.score(texts.tolist()) if model is not None else np.full(len(texts), 0.5))
        release()
        return out

    return run(text)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, max_labelled: int = 8_000) -> DataFrame:
    """``docs`` with ``held_out, score, predicted`` (reserved names); held-out ids never teach."""
    model = fit_model(docs, labels.where(~held_out(F.col("doc_id"))), max_labelled)
    rows = docs.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("score", score(F.col("text"), model))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return classify(docs, labels).select("doc_id", "held_out", "score", "predicted")
