"""SimHash near-duplicates: a segment-popcount embedding with a grid range join.

A 64-bit fingerprint is embedded as the bit counts of its 16 four-bit segments. Manhattan distance between embeddings
is never above Hamming distance, so fingerprints within distance 2 have embeddings within 2; then some grid point lies
within 1 of both. Each distinct fingerprint goes to the (up to 33) grid points within 1 of its embedding, and equal
points meet in an equi-join: no candidate is lost, and chance meetings are rare (5e-7 of all pairs). Pairs in a cell of
up to ``DENSE`` fingerprints are verified bit by bit. Larger cells (families of near copies) never list their pairs:
their fingerprints meet at the 65 bit strings within one flip of each, which holds exactly for those within distance 2,
and each meeting point links its members to its smallest one. Work and rows are linear in the distinct fingerprints.

Null texts count as empty; texts without words get fingerprint zero, linked like any other; copies share a fingerprint
and are one node; null ids never name a component unless all its ids are null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from keystrata.llm.common import fresh, release, stash, text_or_empty
from keystrata.llm.components import components

#: Cells up to this size list their pairs; larger ones meet at shared bit strings.
DENSE = 16
#: Shingles of a block of a large cell's texts; blocks are searched two at a time.
BLOCK = 1 << 20
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def _spans(words: list[bytes], width: int) -> tuple[bytes, Iterable[tuple[int, int]]]:
    """Words joined by spaces, and the bounds of each shingle in it (of all words if there are fewer)."""
    joined = b" ".join(words)
    if len(words) <= width:
        return joined, [(0, len(joined) + 1)]
    ends = list(accumulate(map((1).__add__, map(len, words))))
    return joined, zip([0, *ends], ends[width - 1 :])


def _simhash(words: list[bytes], width: int = 3, seed: int = 42) -> int:
    import xxhash

    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    joined, spans = _spans(words, width)
    hashes = np.fromiter((digest(joined[s : e - 1], seed) for s, e in spans), np.uint64, max(1, len(words) - width + 1))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def simhash(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Signed 64-bit fingerprint of a text's word shingles, repeats included."""
    return _simhash(_words(text), width, seed)


def fingerprint(text: Column, width: int = 3) -> Column:
    @F.pandas_udf(LongType())
    def run(texts: pd.Series) -> pd.Series:
        out = pd.Series([simhash(t, width) for t in texts], dtype="int64")
        release()
        return out

    return run(text)


def _embedding(fp: Column) -> Column:
    """16 nibbles, each the bit count (0 to 4) of the fingerprint's nibble."""
    ones = F.lit(0x1111111111111111)
    return fp.bitwiseAND(ones) + sum((F.shiftrightunsigned(fp, k).bitwiseAND(ones) for k in (1, 2, 3)), F.lit(0).cast("long"))


def _ball(at: str) -> Column:
    """The grid points within 1 of an embedding; counts stay within 0 and 4. Bit operations only, so nothing overflows."""
    near = [F.col(at)]
    for k in range(16):
        count = F.shiftrightunsigned(F.col(at), 4 * k).bitwiseAND(F.lit(15))
        clear = F.col(at).bitwiseAND(F.lit(~(15 << (4 * k)) if k < 15 else (1 << 60) - 1))
        near += [F.when(count < 4, clear.bitwiseOR(F.shiftleft(count + 1, 4 * k))), F.when(count > 0, clear.bitwiseOR(F.shiftleft(count - 1, 4 * k)))]
    return F.array_compact(F.array(*near))


def near_links(prints: DataFrame, distance: int = 2) -> DataFrame:
    """Distinct longs ``fp`` -> edges ``a, b`` that connect exactly those reachable by steps of up to 2 bits."""
    if distance != 2:
        raise ValueError("the grid and the meeting points are laid out for distance 2")
    cells = prints.withColumn("at", _embedding(F.col("fp"))).select("fp", F.explode(_ball("at")).alias("cell"))
    met = cells.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("cell"))).where("n > 1")
    met = stash(met, "simhash-cells")
    sparse = met.where(F.col("n") <= DENSE)
    pairs = sparse.select("cell", F.col("fp").alias("a")).join(sparse.select("cell", F.col("fp").alias("b")), "cell")
    pairs = pairs.where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)).select("a", "b").distinct()
    dense = met.where(F.col("n") > DENSE).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << k) if k < 63 else -(1 << 63)).cast("long") for k in range(64)])
    points = dense.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    stars = points.select(F.col("fp").alias("a"), F.min("fp").over(Window.partitionBy("point")).alias("b")).where("a <> b").distinct()
    return pairs.union(stars)


def near_duplicates(docs: DataFrame, *, width: int = 3, distance: int = 2) -> DataFrame:
    """``docs`` less ``text``, with ``fp`` (long), ``component_fp`` (its component's least ``fp``) and ``component_id``, reserved names."""
    (s_id,) = fresh(docs, "least")
    marked = docs.withColumn("fp", fingerprint(F.col("text"), width)).drop("text")
    marked = stash(marked, "simhash-prints")
    prints = stash(marked.groupBy("fp").agg(F.min("doc_id").alias(s_id)), "simhash-nodes")
    roots = components(near_links(prints.select("fp"), distance))
    named = prints.join(roots, F.col("fp") == F.col("node"), "left").select("fp", s_id, F.coalesce("root", "fp").alias("root"))
    named = stash(named, "simhash-roots")
    ids = named.groupBy("root").agg(F.min(s_id).alias("component_id"))
    ids = named.join(ids, "root").select("fp", F.col("root").alias("component_fp"), "component_id")
    return marked.join(stash(ids, "simhash-components"), "fp")


def _shingles(words: list[bytes], width: int, seed: int = 42) -> np.ndarray:
    """Distinct hashes of the word shingles (of all words if there are fewer)."""
    import xxhash

    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    joined, spans = _spans(words, width)
    return np.array(list({digest(joined[s : e - 1], seed) for s, e in spans}), np.uint64)


def sampled_prints(text: Column, width: int, tables: int, sample: int) -> Column:
    """Struct of the SimHash of three-word shingles, the number of distinct shingles of ``width`` words, and, for each
    table, the SimHash of ``sample`` of them, drawn min-wise.

    Two texts draw the same shingle with a probability equal to their Jaccard similarity, and equal draws make equal
    fingerprints: where SimHash over all shingles spreads similar texts over many bits, these meet exactly.
    """
    rng = np.random.default_rng(11)
    masks = rng.integers(0, 1 << 63, tables * sample, dtype=np.uint64)
    factors = rng.integers(0, 1 << 63, tables * sample, dtype=np.uint64) | np.uint64(1)

    @F.pandas_udf("fp long, n long, prints array<long>")
    def run(texts: pd.Series) -> pd.DataFrame:
        prints, counts, out = [], [], []
        for t in texts:
            words = _words(t)
            prints.append(_simhash(words))
            h = _shingles(words, width)
            counts.append(len(h))
            if not len(h):
                out.append([])
                continue
            drawn = np.array([((h ^ m) * f).min() for m, f in zip(masks, factors)], np.uint64).reshape(tables, sample)
            drawn = drawn ^ (drawn >> np.uint64(29))
            joint = np.zeros(tables, np.uint64)
            for k in range(sample):
                joint = (joint ^ drawn[:, k]) * np.uint64(0x9E3779B97F4A7C15)
                joint ^= joint >> np.uint64(32)
            out.append(joint.view(np.int64))
        release()
        return pd.DataFrame({"fp": np.array(prints, np.int64), "n": np.array(counts, np.int64), "prints": out})

    return run(text)


def _connect(nodes: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs of ``similarity`` or more that connect exactly what all such pairs and equal ``roots`` connect.

    A breadth-first search over texts not reached yet. Of each text only the rarest shingles are indexed, as many as one
    of them must be shared at ``similarity`` (a prefix filter), and the texts met there are compared in full.
    """
    n = np.array([len(s) for s in sets], np.int64)
    ends = np.concatenate([[0], np.cumsum(n)])
    _, flat, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    owner = np.repeat(np.arange(len(n)), n)
    flat = rank[flat.reshape(-1)]
    flat = flat[np.lexsort((flat, owner))]
    prefix = n - np.ceil(similarity * n - 1e-6).astype(np.int64) + 1
    first = np.arange(len(flat)) - ends[owner] < prefix[owner]
    token, holder = flat[first], owner[first]
    by_token = np.argsort(token, kind="stable")
    holder = holder[by_token]
    posted = np.concatenate([[0], np.cumsum(np.bincount(token, minlength=len(counts)))])
    _, root = np.unique(roots, return_inverse=True)
    by_root = np.argsort(root, kind="stable")
    members = np.concatenate([[0], np.cumsum(np.bincount(root))])
    reached, mark, links = np.zeros(len(n), bool), np.zeros(len(counts), bool), []
    for start in range(len(n)):
        queue = [] if reached[start] else by_root[members[root[start]] : members[root[start] + 1]].tolist()
        reached[queue] = True
        while queue:
            u = queue.pop()
            own = flat[ends[u] : ends[u + 1]]
            met = np.concatenate([holder[posted[t] : posted[t + 1]] for t in own[: prefix[u]]])
            met = np.unique(met[~reached[met]])
            met = met[np.minimum(n[met], n[u]) >= similarity * np.maximum(n[met], n[u])]
            if not len(met):
                continue
            mark[own] = True
            shared = np.array([np.count_nonzero(mark[flat[ends[v] : ends[v + 1]]]) for v in met])
            mark[own] = False
            for v in met[shared >= similarity * (n[met] + n[u] - shared)].tolist():
                links.append((int(nodes[u]), int(nodes[v])))
                if not reached[v]:
                    more = by_root[members[root[v]] : members[root[v] + 1]].tolist()
                    reached[more] = True
                    queue += more
    return links


def links_of_large_cells(large: DataFrame, known: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Edges that, with groups ``known`` (``node, root``), connect what all similar pairs in cells ``table, print, node, n`` do.

    Cells of one group need no more. The others are cut into blocks of ``BLOCK`` shingles, groups side by side, and each
    two blocks of a cell are searched together unless they are one group.
    """
    cell = ["table", "print"]
    rows = large.select(*cell, "n", F.col("node").alias("of")).join(known, F.col("of") == F.col("node"), "left").select(*cell, "of", "n", F.coalesce("root", "of").alias("root"))
    whole = Window.partitionBy(*cell)
    rows = rows.withColumn("lo", F.min("root").over(whole)).withColumn("hi", F.max("root").over(whole)).where("lo <> hi").drop("lo", "hi")
    through = whole.orderBy("root", "of").rowsBetween(Window.unboundedPreceding, 0)
    rows = stash(rows.withColumn("block", F.floor((F.sum("n").over(through) - F.col("n")) / BLOCK)), "similar-rest")
    blocks = rows.groupBy(*cell, "block").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    left = blocks.select(*cell, F.col("block").alias("i"), F.col("lo").alias("i_lo"), F.col("hi").alias("i_hi"))
    two = left.join(blocks.withColumnRenamed("block", "j"), cell).where("i <= j and not (i_lo = hi and lo = i_hi)")
    two = two.select(*cell, "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    unit = [*cell, "i", "j"]
    units = rows.join(two, [*cell, "block"]).select(*unit, "of", "root").join(sets, F.col("of") == F.col("node")).select(*unit, "of", "root", "s")

    def run(table: pa.Table) -> pa.Table:
        lists = table.column("s").combine_chunks()
        values, ends = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
        found = _connect(table.column("of").to_numpy(), table.column("root").to_numpy(), [values[a:b] for a, b in zip(ends, ends[1:])], similarity)
        release()
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return stash(units.groupBy(*unit).applyInArrow(run, "a long, b long").distinct(), "similar-rest-links")


def similar_links(prints: DataFrame, texts: DataFrame, *, width: int = 5, similarity: float = 0.8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``node, n, prints`` of different texts, and ``node, text`` -> verified edges ``a, b`` of Jaccard similarity
    ``similarity`` or more, the cells whose pairs they may leave out, and the shingles of texts.

    Cells of up to ``DENSE`` texts pair all of their members. In larger ones each is paired with the most typical one
    (that with the most company in its large cells) and with the one before it in that order, which connects most
    families of copies in linear rows; ``links_of_large_cells`` finds what these pairs leave apart. A pair of similarity
    0.8 shares no cell with a probability below 0.001.
    """
    cell = ["table", "print"]
    cells = prints.select("node", "n", F.posexplode("prints").alias(*cell))
    cells = stash(cells.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy(*cell))).where("size > 1"), "similar-cells")
    small, large = cells.where(F.col("size") <= DENSE), stash(cells.where(F.col("size") > DENSE), "similar-large")
    left = small.select(*cell, F.col("node").alias("a"), F.col("n").alias("a_n"))
    pairs = left.join(small.select(*cell, F.col("node").alias("b"), F.col("n").alias("b_n")), cell).where("a < b").select("a", "a_n", "b", "b_n")
    if not large.isEmpty():
        company = large.groupBy(F.col("node").alias("of")).agg(F.sum("size").alias("company"))
        ranked = large.join(company, F.col("node") == F.col("of")).withColumn("me", F.struct("company", "node", "n"))
        at = Window.partitionBy(*cell)
        ranked = ranked.select("node", "n", F.max("me").over(at).alias("one"), F.lag("me").over(at.orderBy("me")).alias("two"))
        for other in ("one", "two"):
            star = ranked.where(F.col(f"{other}.node") != F.col("node"))
            ends = F.struct("node", "n"), F.struct(f"{other}.node", f"{other}.n")
            star = star.select(F.least(*ends).alias("x"), F.greatest(*ends).alias("y"))
            pairs = pairs.unionByName(star.select(F.col("x.node").alias("a"), F.col("x.n").alias("a_n"), F.col("y.node").alias("b"), F.col("y.n").alias("b_n")))
    # Sizes alone rule out most chance meetings.
    pairs = stash(pairs.where(F.least("a_n", "b_n") >= similarity * F.greatest("a_n", "b_n")).select("a", "b").distinct(), "similar-pairs")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(large.select("node")).distinct()

    @F.pandas_udf("array<long>")
    def shingled(texts: pd.Series) -> pd.Series:
        release()
        return pd.Series([_shingles(_words(t), width).view(np.int64) for t in texts], dtype="object")

    sets = stash(texts(nodes).select("node", shingled("text").alias("s")), "similar-sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("a_s")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("b_s")), "b")
    shared = F.size(F.array_intersect("a_s", "b_s"))
    links = stash(both.where(shared >= similarity * (F.size("a_s") + F.size("b_s") - shared)).select("a", "b"), "similar-links")
    return links, large, sets


def keep_one(docs: DataFrame, *, width: int = 5, similarity: float = 0.8, tables: int = 14, sample: int = 4) -> DataFrame:
    """The rows of ``docs`` less near-duplicates: of each group the row of least id, then least text hash.

    A group is connected by fingerprints within 2 bits (three-word shingles) or by Jaccard similarity of five-word
    shingles, verified exactly. Rows without an id come after those with one. Each text is cut into words once, and
    again if it has a candidate; equal texts (128 bits of hashes) are one node from the first exchange on.
    """
    s_a, s_b = fresh(docs, "a", "b")
    text = text_or_empty()
    row = F.xxhash64("doc_id", text), F.xxhash64(text, "doc_id", F.lit(1))
    marked = docs.select("doc_id", row[0].alias("a"), row[1].alias("b"), F.xxhash64(text).alias("x"), F.xxhash64(text, F.lit(2)).alias("y"), sampled_prints(F.col("text"), width, tables, sample).alias("p"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "a", "b"))
    nodes = marked.groupBy("x", "y").agg(F.first("p").alias("p"), least.alias("r"))
    nodes = stash(nodes.select(F.monotonically_increasing_id().alias("node"), "p.*", "r"), "near-nodes")  # numbered once: the table is written

    def texts(some: DataFrame) -> DataFrame:
        """Texts of nodes, from the row that stands for each (and those that equal it in id and text)."""
        wanted = some.join(nodes.select("node", F.col("r.a").alias("a"), F.col("r.b").alias("b")), "node")
        rows = docs.select(row[0].alias("a"), row[1].alias("b"), text.alias("text")).join(wanted.hint("shuffle_hash"), ["a", "b"])
        return rows.groupBy("a", "b", "node").agg(F.first("text").alias("text")).select("node", "text")

    links, large, sets = similar_links(nodes.select("node", "n", "prints"), texts, width=width, similarity=similarity)
    prints = stash(nodes.groupBy("fp").agg(F.min("node").alias("first")), "near-prints")
    equal = nodes.join(prints, "fp").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    bits = near_links(prints.select("fp"))
    of = lambda c: prints.select(F.col("fp").alias(f"{c}_fp"), F.col("first").alias(c))
    bits = bits.withColumnsRenamed({"a": "a_fp", "b": "b_fp"}).join(of("a"), "a_fp").join(of("b"), "b_fp").select("a", "b")
    groups = components(links.union(equal).union(bits))
    rest = links if large.isEmpty() else links_of_large_cells(large, groups, sets, similarity)
    if not large.isEmpty() and not rest.isEmpty():
        root = lambda c: groups.select(F.col("node").alias(f"{c}_of"), F.col("root").alias(f"{c}_root"))
        joined = rest.join(root("a"), F.col("a") == F.col("a_of"), "left").join(root("b"), F.col("b") == F.col("b_of"), "left")
        more = components(joined.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))).select(F.col("node").alias("old"), F.col("root").alias("new"))
        every = nodes.select("node").join(groups, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        groups = stash(every.join(more, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root")), "near-groups")
    kept = nodes.select("node", "r").join(groups, "node", "left").groupBy(F.coalesce("root", "node").alias("group")).agg(F.min("r").alias("r"))
    kept = stash(kept.select(F.col("r.a").alias(s_a), F.col("r.b").alias(s_b)), "near-kept")
    marked = docs.withColumn(s_a, row[0]).withColumn(s_b, row[1])
    rows = marked.join(kept.hint("shuffle_hash"), [s_a, s_b])
    if marked.select(s_a, s_b).join(kept, [s_a, s_b], "left_semi").count() > kept.count():  # some kept row is there more than once
        rows = rows.dropDuplicates([s_a, s_b])
    return rows.select(*docs.columns)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = near_duplicates(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
