"""Near-duplicates by SimHash, found with covering locality-sensitive hashing.

A text's fingerprint has a bit set where more than half of its shingles' hashes have it. Fingerprints link at RADIUS or fewer
differing bits. Every bit position is given a non-zero vector of RADIUS + 1 bits; each of the 2^(RADIUS + 1) - 1 non-zero vectors v
names a table, keyed by the fingerprint's bits whose vector has an odd product with v. The vectors of up to RADIUS differing bits
never span the whole space, so some v has an even product with all of them, and in its table the pair has equal keys: no pair
within the radius is missed, whatever the data are.

Only distinct fingerprints enter the tables, so copies cost nothing. A bucket with more than PAIRWISE fingerprints is cut into finer
ones by a second, independent family of masks: a pair within the radius agrees in some table of that family as well. What is still
large then differs in the few bits that both masks leave free, so it holds at most 2^free fingerprints, and is linked by flipping up
to RADIUS of these bits instead of comparing pairs. Each bucket sends on a spanning forest of its links, no pairs.

Defined cases: a null text or one without words has fingerprint 0, linked like any other; a text with fewer words than a shingle is
one shingle; repeated rows share fingerprint and component; null identifiers never name a component unless it has no other; an
empty table gives an empty table; extra columns are carried along by `deduplicate`.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.common import by_arrow, documents, only_rows, stored, text_digest
from tallywright.llm.components import components

RADIUS = 3
WORDS = 3
HASH_SEED = 42
PAIRWISE = 256
CHUNK = 1 << 15


# ---- fingerprints

def fingerprint(text: bytes | None, words: int = WORDS, seed: int = HASH_SEED) -> int:
    """Unsigned 64-bit fingerprint of a UTF-8 text; `bytes.lower` touches A-Z only and `bytes.split` the six ASCII spaces only."""
    if not text:
        return 0
    w = text.lower().split()
    if not w:
        return 0
    shingles = zip(*(w[i:] for i in range(words))) if len(w) >= words else [w]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, shingles), repeat(seed)), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at:at + CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, digest of the text, fp): the fingerprint as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), words) for t in b.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp, pa.int64())], ["doc_id", "digest", "fp"])

    narrow = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_digest(F.col(f"`{text}`")).alias("digest"), F.col(f"`{text}`").cast("binary").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return by_arrow(narrow, run, f"doc_id {kind}, digest long, fp long")


# ---- covering masks

def covering_masks(radius: int, seed: int) -> list[int]:
    """Masks of 64 bits such that any `radius` positions are left out by at least one of them."""
    vectors = [1 + i % ((1 << (radius + 1)) - 1) for i in range(64)]  # every non-zero vector about equally often
    random.Random(seed).shuffle(vectors)
    return [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2) for v in range(1, 1 << (radius + 1))]


def families(radius: int) -> tuple[list[int], list[int]]:
    """Two families of covering masks; for radius 3, two masks leave at most 18 bits free."""
    return covering_masks(radius, 1), covering_masks(radius, 150)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


# ---- links inside a bucket

def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes reaches over the links a - b."""
    low = np.arange(n)
    while len(a):
        new = low.copy()
        x, y = low[a], low[b]
        m = np.minimum(x, y)
        np.minimum.at(new, x, m)
        np.minimum.at(new, y, m)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, low):
            return low
        low = new
        live = low[a] != low[b]
        a, b = a[live], b[live]
    return low


def bucket_links(bucket: np.ndarray, fp: np.ndarray, free: np.ndarray, radius: int = RADIUS, pairwise: int = PAIRWISE) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by bucket -> positions (node, root) of a spanning forest of the links inside each bucket.

    bucket: number of each row's bucket; free: the bits in which the rows of its bucket may differ. A bucket of up to `pairwise`
    rows is compared in full; a larger one is searched by flipping up to `radius` of its free bits.
    """
    n, a, b = len(fp), [], []
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if n else np.zeros(0, int)
    sizes = np.diff(np.r_[starts, n])
    end = np.repeat(starts + sizes, sizes)
    at = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= pairwise), sizes))
    step = 1
    while len(at := at[at + step < end[at]]):
        near = np.bitwise_count(fp[at] ^ fp[at + step]) <= radius
        a.append(at[near])
        b.append(at[near] + step)
        step += 1
    for k in np.flatnonzero(sizes > pairwise):
        rows = np.arange(starts[k], starts[k] + sizes[k])
        order = np.argsort(fp[rows], kind="stable")
        rows = rows[order]
        sorted_fp = fp[rows]
        bits = [1 << i for i in range(64) if int(free[rows[0]]) >> i & 1]
        for m in range(1, radius + 1):
            for flips in combinations(bits, m):
                other = sorted_fp ^ np.uint64(sum(flips))
                found = np.minimum(np.searchsorted(sorted_fp, other), len(rows) - 1)
                hit = (sorted_fp[found] == other) & (sorted_fp < other)
                a.append(rows[hit])
                b.append(rows[found[hit]])
    if not a:
        return np.zeros(0, int), np.zeros(0, int)
    root = forest(n, np.concatenate(a), np.concatenate(b))
    node = np.flatnonzero(root != np.arange(n))
    return node, root[node]


def link_sorted(radius: int, pairwise: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows (t1, t2, key, fp) sorted by bucket. A bucket cut by the end of a batch is held back until it is whole."""
    masks, finer = families(radius)

    def free(t1: int, t2: int) -> int:
        return ((1 << 64) - 1) & ~(masks[t1] | (finer[t2] if t2 >= 0 else 0))

    def links(rows: list[np.ndarray]) -> pa.RecordBatch:
        t1, t2, key, fp = rows
        new = np.r_[True, (t1[1:] != t1[:-1]) | (t2[1:] != t2[:-1]) | (key[1:] != key[:-1])]
        bucket, first = np.cumsum(new), np.flatnonzero(new)
        pairs = (t1[first] << 16) | (t2[first] + 1)
        kinds, which = np.unique(pairs, return_inverse=True)
        bits = np.array([free(int(k) >> 16, (int(k) & 0xFFFF) - 1) for k in kinds], np.uint64)
        node, root = bucket_links(bucket, fp.view(np.uint64), np.repeat(bits[which], np.diff(np.r_[first, len(fp)])), radius, pairwise)
        return pa.RecordBatch.from_arrays([pa.array(fp[node]), pa.array(fp[root])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in batches:
            if not b.num_rows:
                continue
            rows = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if held:
                rows = [np.concatenate(p) for p in zip(held, rows, strict=True)]
            same = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1]) & (rows[2] == rows[2][-1])
            cut = len(same) - int(same.sum())
            held = [c[cut:] for c in rows]
            if cut:
                yield links([c[:cut] for c in rows])
        if held:
            yield links(held)

    return run


def fingerprint_links(classes: DataFrame, radius: int = RADIUS, pairwise: int = PAIRWISE) -> DataFrame:
    """(a, b): links that connect every two of the distinct fingerprints `fp` that are within the radius, directly or over others."""
    masks, finer_masks = families(radius)
    keys = classes.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("t1"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(masks)])).alias("k")).select("k.t1", "k.key", "fp")
    counts = keys.groupBy("t1", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # by size the planner counts `keys` as one row a fingerprint, so it would broadcast what has a row for each mask
    rows = keys.hint("merge").join(counts, ["t1", "key"])
    plain = rows.where(F.col("n") <= pairwise).select("t1", F.lit(-1).alias("t2"), "key", "fp")
    wide = F.element_at(F.array(*[F.lit(signed(m)) for m in masks]), F.col("t1") + 1)
    finer = rows.where(F.col("n") > pairwise).select("t1", "fp", wide.alias("wide"), F.explode(F.array(*[
        F.struct(F.lit(j).alias("t2"), F.lit(signed(m)).alias("fine")) for j, m in enumerate(finer_masks)])).alias("k")).select(
        "t1", "k.t2", F.col("fp").bitwiseAND(F.col("wide").bitwiseOR(F.col("k.fine"))).alias("key"), "fp")
    bucketed = plain.unionByName(finer).select(F.col("t1").cast("int"), F.col("t2").cast("int"), "key", "fp")
    together = bucketed.repartition("t1", "t2", "key").sortWithinPartitions("t1", "t2", "key", "fp")
    return by_arrow(together, link_sorted(radius, pairwise), "a long, b long").distinct()


# ---- the operator

def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, digest of the text, fp, root, component_id), one row a row of `docs`.

    component_id is the smallest doc_id reachable over links, root the component's fingerprint.
    """
    marked = stored(fingerprints(docs, doc_id, text, words), "fingerprints")
    classes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-classes")
    roots = components(fingerprint_links(classes, radius), "fingerprint-links")
    members = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = members.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(members.join(least, "root").select("fp", "root", "component_id"), "fp").select("doc_id", "digest", "fp", "root", "component_id")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """One row of each component, that of the smallest doc_id (then of the least digest), with the columns of `docs`."""
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "digest")
    first = near_duplicates(docs, doc_id, text, words).groupBy("root").agg(F.min(order).alias("first")).select("first.doc_id", "first.digest")
    return only_rows(docs, first, doc_id, text)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
