"""Near copies by word shingles: pairs of texts whose sets of shingles have a Jaccard similarity of SIMILARITY or more.

A text's sketch holds the least of its shingles' hashes under BANDS * ROWS hash functions. Two texts of similarity s agree in a function
with probability s, so they share the ROWS minima of at least one band with 1 - (1 - s^ROWS)^BANDS: at s = 0.8 one pair in 40 000 is
missed, above it fewer. A text that shares no band has no near copy; the others go on, and two steps find the links among them without
ever pairing up a bucket.

First come SimHash fingerprints and the covering tables of `simhash`. A text has PARTS fingerprints, of its single words under a hash of
their own each: a changed word changes five shingles but one word, so texts of similarity 0.8 are mostly within the tables' three bits.
Texts of one fingerprint meet that fingerprint's least text, and linked fingerprints' least texts meet each other. Groups of copies with
edits of their own are often further apart than three bits, so every text of a bucket also meets the bucket's hub: of its texts the one
that shares most buckets with others. Either way a group is tied together by about as many pairs as it has texts.

Then, among texts that share a bucket with another component, the rest is found exactly, by rare shingles. In an order by number of texts,
then hash, two texts of sizes m and n that are similar must share at least c = s / (1 + s) * (m + n) shingles, so the first one they
share has c or more from it on in both. Only the rarest shingles of a text can be such a first one, and of the shorter text only
its very first ones; what edits have made unique comes before everything that copies have in common, so texts that are less than
similar hardly meet at all. Candidates of both steps are confirmed by their whole sets. (A candidate of the first step whose sketches
agree in fewer than AGREE places, 5.5 standard deviations below 0.8, is not looked up.)

Links are of texts, not of rows, so copies cost nothing; a text is known by a 128-bit digest.

Defined cases: a text without words (or null) has one empty shingle, so all of them are alike; a text with fewer words than a shingle
is one shingle; repeated rows give one row; null identifiers stay only where their component has no other; extra columns are kept.
"""

from __future__ import annotations

import functools
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import by_arrow, only_rows, stored, text_digest
from tallywright.llm.components import components
from tallywright.llm.simhash import HASH_SEED, fingerprint, fingerprint_links

WORDS = 5
SIMILARITY = 0.8
PARTS = 2
BANDS, ROWS = 20, 4
AGREE = 44
CHUNK = 1 << 11
CLOSE = 1e-9
_random = random.Random(5)
FACTOR, SHIFT, MIX = (np.array([_random.getrandbits(64) | 1 for _ in range(BANDS * ROWS)], np.uint64) for _ in range(3))


def identity(text: str) -> Column:
    """128 bits that tell texts apart; null is the empty text."""
    return F.unhex(F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")))


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of `words` words, in order."""
    w = (text or b"").lower().split()
    parts = zip(*(w[i:] for i in range(words))) if len(w) >= words else [w]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, parts)), np.uint64))


def sketch(hashes: np.ndarray) -> np.ndarray:
    low = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), CHUNK):
        np.minimum(low, (hashes[at:at + CHUNK, None] * FACTOR + SHIFT).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, BANDS * ROWS)


def band_keys(sketches: np.ndarray) -> np.ndarray:
    return (sketches * MIX).reshape(-1, BANDS, ROWS).sum(axis=2, dtype=np.uint64)


def sketches(docs: DataFrame, text: str = "text", words: int = WORDS) -> DataFrame:
    """(digest, sketch, fp0, fp1, ...) of each row's text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            fps = [pa.array(np.array([fingerprint(t, 1, HASH_SEED + i) for t in texts], np.uint64).view(np.int64), pa.int64()) for i in range(PARTS)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sketch(shingles(t, words)).tobytes() for t in texts], pa.binary()), *fps], ["digest", "sketch", *names])

    names = [f"fp{i}" for i in range(PARTS)]
    narrow = docs.select(identity(text).alias("digest"), F.col(f"`{text}`").cast("binary").alias("text"))
    return by_arrow(narrow, run, ", ".join(["digest binary, sketch binary", *(f"{n} long" for n in names)]))


def by_fingerprints(texts: DataFrame) -> DataFrame:
    """(a, b): texts with the least text of their fingerprint, and least texts of fingerprints that covering tables link, in any part."""
    met = []
    for i in range(PARTS):
        marked = texts.select(F.col(f"fp{i}").alias("fp"), "digest")
        classes = stored(marked.groupBy("fp").agg(F.min("digest").alias("least")), "fingerprint-classes")
        one, two = (classes.select(F.col("fp").alias(x), F.col("least").alias(f"least_{x}")) for x in "ab")
        met += [marked.join(classes, "fp").where("digest <> least").select("digest", "least"),
                fingerprint_links(classes).join(one, "a").join(two, "b").select("least_a", "least_b")]
    pairs = functools.reduce(DataFrame.union, met).toDF("a", "b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def bucketed(sketched: DataFrame) -> DataFrame:
    """(key, digest): one row a band; `sketched` has digest and sketch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = band_keys(matrix(b.column(1))).view(np.int64)
            take = pa.array(np.repeat(np.arange(b.num_rows), BANDS))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel(), pa.int64()), b.column(0).take(take)], ["key", "digest"])

    return by_arrow(sketched.select("digest", "sketch"), run, "key long, digest binary")


def to_hubs(shared: DataFrame) -> DataFrame:
    """(a, b): every text of a bucket with the bucket's hub, once. `shared` has key, digest and n, the size of the bucket."""
    weight = shared.groupBy("digest").agg(F.sum("n").alias("weight"))
    hub = shared.join(weight, "digest").groupBy("key").agg(F.max(F.struct("weight", "digest")).alias("hub")).select("key", F.col("hub.digest").alias("hub"))
    met = shared.join(hub, "key").where("digest <> hub")
    return met.select(F.least("digest", "hub").alias("a"), F.greatest("digest", "hub").alias("b")).distinct()


def agreeing(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose sketches agree in AGREE places or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = (matrix(b.column(2)) == matrix(b.column(3))).sum(axis=1) >= AGREE
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(near))

    one, two = (texts.select(F.col("digest").alias(x), F.col("sketch").alias(f"s{x}")) for x in "ab")
    return by_arrow(pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb"), run, "a binary, b binary")


def shingle_sets(docs: DataFrame, wanted: DataFrame, text: str = "text", words: int = WORDS) -> DataFrame:
    """(digest, set) of the texts in `wanted` (digest), stored. The join shuffles all texts where `wanted` is too large to be broadcast."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py(), words).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["digest", "set"])

    found = docs.select(identity(text).alias("digest"), F.col(f"`{text}`").cast("binary").alias("text")).join(wanted, "digest", "left_semi")
    return stored(by_arrow(found.dropDuplicates(["digest"]), run, "digest binary, set array<long>"), "shingle-sets")


def similar(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of texts whose sets have the similarity or more."""
    one, two = (sets.select(F.col("digest").alias(x), F.col("set").alias(f"s{x}")) for x in "ab")
    shared = pairs.join(one, "a").join(two, "b").select("a", "b", (F.size("sa") + F.size("sb")).alias("n"), F.size(F.array_intersect("sa", "sb")).alias("both"))
    return shared.where(F.col("both") >= similarity * (F.col("n") - F.col("both")) - CLOSE).select("a", "b")


def by_rare_shingles(sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): pairs of different roots that may be similar, and all of those that are. `sets` has digest, root and set."""
    every = sets.select("digest", F.explode("set").alias("shingle"))
    often = every.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # what no other text has comes first and meets nothing: only its number counts
    known = every.join(often, "shingle").groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("known"))
    size, place = F.col("size"), F.col("place")
    most = size - F.ceil(similarity * size - CLOSE) + 1
    rows = sets.select("digest", "root", F.size("set").alias("size")).join(known, "digest")
    rows = rows.select("digest", "root", "size", (size - F.size("known")).alias("alone"), F.posexplode(F.slice("known", F.lit(1), F.greatest(F.lit(0), most - (size - F.size("known"))).cast("int"))).alias("at", "k"))
    rows = rows.select("digest", "root", "size", (size - (F.col("alone") + F.col("at"))).alias("rest"), "k.shingle")
    part = similarity / (1 + similarity)
    short, long = (rows.select("shingle", *[F.col(c).alias(f"{c}_{x}") for c in ("digest", "root", "size", "rest")]) for x in "ab")
    short = short.where(F.col("rest_a") >= 2 * part * F.col("size_a") - CLOSE)
    ordered = (F.col("size_a") < F.col("size_b")) | ((F.col("size_a") == F.col("size_b")) & (F.col("digest_a") < F.col("digest_b")))
    enough = (F.col("size_a") >= similarity * F.col("size_b") - CLOSE) & (F.least("rest_a", "rest_b") >= part * (F.col("size_a") + F.col("size_b")) - CLOSE)
    met = short.join(long, (short.shingle == long.shingle) & (F.col("root_a") != F.col("root_b")) & ordered & enough)
    return met.select(F.col("digest_a").alias("a"), F.col("digest_b").alias("b")).distinct()


def near_copies(docs: DataFrame, text: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(node, root): the component's least text digest, for every text that is linked and not the least."""
    texts = stored(sketches(docs, text, words).dropDuplicates(["digest"]), "sketches")
    keys = bucketed(texts)
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stored(keys.join(sizes, "key"), "shared-buckets")
    texts = stored(texts.join(shared.select("digest").distinct(), "digest", "left_semi"), "sharing-texts")

    # every candidate of either step shares a bucket, so one stage of sets, and one shuffle of the texts, serves both
    sets = shingle_sets(docs, texts.select("digest"), text, words)
    close = stored(agreeing(by_fingerprints(texts).union(to_hubs(shared)).distinct(), texts), "close-pairs")
    first = stored(similar(close, sets, similarity), "first-links")

    roots = components(first, "first-components").withColumnRenamed("node", "digest")
    tied = shared.select("key", "digest").join(roots, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    mixed = tied.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    apart = stored(sets.join(tied.join(mixed, "key", "left_semi").select("digest", "root").distinct(), "digest"), "apart")
    pairs = stored(by_rare_shingles(apart, similarity), "near-pairs")
    return components(first.unionByName(similar(pairs, apart, similarity)), "near-links")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each component, that of the smallest doc_id (then of the least digest), with the columns of `docs`."""
    roots = near_copies(docs, text, words, similarity).withColumnRenamed("node", "same")
    marked = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_digest(F.col(f"`{text}`")).alias("digest"), identity(text).alias("same"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "digest")
    first = (marked.join(roots, "same", "left").groupBy(F.coalesce("root", "same").alias("root"))
             .agg(F.min(order).alias("first")).select("first.doc_id", "first.digest"))
    return only_rows(docs, first, doc_id, text)
