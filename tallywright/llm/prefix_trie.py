"""Trie of the prefixes of rebuilt conversations, found by fingerprints that are composed, not computed from rebuilt texts.

A rebuilt conversation is the head of one stored conversation followed by the tail of another. A sequence of turns has the fingerprint
(n, v) with v = sum of hash(turn i) * B^i modulo a prime, for four primes and hashes side by side (124 bits); these form a monoid under
(n, v) * (m, w) = (n + m, v + B^n * w). So prefix sums of the stored conversations are all that is needed: a rebuilt prefix is the
product of a head of the base and of a stretch of the own turns, and that stretch is the difference of two prefix sums moved to its
place. No text is copied, hashed again or carried along: members are rows of numbers, each with a reference to the stored turn that
comes last in it.

Prefixes with equal depth and fingerprint form a node. Where their last turns are references to different stored turns, role and text
of these are looked up and compared in full; with equal last turns in every node, nodes are equal sequences all the way from the root.
A difference changes the multipliers and hashes, and everything is done anew.

Subtrees need no walk from node to node: the members of a node are conversations, and each node below it is the node of some member
deeper on its path. Each node is counted with its least member only, so sums over a subtree are sums over members of what lies deeper on
their own paths (running sums along each path), which is linear in the number of turns.

Only the digest over the identifiers that end at a node runs through them in order in one task; it is streamed, eight bytes each.

Defined cases: null roles and texts are empty; turns with equal numbers stand in the order of role, then digest of the text, null numbers
first; rows without conv_id belong to no conversation; repeated rows are turns each; a conversation without turns left is a member of the
root and ends there; a table without conversations gives no node, not even a root; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.common import by_arrow, stored
from tallywright.llm.prefix_sums import with_running

#: Primes just under 2^31, so that a product of two remainders fits into 63 bits.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
POSITION_BITS = 31
TRIES = 8


class Lanes:
    """The monoid, for some primes and one choice of multipliers: columns v0, v1, ... hold a fingerprint."""

    def __init__(self, primes: Sequence[int] = PRIMES, choice: int = 0) -> None:
        self.primes, self.choice = tuple(primes), choice
        draw = lambda i: int.from_bytes(hashlib.sha256(f"{choice}:{i}".encode()).digest()[:8], "big")
        self.bases = [2 + draw(i) % (p - 3) if p > 3 else 1 for i, p in enumerate(self.primes)]

    def names(self, stem: str = "v") -> list[str]:
        return [f"{stem}{i}" for i in range(len(self.primes))]

    def hashes(self, *content: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(self.choice), F.lit(i), *content), F.lit(p)) for i, p in enumerate(self.primes)]

    def power(self, i: int, exponent: Column) -> Column:
        """B^exponent modulo the prime, from the squares of B and the bits of the exponent; exponents may be negative."""
        p, base = self.primes[i], self.bases[i]

        def of(b: int) -> Column:
            squares = F.array(*[F.lit(pow(b, 1 << bit, p)).cast("long") for bit in range(POSITION_BITS)])
            bits = F.filter(F.transform(squares, lambda s, at: F.when(F.getbit(F.abs(exponent).cast("long"), at) == 1, s)), lambda s: s.isNotNull())
            return F.aggregate(bits, F.lit(1).cast("long"), lambda a, s: a * s % p)

        # the exponents that occur most are the small ones
        return F.when(exponent == 0, F.lit(1).cast("long")).when(exponent > 0, of(base)).otherwise(of(pow(base, -1, p)))


def stored_turns(turns: DataFrame, lanes: Lanes) -> DataFrame:
    """(conv_id, pos, role, text, chars, v...): every turn with its place from 1 and the fingerprint of the conversation up to it."""
    filled = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                                              F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    filled = filled.withColumn("digest", F.sha2("text", 256))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    placed = with_running(filled, "conv_id", order, {"pos": F.lit(1).cast("long")}, "trie-order")
    parts = {n: h * lanes.power(i, F.col("pos") - 1) % lanes.primes[i] for i, (n, h) in enumerate(zip(lanes.names("h"), lanes.hashes(F.col("role"), F.col("digest")), strict=True))}
    hashed = placed.withColumns(parts)
    summed = with_running(hashed, "conv_id", [F.col("pos")], {n: F.col(h) for n, h in zip(lanes.names(), lanes.names("h"), strict=True)}, "trie-hashes")
    return stored(summed.select("conv_id", "pos", "role", "text", F.length("text").cast("long").alias("chars"), *[(F.col(n) % p).alias(n) for n, p in zip(lanes.names(), lanes.primes, strict=True)]), "trie-turns")


def members(turns: DataFrame, plan: DataFrame, lanes: Lanes) -> DataFrame:
    """(conv_id, depth, total, v..., ref_conv, ref_pos, chars): each prefix of each rebuilt conversation, down from depth 1, stored.

    `plan` has conv_id, base and head, one row a conversation: its first `head` turns are those of `base`. Conversations that come out
    without turns have one row of depth 0; the others' roots are left to `nodes`.
    """
    slim = turns.drop("role", "text")
    sizes = slim.groupBy("conv_id").agg(F.max("pos").alias("n"))
    v = lanes.names()

    def at(side: str, key: str, pos: str) -> DataFrame:
        """Fingerprints of stored prefixes, to be joined by conversation and length."""
        return slim.select(F.col("conv_id").alias(key), F.col("pos").alias(pos), *[F.col(n).alias(f"{side}_{n}") for n in v])

    p = plan.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left").join(sizes.withColumnRenamed("n", "own_n"), "conv_id", "left")
    p = p.withColumns({"taken": F.least("head", F.coalesce("base_n", F.lit(0))).cast("long"), "skipped": F.col("head").cast("long")})
    p = p.withColumn("total", F.col("taken") + F.greatest(F.coalesce("own_n", F.lit(0)) - F.col("skipped"), F.lit(0)))
    p = p.join(at("of_base", "base", "taken"), ["base", "taken"], "left").join(at("of_own", "conv_id", "skipped"), ["conv_id", "skipped"], "left")
    zero = F.lit(0).cast("long")
    p = stored(p.select("conv_id", "base", "taken", "skipped", "total", *[F.coalesce(f"{s}_{n}", zero).alias(f"{s}_{n}") for s in ("of_base", "of_own") for n in v]), "trie-plan")

    heads = p.where("taken > 0").select("conv_id", "total", "taken", F.col("base").alias("ref_conv")).join(
        slim.withColumnsRenamed({"conv_id": "ref_conv", "pos": "ref_pos"}), "ref_conv").where(F.col("ref_pos") <= F.col("taken"))
    heads = heads.select("conv_id", F.col("ref_pos").alias("depth"), "total", *v, "ref_conv", "ref_pos", "chars")
    tails = slim.join(p, "conv_id").where(F.col("pos") > F.col("skipped"))
    moved = [((F.col(f"of_base_{n}") + F.pmod(F.col(n) - F.col(f"of_own_{n}"), F.lit(m)) * lanes.power(i, F.col("taken") - F.col("skipped"))) % m).alias(n)
             for i, (n, m) in enumerate(zip(v, lanes.primes, strict=True))]
    tails = tails.select("conv_id", (F.col("taken") + F.col("pos") - F.col("skipped")).alias("depth"), "total", *moved, F.col("conv_id").alias("ref_conv"), F.col("pos").alias("ref_pos"), "chars")
    empty = p.where("total = 0").select("conv_id", zero.alias("depth"), "total", *[zero.alias(n) for n in v], F.lit(None).cast("long").alias("ref_conv"), F.lit(None).cast("long").alias("ref_pos"), zero.alias("chars"))
    return stored(heads.unionByName(tails).unionByName(empty), "trie-members")


def by_reference(member: DataFrame, lanes: Lanes) -> DataFrame:
    """Members of one node with one last turn, put together, stored: what many conversations took from one base is one row."""
    return stored(member.groupBy("depth", *lanes.names(), "ref_conv", "ref_pos", "chars").agg(
        F.min("conv_id").alias("first"), F.count(F.lit(1)).alias("n"), F.max("total").alias("deepest")), "trie-references")


def differing(references: DataFrame, turns: DataFrame, lanes: Lanes) -> int:
    """How many nodes have last turns that are not the same: role and text of all stored turns referred to, compared in full."""
    node = ["depth", *lanes.names()]
    mixed = references.where("depth > 0").groupBy(*node).agg(F.count(F.lit(1)).alias("refs")).where("refs > 1").drop("refs")
    said = references.join(mixed, node, "left_semi").select(*node, "ref_conv", "ref_pos").join(
        turns.select(F.col("conv_id").alias("ref_conv"), F.col("pos").alias("ref_pos"), "role", "text"), ["ref_conv", "ref_pos"])
    unlike = said.groupBy(*node).agg(F.min(F.struct("role", "text")).alias("low"), F.max(F.struct("role", "text")).alias("high")).where("low <> high")
    return unlike.count()


def end_digests(ends: DataFrame) -> DataFrame:
    """(node_conv, depth, ends_sha256) from rows (node_conv, depth, conv_id): digest of the identifiers in order, joined by commas."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, done = None, None, []

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string()))], ["node_conv", "depth", "ends_sha256"])
            done.clear()
            return batch

        for b in batches:
            for *node, conv_id in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if node != now:
                    if now is not None:
                        done.append((*now, digest.hexdigest()))
                    now, digest = node, hashlib.sha256(str(conv_id).encode())
                else:
                    digest.update(f",{conv_id}".encode())
            if done:
                yield out()
        if now is not None:
            done.append((*now, digest.hexdigest()))
            yield out()

    dealt = ends.select("node_conv", "depth", "conv_id").repartition("node_conv", "depth").sortWithinPartitions("node_conv", "depth", "conv_id")
    return by_arrow(dealt, run, "node_conv long, depth long, ends_sha256 string")


def nodes(member: DataFrame, references: DataFrame, n_convs: Column, least: Column, lanes: Lanes) -> DataFrame:
    """One row a node, named by its least member and its depth, with its parent, counts, subtree sums and its last turn's reference.

    `n_convs` and `least` are the number and the least identifier of all conversations, those of the root.
    """
    key = ["depth", *lanes.names()]
    found = references.where("depth > 0").groupBy(*key).agg(
        F.min("first").alias("node_conv"), F.sum("n").alias("n"), F.max("deepest").alias("deepest"), F.min(F.struct("ref_conv", "ref_pos")).alias("ref"))
    path = stored(member.where("depth > 0").join(found, key).select(
        "conv_id", "depth", "total", "node_conv", "n", "deepest", "ref",
        F.when(F.col("conv_id") == F.col("node_conv"), (F.col("n") - 1) * F.col("chars")).otherwise(0).alias("saved"),
        # a leaf is counted on the path of its least member, which ends there
        (F.col("conv_id") == F.col("node_conv")).alias("named"), (F.col("total") == F.col("depth")).alias("ends")), "trie-path")
    deeper = with_running(path.select("conv_id", "depth", "node_conv", "saved"), "conv_id", [F.col("depth").desc()], {"below": F.col("saved")}, "trie-sums")
    sums = deeper.groupBy("node_conv", "depth").agg(F.sum("below").alias("saved_tokens"))
    leaf_paths = path.where("ends AND named AND deepest = depth").select("conv_id", F.lit(1).alias("leaf"))
    leaves = path.select("conv_id", "node_conv", "depth").join(leaf_paths, "conv_id").groupBy("node_conv", "depth").agg(F.count(F.lit(1)).alias("n_leaves"))
    named = path.where("named").select("node_conv", "depth", "n", "ref")
    above = path.select(F.col("conv_id").alias("node_conv"), (F.col("depth") + 1).alias("depth"), F.col("node_conv").alias("parent_conv"))
    linked = stored(named.join(above, ["node_conv", "depth"], "left"), "trie-nodes")
    children = linked.where("depth > 1").groupBy(F.col("parent_conv").alias("node_conv"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    inner = (linked.join(sums, ["node_conv", "depth"]).join(leaves, ["node_conv", "depth"]).join(children, ["node_conv", "depth"], "left")
             .select("node_conv", "depth", F.when(F.col("depth") == 1, least).otherwise(F.col("parent_conv")).alias("parent_conv"), "n", F.coalesce("n_children", F.lit(0)).alias("n_children"),
                     "n_leaves", "saved_tokens", "ref.ref_conv", "ref.ref_pos"))
    below = path.agg(F.count_if(F.col("named") & (F.col("depth") == 1)).alias("n_children"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved_tokens"),
                     F.count_if(F.col("ends") & F.col("named") & (F.col("deepest") == F.col("depth"))).alias("n_leaves"))
    root = below.select(
        least.alias("node_conv"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv"), n_convs.alias("n"), "n_children",
        F.greatest("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), "saved_tokens", F.lit(None).cast("long").alias("ref_conv"), F.lit(None).cast("long").alias("ref_pos"))
    ends = path.where("ends").select("node_conv", "depth", "conv_id").unionByName(member.where("depth = 0").select(least.alias("node_conv"), "depth", "conv_id"))
    return inner.unionByName(root).join(end_digests(ends), ["node_conv", "depth"], "left")


def prefix_trie(turns: DataFrame, plan: DataFrame, primes: Sequence[int] = PRIMES) -> DataFrame:
    """Nodes of the trie of the conversations that `plan` (conv_id, base, head) rebuilds from `turns` (conv_id, turn, role, text).

    Returns conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, ref_conv and ref_pos
    (the stored turn that is the node's last). Raises if TRIES choices of multipliers all fail, rather than return nodes that are not equal.
    """
    size = plan.agg(F.count(F.lit(1)), F.min("conv_id")).first()
    for choice in range(TRIES):
        lanes = Lanes(primes, choice)
        kept = stored_turns(turns, lanes)
        member = members(kept, plan, lanes)
        references = by_reference(member, lanes)
        if differing(references, kept, lanes) == 0:
            break
    else:
        raise RuntimeError(f"{TRIES} choices of multipliers left unlike prefixes with one fingerprint")
    out = nodes(member, references, F.lit(size[0]).cast("long"), F.lit(size[1]).cast("long"), lanes)
    out = out if size[0] else out.limit(0)
    return out.select(F.col("node_conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), "ref_conv", "ref_pos")


def hundreds(turns: DataFrame) -> DataFrame:
    """The plan of op12: conversation c goes on from the first crc32(c) % 6 turns of conversation c - c % 100."""
    convs = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    return stored(convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 100).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).alias("head")), "trie-convs")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return prefix_trie(turns, hundreds(turns)).drop("ref_conv", "ref_pos")


_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295)"""
OP12_SQL = f"""
WITH s AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS turns
           FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, turns, conv_id - conv_id % 100 AS base, ({_CRC32} % 6)::BIGINT AS head FROM s),
r AS (SELECT h.conv_id, list_concat(coalesce(b.turns[:h.head], []), h.turns[h.head + 1:]) AS turns FROM h LEFT JOIN s b ON b.conv_id = h.base),
m AS (SELECT conv_id, len(turns) AS total, turns, unnest(range(len(turns) + 1)) AS depth FROM r),
k AS (SELECT conv_id, total, depth, turns[:depth] AS path, turns[:depth - 1] AS above, turns[depth].text AS last FROM m),
n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(above) AS above, coalesce(length(any_value(last)), 0) AS chars,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE total = depth), '')) AS ends_sha256
      FROM k GROUP BY path, depth),
c AS (SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM n x WHERE x.depth = n.depth + 1 AND x.above = n.path) AS n_children
      FROM n LEFT JOIN n p ON p.depth = n.depth - 1 AND p.path = n.above),
t AS (SELECT a.path, a.depth, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.chars) AS saved_tokens
      FROM c a JOIN c b ON b.depth >= a.depth AND b.path[:a.depth] = a.path GROUP BY a.path, a.depth)
SELECT c.conv_id, c.depth::BIGINT AS depth, c.parent_conv_id, c.n_convs, c.n_children::BIGINT AS n_children, t.n_leaves, t.saved_tokens::BIGINT AS saved_tokens, c.ends_sha256
FROM c JOIN t ON t.path = c.path AND t.depth = c.depth
"""
