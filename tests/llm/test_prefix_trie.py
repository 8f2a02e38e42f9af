"""The trie against one built turn by turn from rebuilt conversations."""

import hashlib
import zlib

import pytest
from pyspark.sql import types as T

from tallywright.llm import prefix_trie as trie

SF = "/root/testdata/sf0.001"


def rebuilt(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    said = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, own in said.items():
        head = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = said.get(base, [])[:head] + own[head:]
    return out


def expected(rows):
    convs = rebuilt(rows)
    node = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            node.setdefault(tuple(turns[:d]), []).append(c)
    kids = {p: [q for q in node if len(q) == len(p) + 1 and q[:len(p)] == p] for p in node}
    under = {p: [q for q in node if q[:len(p)] == p] for p in node}
    own = lambda q: (len(node[q]) - 1) * len(q[-1][1]) if q else 0
    return sorted((min(m), len(p), min(node[p[:-1]]) if p else None, len(m), len(kids[p]), sum(not kids[q] for q in under[p]), sum(map(own, under[p])),
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p)).encode()).hexdigest()) for p, m in node.items())


def result(frame):
    return sorted(tuple(r)[:8] for r in frame.collect())


SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
                       T.StructField("pos", T.StringType()), T.StructField("V0", T.StringType()), T.StructField("depth", T.StringType())])
ODD = [(c, t, "user" if t % 2 else "assistant", f"turn {t} {'same' if c % 3 else c}") for c in (0, 1, 2, 3, 5, 7, 40, 100, 101, 150, 199, -7, -100, 305) for t in range(c % 9)]
ODD += [(0, None, None, None), (0, 3, None, "x"), (0, 3, "user", ""), (0, 3, "user", ""), (4, None, "user", "😀 ü"), (4, None, "user", "😀 ü"), (None, 1, "user", "nobody's"), (200, 0, "", ""), (201, 0, "user", "long " * 50_000),
        (202, 0, "user", "long " * 50_000), (203, 5, None, None)]


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(trie.op12_prefix_trie(spark, SF)) == expected(rows)


def test_odd_rows(spark):
    frame = spark.createDataFrame([(*r, "p", "v", "d") for r in ODD], SCHEMA).repartition(3)
    out = trie.prefix_trie(frame, trie.hundreds(frame))
    assert result(out) == expected(ODD)
    said = {(c, d): t for c, turns in rebuilt(ODD).items() for d, t in enumerate(turns, 1)}
    kept = {(r.conv_id, r.pos): (r.role, r.text) for r in trie.stored_turns(frame, trie.Lanes()).collect()}
    assert all(kept[r.ref_conv, r.ref_pos] == said[r.conv_id, r.depth] for r in out.where("depth > 0").collect())


def test_empty_table_and_turnless_conversation(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert trie.prefix_trie(empty, trie.hundreds(empty)).collect() == []
    number = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6)
    lone = [(number, 0, "user", "one turn, and all of it is skipped")]
    frame = spark.createDataFrame([(*r, "p", "v", "d") for r in lone], SCHEMA)
    assert result(trie.prefix_trie(frame, trie.hundreds(frame))) == expected(lone) == [(number, 0, None, 1, 0, 1, 0, hashlib.sha256(str(number).encode()).hexdigest())]


def test_equal_fingerprints_of_unlike_prefixes_are_noticed(spark):
    """With a tiny prime fingerprints collide: nodes are compared in full, other multipliers are tried, and wrong nodes never come out."""
    frame = spark.createDataFrame([(*r, "p", "v", "d") for r in ODD], SCHEMA)
    lanes = trie.Lanes((5,))
    turns = trie.stored_turns(frame, lanes)
    assert trie.differing(trie.by_reference(trie.members(turns, trie.hundreds(frame), lanes), lanes), turns, lanes) > 0
    few = frame.where("conv_id IN (1, 2, 3)")
    rows = [r for r in ODD if r[0] in (1, 2, 3)]
    assert result(trie.prefix_trie(few, trie.hundreds(few), primes=(13,))) == expected(rows)


def test_powers(spark):
    from pyspark.sql import functions as F

    lanes = trie.Lanes()
    exponents = [0, 1, 2, 5, -1, -5, 77, 2**31 - 1]
    got = spark.createDataFrame([(e,) for e in exponents], "e long").select("e", *[lanes.power(i, F.col("e")).alias(f"p{i}") for i in range(4)]).collect()
    assert all(r[1 + i] == pow(lanes.bases[i], r.e, p) for r in got for i, p in enumerate(lanes.primes))


@pytest.mark.parametrize("partitions", [1, 5, 50])
def test_running_sums_across_partitions(spark, partitions):
    """One key with most rows is cut into several partitions; sums go on across the cuts."""
    from pyspark.sql import functions as F

    from tallywright.llm.prefix_sums import with_running

    rows = [(k, i, (i * 7 + k) % 11) for k, n in ((1, 900), (2, 3), (3, 1), (4, 40)) for i in range(n)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        out = with_running(spark.createDataFrame(rows, "k long, i long, x long"), "k", [F.col("i")], {"n": F.lit(1).cast("long"), "s": F.col("x")}, "running").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sorted((r.k, r.i, r.n, r.s) for r in out) == sorted((k, i, i + 1, sum(x for q, j, x in rows if q == k and j <= i)) for k, i, _ in rows)
