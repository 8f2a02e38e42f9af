"""SimHash near-duplicates against comparisons of all pairs."""

import itertools
import random

import numpy as np
import xxhash
from conftest import SF
from llm_rows import ROWS, none, odd, schema  # noqa: F401

from tallywright.llm import simhash
from tallywright.llm.components import components


def slow_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not words:
        return 0
    shingles = [words[i:i + 3] for i in range(len(words) - 2)] or [words]
    hashes = [xxhash.xxh64_intdigest(b" ".join(s), seed=42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def slow_components(rows, radius=3):
    """rows: (doc_id, fingerprint) -> smallest doc_id of each row's component."""
    kinds = sorted({f for _, f in rows})
    root = {f: f for f in kinds}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(kinds, 2):
        if (a ^ b).bit_count() <= radius:
            root[find(a)] = find(b)
    least = {}
    for d, f in rows:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return [least.get(find(f)) for _, f in rows]


def test_masks_cover_every_three_positions():
    for masks in simhash.families(3):
        assert all(any(not any(m >> i & 1 for i in c) for m in masks) for c in itertools.combinations(range(64), 3))


def test_bucket_search_agrees_with_pairs():
    rng = np.random.default_rng(5)
    free = (1 << 12) - 1
    fp = np.unique(rng.integers(0, 1 << 12, 400).astype(np.uint64))
    for some in (fp, fp[::7], fp[:1], fp[:0]):
        ways = []
        for pairwise in (10, 10_000):
            node, root = simhash.bucket_links(np.zeros(len(some), int), some, np.full(len(some), free, np.uint64), 3, pairwise)
            label = np.arange(len(some))
            label[node] = root
            ways.append(label.tolist())
        assert ways[0] == ways[1]


def test_planted_neighbours(spark):
    rnd = random.Random(4)
    base = [rnd.getrandbits(64) for _ in range(300)]
    fps = base + [b ^ sum(1 << i for i in rnd.sample(range(64), rnd.choice((1, 2, 3, 4, 5)))) for b in base for _ in range(2)]
    classes = spark.createDataFrame([(simhash.signed(f),) for f in set(fps)], "fp long")
    rows = [(i, f) for i, f in enumerate(fps)]
    for pairwise in (256, 1):  # the second sends every bucket to the finer tables and to the search by flips
        roots = dict(components(simhash.fingerprint_links(classes, 3, pairwise)).collect())
        label = [roots.get(simhash.signed(f), simhash.signed(f)) for f in fps]
        same = {}
        for want, got in zip(slow_components(rows), label, strict=True):
            assert same.setdefault(want, got) == got
        assert len(set(same.values())) == len(same)


def test_long_chain_of_links(spark):
    n = 200
    order = random.Random(1).sample(range(n), n)
    links = spark.createDataFrame(list(itertools.pairwise(order)), "a long, b long")
    assert {r.root for r in components(links).collect()} == {0}


def test_documents(spark, odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert sorted((r.doc_id or -1, r.fp & ((1 << 64) - 1)) for r in got) == sorted((r[0] or -1, slow_fingerprint(r[1])) for r in ROWS)
    rows = [(r.doc_id, r.fp & ((1 << 64) - 1)) for r in got]
    assert [r.component_id for r in got] == slow_components(rows)
    stay = simhash.deduplicate(odd)
    assert stay.columns == odd.columns and stay.count() == len({r.root for r in got})
    assert simhash.near_duplicates(none).count() == 0 and simhash.deduplicate(none).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = simhash.op2_simhash(spark, SF).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == {d: slow_fingerprint(t) for d, t in texts.items()}
    assert [r.component_id for r in got] == slow_components([(r.doc_id, int(r.fingerprint, 16)) for r in got])


def test_rows_of_masks_are_never_broadcast(spark, capsys):
    """The planner takes the rows of all masks for as few bytes as the fingerprints, so even where those are small they are not broadcast."""
    classes = spark.range(2000).selectExpr("xxhash64(id) AS fp")
    capsys.readouterr()
    simhash.fingerprint_links(classes).explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
