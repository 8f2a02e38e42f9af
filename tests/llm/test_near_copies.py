"""Near copies of the pipeline against exact comparison of all pairs."""

from itertools import combinations

from conftest import SF
from llm_rows import none, odd, schema  # noqa: F401

import corpus_pipeline
from tallywright.llm import near_copies


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def brute_pairs(texts):
    """Pairs of positions with similarity 0.8 or more."""
    sets = [shingle_set(t) for t in texts]
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    out = []
    for at, i in enumerate(order):
        for j in order[at + 1:]:
            if len(sets[i]) < 0.8 * len(sets[j]) - 1e-9:
                break
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                out.append((i, j))
    return out


def kept_by_brute(rows):
    least = {i: i for i in range(len(rows))}
    for _ in rows:
        before = dict(least)
        for i, j in brute_pairs([t for _, t in rows]):
            least[i] = least[j] = min(least[i], least[j])
        if before == least:
            break
    return {rows[i][0] for i in least if least[i] == i}


def edited(n, every):
    """A text of n words with a changed word at each of `every`."""
    return " ".join(f"x{i}" if i in every else f"w{i}" for i in range(n))


def test_copies_many_bits_apart_go(spark):
    # similarity of a change in the middle of n words: (n - 9) / (n + 1)
    rows = [(1, edited(60, ())), (2, edited(60, (30,))), (3, edited(60, (0, 59))), (4, edited(60, (15, 30, 45))), (5, "Other words. " * 9), (6, edited(49, (24,))), (7, edited(49, ()).replace("w", "v")),
            (8, edited(49, (24,)).replace("w", "v"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in near_copies.deduplicate(docs).collect()}
    assert got == kept_by_brute(rows)
    assert 2 not in got and {1, 4, 5, 7} <= got


def test_no_near_copy_stays(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted({r.text: (r.doc_id, r.text) for r in docs.orderBy(docs.doc_id.desc()).collect()}.values())
    assert {r.doc_id for r in corpus_pipeline.near(spark, docs, SF).collect()} == kept_by_brute(rows)


def test_large_buckets(spark):
    """Groups that share many buckets, and texts that share a passage without being near copies."""
    rows = [(i, edited(80, (i % 80,)) if i % 3 else " ".join([edited(60, ()), *(f"y{i}-{k}" for k in range(30 + i % 5))])) for i in range(120)]
    rows = [(i, t) for i, t in sorted({t: (i, t) for i, t in reversed(rows)}.values())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in near_copies.deduplicate(docs).collect()} == kept_by_brute(rows)


def test_copies_whose_first_text_is_gone(spark):
    """Each text has edits of its own, so most pairs lie just below the bound and no hub ties the group: the exact step finds the rest."""
    import random

    r = random.Random(7)
    rows = [(i, edited(120, tuple(r.sample(range(120), 2))).replace("x", f"x{i}-")) for i in range(90)]
    rows += [(100 + i, edited(120, tuple(r.sample(range(120), 3))).replace("x", f"x{i}-")) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    links = brute_pairs([t for _, t in rows])
    assert 0 < len(links) < len(rows) ** 2 / 4
    assert {r.doc_id for r in near_copies.deduplicate(docs).collect()} == kept_by_brute(rows)


def test_rare_shingles_find_every_similar_pair_and_few_others(spark):
    """The exact step alone, without buckets: all pairs of similar sets, whatever their sizes."""
    import random

    r = random.Random(11)
    base = [r.sample(range(1000), 60) for _ in range(6)]
    sets = [sorted({*r.sample(b, r.randrange(44, 61)), *r.sample(range(10**6), r.randrange(0, 9))}) for b in base for _ in range(25)] + [[5], [5], [5, 6], [7], list(range(3000, 3005)), list(range(3000, 3004))]
    frame = spark.createDataFrame([(bytes([i // 256, i % 256]), bytes([i // 256, i % 256]), s) for i, s in enumerate(sets)], "digest binary, root binary, set array<long>")
    found = {tuple(sorted((bytes(p.a), bytes(p.b)))) for p in near_copies.by_rare_shingles(frame).collect()}
    name = lambda i: bytes([i // 256, i % 256])
    jaccard = lambda a, b: len({*a} & {*b}) / len({*a} | {*b})
    want = {(name(i), name(j)) for i in range(len(sets)) for j in range(i + 1, len(sets)) if jaccard(sets[i], sets[j]) >= 0.8}
    assert want <= found and len(want) > 20
    assert len(found) < len(sets) ** 2 / 6


def shuffled(spark, run):
    """Bytes that the stages of `run` write for shuffles."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty(30_000)
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = written()
    out = run()
    return written() - before, out


def test_texts_are_shuffled_once_for_both_steps(spark, tmp_path):
    """Where nothing is small enough to be broadcast, the texts are shuffled for their sets and for the rows that stay, and not again."""
    import random

    r = random.Random(13)
    word = lambda: f"{r.randrange(16**12):012x}"
    rows = [(i, [word() for _ in range(600)]) for i in range(500)]
    # texts that are similar, and texts that share buckets without being similar: candidates of the first and of the second step
    rows += [(1000 + i, [word() if k in at else w for k, w in enumerate(rows[i][1])]) for i, at in enumerate([{300}] * 6 + [set(range(0, 600, 40))] * 20)]
    rows = [(i, " ".join(w)) for i, w in rows]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        for n in names:
            spark.conf.set(n, "-1")
        once, _ = shuffled(spark, lambda: docs.repartition("doc_id").write.parquet(str(tmp_path / "once")))
        all_in_all, kept = shuffled(spark, lambda: {x.doc_id for x in near_copies.deduplicate(docs).collect()})
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)
    assert kept == set(range(500)) | set(range(1006, 1026)) == kept_by_brute(rows)
    assert all_in_all < 3 * once
