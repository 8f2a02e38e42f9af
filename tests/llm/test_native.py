"""Exact dedup, chat formatting and mixing. Whole tables are compared with SQL in test_contract."""

import hashlib
import re
from collections import Counter

from llm_rows import CLASHES, ROWS, none, odd, schema  # noqa: F401
from pyspark.sql import functions as F

from tallywright.llm import chat, exact_dedup, mixing


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_dedup(odd, none):
    got = exact_dedup.mark_duplicates(odd).collect()
    groups = {}
    for r in ROWS:
        groups.setdefault(normal(r[1]), []).append(r[0])
    assert len(got) == len(ROWS)
    for r in got:
        group = groups[normal(r.text)]
        assert r.keep_id == min((i for i in group if i is not None), default=None)
        assert r.group_size == len(group)
        assert r.text_sha256 == hashlib.sha256(normal(r.text).encode()).hexdigest()
    assert Counter(normal(r.text) for r in got if r.kept) == Counter(list(groups))
    stay = exact_dedup.deduplicate(odd)
    assert stay.columns == odd.columns and stay.count() == len(groups)
    assert exact_dedup.mark_duplicates(none).count() == 0


def test_exact_dedup_deals_out_a_hot_text(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 1, "the same").otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    hot = exact_dedup.hot_texts(docs.select("doc_id", F.xxhash64("text").alias("digest")), "digest", "doc_id").collect()
    assert len(hot) == 1 and hot[0].parts > 100
    got = exact_dedup.mark_duplicates(docs).where("text = 'the same'").collect()
    assert {(r.keep_id, r.group_size) for r in got} == {(1, 2000)} and [r.doc_id for r in got if r.kept] == [1]


def test_chat(spark):
    rows = [(1, 2, "assistant", "b\\s </s>"), (1, 1, "user", "[INST] a <turn>"), (1, 3, "assistant", "c"), (2, 0, "user", None), (None, 5, None, "x"), (None, None, "assistant", ""),
            (3, 1, "assistant", "\\o\\\\e<s>"), (3, 1, "assistant", "\\o\\\\e<s>"), (4, 1, "[/INST]</s>", "é😀")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    out = chat.format_conversations(df).withColumn("back", chat.turns_of(F.col("formatted"))).withColumn("loss", chat.loss_texts(F.col("formatted"), F.col("loss_spans")))
    for r in out.collect():
        turns = sorted(((t if t is not None else -1, role or "", text or "") for c, t, role, text in rows if c == r.conv_id))
        assert [(b.role, b.text) for b in r.back] == [t[1:] for t in turns]
        assert r.loss == [t[2] for t in turns if t[1] == "assistant"]
    one = out.where("conv_id = 1").first().formatted
    assert one.count("[INST]") == 2 and one.count("<turn>") == 1  # the assistant's turns are one block
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_mixing_decisions(odd, none):
    rows = mixing.decide(mixing.sizes(odd)).collect()
    size = {s: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in ROWS if r[3] == s) for s in {r[3] for r in ROWS}}
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(size.values())
    while True:  # hand out by weight, cap, hand out the excess again
        part = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if part[s] > 2 * size[s]}
        if not full:
            target |= part
            break
        target |= {s: 2.0 * size[s] for s in full}
        left -= sum(2 * size[s] for s in full)
        free -= full
    assert len(rows) == len(ROWS)
    for r in rows:
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6 and 0 <= r.copies <= 2
    assert mixing.decide(mixing.sizes(none)).count() == 0


def test_mixed_rows(spark, odd, none):
    decided = Counter((r.doc_id, r.source, r.size) for r in mixing.decide(mixing.sizes(odd)).collect() for _ in range(r.copies))
    mixed = mixing.mixed(odd)
    assert mixed.columns == odd.columns
    assert Counter((r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in mixed.collect()) == decided
    assert mixing.mixed(none).count() == 0
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 97 + 1).cast("int")).alias("text"),
                                    F.when(F.col("id") % 3 > 0, "big").otherwise("small").alias("source"))
    sums = mixing.decide(mixing.sizes(docs)).groupBy("source").agg(F.first("target").alias("target"), F.sum(F.col("copies") * F.col("size")).alias("taken")).collect()
    assert all(abs(r.taken - r.target) < 0.02 * r.target for r in sums)


def test_clashing_names_are_kept(odd):
    assert set(CLASHES) <= set(exact_dedup.deduplicate(odd).columns) & set(mixing.mixed(odd).columns)
