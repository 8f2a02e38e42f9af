import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywright import schema as S
from tallywright.operators import cells as C
from tallywright.operators import file_rules as R
from tallywright.operators import learn as L
from tallywright.operators import ordered as O
from tallywright.operators import rows as RW


def brute_pairs(spans):
    out = []
    for i, a in enumerate(spans):
        for b in spans[i + 1:]:
            w, h = min(a[6], b[6]) - max(a[4], b[4]), min(a[7], b[7]) - max(a[5], b[5])
            if w <= 0 or h <= 0 or a[3] == b[3]:
                continue
            small = min((a[6] - a[4]) * (a[7] - a[5]), (b[6] - b[4]) * (b[7] - b[5]))
            if small > 0 and w * h / small > 0.45:
                out.append((a, b))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_stacked_text_with_many_copies(spark, seed):
    rng = random.Random(seed)
    data = []
    for i in range(150):
        x, y = rng.choice([0.0, 30.0, 47.0, 90.0]), rng.choice([0.0, 40.0, 46.0])
        data.append((1, 1, i, rng.choice("abc"), x, y, x + rng.choice([20.0, 60.0]), y + 10.0, None, None))
    got = R.stacked_pages(spark.createDataFrame(data, S.SPANS)).first()
    want = brute_pairs(data)
    assert got.n_pairs == len(want)
    assert got.pairs == [f"{a[3]} / {b[3]}" for a, b in want[:6]]


def test_overlap_threshold(spark):
    s = lambda *b: spark.createDataFrame([(1, 1, i, t, *map(float, x), None, None) for i, (t, x) in enumerate(b)], S.SPANS)
    assert R.stacked_pages(s(("a", (0, 0, 10, 10)), ("b", (1, 1, 11, 11)))).count() == 1
    assert R.stacked_pages(s(("a", (0, 0, 10, 10)), ("a", (1, 1, 11, 11)))).count() == 0
    assert R.stacked_pages(s(("a", (0, 0, 10, 10)), ("b", (5.5, 0, 15.5, 10)))).count() == 0


def test_patch_needs_text_under_it_and_at_most_four(spark):
    pages = spark.createDataFrame([(1, 1, 612.0, 792.0, False)], "doc_id BIGINT, page INT, width DOUBLE, height DOUBLE, ocr BOOLEAN")
    spans = spark.createDataFrame([(1, 1, 0, "a", 10.0, 10.0, 30.0, 20.0, None, None)], S.SPANS)
    none = spark.createDataFrame([], "doc_id BIGINT, page INT")
    p = lambda n: spark.createDataFrame([(1, 1, i, 5.0 + 200 * (i > 0), 5.0, 40.0 + 200 * (i > 0), 25.0) for i in range(n)], "doc_id BIGINT, page INT, patch_no INT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE")
    assert R.patch_findings(p(4), spans, pages, none).count() == 1
    assert R.patch_findings(p(5), spans, pages, none).count() == 0
    assert RW.page_classes(pages.withColumn("image_cover", F.lit(0.5)).withColumn("visible_text_spans", F.lit(0)), spans).first().ocr


@pytest.mark.parametrize("a,b,linked", [((0, 0), (0, 3), True), ((0, 0), (0, 4), False), ((0, 0), (1, 2), True), ((0, 0), (1, 3), False), ((0, 0), (2, 0), False)])
def test_region_links(spark, a, b, linked):
    hot = spark.createDataFrame([(1, *a), (1, *b)], "page_id BIGINT, rw INT, cl INT")
    assert (C.region_labels(hot).select("region").distinct().count() == 1) == linked


def test_regions_match_flood_fill(spark):
    rng = random.Random(5)
    pts = {(rng.randint(0, 30), rng.randint(0, 40)) for _ in range(130)} | {(r, 60) for r in range(60)}
    hot = spark.createDataFrame([(1, r, c) for r, c in pts], "page_id BIGINT, rw INT, cl INT")
    got = {}
    for x in C.region_labels(hot).collect():
        got.setdefault(x.region, set()).add((x.rw, x.cl))
    left, want = set(pts), []
    while left:
        todo, comp = [left.pop()], set()
        while todo:
            p = todo.pop()
            comp.add(p)
            near = {q for q in left if (q[0] == p[0] and abs(q[1] - p[1]) <= 3) or (abs(q[0] - p[0]) == 1 and abs(q[1] - p[1]) <= 2)}
            left -= near
            todo += near
        want.append(comp)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))


def test_auc_and_quantile(spark):
    rng = np.random.default_rng(0)
    s, y = np.round(rng.random(500), 2), rng.integers(0, 2, 500)
    d = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "score DOUBLE, label INT")
    p, n = s[y == 1], s[y == 0]
    want = ((p[:, None] > n).sum() + 0.5 * (p[:, None] == n).sum()) / (len(p) * len(n))
    assert L.auc(d).first().auc == pytest.approx(want)
    for q in (0.0, 0.37, 0.98, 1.0):
        assert O.exact_quantile(d, "score", q).first().quantile == pytest.approx(np.quantile(s, q))


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_previous_and_rank_do_not_depend_on_chunks(spark, chunk):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.randint(0, 4), i) for i in rng.sample(range(500), 80)]
    d = spark.createDataFrame(rows, "k STRING, day INT, n BIGINT")
    got = {(r.k, r.n): r.prev.n if r.prev else None for r in O.with_previous(d, ["k"], "n", ["n"], outer="day", chunk=chunk).collect()}
    rank = {(r.k, r.n): r["rank"] for r in O.with_rank(d, ["k"], "n", chunk=chunk).collect()}
    for k in "ab":
        mine = sorted([(r[1], r[2]) for r in rows if r[0] == k])
        assert [got[(k, n)] for _, n in mine] == [None] + [n for _, n in mine[:-1]]
        assert [rank[(k, n)] for n in sorted(n for _, n in mine)] == list(range(1, len(mine) + 1))


def test_model_learns_and_drivers_point_at_the_signal(spark, tmp_path):
    from tallywright.sources import sinks
    rng = random.Random(1)
    rows = [(i, float(i % 2), rng.random(), i % 2) for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id BIGINT, a DOUBLE, b DOUBLE, label INT")
    m = L.fit_score_model(L.training_rows(d, d.limit(10)), ["a", "b"], trees=5)
    sinks.save_model(m, str(tmp_path / "m"))
    m = sinks.load_newest_model(spark, str(tmp_path / "m"))
    assert L.auc(L.score_rows(m, d).withColumnRenamed("probability", "score")).first().auc == 1.0
    top = L.drivers(m, d, ["a", "b"]).where("rank = 1").select("feature").distinct().collect()
    assert [r.feature for r in top] == ["a"]
    assert sinks.load_newest_model(spark, str(tmp_path / "none")) is None
    c = L.fit_cell_model(d.select("a", "b", "label"), ["a", "b"], trees=3)
    assert L.score_rows(c, d).count() == 200


def test_sparse_numbers_fill_chunks(spark):
    """Hash-like numbers of one large key and of many small ones: few chunks, same neighbours."""
    rnd = random.Random(6)
    rows = [("big", rnd.randrange(1 << 62)) for _ in range(1000)] + [(f"k{i % 50}", rnd.randrange(1 << 62)) for i in range(200)]
    d = spark.createDataFrame(rows, "k string, n long")
    chunks = {(r.k, r._chunk) for r in O._with_chunk(d, ["k"], "n", 100).collect()}
    assert len({c for k, c in chunks if k == "big"}) <= 11 and {c for k, c in chunks if k != "big"} == {0}
    got = {(r.k, r.n): r.prev.n if r.prev else None for r in O.with_previous(d, ["k"], "n", ["n"], chunk=100).collect()}
    for key in {k for k, _ in rows}:
        numbers = sorted(n for k, n in rows if k == key)
        assert [got[key, n] for n in numbers] == [None, *numbers[:-1]]


def test_broken_boxes_do_not_explode(spark):
    """A box that reaches far off its page is laid over the squares of the page only."""
    spans = spark.createDataFrame([(1, 1, 1, "a", 0.0, 0.0, 1e9, 10.0), (1, 1, 2, "b", 300.0, 0.0, 310.0, 10.0), (1, 1, 3, "c", 600.0, 0.0, 610.0, 10.0)],
                                  "doc_id long, page int, span_no long, text string, x0 double, y0 double, x1 double, y1 double")
    got = R.overlapping_texts(spans)
    assert {(r.a_text, r.c_text) for r in got.collect()} == {("a", "b"), ("a", "c")}
    patches = spans.where("text = 'a'").withColumnRenamed("span_no", "patch_no")
    assert R.covering_patches(patches, spans.where("text <> 'a'")).count() == 1


def test_pages_too_small_for_the_cell_rules(spark):
    blocks = spark.createDataFrame([(p, x, y, 1.0 + 500 * (x < 2 and y == 0), 0.5) for p, n in ((1, 6), (2, 5)) for x in range(n) for y in range(n)],
                                   "page_id long, bx int, by int, score double, edge_share double")
    assert [r.page_id for r in R.robust_hot_spots(blocks).collect()] == [1]


def test_uneven_numbers_fill_chunks(spark):
    """Half of a key's numbers lie close together, half far apart: no chunk holds more than a few parts of the key."""
    from tallywright.operators import ordered

    rows = [(1, i) for i in range(3000)] + [(1, 10**6 + i * 10**6) for i in range(3000)] + [(2, i) for i in range(5)]
    df = spark.createDataFrame(rows, "k long, n long").repartition(5)
    sizes = [r["count"] for r in ordered._with_chunk(df, ["k"], "n", 100).where("k = 1").groupBy("_chunk").count().collect()]
    assert sum(sizes) == 6000 and max(sizes) <= 2 * 100
    got = {(r.k, r.n): (r.prev.n if r.prev else None) for r in ordered.with_previous(df, ["k"], "n", ["n"], chunk=100).collect()}
    ordered_rows = sorted(rows)
    assert got == {r: (q[1] if q and q[0] == r[0] else None) for q, r in zip([None, *ordered_rows], ordered_rows)}
    ranks = {(r.k, r.n): r["rank"] for r in ordered.with_rank(df, ["k"], "n", chunk=100).collect()}
    assert all(ranks[r] == 1 + sum(q[0] == r[0] and q[1] < r[1] for q in rows) for r in rows[::97])
