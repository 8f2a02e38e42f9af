"""Queries over image cells, regions, training and evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallywright import constants as K
from tallywright.operators import cells as C
from tallywright.operators import decide as D
from tallywright.operators import learn as L
from tallywright.plans import fixtures as X
from tallywright.plans import stubs as SB
from tallywright.plans.registry import query
from tallywright.plans.retrain import retrain
from tallywright.session import ensure_checkpoint_dir, staged
from tallywright.sources import sinks

T_PAGE, T_CELL = 0.7, 0.5


def cells(spark, d):
    return X.view(spark, d, "d_cells")


def sql(body: str) -> str:
    return X.with_views(body, "d_cells")


# Pixels: rows of the embedding table are image rows, 96 to a page.
PIXELS = """
px AS (SELECT vec_id // 96 AS page_id, vec_id % 96 AS y, cast(x - 1 AS bigint) AS x, floor(abs(e) * 400) % 256 AS r, floor(abs(e) * 300) % 256 AS g, floor(abs(e) * 500) % 256 AS b, abs(e) * 10 AS e90, abs(e) * 7 AS e75
       FROM (SELECT vec_id, unnest(embedding)::double AS e, generate_subscripts(embedding, 1) AS x FROM embeddings) z),
gr AS (SELECT *, (r + g + b) / 3 AS grey, abs(r - g) + abs(g - b) AS chroma FROM px),
rm AS (SELECT *, (coalesce(lag(grey) OVER wx, grey) + grey + coalesce(lead(grey) OVER wx, grey)) / 3 AS rowm, abs(grey - coalesce(lag(grey) OVER wx, grey)) AS dx FROM gr WINDOW wx AS (PARTITION BY page_id, y ORDER BY x)),
ms AS (SELECT *, abs(grey - (coalesce(lag(rowm) OVER wy, rowm) + rowm + coalesce(lead(rowm) OVER wy, rowm)) / 3) AS hp, dx + abs(grey - coalesce(lag(grey) OVER wy, grey)) AS grad, y // 24 AS rw, x // 24 AS cl FROM rm WINDOW wy AS (PARTITION BY page_id, x ORDER BY y))
"""


def pixels(spark, d):
    e = X.table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "e"))
    a = F.abs(F.col("e").cast("double"))
    chan = lambda k: (F.floor(a * k) % 256).cast("double")
    return e.select(F.floor(F.col("vec_id") / 96).alias("page_id"), (F.col("vec_id") % 96).alias("y"), F.col("x").cast("bigint").alias("x"),
                    chan(400).alias("r"), chan(300).alias("g"), chan(500).alias("b"), (a * 10).alias("e90"), (a * 7).alias("e75"))


@query("g1_pixel_measures", "WITH " + PIXELS + " SELECT page_id, rw, cl, count(*) AS n, round(sum(grad), 4) AS grad, round(sum(hp), 4) AS hp FROM ms GROUP BY page_id, rw, cl")
def pixel_measures(spark, d):
    m = C.pixel_measures(pixels(spark, d), least_cells=1)
    return m.groupBy("page_id", F.col("cy").alias("rw"), F.col("cx").alias("cl")).agg(F.count("*").alias("n"), F.round(F.sum("grad"), 4).alias("grad"), F.round(F.sum("hp"), 4).alias("hp"))


_MEAN = "sum(CASE WHEN {m} THEN {v} ELSE 0 END) / greatest(count(*) FILTER ({m}), 1)"


@query("g2_cell_measures", "WITH " + PIXELS + """,
q AS (SELECT *, quantile_cont(grey, 0.9) OVER c AS bg, quantile_cont(grey, 0.05) OVER c AS dark FROM ms WINDOW c AS (PARTITION BY page_id, rw, cl)),
f AS (SELECT *, bg - dark AS con, grey < bg - 0.5::double * (bg - dark) AS ink, grey < bg - 0.1::double * (bg - dark) AS edge, grey > bg - 12 AS paper FROM q),
f2 AS (SELECT *, edge AND grey > dark + 0.25::double * con AND grey < bg - 0.25::double * con AS mid FROM f)
SELECT page_id, rw, cl, round(count(*) FILTER (ink) / count(*), 6) AS ink_frac, round(any_value(bg), 6) AS bg, round(any_value(con), 6) AS contrast,
  round(list_avg(list_sort(list(grad), 'DESC')[1:57]) / (any_value(con) + 1), 6) AS sharp, round(count(*) FILTER (mid) / greatest(count(*) FILTER (edge), 1), 6) AS soft,
  round(""" + _MEAN.format(m="edge", v="hp") + ", 6) AS hp, round(" + _MEAN.format(m="edge", v="e90") + """, 6) AS ela90_ink, round(max(CASE WHEN edge THEN e90 ELSE 0 END), 6) AS ela90_max,
  round(any_value(dark), 6) AS dark, round(sqrt(greatest(""" + _MEAN.format(m="paper", v="grey * grey") + " - power(" + _MEAN.format(m="paper", v="grey") + """, 2), 0)), 5) AS noise,
  round(""" + _MEAN.format(m="edge", v="chroma") + ", 6) AS chroma, round(" + _MEAN.format(m="edge", v="e75") + ", 6) AS ela75_ink, round(" + _MEAN.format(m="paper", v="e90") + """, 6) AS ela90_bg
FROM f2 GROUP BY page_id, rw, cl HAVING count(*) = 576""")
def cell_measures(spark, d):
    m = C.cell_measures(C.pixel_measures(pixels(spark, d), least_cells=1))
    return m.select("page_id", "rw", "cl", *[F.round(c, 5 if c == "noise" else 6).alias(c) for c in K.CELL_MEASURES])


@query("g3_inked_cells", sql("SELECT page_id, cast(rw AS bigint) AS rw, cast(cl AS bigint) AS cl FROM d_cells WHERE ink_frac > 0.03 AND contrast > 50 QUALIFY count(*) OVER (PARTITION BY page_id) >= 12"))
def inked(spark, d):
    return C.inked_cells(cells(spark, d)).select("page_id", "rw", "cl")


@query("g4_robust_z", sql("""
WITH m AS (SELECT page_id, median(contrast) AS mc, median(noise) AS mn FROM d_cells GROUP BY 1),
j AS (SELECT c.*, mc, mn FROM d_cells c JOIN m USING (page_id)), a AS (SELECT page_id, median(abs(contrast - mc)) AS ac, median(abs(noise - mn)) AS an FROM j GROUP BY 1)
SELECT page_id, cast(rw AS bigint) AS rw, cast(cl AS bigint) AS cl, round(greatest(least((contrast - mc) / (ac * 1.4826::double + 1e-3::double + 0.02::double * abs(mc)), 30), -30), 6) AS rel_contrast,
       round(greatest(least((noise - mn) / (an * 1.4826::double + 1e-3::double + 0.02::double * abs(mn)), 30), -30), 6) AS rel_noise FROM j JOIN a USING (page_id)"""))
def robust_z(spark, d):
    r = C.page_relative(cells(spark, d), ["contrast", "noise"], {"ctx_noise": "noise"})
    return r.select("page_id", "rw", "cl", F.round("rel_contrast", 6).alias("rel_contrast"), F.round("rel_noise", 6).alias("rel_noise"))


_SMOOTH = "sm AS (SELECT c.*, 0.6::double * c.p + 0.4::double * greatest(coalesce(l.p, 0), coalesce(r.p, 0)) AS s FROM d_cells c LEFT JOIN d_cells l ON l.page_id = c.page_id AND l.rw = c.rw AND l.cl = c.cl - 1 LEFT JOIN d_cells r ON r.page_id = c.page_id AND r.rw = c.rw AND r.cl = c.cl + 1)"


@query("w8_smoothing", sql("WITH " + _SMOOTH + " SELECT page_id, cast(rw AS bigint) AS rw, cast(cl AS bigint) AS cl, round(s, 9) AS s FROM sm"))
def smoothing(spark, d):
    return C.smoothed_scores(cells(spark, d)).select("page_id", "rw", "cl", F.round("s", 9).alias("s"))


@query("g5_page_flags", sql(f"WITH {_SMOOTH} SELECT page_id, round(max(s), 9) AS score, max(s) >= {T_PAGE}::double AS flagged FROM sm GROUP BY page_id"))
def page_flags(spark, d):
    return C.page_scores(C.smoothed_scores(cells(spark, d)), T_PAGE).select("page_id", F.round("score", 9).alias("score"), "flagged")


# Cells above 0.9 only, so that pages hold several regions.
def hot(spark, d):
    return C.smoothed_scores(cells(spark, d)).where(F.col("p") >= 0.9)


_REGION = f"""
WITH RECURSIVE {{views}}, {_SMOOTH}, hot AS (SELECT *, rw * 100000 + cl AS node FROM sm WHERE p >= 0.9),
link AS (SELECT a.page_id, a.node AS a, b.node AS b FROM hot a JOIN hot b ON a.page_id = b.page_id AND ((a.rw = b.rw AND abs(a.cl - b.cl) <= 3) OR (abs(a.rw - b.rw) = 1 AND abs(a.cl - b.cl) <= 2))),
reach(page_id, node, root) AS (SELECT page_id, node, node FROM hot UNION SELECT r.page_id, l.b, r.root FROM reach r JOIN link l ON l.page_id = r.page_id AND l.a = r.node WHERE r.root <= l.b),
reg AS (SELECT page_id, node, min(root) AS region FROM reach GROUP BY 1, 2),
"""
_REGION = _REGION.replace("{views}", "d_cells AS (" + X.ORACLE_VIEWS["d_cells"] + ")")


@query("g6_regions", _REGION.rstrip().rstrip(",") + " SELECT page_id, count(DISTINCT region) AS regions, max(n) AS largest FROM (SELECT page_id, region, count(*) AS n FROM reg GROUP BY 1, 2) GROUP BY page_id")
def regions(spark, d):
    r = C.region_labels(hot(spark, d)).groupBy("page_id", "region").agg(F.count("*").alias("n"))
    return r.groupBy("page_id").agg(F.count("*").alias("regions"), F.max("n").alias("largest"))


@query("g7_region_boxes", _REGION + f"""bx AS (SELECT h.page_id, g.region, max(s) AS score, min(cl) * 24.0::double AS x0, min(rw) * 24.0::double AS y0, (max(cl) + 1) * 24.0::double AS x1, (max(rw) + 1) * 24.0::double AS y1
  FROM hot h JOIN reg g ON g.page_id = h.page_id AND g.node = h.node GROUP BY 1, 2)
SELECT page_id, round(score, 9) AS score, x0, y0, x1, y1 FROM bx QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, region) <= 6 AND score >= {T_PAGE}::double""")
def boxes(spark, d):
    b = C.region_boxes(C.region_labels(hot(spark, d)), T_PAGE)
    return b.select("page_id", F.round("score", 9).alias("score"), "x0", "y0", "x1", "y1")


# --- evaluation ------------------------------------------------------------

def scored(spark, d):
    for t in ("labels", "documents"):
        X.table(spark, d, t).createOrReplaceTempView(t)
    return spark.sql(X.D_SCORED).withColumnRenamed("y", "label")


def ev(body: str) -> str:
    return X.with_views(body, "d_scored")


@query("m7_auc", ev("""
WITH r AS (SELECT kind, y, rank() OVER (PARTITION BY kind ORDER BY score) + (count(*) OVER (PARTITION BY kind, score) - 1) / 2.0 AS rk FROM d_scored)
SELECT kind, round((sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0), 9) AS auc FROM r GROUP BY kind"""))
def auc(spark, d):
    return L.auc(scored(spark, d), "score", "label", ("kind",)).select("kind", F.round("auc", 9).alias("auc"))


@query("m8_rates", ev("""SELECT round_even(avg(((score > 0.5)::int = y)::int), 4) AS accuracy, round_even(avg((verdict = 'pass')::int) FILTER (y = 0), 4) AS genuine_passed, round_even(avg((verdict = 'fail')::int) FILTER (y = 0), 4) AS genuine_failed,
 round_even(avg((verdict <> 'pass')::int) FILTER (y = 1), 4) AS tampered_caught, round_even(avg((verdict = 'pass')::int) FILTER (y = 1), 4) AS tampered_passed, count(*) AS n FROM d_scored"""))
def rates(spark, d):
    return L.headline_rates(scored(spark, d))


@query("a16_confusion", ev("SELECT kind, cast(y AS bigint) AS label, count(*) FILTER (verdict='pass') AS n_pass, count(*) FILTER (verdict='review') AS n_review, count(*) FILTER (verdict='fail') AS n_fail FROM d_scored GROUP BY kind, y"))
def confusion(spark, d):
    return L.confusion_by_kind(scored(spark, d))


@query("a17_flag_rates", ev("SELECT kind, count(*) AS n, count(*) FILTER (score >= 0.7) AS flagged, round_even(count(*) FILTER (score >= 0.7) / count(*), 4) AS rate FROM d_scored GROUP BY kind"))
def rates_by_kind(spark, d):
    return L.flag_rates(scored(spark, d).withColumn("flagged", F.col("score") >= 0.7))


@query("m9_thresholds", ev("SELECT greatest(0.5, quantile_cont(score, 0.98)) AS t_page, least(0.5::double, greatest(0.5, quantile_cont(score, 0.98)) * 0.6::double) AS t_cell FROM d_scored WHERE y = 0"))
def thresholds(spark, d):
    return L.thresholds(scored(spark, d).where("label = 0"))


@query("m6_holdout", ev("""SELECT doc_id, row_number() OVER (PARTITION BY y ORDER BY sha256(cast(doc_id AS varchar))) <= ceil(count(*) OVER (PARTITION BY y) * 0.25) AS holdout FROM d_scored"""))
def holdout(spark, d):
    return L.stratified_holdout(scored(spark, d), "doc_id", "label").select("doc_id", "holdout")


@query("w10_ordered_split", "SELECT event_id, CASE WHEN row_number() OVER (ORDER BY event_id) - 1 < floor(count(*) OVER () * 0.7::double) THEN 'fit' WHEN row_number() OVER (ORDER BY event_id) - 1 < floor(count(*) OVER () * 0.8::double) THEN 'calibrate' ELSE 'test' END AS part FROM events")
def split(spark, d):
    return L.ordered_split(X.table(spark, d, "events").select("event_id"), "event_id")


# Edit boxes on the cell pages, from the part table's numbers.
EDITS = "SELECT s_suppkey AS page_id, cast(s_nationkey * 30 AS double) AS x0, cast(s_nationkey * 20 AS double) AS y0, cast(s_nationkey * 30 + 100 AS double) AS x1, cast(s_nationkey * 20 + 40 AS double) AS y1 FROM supplier"
_FR = f"fr AS (SELECT c.page_id, c.rw, c.cl, max(greatest(0, least(cl * 24.0 + 24, x1) - greatest(cl * 24.0, x0)) * greatest(0, least(rw * 24.0 + 24, y1) - greatest(rw * 24.0, y0)) / 576) AS f FROM d_cells c LEFT JOIN ({EDITS}) e USING (page_id) GROUP BY 1, 2, 3), lb AS (SELECT *, CASE WHEN f >= 0.2 THEN 1 WHEN f > 0 THEN -1 ELSE 0 END AS label FROM fr)"


def edits(spark, d):
    X.table(spark, d, "supplier").createOrReplaceTempView("supplier")
    return spark.sql(EDITS)


# Every third page was shrunk before it was cut into cells, so its cells are larger in the boxes' pixels.
_SCALED = f"""sf AS (SELECT c.page_id, c.rw, c.cl, max(greatest(0, least((cl + 1) * side, x1) - greatest(cl * side, x0)) * greatest(0, least((rw + 1) * side, y1) - greatest(rw * side, y0)) / (side * side)) AS f
 FROM (SELECT *, CASE WHEN page_id % 3 = 0 THEN 48.0::double ELSE 24.0::double END AS side FROM d_cells) c LEFT JOIN ({EDITS}) e USING (page_id) GROUP BY 1, 2, 3)"""


@query("j9_cell_labels", sql("WITH " + _SCALED + " SELECT page_id, rw::bigint AS rw, cl::bigint AS cl, CASE WHEN f >= 0.2 THEN 1 WHEN f > 0 THEN -1 ELSE 0 END::bigint AS label FROM sf"))
def cell_labels(spark, d):
    c = cells(spark, d)
    scales = c.where("page_id % 3 = 0").select("page_id", F.lit(0.5).alias("scale")).distinct()
    return L.cell_labels(c, edits(spark, d), scales).select("page_id", "rw", "cl", "label")


@query("j8_regions_on_edits", sql(f"SELECT page_id, (rw * 1000 + cl)::bigint AS region FROM (SELECT DISTINCT c.page_id, rw, cl FROM d_cells c JOIN ({EDITS}) e ON c.page_id = e.page_id AND NOT (cl * 24 + 24 < x0 OR cl * 24 > x1 OR rw * 24 + 24 < y0 OR rw * 24 > y1))"))
def on_edits(spark, d):
    r = cells(spark, d).select("page_id", (F.col("rw") * 1000 + F.col("cl")).alias("region"), (F.col("cl") * 24.0).alias("x0"), (F.col("rw") * 24.0).alias("y0"),
                               (F.col("cl") * 24.0 + 24).alias("x1"), (F.col("rw") * 24.0 + 24).alias("y1"))
    return L.regions_on_edits(r, edits(spark, d)).select("page_id", "region")


@query("w9_negative_sampling", sql("WITH " + _FR + " SELECT page_id, label::bigint AS label, least(count(*), CASE WHEN label = 1 THEN count(*) ELSE 60 END) AS n FROM lb WHERE label >= 0 GROUP BY page_id, label"))
def negatives(spark, d):
    return L.sample_negatives(L.cell_labels(cells(spark, d), edits(spark, d))).groupBy("page_id", "label").agg(F.count("*").alias("n"))


@query("m10_localisation", sql("WITH " + _SMOOTH + ", " + _FR + " , tp AS (SELECT sm.page_id, label FROM sm JOIN lb ON sm.page_id = lb.page_id AND sm.rw = lb.rw AND sm.cl = lb.cl QUALIFY row_number() OVER (PARTITION BY sm.page_id ORDER BY round(s, 12) DESC, sm.rw, sm.cl) = 1) SELECT count(*) AS pages, round_even(avg((label <> 0)::int), 4) AS on_edit FROM tp"))
def localisation(spark, d):
    c = L.cell_labels(C.smoothed_scores(cells(spark, d)).withColumn("s", F.round("s", 12)), edits(spark, d))
    return L.top_cell_on_edit(c)


@query("m11_public_summary", ev("""
WITH r AS (SELECT kind, y, score, rank() OVER (PARTITION BY kind ORDER BY score) + (count(*) OVER (PARTITION BY kind, score) - 1) / 2.0 AS rk FROM d_scored)
SELECT kind AS "set", count(*) FILTER (y = 0) AS genuine, count(*) FILTER (y = 1) AS forged, count(*) FILTER (y = 0 AND score >= 0.7) AS genuine_flagged, count(*) FILTER (y = 1 AND score >= 0.7) AS forged_flagged,
 count(*) FILTER (y = 1 AND score >= 0.8) AS forged_flagged_on_the_edit,
 round_even((sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0), 3) AS page_auc FROM r GROUP BY kind"""))
def public_summary(spark, d):
    p = scored(spark, d).select(F.col("kind").alias("set"), "label", "score", (F.col("score") >= 0.7).alias("flagged"), (F.col("score") >= 0.8).alias("hit"))
    return L.public_summary(p)


# --- models: the fit has no SQL equivalent, its properties have ------------

def features(spark, d):
    docs = X.stubs(spark, d).select("doc_id", "ocr_used", F.lit(1).alias("n_eof"), F.lit("pdf").alias("kind"), "decision")
    f = D.feature_rows(docs, SB.findings(spark, d))
    # whether a fault was printed into the stub is known from how it was made, not from what the rules found
    made = X.view(spark, d, "d_wide").select("doc_id", F.expr("k % 61 = 0 OR k % 83 = 0 OR k % 97 = 0 OR k % 101 = 0 OR k % 103 = 0").alias("faulty"))
    return f.join(docs.select("doc_id", "decision"), "doc_id").join(made, "doc_id")


def trained(spark, d):
    """A fitted model and the feature rows, which are a stage table: a fit and its scores read them many times."""
    path = f"{ensure_checkpoint_dir(spark)}/features-{uuid.uuid4().hex}"
    features(spark, d).write.parquet(path)
    f = spark.read.parquet(path)
    base = f.withColumn("label", F.col("faulty").cast("int")).drop("decision", "faulty")
    labelled = f.where(F.col("decision").isNotNull()).withColumn("label", (F.col("decision") == "fraudulent").cast("int")).drop("decision", "faulty")
    return L.fit_score_model(L.training_rows(base, labelled)), f


@query("u2_training_union", SB.sql("SELECT weight, count(*) AS n FROM (SELECT 1.0::double AS weight FROM d_wide UNION ALL SELECT 8.0::double FROM d_wide WHERE decision IS NOT NULL) GROUP BY weight"))
def training_union(spark, d):
    f = X.stubs(spark, d).select("doc_id", "decision")
    return L.training_rows(f, f.where(F.col("decision").isNotNull())).groupBy("weight").agg(F.count("*").alias("n"))


@query("m1_m4_fit_and_score", SB.sql("SELECT doc_id, true AS is_probability FROM d_wide"))
def fit_and_score(spark, d):
    model, f = trained(spark, d)
    return L.score_rows(model, f).select("doc_id", F.col("probability").between(0, 1).alias("is_probability"))


@query("m5_drivers", SB.sql("SELECT true AS ranks_without_gaps, true AS only_features_present, true AS at_most_five"))
def drivers(spark, d):
    model, f = trained(spark, d)
    top = L.drivers(model, f)
    value = F.element_at(F.map_from_arrays(F.array(*[F.lit(n) for n in L.FEATURES]), F.array(*[F.col(n) for n in L.FEATURES])), F.col("feature"))
    per = top.join(f, "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"), F.max("rank").alias("last"), F.count_distinct("rank").alias("ranks"), F.bool_and(value != 0).alias("present"))
    all_of = lambda c: F.coalesce(F.bool_and(c), F.lit(True))
    return per.agg(all_of((F.col("n") == F.col("last")) & (F.col("n") == F.col("ranks"))).alias("ranks_without_gaps"),
                   all_of(F.col("present")).alias("only_features_present"), all_of(F.col("n") <= 5).alias("at_most_five"))


@query("m2_retrained_scores", SB.sql("SELECT true AS better_than_chance, (SELECT count(*) FROM d_wide) AS base_rows, (SELECT count(*) FROM d_wide WHERE decision IS NOT NULL) AS labelled_rows"))
def retrained(spark, d):
    """The score model fitted to base and reviewed rows ranks faulty stubs above the others."""
    model, f = trained(spark, d)
    scored_rows = L.score_rows(model, f).select(F.col("faulty").cast("int").alias("label"), F.round("probability", 9).alias("score"), "decision")
    rows = scored_rows.agg(F.count("*").alias("base_rows"), F.count("decision").alias("labelled_rows"))
    return L.auc(scored_rows).select((F.col("auc") > 0.7).alias("better_than_chance")).join(F.broadcast(rows))  # one row each


@query("m2_model_versions", SB.sql("SELECT 1::bigint AS version, (SELECT count(*) FROM d_wide) AS base_rows, 0::bigint AS labelled_rows, 42::bigint AS n_features, false AS newest, true AS readable UNION ALL SELECT 2, (SELECT count(*) FROM d_wide), (SELECT count(*) FROM d_wide WHERE decision IS NOT NULL), 42, true, true"))
def model_versions(spark, d):
    """Two runs of the retraining job, without and with reviewed rows, and what the store then says. Small models: the store is what is tested."""
    store = f"{ensure_checkpoint_dir(spark)}/models-{uuid.uuid4().hex}"
    f = staged(features(spark, d), "features")
    base = f.withColumn("label", F.col("faulty").cast("int")).drop("decision", "faulty")
    labelled = f.where(F.col("decision").isNotNull()).withColumn("label", (F.col("decision") == "fraudulent").cast("int")).drop("decision", "faulty")
    retrain(spark, store, base, labelled.limit(0), trees=8)
    retrain(spark, store, base, labelled, trees=8)
    model = sinks.load_newest_model(spark, store)
    known = sinks.model_versions(spark, store)
    newest = known.agg(F.max("version").alias("top"))
    readable = L.score_rows(model, base).where(~F.coalesce(F.col("probability").between(0, 1), F.lit(True))).isEmpty()
    return known.join(F.broadcast(newest)).select("version", "base_rows", "labelled_rows", F.size("features").cast("bigint").alias("n_features"), (F.col("version") == F.col("top")).alias("newest"), F.lit(readable).alias("readable"))


# Pages that the detector has scored (every second one) have its regions where it flagged them; the others fall back on the blocks.
_AREAS = """
det AS (SELECT s_suppkey AS page_id, 0.25::double + (s_suppkey % 3) / 8::double AS score, (s_suppkey % 50)::double AS x0, 10.0::double AS y0, (s_suppkey % 50) + 24.0::double AS x1, 58.0::double AS y1 FROM supplier WHERE s_suppkey % 4 = 0
        UNION ALL SELECT s_suppkey, 0.125::double, 100.0, 200.0, 148.0, 224.0 FROM supplier WHERE s_suppkey % 8 = 0)"""


@query("r15_pixel_areas", """
WITH b AS (SELECT l_suppkey AS page_id, l_partkey % 60 AS bx, l_orderkey % 60 AS "by", max(l_quantity + CASE WHEN l_partkey % 60 = 7 AND l_suppkey % 3 = 0 THEN 400 ELSE 0 END) AS score, max(l_tax) AS es FROM lineitem GROUP BY 1, 2, 3),
ok AS (SELECT * FROM b WHERE es > 0.04 AND page_id IN (SELECT page_id FROM b GROUP BY 1 HAVING max(bx) >= 5 AND max("by") >= 5)), md AS (SELECT page_id, median(score) AS med, count(*) AS n_ok FROM ok GROUP BY 1 HAVING count(*) >= 20),
dv AS (SELECT ok.*, med, n_ok FROM ok JOIN md USING (page_id)), mad AS (SELECT page_id, median(abs(score - med)) * 1.4826::double + 0.5::double AS mad FROM dv GROUP BY 1),
z AS (SELECT *, (score - med) / mad AS zz FROM dv JOIN mad USING (page_id) WHERE (score - med) / mad > 7),
hot AS (SELECT page_id, 0.0::double AS score, min(bx) * 24 AS x0, min("by") * 24 AS y0, (max(bx) + 1) * 24 AS x1, (max("by") + 1) * 24 AS y1 FROM z WHERE page_id % 2 = 1 GROUP BY page_id, n_ok HAVING count(*) >= 2 AND count(*) <= 0.12 * n_ok),
""" + _AREAS.strip() + """, areas AS (SELECT * FROM det UNION ALL SELECT * FROM hot), f AS (SELECT page_id, count(*) AS n, max(score) AS score FROM areas GROUP BY 1)
SELECT page_id AS doc_id, n, score, round_even(x0 * 0.5, 1) AS x0, round_even(y0 * 0.25, 1) AS y0, round_even(x1 * 0.5, 1) AS x1, round_even(y1 * 0.25, 1) AS y1 FROM f JOIN areas USING (page_id) """.replace("areas USING (page_id) ", "(SELECT page_id, x0, y0, x1, y1 FROM areas) q USING (page_id)"))
def pixel_areas(spark, d):
    """F_PIXEL with its boxes, from the detector where it scored a page and from the blocks elsewhere."""
    from tallywright.operators import evidence as EV
    from tallywright.operators import file_rules as FR
    from tallywright.plans.files import blocks

    sup = X.table(spark, d, "supplier").select(F.col("s_suppkey").alias("page_id"))
    box = lambda *c: [F.lit(float(v)).alias(n) if not hasattr(v, "cast") else v.cast("double").alias(n) for n, v in zip(("score", "x0", "y0", "x1", "y1"), c, strict=True)]
    k = F.col("page_id") % 50
    det = sup.where("page_id % 4 = 0").select("page_id", *box(0.25 + (F.col("page_id") % 3) / 8, k, 10, k + 24, 58)).unionByName(sup.where("page_id % 8 = 0").select("page_id", *box(0.125, 100, 200, 148, 224)))
    pages = sup.select("page_id", F.col("page_id").alias("doc_id"), F.lit(1).alias("page"), F.lit(500.0).alias("width"), F.lit(250.0).alias("height"), F.lit(1000).alias("width_px"), F.lit(1000).alias("height_px"))
    areas = FR.image_areas(det, sup.where("page_id % 2 = 0"), FR.robust_hot_spots(blocks(spark, d)), pages)
    found = FR.pixel_findings(areas, pages)
    e = EV.evidence(found, EV.region_boxes(areas, pages)).select("doc_id", *[F.element_at("bbox", i + 1).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])
    return found.select("doc_id", F.col("n").cast("bigint").alias("n"), F.element_at("detail", 1).cast("double").alias("score")).join(e, "doc_id")
