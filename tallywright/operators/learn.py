"""Training tables, the boosted-tree models and their evaluation."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright import constants as K
from tallywright.functions import geometry as G
from tallywright.operators.ordered import cumulative_counts, exact_quantile, top_k, with_rank

FEATURES = K.FEATURE_CODES + K.NUMERIC_FEATURES


def training_rows(base: DataFrame, labelled: DataFrame) -> DataFrame:
    """Base rows at weight 1 and analyst-labelled, consented rows at weight 8."""
    return base.withColumn("weight", F.lit(1.0)).unionByName(labelled.withColumn("weight", F.lit(K.LABEL_WEIGHT)))


TASK_ROWS = 250_000


def spread(rows: DataFrame) -> DataFrame:
    """Training rows over all cores, and at most about TASK_ROWS in a task: they are small in a file but wide in memory, and each tree reads them."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS)))


def fit_score_model(rows: DataFrame, features: list[str] | None = None, trees: int = 160, seed: int = 0) -> PipelineModel:
    """Boosted trees: 160 of depth 3, step 0.08, subsample 0.9, weighted."""
    names = features or FEATURES
    rows = spread(rows.dropna(subset=names))  # unreadable documents have no features
    gbt = GBTClassifier(labelCol="label", featuresCol="x", weightCol="weight", maxIter=trees, maxDepth=3, stepSize=0.08, subsamplingRate=0.9, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="x"), gbt]).fit(rows)


def fit_cell_model(rows: DataFrame, features: list[str], trees: int = 300, seed: int = 0) -> PipelineModel:
    """Cell classifier with classes weighted to balance; depth 5 gives at most 32 leaves."""
    n = rows.groupBy("label").agg(F.count("*").alias("_n"))
    per = n.agg(F.sum("_n").alias("_t"), F.map_from_entries(F.collect_list(F.struct("label", "_n"))).alias("_by"))  # two classes
    w = per.select(F.explode("_by").alias("label", "_n"), "_t").select("label", (F.col("_t") / (2 * F.col("_n"))).alias("weight"))
    d = rows.drop("weight").join(F.broadcast(w), "label")
    gbt = GBTClassifier(labelCol="label", featuresCol="x", weightCol="weight", maxIter=trees, maxDepth=5, stepSize=0.08, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="x"), gbt]).fit(spread(d))


def score_rows(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("probability", vector_to_array("probability")[1]).drop("x", "rawPrediction", "prediction")


def drivers(model: PipelineModel, rows: DataFrame, features: list[str] | None = None, k: int = 5) -> DataFrame:
    """For each document the features whose removal lowers the probability by over 0.01, strongest first."""
    names = features or FEATURES
    arr = F.array(*[F.col(n).cast("double") for n in names])
    base = score_rows(model, rows).select("doc_id", "probability", arr.alias("v"))
    alone = base.select("doc_id", "probability", "v", F.explode(F.filter(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda i: F.get("v", i) != 0)).alias("i"))
    zeroed = alone.withColumn("x", array_to_vector(F.transform("v", lambda c, i: F.when(i == F.col("i"), 0.0).otherwise(c))))
    rescored = model.stages[-1].transform(zeroed.withColumnRenamed("probability", "p0")).select(
        "doc_id", F.get(F.array(*[F.lit(n) for n in names]), F.col("i")).alias("feature"), (F.col("p0") - vector_to_array("probability")[1]).alias("effect"))
    return top_k(rescored.where(F.col("effect") > 0.01), ["doc_id"], [F.desc("effect"), F.col("feature")], k)


# --- splits ----------------------------------------------------------------

def stratified_holdout(rows: DataFrame, key: str, label: str, share: float = 0.25) -> DataFrame:
    """Mark an exact share of each class, taken by hash order.

    Only the one hash bucket (of 4096) where the share ends has to be ranked.
    """
    d = rows.withColumn("_h", F.sha2(F.col(key).cast("string"), 256))
    d = d.withColumn("_b", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    from pyspark.sql import Window
    n = d.groupBy(label, "_b").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(label).orderBy("_b")
    n = n.select(label, "_b", "_n", F.sum("_n").over(w).alias("_upto"), F.ceil(F.sum("_n").over(Window.partitionBy(label)) * F.lit(share)).alias("_want"))
    d = d.join(n.select(label, "_b", (F.col("_upto") <= F.col("_want")).alias("_all"), (F.col("_want") - F.col("_upto") + F.col("_n")).alias("_left")), [label, "_b"])
    edge = d.where(~F.col("_all") & (F.col("_left") > 0))
    inside = edge.withColumn("_r", F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h"))).where(F.col("_r") <= F.col("_left"))
    chosen = d.where("_all").select(key).unionByName(inside.select(key)).withColumn("holdout", F.lit(True))
    return rows.join(chosen, key, "left").withColumn("holdout", F.coalesce("holdout", F.lit(False)))


def ordered_split(pages: DataFrame, number: str) -> DataFrame:
    """First 70 % to fit, next 10 % to calibrate, the rest to test, by a unique page number."""
    n = pages.agg(F.count("*").alias("_n")).withColumn("_one", F.lit(1))
    d = with_rank(pages.withColumn("_one", F.lit(1)), ["_one"], number).join(F.broadcast(n), "_one")  # one row
    at = F.col("rank") - 1
    cut = lambda pct: F.floor(F.col("_n") * F.lit(pct))
    return d.withColumn("part", F.when(at < cut(0.7), "fit").when(at < cut(0.8), "calibrate").otherwise("test")).drop("_n", "_one", "rank")


def sample_negatives(cells: DataFrame, k: int = 60) -> DataFrame:
    """All edited cells and at most 60 untouched ones per page (the sampling operator), by hash; unclear ones left out."""
    h = F.sha2(F.concat_ws("/", "page_id", "rw", "cl"), 256)
    neg = top_k(cells.where(F.col("label") == 0).withColumn("_h", h), ["page_id"], [F.col("_h")], k, "_r").drop("_h", "_r")
    return cells.where(F.col("label") == 1).unionByName(neg)


# --- evaluation ------------------------------------------------------------

def auc(rows: DataFrame, score: str = "score", label: str = "label", keys: tuple[str, ...] = ()) -> DataFrame:
    """ROC AUC, ties counted half: for each score, positives at it times negatives under it."""
    c = cumulative_counts(rows, score, {"pos": F.count_if(F.col(label) == 1), "neg": F.count_if(F.col(label) == 0)}, keys)
    won = F.sum(F.col("pos").cast("double") * (F.col("neg_below") + F.col("neg") / 2))
    return c.groupBy(*keys).agg(won.alias("w"), F.sum("pos").alias("p"), F.sum("neg").alias("n")).select(
        *keys, F.try_divide(F.col("w"), F.col("p").cast("double") * F.col("n")).alias("auc"))


def headline_rates(rows: DataFrame) -> DataFrame:
    """Accuracy at 0.5 and what happened to genuine and tampered documents. Needs label, score, verdict."""
    y, v = F.col("label"), F.col("verdict")
    rate = lambda cond, of: F.bround(F.avg(F.when(of, cond.cast("double"))), 4)
    return rows.agg(
        F.bround(F.avg(((F.col("score") > 0.5).cast("int") == y).cast("double")), 4).alias("accuracy"),
        rate(v == "pass", y == 0).alias("genuine_passed"), rate(v == "fail", y == 0).alias("genuine_failed"),
        rate(v != "pass", y == 1).alias("tampered_caught"), rate(v == "pass", y == 1).alias("tampered_passed"), F.count("*").alias("n"))


def confusion_by_kind(rows: DataFrame) -> DataFrame:
    d = rows.groupBy("kind", "label").pivot("verdict", ["pass", "review", "fail"]).agg(F.count(F.lit(1)))
    count = lambda c: F.coalesce(c, F.lit(0))
    return d.select("kind", "label", *[count(c).alias(f"n_{c}") for c in ("pass", "review", "fail")])


def flag_rates(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("flagged").alias("flagged")).withColumn(
        "rate", F.bround(F.col("flagged") / F.greatest(F.col("n"), F.lit(1)), 4))


def thresholds(page_maxima: DataFrame, score: str = "score") -> DataFrame:
    """Page threshold: the larger of 0.5 and the 98th percentile over genuine pages; cells at most 0.6 of it."""
    t = F.greatest(F.lit(0.5), F.col("quantile"))
    return exact_quantile(page_maxima, score, 0.98).select(t.alias("t_page"), F.least(F.lit(0.5), t * 0.6).alias("t_cell"))


def cell_labels(cells: DataFrame, boxes: DataFrame, scales: DataFrame | None = None) -> DataFrame:
    """1 where an edit covers at least 0.2 of the cell, -1 where it touches less, else 0.

    Boxes go to the cells they reach, within the page's own cells, so cells and boxes meet by equality only.
    ``scales``: page_id, scale of pages that were resized before they were cut into cells; their cells are larger
    in the boxes' pixels.
    """
    page = cells.groupBy("page_id").agg(F.max("cl").alias("_mc"), F.max("rw").alias("_mr"))
    b = boxes.select("page_id", "x0", "y0", "x1", "y1").distinct().join(page, "page_id")
    b = b.withColumn("scale", F.lit(1.0)) if scales is None else b.join(scales.select("page_id", "scale"), "page_id", "left").withColumn("scale", F.coalesce("scale", F.lit(1.0)))
    b = b.withColumn("side", F.lit(float(K.CELL)) / F.col("scale"))
    c = F.col("side")
    first = lambda lo: F.greatest(F.floor(F.col(lo) / c), F.lit(0))
    end = lambda hi, most: F.least(F.floor(F.col(hi) / c), F.col(most).cast("bigint"))
    b = b.where((first("x0") <= end("x1", "_mc")) & (first("y0") <= end("y1", "_mr"))).withColumn(
        "cl", F.explode(F.sequence(first("x0"), end("x1", "_mc")))).withColumn("rw", F.explode(F.sequence(first("y0"), end("y1", "_mr"))))
    cell = (F.col("cl") * c, F.col("rw") * c, F.col("cl") * c + c, F.col("rw") * c + c)
    w, h = F.greatest(G.overlap_width(cell, G.box()), F.lit(0.0)), F.greatest(G.overlap_height(cell, G.box()), F.lit(0.0))
    best = b.select("page_id", F.col("rw").cast("int").alias("rw"), F.col("cl").cast("int").alias("cl"), (w * h / (c * c)).alias("f")).groupBy("page_id", "rw", "cl").agg(F.max("f").alias("f"))
    return cells.join(best, ["page_id", "rw", "cl"], "left").withColumn(
        "label", F.when(F.col("f") >= 0.2, 1).when(F.col("f") > 0, -1).otherwise(0)).drop("f")


def regions_on_edits(regions: DataFrame, boxes: DataFrame, grid: float = 96.0) -> DataFrame:
    """Regions that touch a truth box, edges included; met through shared grid squares."""
    r = regions.select("page_id", "region", *[F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")])
    # neither side is laid out beyond what the page's regions reach
    reach = r.groupBy("page_id").agg(F.min("r_x0").alias("_ax"), F.min("r_y0").alias("_ay"), F.max("r_x1").alias("_bx"), F.max("r_y1").alias("_by"))
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / grid), F.floor(hi / grid)))
    r = r.withColumn("gx", cells(F.col("r_x0"), F.col("r_x1"))).withColumn("gy", cells(F.col("r_y0"), F.col("r_y1")))
    b = boxes.select("page_id", "x0", "y0", "x1", "y1").distinct().join(reach, "page_id")
    left, up, right, down = F.greatest("x0", "_ax"), F.greatest("y0", "_ay"), F.least("x1", "_bx"), F.least("y1", "_by")
    b = b.where((left <= right) & (up <= down)).withColumn("gx", cells(left, right)).withColumn("gy", cells(up, down)).drop("_ax", "_ay", "_bx", "_by")
    cond = [r[c] == b[c] for c in ("page_id", "gx", "gy")] + [G.touches((r["r_x0"], r["r_y0"], r["r_x1"], r["r_y1"]), (b["x0"], b["y0"], b["x1"], b["y1"]))]
    return r.join(b, cond, "left_semi").select("page_id", "region").distinct()


def top_cell_on_edit(scored: DataFrame) -> DataFrame:
    """Share of pages whose best cell is not untouched. Needs page_id, rw, cl, s, label; pages already flagged and edited."""
    top = scored.groupBy("page_id").agg(F.max_by("label", F.struct("s", -F.col("rw"), -F.col("cl"))).alias("label"))
    return top.agg(F.count("*").alias("pages"), F.bround(F.avg((F.col("label") != 0).cast("double")), 4).alias("on_edit"))


def public_summary(pages: DataFrame) -> DataFrame:
    """Per set: genuine, forged, flagged, flagged on the edit and AUC. Needs set, label, flagged, hit, score."""
    forged = F.col("label") == 1
    g = pages.groupBy("set").agg(
        F.count_if(~forged).alias("genuine"), F.count_if(forged).alias("forged"), F.count_if(~forged & F.col("flagged")).alias("genuine_flagged"),
        F.count_if(forged & F.col("flagged")).alias("forged_flagged"), F.count_if(forged & F.col("hit")).alias("forged_flagged_on_the_edit"))
    return g.join(auc(pages, "score", "label", ("set",)).select("set", F.bround("auc", 3).alias("page_auc")), "set", "left")
