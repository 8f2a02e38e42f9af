"""Image cells: pixel measures, page-relative scores, smoothing, regions.

A page side has at most 2600 pixels (109 cells), so a page holds at most about 12 000 cells and a page row 109.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywright import constants as K
from tallywright.operators.ordered import top_k
from tallywright.session import ensure_checkpoint_dir

C = K.CELL


def pixel_measures(pixels: DataFrame, least_cells: int = K.MIN_CELLS) -> DataFrame:
    """Gradient and 3x3 high-pass per pixel, with its cell.

    ``pixels``: page_id, x, y, r, g, b, e90, e75. Each pixel is sent to its own cell and, on a border, to the
    cells next to it; after that one shuffle by cell everything is local. Image borders repeat the edge pixel.
    Pages under ``least_cells`` full cells a side are left out.
    """
    if least_cells > 1:
        size = pixels.groupBy("page_id").agg(F.max("x").alias("_x"), F.max("y").alias("_y"))
        large = size.where((F.floor((F.col("_x") + 1) / C) >= least_cells) & (F.floor((F.col("_y") + 1) / C) >= least_cells))
        pixels = pixels.join(large.select("page_id"), "page_id", "left_semi")
    grey = (F.col("r") + F.col("g") + F.col("b")) / 3.0
    near = lambda v: F.array_distinct(F.array(F.floor((F.col(v) - 1) / C), F.floor(F.col(v) / C), F.floor((F.col(v) + 1) / C)))
    p = pixels.select("page_id", "x", "y", grey.alias("grey"), (F.abs(F.col("r") - F.col("g")) + F.abs(F.col("g") - F.col("b"))).alias("chroma"), "e90", "e75")
    p = p.withColumn("cx", F.explode(near("x"))).withColumn("cy", F.explode(near("y"))).where((F.col("cx") >= 0) & (F.col("cy") >= 0))
    p = p.repartition("page_id", "cx", "cy")
    along_x = Window.partitionBy("page_id", "cx", "cy", "y").orderBy("x")
    along_y = Window.partitionBy("page_id", "cx", "cy", "x").orderBy("y")
    side = lambda f, c, w: F.coalesce(f(c).over(w), F.col(c))
    p = p.withColumn("left", side(F.lag, "grey", along_x)).withColumn("_row", (F.col("left") + F.col("grey") + side(F.lead, "grey", along_x)) / 3)
    p = p.withColumn("_mean", (side(F.lag, "_row", along_y) + F.col("_row") + side(F.lead, "_row", along_y)) / 3)
    p = p.withColumn("grad", F.abs(F.col("grey") - F.col("left")) + F.abs(F.col("grey") - side(F.lag, "grey", along_y)))
    own = (F.floor(F.col("x") / C) == F.col("cx")) & (F.floor(F.col("y") / C) == F.col("cy"))
    return p.where(own).withColumn("hp", F.abs(F.col("grey") - F.col("_mean"))).drop("left", "_row", "_mean")


def cell_measures(measured: DataFrame) -> DataFrame:
    """The 13 raw measures of every full 24 x 24 cell."""
    cell = ["page_id", "cx", "cy"]
    w = Window.partitionBy(*cell)
    d = measured.withColumn("bg", F.percentile("grey", 0.9).over(w)).withColumn("dark", F.percentile("grey", 0.05).over(w))
    d = d.withColumn("con", F.col("bg") - F.col("dark"))
    g, bg, con = F.col("grey"), F.col("bg"), F.col("con")
    ink, edge, paper = g < bg - 0.5 * con, g < bg - 0.1 * con, g > bg - 12
    mid = edge & (g > F.col("dark") + 0.25 * con) & (g < bg - 0.25 * con)
    d = d.withColumn("ink", ink).withColumn("edge", edge).withColumn("mid", mid).withColumn("paper", paper)
    n = lambda m: F.greatest(F.count_if(m), F.lit(1))
    mean = lambda c, m: F.sum(F.when(F.col(m), c).otherwise(0.0)) / n(m)
    top = F.slice(F.sort_array(F.collect_list("grad"), asc=False), 1, C * C // 10)  # a cell has 576 pixels
    out = d.groupBy(*cell).agg(
        F.count("*").alias("n_px"), (F.count_if("ink") / F.count("*")).alias("ink_frac"), F.first("dark").alias("dark"), F.first("bg").alias("bg"),
        F.first("con").alias("contrast"), top.alias("_top"), (F.count_if("mid") / n("edge")).alias("soft"),
        F.sqrt(F.greatest(mean(g * g, "paper") - mean(g, "paper") * mean(g, "paper"), F.lit(0.0))).alias("noise"),
        mean(F.col("chroma"), "edge").alias("chroma"), mean(F.col("hp"), "edge").alias("hp"), mean(F.col("e90"), "edge").alias("ela90_ink"),
        F.max(F.when(F.col("edge"), F.col("e90")).otherwise(0.0)).alias("ela90_max"), mean(F.col("e75"), "edge").alias("ela75_ink"),
        mean(F.col("e90"), "paper").alias("ela90_bg"))
    sharp = F.aggregate("_top", F.lit(0.0), lambda a, x: a + x) / F.size("_top") / (F.col("contrast") + 1)
    return out.where(F.col("n_px") == C * C).withColumn("sharp", sharp).select(
        "page_id", F.col("cy").alias("rw"), F.col("cx").alias("cl"), *K.CELL_MEASURES)


def inked_cells(cells: DataFrame) -> DataFrame:
    """Cells with ink and contrast, on pages that have at least twelve of them."""
    d = cells.where((F.col("ink_frac") > 0.03) & (F.col("contrast") > 50))
    n = d.groupBy("page_id").agg(F.count("*").alias("n_cells")).where(F.col("n_cells") >= 12)
    return d.join(n, "page_id")


def page_relative(cells: DataFrame, measures: list[str], context: dict[str, str] | None = None) -> DataFrame:
    """Robust z-scores against the cell's own page, clipped to 30, and the page's context columns."""
    med = cells.groupBy("page_id").agg(*[F.median(m).alias(f"_med_{m}") for m in measures], F.count("*").alias("_n"))
    d = cells.join(med, "page_id")
    mad = d.groupBy("page_id").agg(*[F.median(F.abs(F.col(m) - F.col(f"_med_{m}"))).alias(f"_mad_{m}") for m in measures])
    d = d.join(mad, "page_id")

    def rel(m):
        spread = F.col(f"_mad_{m}") * 1.4826 + 1e-3 + 0.02 * F.abs(F.col(f"_med_{m}"))
        return F.greatest(F.least((F.col(m) - F.col(f"_med_{m}")) / spread, F.lit(30.0)), F.lit(-30.0)).alias(f"rel_{m}")

    ctx = [F.col(f"_med_{src}").alias(name) for name, src in (context or {}).items()]
    return d.select(*cells.columns, *[rel(m) for m in measures], *ctx, F.log("_n").alias("ctx_cells"))


def smoothed_scores(cells: DataFrame) -> DataFrame:
    """0.6 p + 0.4 of the better side neighbour; a missing neighbour counts as 0."""
    w = Window.partitionBy("page_id", "rw").orderBy("cl")
    at = lambda k: F.coalesce(F.max("p").over(w.rangeBetween(k, k)), F.lit(0.0))
    return cells.withColumn("s", 0.6 * F.col("p") + 0.4 * F.greatest(at(-1), at(1)))


def page_scores(scored: DataFrame, t_page: float) -> DataFrame:
    d = scored.groupBy("page_id").agg(F.max("s").alias("score"))
    return d.withColumn("flagged", F.col("score") >= t_page)


def _runs(hot: DataFrame) -> DataFrame:
    """Cells of a row at most three columns apart share a run, named by its first cell."""
    w = Window.partitionBy("page_id", "rw").orderBy("cl")
    node = F.col("rw").cast("bigint") * 100000 + F.col("cl")
    gap = F.col("cl") - F.lag("cl").over(w)
    start = F.when(gap.isNull() | (gap > 3), node)
    return hot.withColumn("_start", start).withColumn("run", F.max("_start").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_start")


def region_labels(hot: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Add ``region``: cells connect in one row up to 3 columns apart and in adjacent rows up to 2 apart.

    Runs are the nodes; labels shrink to the smallest reachable run, with a jump through the label each round,
    so rounds grow with the logarithm of a region's height. Each round is checkpointed.
    """
    spark = hot.sparkSession
    ensure_checkpoint_dir(spark)
    cells = _runs(hot.select("page_id", "rw", "cl", *[c for c in hot.columns if c not in ("page_id", "rw", "cl")])).checkpoint()
    below = cells.select("page_id", (F.col("rw") + 1).alias("rw"), F.explode(F.sequence(F.col("cl") - 2, F.col("cl") + 2)).alias("cl"), F.col("run").alias("a"))
    half = below.join(cells.select("page_id", "rw", "cl", F.col("run").alias("b")), ["page_id", "rw", "cl"]).select("page_id", "a", "b").distinct()
    edges = half.unionByName(half.select("page_id", F.col("b").alias("a"), F.col("a").alias("b"))).checkpoint()
    labels = cells.select("page_id", F.col("run").alias("node")).distinct().withColumn("lab", F.col("node")).checkpoint()
    for _ in range(max_rounds):
        seen = edges.join(labels.select("page_id", F.col("node").alias("b"), "lab"), ["page_id", "b"]).groupBy("page_id", "a").agg(F.min("lab").alias("near"))
        step = labels.join(seen.withColumnRenamed("a", "node"), ["page_id", "node"], "left").select(
            "page_id", "node", F.least("lab", F.coalesce("near", "lab")).alias("lab"), F.col("lab").alias("old"))
        jump = step.select("page_id", F.col("node").alias("lab"), F.col("lab").alias("via"))
        step = step.join(jump, ["page_id", "lab"], "left").select(
            "page_id", "node", F.least("lab", F.coalesce("via", "lab")).alias("lab"), "old").checkpoint()
        labels = step.select("page_id", "node", "lab")
        if step.where(F.col("lab") != F.col("old")).limit(1).count() == 0:
            break
    else:
        raise RuntimeError("regions did not settle")
    return cells.join(labels.select("page_id", F.col("node").alias("run"), F.col("lab").alias("region")), ["page_id", "run"]).drop("run")


def region_boxes(labelled: DataFrame, t_page: float, k: int = 6) -> DataFrame:
    """The best regions of a page with their boxes in image pixels. Needs page_id, region, rw, cl, s and scale (optional)."""
    scale = F.col("scale") if "scale" in labelled.columns else F.lit(1.0)
    px = lambda c: c * C / scale
    d = labelled.groupBy("page_id", "region").agg(
        F.max("s").alias("score"), F.min(px(F.col("cl"))).alias("x0"), F.min(px(F.col("rw"))).alias("y0"),
        F.max(px(F.col("cl") + 1)).alias("x1"), F.max(px(F.col("rw") + 1)).alias("y1"))
    return top_k(d, ["page_id"], [F.desc("score"), F.col("region")], k).where(F.col("score") >= t_page)


def detect_regions(scored: DataFrame, t_page: float, t_cell: float) -> DataFrame:
    """Boxes on flagged pages. ``scored``: page_id, rw, cl, p, s."""
    flagged = page_scores(scored, t_page).where("flagged").select("page_id")
    hot = scored.where(F.col("p") >= t_cell).join(flagged, "page_id", "left_semi")
    return region_boxes(region_labels(hot), t_page)
