"""Queries over files, boxes and typefaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywright import constants as K
from tallywright.functions import geometry as G
from tallywright.functions import text as T
from tallywright.operators import decide as D
from tallywright.operators import file_rules as R
from tallywright.operators import rows as RW
from tallywright.operators import bank_rules as B
from tallywright.operators import evidence as EV
from tallywright.operators import fields as E
from tallywright.plans import fixtures as X
from tallywright.plans import statements as BK
from tallywright.plans import stubs as SB
from tallywright.plans.registry import query
from tallywright.session import staged


def files(spark, d):
    return X.view(spark, d, "d_files")


def spans(spark, d):
    return X.view(spark, d, "d_spans")


def any_of(words):
    return "(" + " OR ".join("contains(low, '%s')" % w.replace("'", "''") for w in words) + ")"


META = f"""
m0 AS (SELECT *, trim(coalesce(producer, '') || ' ' || coalesce(creator, '')) AS prod,
   try_strptime(substr(created, 3), '%Y%m%d%H%M%S') AS c, try_strptime(substr(modified, 3), '%Y%m%d%H%M%S') AS m FROM d_files),
m1 AS (SELECT *, lower(prod) AS low, n_eof - linearized::int AS saves FROM m0),
m2 AS (SELECT *, {any_of(K.IMAGE_EDITORS)} AS img, {any_of(K.PDF_EDITORS)} AS ed, {any_of(K.OFFICE_SUITES)} AS off FROM m1),
meta AS (
  SELECT doc_id, 'F_EDITOR' AS code, 'high' AS severity, CASE WHEN img THEN 'image' ELSE 'pdf' END AS variant FROM m2 WHERE kind = 'pdf' AND (img OR ed)
  UNION ALL SELECT doc_id, 'F_OFFICE', 'high', '' FROM m2 WHERE kind = 'pdf' AND NOT img AND NOT ed AND off
  UNION ALL SELECT doc_id, 'F_MODIFIED', 'medium', '' FROM m2 WHERE kind = 'pdf' AND date_diff('second', c, m) > 120
  UNION ALL SELECT doc_id, 'F_NOMETA', 'low', '' FROM m2 WHERE kind = 'pdf' AND prod = '' AND created IS NULL
  UNION ALL SELECT doc_id, 'F_INCREMENTAL', 'medium', '' FROM m2 WHERE kind = 'pdf' AND saves > 1
  UNION ALL SELECT doc_id, 'F_EDITOR', 'high', 'exif' FROM m2 WHERE exif_software IS NOT NULL)
"""


def sql(body: str, parts: str = META) -> str:
    return X.with_views("WITH " + parts + "\n" + body, "d_files")


@query("r1_r5_r14_metadata", sql("SELECT doc_id, code, severity, variant FROM meta"))
def metadata(spark, d):
    return R.metadata_findings(files(spark, d)).select("doc_id", "code", "severity", "variant")


@query("r3_modified_text", sql("SELECT doc_id, 'Created ' || strftime(c, '%b %d, %Y %H:%M') || ', changed ' || strftime(m, '%b %d, %Y %H:%M') || ' (' || cast(date_diff('second', c, m) // 60 AS varchar) || ' minutes later).' AS what FROM m2 WHERE kind = 'pdf' AND date_diff('second', c, m) > 120"))
def modified(spark, d):
    return R.metadata_findings(files(spark, d)).where(F.col("code") == "F_MODIFIED").select("doc_id", "what")


@query("j13_file_checks", sql("""
SELECT doc_id, code FROM (
  SELECT doc_id, unnest([CASE WHEN prod <> '' THEN 'F_EDITOR' END, CASE WHEN coalesce(created, '') <> '' AND coalesce(modified, '') <> '' THEN 'F_MODIFIED' END,
    'F_INCREMENTAL', 'F_STACKED', 'F_ANNOT', CASE WHEN len(regexp_extract_all(text, '[0-9]+')) >= 5 THEN 'F_FONT' END]) AS code FROM m2 WHERE kind = 'pdf' AND doc_id % 7 <> 0) a
WHERE code IS NOT NULL AND NOT EXISTS (SELECT 1 FROM meta f WHERE f.doc_id = a.doc_id AND (f.code = a.code OR (f.code = 'F_OFFICE' AND a.code = 'F_FONT')))"""))
def file_checks(spark, d):
    """Checks that a file passed; numbers in its text stand for amounts, every seventh text was read by OCR."""
    docs = files(spark, d).withColumn("ocr_used", F.col("doc_id") % 7 == 0)
    amounts = docs.select("doc_id", F.regexp_count("text", F.lit("[0-9]+")).alias("n"))
    return D.passed_checks(D.pdf_applicability(docs, amounts), R.metadata_findings(docs)).select("doc_id", "code")


@query("f2_pdf_date", sql("SELECT doc_id, cast(c AS varchar) AS created FROM m1"))
def pdf_date(spark, d):
    return files(spark, d).select("doc_id", T.pdf_timestamp(F.col("created")).alias("created"))


@query("j11_keyword_any_match", sql("SELECT doc_id, img, ed, off FROM m2"))
def keywords(spark, d):
    low = F.lower(R.producer_of(F.col("producer"), F.col("creator")))
    return files(spark, d).select("doc_id", T.contains_any(low, K.IMAGE_EDITORS).alias("img"), T.contains_any(low, K.PDF_EDITORS).alias("ed"),
                                  T.contains_any(low, K.OFFICE_SUITES).alias("off"))


@query("f12_sha256", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def sha(spark, d):
    return X.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("f1_base_family", X.with_views("SELECT font, count(*) AS n, CASE WHEN contains(font, 'Courier') THEN 'courier' ELSE 'arial' END AS family FROM d_spans GROUP BY font", "d_spans"))
def families(spark, d):
    return spans(spark, d).groupBy("font").agg(F.count("*").alias("n")).select("font", "n", T.base_family(F.col("font")).alias("family"))


PAIRS = """
pr AS (
  SELECT a.doc_id, a.page, a.span_no AS i, b.span_no AS j, a.text AS t1, b.text AS t2,
         least(a.x1, b.x1) - greatest(a.x0, b.x0) AS w, least(a.y1, b.y1) - greatest(a.y0, b.y0) AS h,
         least((a.x1-a.x0)*(a.y1-a.y0), (b.x1-b.x0)*(b.y1-b.y0)) AS small
  FROM d_spans a JOIN d_spans b ON a.doc_id = b.doc_id AND a.page = b.page AND a.span_no < b.span_no AND a.text <> b.text),
hit AS (SELECT * FROM pr WHERE w > 0 AND h > 0 AND w * h / small > 0.45)
"""


@query("j5_box_overlap", X.with_views("WITH " + PAIRS + "SELECT doc_id, page, count(*) AS n_pairs, arg_min(t1 || ' / ' || t2, (i, j)) AS first_pair FROM hit GROUP BY doc_id, page", "d_spans"))
def box_overlap(spark, d):
    return R.stacked_pages(spans(spark, d)).select("doc_id", "page", F.col("n_pairs").cast("bigint").alias("n_pairs"), F.element_at("pairs", 1).alias("first_pair"))


@query("r8_stacked", X.with_views("WITH " + PAIRS + "SELECT doc_id, page, count(*) AS n, least(count(*), 6) AS shown FROM hit WHERE doc_id % 7 <> 0 GROUP BY doc_id, page", "d_spans"))
def stacked(spark, d):
    s = spans(spark, d)
    pages = s.groupBy("doc_id", "page").agg(F.bool_or("ocr").alias("ocr"))
    return R.stacked_findings(s, pages).select("doc_id", "page", "n", F.size("detail").alias("shown"))


@query("f10_box_geometry", X.with_views("SELECT doc_id, span_no, (x1-x0)*(y1-y0) AS area, (x0+x1)/2 AS cx, least(x1, 60) - greatest(x0, 20) AS w FROM d_spans", "d_spans"))
def geometry(spark, d):
    b = G.box()
    fixed = (F.lit(20.0), F.lit(0.0), F.lit(60.0), F.lit(50.0))
    return spans(spark, d).select("doc_id", "span_no", G.area(b).alias("area"), ((b[0] + b[2]) / 2).alias("cx"), G.overlap_width(b, fixed).alias("w"))


# White rectangles from the part table, laid over the line items' pages.
PATCHES = "SELECT l_orderkey AS doc_id, cast(1 + l_linenumber % 2 AS int) AS page, cast(l_linenumber AS bigint) * 1000000000 + l_partkey * 10000 + l_suppkey AS patch_no, cast(l_suppkey % 9 AS double) * 8 AS x0, cast(l_partkey % 7 AS double) * 4 AS y0, cast(l_suppkey % 9 AS double) * 8 + 14 AS x1, cast(l_partkey % 7 AS double) * 4 + 8 AS y1, 0.9 + cast(l_partkey % 10 AS double) / 100 AS fill_min, l_suppkey % 11 = 0 AS stroked FROM lineitem"
PATCH_SQL = f"patches AS (SELECT * FROM ({PATCHES}) p WHERE fill_min > 0.97 AND NOT stroked)"


def patches(spark, d):
    X.table(spark, d, "lineitem").createOrReplaceTempView("lineitem")
    raw = spark.sql(PATCHES)
    pages = raw.select("doc_id", "page").distinct().withColumn("width", F.lit(612.0)).withColumn("height", F.lit(792.0))
    return RW.whiteout_patches(raw, pages), pages


@query("p9_whiteout_patches", "WITH " + PATCH_SQL + " SELECT doc_id, page, patch_no FROM patches")
def whiteouts(spark, d):
    return patches(spark, d)[0].select("doc_id", "page", "patch_no")


_COVERED = PATCH_SQL + ", cov AS (SELECT p.* FROM patches p WHERE EXISTS (SELECT 1 FROM d_spans s WHERE s.doc_id = p.doc_id AND s.page = p.page AND (s.x0+s.x1)/2 BETWEEN p.x0 AND p.x1 AND (s.y0+s.y1)/2 BETWEEN p.y0 AND p.y1))"


@query("j6_patch_covers_text", X.with_views("WITH " + _COVERED + " SELECT doc_id, page, patch_no FROM cov", "d_spans"))
def patch_cover(spark, d):
    return R.covering_patches(patches(spark, d)[0], spans(spark, d))


@query("r9_patch", X.with_views("WITH " + PAIRS + ", " + _COVERED + """
SELECT doc_id, page, count(*) AS n FROM cov c WHERE (SELECT count(*) FROM patches p WHERE p.doc_id = c.doc_id AND p.page = c.page) <= 4
  AND NOT EXISTS (SELECT 1 FROM hit h WHERE h.doc_id = c.doc_id AND h.page = c.page) AND doc_id % 7 <> 0 GROUP BY doc_id, page""", "d_spans"))
def patch_rule(spark, d):
    s, (p, pages) = spans(spark, d), patches(spark, d)
    pages = pages.withColumn("ocr", F.col("doc_id") % 7 == 0)
    live = s.where(F.col("doc_id") % 7 != 0)
    return R.patch_findings(p, s, pages, R.stacked_pages(live)).select("doc_id", "page", "n")


FONTS = """
fam AS (SELECT doc_id, CASE WHEN contains(font, 'Courier') THEN 'courier' ELSE 'arial' END AS family, count(*) AS n, min(span_no) AS seen FROM d_spans GROUP BY 1, 2),
dom AS (SELECT doc_id, arg_min(family, (-n, seen)) AS dominant, max(n) AS n_dominant, sum(n) AS total, count(*) AS n_values FROM fam GROUP BY doc_id)
"""


@query("a7_dominant_value", X.with_views("WITH " + FONTS + "SELECT doc_id, dominant, n_dominant, cast(total AS bigint) AS total, n_values FROM dom", "d_spans"))
def dominant(spark, d):
    return R.dominant_value(spans(spark, d).withColumn("family", T.base_family(F.col("font"))), "family", "span_no")


@query("r10_font", X.with_views("WITH " + FONTS + "SELECT doc_id, cast(total - n_dominant AS bigint) AS n FROM dom WHERE total >= 5 AND total > n_dominant AND n_dominant >= 0.6 * total AND total - n_dominant <= 6", "d_spans"))
def font_rule(spark, d):
    m = spans(spark, d).select("doc_id", F.col("span_no").alias("seq"), "font", X.money("amount_c").alias("value"))
    return R.font_findings(m).select("doc_id", "n")


_EDGE = """
e AS (SELECT doc_id, span_no, span_no % 2 AS knd, amount_c, 200 + CASE WHEN span_no % 6 = 0 THEN 3.5 ELSE 0 END::double AS x1 FROM d_spans WHERE NOT ocr),
en AS (SELECT doc_id, round_even(x1, 0) AS edge, count(*) AS n, min((knd, span_no)) AS seen FROM e GROUP BY 1, 2),
ed AS (SELECT doc_id, arg_min(edge, (-n, seen)) AS edge, max(n) AS k, sum(n) AS total FROM en GROUP BY 1)
"""


@query("r11_align", X.with_views("WITH " + _EDGE + "SELECT doc_id, count(*) AS n, arg_min(amount_c, (knd, span_no))::double / 100 AS first_amount FROM e JOIN ed USING (doc_id) WHERE total >= 4 AND k >= total - 2 AND abs(x1 - edge) > 0.9 AND abs(x1 - edge) < 14 GROUP BY doc_id HAVING count(*) <= 2", "d_spans"))
def align_rule(spark, d):
    s = spans(spark, d)
    lines = s.select("doc_id", F.col("span_no").alias("line_no"), X.money("amount_c").alias("current"),
                     F.when(F.col("span_no") % 2 == 0, "earning").otherwise("deduction").alias("kind"),
                     (F.lit(200.0) + F.when(F.col("span_no") % 6 == 0, 3.5).otherwise(0.0)).alias("x1"))
    f = R.alignment_findings(lines, s.where("ocr").select("doc_id").distinct())
    said = F.regexp_replace(F.regexp_extract("what", r"; \$?([0-9,]+\.[0-9]{2})", 1), ",", "").cast("double")
    return f.select("doc_id", "n", said.alias("first_amount"))


@query("r12_size", X.with_views("SELECT doc_id, arg_min(text, (span_no % 5, span_no)) AS label FROM d_spans WHERE NOT ocr AND span_no % 50 = 0 GROUP BY doc_id", "d_spans"))
def size_rule(spark, d):
    s = spans(spark, d)
    lines = s.select("doc_id", F.col("span_no").alias("line_no"), F.element_at(F.array(*[F.lit(k) for k in K.LINE_KINDS]), (F.col("span_no") % 5 + 1).cast("int")).alias("kind"), F.col("text").alias("label"), X.money("amount_c").alias("current"), X.money("amount_c").alias("ytd"),
                     F.lit(9.0).alias("size"), F.when(F.col("span_no") % 50 == 0, 9.5).otherwise(9.2).alias("ytd_size"))
    f = R.size_findings(lines, s.where("ocr").select("doc_id").distinct())
    return f.select("doc_id", F.regexp_extract("what", '"(.*)"', 1).alias("label"))


# Pages of the documents table: image share, live text and annotations from the page's own numbers.
D_PAGES = "SELECT o_orderkey AS doc_id, 1 AS page, 612.0::double AS width, 792.0::double AS height, (o_custkey % 11) / 10::double AS image_cover, cast(o_orderkey % 4 AS bigint) AS visible_text_spans, o_orderkey % 5 AS chars FROM orders"


def doc_pages(spark, d):
    o = X.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.lit(612.0).alias("width"), F.lit(792.0).alias("height"),
                    ((F.col("o_custkey") % 11) / F.lit(10.0)).alias("image_cover"), (F.col("o_orderkey") % 4).alias("visible_text_spans"))


_CLASS = "chars AS (SELECT doc_id, page, sum(length(text)) AS chars, count(*) AS n FROM d_spans GROUP BY 1, 2), pg AS (SELECT p.*, coalesce(c.chars, 0) AS ch, coalesce(c.n, 0) AS n FROM (" + D_PAGES + ") p LEFT JOIN chars c USING (doc_id, page)), cl AS (SELECT *, ch < 40 AND image_cover > 0.3 AS ocr FROM pg)"


@query("p8_page_class", X.with_views("WITH " + _CLASS + " SELECT doc_id, page, ocr, (NOT ocr AND image_cover > 0.6 AND visible_text_spans > 0) OR (ocr AND n > 0) AS has_overlay FROM cl", "d_spans"))
def page_class(spark, d):
    return RW.page_classes(doc_pages(spark, d), spans(spark, d)).select("doc_id", "page", "ocr", "has_overlay")


@query("r7_text_on_scan", X.with_views("WITH " + _CLASS + " SELECT doc_id, page, visible_text_spans AS n, least(n, 8) AS shown FROM cl WHERE n > 0 AND image_cover > 0.6 AND visible_text_spans >= 1", "d_spans"))
def text_on_scan(spark, d):
    s = spans(spark, d)
    pages = RW.page_classes(doc_pages(spark, d), s)
    over = s.join(pages.where("has_overlay"), ["doc_id", "page"], "left_semi")
    return R.overlay_findings(pages, over).select("doc_id", "page", "n", F.size("detail").alias("shown"))


@query("r13_scan", X.with_views("WITH " + _CLASS + " SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'image' ELSE 'pdf' END AS variant FROM cl WHERE doc_id % 9 = 0 OR ocr OR (image_cover > 0.6 AND visible_text_spans = 0)", "d_spans"))
def scan(spark, d):
    pages = RW.page_classes(doc_pages(spark, d), spans(spark, d))
    f = pages.select("doc_id", F.when(F.col("doc_id") % 9 == 0, "jpeg").otherwise("pdf").alias("kind"))
    return R.scan_findings(f, pages).select("doc_id", "variant")


_TYPES = "list_extract(['FreeText','Link','Stamp','Widget','Ink'], cast(l_partkey % 5 + 1 AS int))"


@query("r6_annotations", f"SELECT l_orderkey AS doc_id, cast(1 + l_linenumber % 2 AS bigint) AS page, count(*) AS n, string_agg(DISTINCT t, ', ' ORDER BY t) AS kinds FROM (SELECT *, {_TYPES} AS t FROM lineitem) x WHERE t IN ('FreeText','Stamp','Ink') GROUP BY 1, 2")
def annotations(spark, d):
    types = F.array(*[F.lit(t) for t in ("FreeText", "Link", "Stamp", "Widget", "Ink")])
    a = X.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 2 + 1).cast("int").alias("page"),
                                             F.element_at(types, (F.col("l_partkey") % 5 + 1).cast("int")).alias("type"))
    return R.annotation_findings(a).select("doc_id", "page", "n", F.regexp_extract("what", r": (.*)\.", 1).alias("kinds"))


@query("p10_image_cover", "SELECT l_orderkey AS doc_id, 1::bigint AS page, round(sum(greatest(l_quantity - 5, 0) * greatest(l_linenumber * 10.0::double, 0)) / (612.0::double * 792.0::double), 9) AS image_cover FROM lineitem GROUP BY 1")
def image_cover(spark, d):
    im = X.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.lit(5.0).alias("x0"), F.col("l_quantity").alias("x1"),
                                              F.lit(0.0).alias("y0"), (F.col("l_linenumber") * 10.0).alias("y1"))
    pages = im.select("doc_id", "page").distinct().withColumn("width", F.lit(612.0)).withColumn("height", F.lit(792.0))
    return RW.page_cover(im, pages).select("doc_id", "page", F.round("image_cover", 9).alias("image_cover"))


@query("p11_text_objects", "SELECT l_orderkey AS doc_id, 1::bigint AS page, count(*) FILTER (l_linenumber = 3 OR l_discount = 0) AS invisible_text_spans, count(*) FILTER (NOT (l_linenumber = 3 OR l_discount = 0)) AS visible_text_spans FROM lineitem GROUP BY 1")
def text_objects(spark, d):
    t = X.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("l_linenumber").alias("render_type"), F.col("l_discount").alias("opacity"))
    return RW.text_object_counts(t)


@query("p12_large_jpegs", "SELECT l_orderkey AS doc_id, l_quantity * 1000 AS width_px FROM lineitem WHERE l_returnflag = 'A' AND l_quantity * 1000 * l_linenumber * 10 > 250000")
def jpegs(spark, d):
    im = X.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_returnflag") == "A", "JPEG").otherwise("png").alias("ext"),
                                              (F.col("l_quantity") * 1000).alias("width_px"), (F.col("l_linenumber") * 10).alias("height_px"))
    return RW.large_jpegs(im).select("doc_id", "width_px")


_UNREAD = "u AS (SELECT f.doc_id, count(s.doc_id) AS n_spans, any_value(kind) AS kind FROM d_files f LEFT JOIN (SELECT doc_id FROM d_spans) s USING (doc_id) GROUP BY f.doc_id)"


@query("p4_p5_unreadable", X.with_views("WITH " + _UNREAD + " SELECT doc_id, CASE WHEN kind IS NULL THEN 'kind' ELSE 'words' END AS variant, 'unreadable' AS verdict, 0::bigint AS risk FROM u WHERE kind IS NULL OR n_spans < 15", "d_files", "d_spans"))
def unreadable(spark, d):
    from tallywright.operators.decide import score_documents
    f = files(spark, d)
    found = R.unreadable_findings(RW.unreadable_documents(f, spans(spark, d)))
    v = score_documents(f, found).where(F.col("verdict") == "unreadable")
    return v.join(found.select("doc_id", "variant"), "doc_id").select("doc_id", "variant", "verdict", "risk")


@query("r16_robust_blocks", """
WITH b AS (SELECT l_suppkey AS page_id, l_partkey % 60 AS bx, l_orderkey % 60 AS "by", max(l_quantity + CASE WHEN l_partkey % 60 = 7 AND l_suppkey % 3 = 0 THEN 400 ELSE 0 END) AS score, max(l_tax) AS es FROM lineitem GROUP BY 1, 2, 3),
ok AS (SELECT * FROM b WHERE es > 0.04 AND page_id IN (SELECT page_id FROM b GROUP BY 1 HAVING max(bx) >= 5 AND max("by") >= 5)), md AS (SELECT page_id, median(score) AS med, count(*) AS n_ok FROM ok GROUP BY 1 HAVING count(*) >= 20),
dv AS (SELECT ok.*, med, n_ok FROM ok JOIN md USING (page_id)), mad AS (SELECT page_id, median(abs(score - med)) * 1.4826::double + 0.5::double AS mad FROM dv GROUP BY 1),
z AS (SELECT *, (score - med) / mad AS zz FROM dv JOIN mad USING (page_id) WHERE (score - med) / mad > 7)
SELECT page_id, count(*) AS blocks, round(max(zz), 6) AS z, min(bx) * 24 AS x0, (max("by") + 1) * 24 AS y1 FROM z GROUP BY page_id, n_ok HAVING count(*) >= 2 AND count(*) <= 0.12 * n_ok""")
def robust_blocks(spark, d):
    return R.robust_hot_spots(blocks(spark, d)).select("page_id", "blocks", F.round("z", 6).alias("z"), "x0", "y1")


def blocks(spark, d):
    li = X.table(spark, d, "lineitem")
    hot = (F.col("l_partkey") % 60 == 7) & (F.col("l_suppkey") % 3 == 0)
    return li.groupBy(F.col("l_suppkey").alias("page_id"), (F.col("l_partkey") % 60).alias("bx"), (F.col("l_orderkey") % 60).alias("by")).agg(
        F.max(F.col("l_quantity") + F.when(hot, 400).otherwise(0)).alias("score"), F.max("l_tax").alias("edge_share"))


# Where the printed stub has each value: the same page as `fixtures.stub_spans` lays out, five points a character, nine points high.
_W = lambda c: f"5 * length(format('${{:,.2f}}', {c}/100.0))"
_AT = lambda field, cents, x, y, no="NULL", where="true", bare=0: (
    f"SELECT doc_id, '{field}' AS field, {no}::bigint AS line_no, x AS x0, {y} AS y0, x + {_W(cents)} - {bare} AS x1 FROM (SELECT *, {x} AS x FROM e_print) q WHERE {cents} IS NOT NULL AND ({where})")
_SWAPPED = lambda ytd, left, right: f"CASE WHEN k % 7 = 0 AND {ytd} IS NOT NULL THEN {right} ELSE {left} END"
_PLAIN = "k % 83 > 0"  # overtime whose three amounts multiply out
_ROW = lambda field, y, right: f"SELECT doc_id, '{field}', NULL::bigint, 40, {y}, {right} FROM e_print"
STUB_BOXES = "e_print AS (SELECT *, CASE WHEN gross_ytd_c IS NOT NULL THEN net_c * n_periods END AS net_y FROM d_wide), e_box AS (" + " UNION ALL ".join([
    _AT("gross", "gross_c", _SWAPPED("gross_ytd_c", 120, 220), 360), _AT("gross_ytd", "gross_ytd_c", _SWAPPED("gross_ytd_c", 220, 120), 360, where="gross_c IS NOT NULL"),
    _AT("total_deductions", "total_c", 150, 380), _AT("net", "net_c", _SWAPPED("net_y", 120, 220), 400), _AT("net_ytd", "net_y", _SWAPPED("net_y", 220, 120), 400),
    _AT("earning", "reg_c", 120, 260, 1), _AT("earning", "ot_c", 230, 281, 2, _PLAIN + " OR k % 7 = 0"), _AT("earning", "hours_c", 170, 280, 2, f"NOT ({_PLAIN}) AND k % 7 > 0", 5),
    _AT("deduction", "fed_c", 450, 262, 3), _AT("deduction", "ss_c", _SWAPPED("ss_ytd_c", 450, 520), 280, 4), _AT("deduction", "med_c", 120, 300, 5),
    _AT("deduction", "health_c", 150, 320, 6), _AT("deduction", "k401_c", 120, 340, 7),
    _AT("social_security", "ss_c", _SWAPPED("ss_ytd_c", 450, 520), 280), _AT("medicare", "med_c", 120, 300),
    _AT("shrunk", "gross_c", _SWAPPED("gross_ytd_c", 120, 220), 360, where="gross_ytd_c + 2 < gross_c"),
    _AT("shrunk_ytd", "gross_ytd_c", _SWAPPED("gross_ytd_c", 220, 120), 360, where="gross_ytd_c + 2 < gross_c"),
    _AT("shrunk", "ss_c", _SWAPPED("ss_ytd_c", 450, 520), 280, where="NOT coalesce(gross_ytd_c + 2 < gross_c, false) AND NOT coalesce(net_y + 2 < net_c, false) AND ss_ytd_c + 2 < ss_c"),
    _AT("shrunk_ytd", "ss_ytd_c", _SWAPPED("ss_ytd_c", 520, 450), 280, where="NOT coalesce(gross_ytd_c + 2 < gross_c, false) AND NOT coalesce(net_y + 2 < net_c, false) AND ss_ytd_c + 2 < ss_c"),
    _ROW("pay_date", 100, 150), _ROW("period_start", 120, 230), _ROW("period_end", 120, 230),
    "SELECT doc_id, 'employee', NULL::bigint, 95, 80, 124 + 5 * length(split_part(employee, ' ', 2)) FROM e_print WHERE employee IS NOT NULL"]) + """),
e_points AS (SELECT * FROM (VALUES """ + ", ".join(f"('{code.split('/')[0]}', '{(code + '/').split('/')[1]}', '{name}', {i})" for code, names in EV.POINTS_AT.items() for i, name in enumerate(names) if not name.endswith(("@", "#"))) + """) p(code, variant, field, place)),
e_found AS (SELECT *, CASE WHEN code = 'C_DATES' THEN CASE WHEN severity = 'high' THEN 'length' ELSE 'early' END WHEN code = 'C_NAME' THEN 'stub' ELSE '' END AS variant FROM stub_findings)"""


@query("f6_evidence_boxes", X.with_views("WITH " + SB.RULES + ", " + STUB_BOXES + """
SELECT f.doc_id, f.code, f.emit, p.place, b.x0::double AS x0, b.y0::double AS y0, b.x1::double AS x1, b.y0::double + 9 AS y1, 1::bigint AS page
FROM e_found f JOIN e_points p USING (code, variant) JOIN e_box b ON b.doc_id = f.doc_id AND b.field = p.field WHERE f.code NOT IN ('C_RATE_HOURS')""", "o_lines", "d_wide"))
def evidence_boxes(spark, d):
    """Findings of the typed stubs with the boxes that the extraction of the printed ones read them from."""
    sp = staged(RW.clean_spans(X.stub_spans(spark, d)), "stub-spans")
    x = E.extract_stub_tables(RW.build_rows(sp), sp, X.stub_pages(spark, d))
    e = EV.evidence(SB.findings(spark, d), x["boxes"])
    return e.select("doc_id", "code", "emit", "place", *[F.element_at("bbox", i + 1).alias(c) for i, c in enumerate(E.BOX)], "page")


@query("f6_line_evidence", X.with_views("""SELECT doc_id, 'B_RUNNING' AS code, txn_no AS sub, unnest([0, 1])::bigint AS place, unnest([300.0, 400.0])::double AS x0, 200 + original * 12.0::double AS y0,
       unnest([300 + 5 * length(format('${:,.2f}', amount_c/100.0)), 400 + 5 * length(format('${:,.2f}', balance_c/100.0))])::double AS x1
FROM (SELECT t.doc_id, txn_no AS original, row_number() OVER (PARTITION BY t.doc_id ORDER BY txn_no) - 1 AS txn_no, amount_c, balance_c FROM o_txns t) n
WHERE (doc_id, original) IN (SELECT doc_id, first_break FROM facts WHERE first_break IS NOT NULL)
UNION ALL SELECT doc_id, 'C_RATE_HOURS', k, unnest([0, 1, 2])::bigint, unnest([120, 170, 230])::double, unnest([280, 280, 281])::double, unnest([120 + %s, 170 + 5 * length(format('{:,.2f}', hours_c/100.0)), 230 + %s])::double
FROM (SELECT doc_id, 0::bigint AS k, rate_c, hours_c, ot_c FROM d_wide WHERE ot_c IS NOT NULL AND k %% 83 > 0 AND doc_id %% 5 = 0) w""".replace("SELECT doc_id, 'B_RUNNING'", "WITH " + BK.FACTS.replace("%", "%%") + "SELECT doc_id, 'B_RUNNING'") % (_W("rate_c"), _W("ot_c")), "o_txns", "d_statements", "d_wide"))
def line_evidence(spark, d):
    """Evidence of single lines: the first break of printed statements, and overtime lines of every fifth stub under a finding of their own."""
    x = E.extract_statements(RW.build_rows(RW.clean_spans(X.statement_spans(spark, d))), X.TODAY)
    st = X.statements(spark, d).select("doc_id", "begin_balance", "ocr_used", "applicant")
    facts = B.statement_facts(B.balance_chain(x["txns"], st))
    own = x["statements"].drop("begin_balance").join(st, "doc_id")
    breaks = EV.evidence(B.bank_findings(own, x["txns"], facts).where(F.col("code") == "B_RUNNING"), x["boxes"])
    sp = staged(RW.clean_spans(X.stub_spans(spark, d)), "stub-spans")
    s = E.extract_stub_tables(RW.build_rows(sp), sp, X.stub_pages(spark, d))
    rated = s["lines"].where((F.col("kind") == "earning") & F.col("rate").isNotNull() & (F.col("doc_id") % 5 == 0))
    # the rule itself is silent on these lines, so a finding is made for each: what is compared is where it points
    about = rated.select("doc_id", F.lit("C_RATE_HOURS").alias("code"), F.lit("").alias("variant"), F.lit(54).alias("emit"), F.col("line_no").alias("sub"), F.lit(None).cast("int").alias("page"))
    hours = EV.evidence(about, s["boxes"]).withColumn("sub", F.lit(0).cast("bigint"))
    pick = lambda e: e.select("doc_id", "code", "sub", "place", *[F.element_at("bbox", i + 1).alias(c) for i, c in enumerate(E.BOX) if c != "y1"])
    return pick(breaks).unionByName(pick(hours))


_FILE_BOX = lambda code, body: f"SELECT doc_id, '{code}' AS code, page::bigint AS page, x0, y0, x1, y1 FROM ({body}) q"


@query("f6_file_evidence", X.with_views("WITH " + PAIRS + ", " + FONTS + ", six AS (SELECT * FROM hit WHERE doc_id % 7 <> 0 QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY i, j) <= 6)" + " ".join([
    _FILE_BOX("F_STACKED", "SELECT s.* FROM six JOIN d_spans s ON s.doc_id = six.doc_id AND s.page = six.page AND s.span_no = six.i"), "UNION ALL",
    _FILE_BOX("F_FONT", "SELECT s.* FROM d_spans s JOIN dom USING (doc_id) WHERE total >= 5 AND total > n_dominant AND n_dominant >= 0.6 * total AND total - n_dominant <= 6 AND CASE WHEN contains(font, 'Courier') THEN 'courier' ELSE 'arial' END <> dominant"), "UNION ALL",
    _FILE_BOX("F_ANNOT", "SELECT * FROM d_spans WHERE span_no % 5 = 0")]), "d_spans"))
def file_evidence(spark, d):
    """Boxes of file findings: overlapping texts, amounts in another typeface, annotations. Spans, overlaps and outliers are stages: findings and boxes read them."""
    s = staged(spans(spark, d), "file-spans")
    pages = s.groupBy("doc_id", "page").agg(F.bool_or("ocr").alias("ocr"))
    live = s.join(pages.where(~F.col("ocr")).select("doc_id", "page"), ["doc_id", "page"], "left_semi")
    stacked = staged(R.stacked_pages(live), "stacked-pages")
    outliers = staged(R.font_outliers(s.select("doc_id", "page", F.col("span_no").alias("seq"), "font", X.money("amount_c").alias("value"), *E.BOX)), "font-outliers")
    annots = s.where(F.col("span_no") % 5 == 0).withColumn("type", F.lit("Stamp"))
    found = R.stacked_page_findings(stacked).unionByName(R.font_outlier_findings(outliers)).unionByName(R.annotation_findings(annots))
    boxes = EV.stacked_boxes(stacked).unionByName(EV.font_boxes(outliers)).unionByName(EV.annotation_boxes(annots))
    e = EV.evidence(found, boxes)
    return e.select("doc_id", "code", "page", *[F.element_at("bbox", i + 1).alias(c) for i, c in enumerate(E.BOX)])


@query("f3_f4_formats", """SELECT event_id, format('${:,.2f}', value * 1000) AS usd, CASE WHEN event_id < 3600 THEN cast(event_id // 60 AS varchar) || ' minutes' WHEN event_id < 172800 THEN cast(event_id // 3600 AS varchar) || ' hours' ELSE cast(event_id // 86400 AS varchar) || ' days' END AS gap FROM events""")
def formats(spark, d):
    return X.table(spark, d, "events").select("event_id", T.usd(F.col("value") * 1000).alias("usd"), T.elapsed_words(F.col("event_id")).alias("gap"))


@query("f7_f9_rounding", "SELECT o_orderkey AS doc_id, round_even(cast(o_totalprice AS decimal(18,2)) * 0.145, 2)::double AS cents, o_totalprice = floor(o_totalprice) AS whole FROM orders")
def rounding(spark, d):
    p = F.col("o_totalprice").cast("decimal(18,2)")
    return X.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.bround(p * F.lit("0.145").cast("decimal(4,3)"), 2).alias("cents"), (p == F.floor(p)).alias("whole"))


@query("f11_description_kind", "SELECT conv_id, cast(turn AS bigint) AS turn, CASE WHEN regexp_matches(lower(text), 'deposit|payroll|credit|direct dep|refund|transfer from') THEN 'deposit' ELSE 'withdrawal' END AS kind FROM conversations")
def desc_kind(spark, d):
    return X.table(spark, d, "conversations").select("conv_id", "turn", T.description_kind(F.col("text")).alias("kind"))
