"""What must hold for tables much larger than the given ones: where work is done, and how often."""

import glob

from conftest import SF
from pyspark.sql import functions as F

from tallywright.functions import text as T
from tallywright.operators import evidence as EV
from tallywright.operators import fields as E
from tallywright.operators import learn, ordered
from tallywright.operators import rows as R
from tallywright.plans import catalogue, intake
from tallywright.plans import fixtures as X


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_chunks_are_cut_at_marks_that_were_stored(spark):
    """A sketch worked out twice may give two sets of marks; sizes of chunks then belong to other chunks than the rows'."""
    rows = spark.range(3000).selectExpr("0 AS k", "id AS n").repartition(16)
    ranked = ordered.with_rank(rows, ["k"], "n", chunk=100)
    assert "percentile_approx" not in plan(ranked)
    assert all(r["rank"] == r.n + 1 for r in ranked.collect())
    assert "percentile_approx" not in plan(ordered.with_previous(rows, ["k"], "n", ["n"], chunk=100))


def test_documents_are_printed_by_all_cores(spark):
    """The file has one row group, so one task reads it; what is worked out from its rows is spread."""
    assert X.table(spark, SF, "orders").rdd.getNumPartitions() == 1
    for spans in (X.stub_spans(spark, SF), X.view(spark, SF, "d_spans")):
        assert spans.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_rows_of_stubs_are_read_once(spark):
    for name in ("t9_stub_amounts", "t9_t10_pay_lines"):
        assert "MapInArrow" not in plan(catalogue.QUERIES[name](spark, SF))


def test_queries_work_out_only_what_they_return(spark, monkeypatch):
    def unwanted(*a, **k):
        raise AssertionError("not needed")

    monkeypatch.setattr(E, "extract_statements", unwanted)
    assert catalogue.QUERIES["t19_money_spans"](spark, SF).count() > 0
    monkeypatch.setattr(E, "stub_lines", unwanted)
    assert catalogue.QUERIES["t12_letterhead"](spark, SF).where("employer IS NOT NULL").count() == X.table(spark, SF, "orders").count()


def test_no_task_writes_a_whole_arrival(spark, monkeypatch):
    paths = []
    real = intake.scratch
    monkeypatch.setattr(intake, "scratch", lambda s, name: paths.append(real(s, name)) or paths[-1])
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")  # the test's tables are small enough for one task
    try:
        intake.arrivals(spark, SF)
    finally:
        spark.conf.set(key, "true")
    folder = paths[0].removeprefix("file:")
    assert all(len(glob.glob(f"{folder}/stub_lines/arrived={i}/*.parquet")) > 1 for i in range(4))


def test_training_rows_fill_tasks_evenly(spark, monkeypatch):
    seen = []
    real = learn.Pipeline.fit
    monkeypatch.setattr(learn.Pipeline, "fit", lambda self, rows: seen.append(rows.rdd.glom().map(len).collect()) or real(self, rows))
    monkeypatch.setattr(learn, "TASK_ROWS", 50)
    rows = spark.range(0, 1000, 1, 1).selectExpr("cast(id % 2 AS double) AS a", "cast(id % 2 AS int) AS label", "1.0D AS weight")
    learn.fit_score_model(rows, ["a"], trees=1)
    learn.fit_cell_model(rows, ["a"], trees=1)
    assert len(seen) == 2 and all(sum(n) == 1000 and max(n) <= 100 for n in seen)


def test_what_compares_documents_is_read_from_stages(spark, monkeypatch):
    """Pairs, pay dates and deposits come from stored tables: printing stubs and chaining balances is not repeated for each of them."""
    found = catalogue.QUERIES["cross_findings"](spark, SF)
    assert "orders.parquet" not in str(found.inputFiles()) and found.count() > 0


def test_independent_jobs_run_side_by_side_and_fail_loudly(spark):
    import threading

    import pytest

    from tallywright.session import together

    meet = threading.Barrier(2, timeout=20)
    assert together(spark, lambda: (meet.wait(), spark.range(3).count())[1], lambda: (meet.wait(), spark.range(4).count())[1]) == [3, 4]
    with pytest.raises(ZeroDivisionError):
        together(spark, lambda: 1, lambda: 1 // 0)


def test_printed_spans_are_compiled(spark):
    """Worked out inside the generator, the forty texts of a stub are interpreted, which takes four times as long."""
    for spans in (X.stub_spans(spark, SF), X.statement_spans(spark, SF)):
        assert "inline(array(" not in plan(spans).replace("struct", "").lower()


def test_rows_carry_only_what_is_asked_for(spark):
    spans = X.stub_spans(spark, SF)
    rows = R.build_rows(R.clean_spans(spans), ())
    assert "spans" not in rows.columns and "font" not in str(rows._jdf.queryExecution().optimizedPlan())
    whole = R.build_rows(R.clean_spans(spans))
    assert rows.exceptAll(whole.drop("spans")).isEmpty() and whole.drop("spans").exceptAll(rows).isEmpty()


def test_segments_need_no_more_of_a_span_than_its_text(spark):
    """Labels and values come from texts alone; boxes and fonts of amounts are there where the spans carry them."""
    spans = R.clean_spans(X.stub_spans(spark, SF))
    values = lambda s: s.select("doc_id", "page", "at", "seg_no", "label", "role", "vals.value")
    short, whole = (values(E.money_segments(R.build_rows(spans, inside))) for inside in (("text",), R.SPAN))
    assert short.count() > 0 and short.exceptAll(whole).isEmpty() and whole.exceptAll(short).isEmpty()
    assert E.money_segments(R.build_rows(spans)).schema["vals"].dataType.elementType.names == ["value", *E.BOX, "font", "size"]
    assert plan(R.with_segments(R.build_rows(spans))).count("regexp_extract_all") == 1


def test_lone_amounts_are_read_as_any_other(spark):
    texts = ["12.34", "$12.34", "$1,234.56", "$1,23.00", "1234,567.89", "12.34\n", "$ 12.34", "(12.34)", "-$5.00", "$$1.00", "12.345", "12.34%", "1.2.34", "12.34 5.00", "x12.34", "١٢.٣٤", "0.99", "$.99"]
    rows = spark.createDataFrame([(i, 1, f"Net {t}", [(n, t) for n, t in (("Net", "Net"), ("v", t))]) for i, t in enumerate(texts)],
                                 "doc_id long, page int, text string, spans array<struct<n: string, text: string>>").withColumn("at", F.lit(0))
    found = {r.doc_id: [v.value for s in r.segs or [] for v in s.vals] for r in R.with_segments(rows).collect()}
    said = rows.select("doc_id", T.money_mentions(F.element_at("spans", 2)["text"]).alias("v"))
    assert found == {r.doc_id: r.v for r in said.collect()}
    assert {len(v) for v in found.values()} == {0, 1, 2}


def test_tables_with_a_row_per_document_are_not_broadcast(spark):
    """Their stages are small files here, as two of their columns are for the planner at any size."""
    from tallywright.session import staged

    sp = staged(R.clean_spans(X.stub_spans(spark, SF)), "spans")
    facts = staged(E.stub_row_facts(R.build_rows(sp)), "rows")
    headers = staged(E.placed_headers(facts), "headers")
    physical = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in physical(E.stub_lines(E.segments_of(facts), headers))
    assert "LeftSemi, BuildRight" not in physical(E.full_headers(headers, sp, X.stub_pages(spark, SF)))


def test_evidence_reads_findings_and_boxes_once(spark):
    """Findings of a document, of a line and of a page meet their boxes in one join."""
    found = spark.createDataFrame([(1, "C_EARN_SUM", 1, 0, "", None), (1, "C_RATE_HOURS", 2, 7, "", None), (1, "F_ANNOT", 3, 0, "", 2), (1, "B_RUNNING", 4, None, "", None), (1, "X_DUP", 5, 0, "", None)],
                                  "doc_id long, code string, emit int, sub long, variant string, page int")
    box = lambda field, line, page: (1, field, line, page, 1.0, 2.0, 3.0, 4.0)
    boxes = spark.createDataFrame([box("gross", None, 1), box("earning", 7, 1), box("earning", 8, 1), box("rate", 7, 1), box("hours", 8, 1), box("annotation", None, 2), box("annotation", None, 1),
                                   box("amount", None, 1), box("employer", None, 1)], "doc_id long, field string, line_no long, page int, x0 double, y0 double, x1 double, y1 double")
    e = EV.evidence(found, boxes)
    assert sorted((r.code, r.place, str(r.ord.line_no), r.page) for r in e.collect()) == [
        ("C_EARN_SUM", 0, "None", 1), ("C_EARN_SUM", 1, "7", 1), ("C_EARN_SUM", 1, "8", 1),
        ("C_RATE_HOURS", 0, "7", 1), ("C_RATE_HOURS", 2, "7", 1), ("F_ANNOT", 0, "None", 2)]
    assert plan(e).count("Join") == 1


def test_outer_levels_are_built_for_wide_keys_only(spark):
    """The row before by (date, number): one window where no key has many rows, levels and the same rows where one has."""
    rows = spark.range(400).selectExpr("id % 7 AS k", "(id * 37) % 11 AS day", "id AS n")
    plain, wide = (ordered.with_previous(rows, ["k"], "n", ["day", "n"], outer="day", chunk=c) for c in (1 << 20, 3))
    assert "Join" not in plan(plain) and "Join" in plan(wide)
    found, same = (sorted(map(tuple, df.select("k", "day", "n", "prev").collect()), key=repr) for df in (plain, wide))
    assert found == same and len(found) == 400 and sum(r[3] is None for r in found) == 7
    odd = rows.selectExpr("if(k = 2, NULL, k) AS k", "if(day = 3, NULL, day) AS day", "if(day = 4, NULL, n) AS n")
    plain, wide = (ordered.with_previous(odd, ["k"], "n", ["day"], outer="day", chunk=c) for c in (1 << 20, 50))
    found, same = (sorted(map(tuple, df.select("k", "day", "n", "prev").collect()), key=repr) for df in (plain, wide))
    assert len(found) == 400 and found == same  # 57 rows a key; at 50 keys are wide and levels, which have at most 6, are not


def test_file_evidence_deals_and_compares_spans_once(spark):
    """Findings and boxes come from stored spans, overlaps and outliers; the table itself is dealt once, before them."""
    found = catalogue.QUERIES["f6_file_evidence"](spark, SF)
    assert "lineitem.parquet" not in str(found.inputFiles()) and found.count() > 0
