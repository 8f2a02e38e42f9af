from conftest import SF
from pyspark.sql import functions as F

from tallywright.plans import catalogue
from tallywright.plans import fixtures as X
from tallywright.plans.screen import Inputs, screen_portfolio


def test_whole_job(spark, tmp_path):
    stubs, st = X.stubs(spark, SF), X.statements(spark, SF)
    cols = ["doc_id", "app_id", "filename"]
    sha = F.sha2(F.col("doc_id").cast("string"), 256).alias("sha256")
    docs = stubs.select(*cols, sha, "status", "decision").unionByName(
        st.select(*cols, sha, F.lit("done").alias("status"), F.lit(None).cast("string").alias("decision")))
    x = Inputs(docs, stubs, X.stub_lines(spark, SF), st, X.txns(spark, SF), X.applications(spark, SF), X.orgs(spark, SF))
    done = screen_portfolio(spark, x, str(tmp_path / "out"), X.TODAY)
    want = {r.doc_id: r.verdict for r in catalogue.QUERIES["d1_verdict"](spark, SF).collect()}
    want |= {r.doc_id: r.verdict for r in catalogue.QUERIES["statement_verdicts"](spark, SF).collect()}
    assert {r.doc_id: r.verdict for r in done["scores"].collect()} == want
    assert done["applications"].count() == docs.select("app_id").distinct().count()
    assert {"X_DEPOSIT", "X_DEPOSIT_OK", "X_YTD"} <= {r.code for r in done["cross_findings"].select("code").distinct().collect()}
    assert done["needs"].where(F.col("need").isNull()).count() == 0


def test_partitioning_does_not_change_results(spark):
    from tallywright.operators.stub_rules import all_stub_findings
    stubs, lines = X.stubs(spark, SF), X.stub_lines(spark, SF)
    cols = ["doc_id", "code", "severity", "emit", "sub", "what"]
    a = sorted(map(tuple, all_stub_findings(stubs, lines, X.TODAY).select(cols).collect()))
    b = sorted(map(tuple, all_stub_findings(stubs.repartition(7), lines.orderBy(F.rand(1)), X.TODAY).select(cols).collect()))
    assert a == b
