"""The store of the upload stream: what counts, what is read, and that neither order nor repetition matters."""

import glob

import pytest
from conftest import SF
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tallywright.plans import fixtures as X
from tallywright.plans import intake
from tallywright.plans.intake import arrivals
from tallywright.streaming import incremental as ST


@pytest.fixture(scope="module")
def some(spark):
    """Arrivals of the applications up to number 20."""
    x = arrivals(spark, SF)
    mine = x.documents.where("app_id <= 20").select("doc_id")
    return ST.Arrivals(*[df.join(mine, "doc_id", "left_semi") for df in (x.documents, x.stubs, x.stub_lines, x.statements, x.bank_txns)])


def part(some, *folders):
    return some.documents.where(F.col("arrived").isin(*folders)).select("doc_id", "arrived")


def state(spark, store):
    own, between = ST.findings_of(spark, store)
    rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()), key=repr)
    return (rows(ST.documents_of(spark, store), "doc_id", "verdict", "risk"), rows(own, "doc_id", "code", "severity", "emit", "sub", "what"),
            rows(between, "app_id", "doc_id", "code", "what"), rows(ST.applications_of(spark, store), "app_id", "n_docs", "n_done", "verdict"))


@pytest.fixture(scope="module")
def whole(spark, some, tmp_path_factory):
    store = ST.Store(str(tmp_path_factory.mktemp("whole")), 8)
    ST.process_batch(spark, part(some, 0, 1, 2, 3), "all", store, some, X.TODAY)
    return state(spark, store)


def test_batches_in_any_order_repeated_and_compacted(spark, some, whole, tmp_path):
    """Copies, stubs and statements of one application come apart; a failed, a repeated and a re-analysed batch change nothing."""
    store = ST.Store(str(tmp_path / "parts"), 8)

    def fail(key):
        raise RuntimeError(key)

    ST.process_batch(spark, part(some, 3), "a", store, some, X.TODAY)
    with pytest.raises(RuntimeError):
        ST.process_batch(spark, part(some, 0, 1), "b", store, some, X.TODAY, fail)
    assert store.keys(spark) == {"a"}
    ST.process_batch(spark, part(some, 0, 1), "b", store, some, X.TODAY)
    ST.process_batch(spark, part(some, 2), "c", store, some, X.TODAY)
    assert state(spark, store) == whole
    assert {"X_DUP", "X_DEPOSIT", "X_DEPOSIT_OK", "X_YTD"} <= {r[2] for r in whole[2]}
    ST.process_batch(spark, part(some, 0, 1), "b", store, some, X.TODAY)  # logged already
    assert len(store.log(spark)) == 3
    ST.reanalyze(spark, part(some, 1), "again", store, some, X.TODAY)
    assert state(spark, store) == whole
    ST.compact(spark, store)
    assert len(store.log(spark)) == 1 and store.keys(spark) >= {"a", "b", "c", "again"}
    assert state(spark, store) == whole


def test_untouched_applications_are_not_read(spark, some, tmp_path):
    """Files of buckets that a batch does not touch are made unreadable; the batch goes through."""
    store = ST.Store(str(tmp_path / "store"), 8)
    ST.process_batch(spark, part(some, 0, 1, 2), "first", store, some, X.TODAY)
    one = some.documents.where("arrived = 3 AND app_id = 5").select("doc_id", "arrived")
    assert one.count() > 0
    buckets = store.touched(some.documents.where("app_id = 5"))
    assert len(buckets) == 1
    spoilt = [f for f in glob.glob(f"{tmp_path}/store/*/run=1/**/*.parquet", recursive=True) if f"bucket={buckets[0]}/" not in f]
    assert len(spoilt) > 5
    for f in spoilt:
        with open(f, "wb") as out:
            out.write(b"not parquet")
    ST.process_batch(spark, one, "second", store, some, X.TODAY)
    mine = store.newest(spark, "applications", "app_id", buckets=buckets).where("app_id = 5").first()
    assert mine.n_docs == some.documents.where("app_id = 5 AND arrived <> 3").count() + one.count()
    with pytest.raises(Exception, match="not a Parquet file|FAILED_READ_FILE|CANNOT_READ"):
        ST.documents_of(spark, store).collect()


def test_unknown_documents_are_reported(spark, some, tmp_path):
    store = ST.Store(str(tmp_path / "store"), 4)
    strange = ST.Arrivals(some.documents.where("app_id = 2"), some.stubs.limit(0), some.stub_lines.limit(0), some.statements.limit(0), some.bank_txns.limit(0))
    ST.process_batch(spark, strange.documents.select("doc_id", "arrived"), "x", store, strange, X.TODAY)
    assert {(r.doc_type, r.verdict) for r in ST.documents_of(spark, store).collect()} == {("unknown", "review")}
    assert {r.code for r in ST.findings_of(spark, store)[0].collect()} == {"C_TYPE"}


def test_a_stream_that_fails_again_has_no_result(spark, monkeypatch):
    """The loss that is asked for is repeated; a failure of the repeated stream is raised, not taken for its end."""
    own = spark.range(8).selectExpr("id AS doc_id", "id % 4 AS arrived")
    monkeypatch.setattr(intake, "arrivals", lambda spark, d: ST.Arrivals(own, own, own, own, own))
    done = []

    def run(broken):
        def process(spark, queue, key, store, arrivals, today, before_commit=None):
            before_commit(key)
            if key == broken:
                raise RuntimeError("no space left")
            done.append(key)

        done.clear()
        monkeypatch.setattr(ST, "process_batch", process)
        return intake.run_stream(spark, "nowhere")

    run(None)
    assert done == [f"stream-{i}" for i in range(4)]
    with pytest.raises(StreamingQueryException, match="no space left"):
        run("stream-2")
    assert done == ["stream-0", "stream-1"]
