from tallywright.sources import annotations as A
from tallywright.sources import files as FS
from tallywright.sources import sinks


def test_files_on_disk(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4\n/Linearized 1\n/Producer (PDFKit) /ModDate (D:20240101)\n%%EOF\n%%EOF")
    (tmp_path / "sub" / "b-g.png").write_bytes(b"\x89PNG\r\n\x1a\n....")
    (tmp_path / "c.bin").write_bytes(b"not a document")
    up = FS.read_uploads(spark, str(tmp_path))
    kinds = {r.filename: r.kind for r in up.collect()}
    assert kinds == {"a.pdf": "pdf", "b-g.png": "png", "c.bin": None}
    f = {r.filename: r for r in FS.byte_facts(up).collect()}
    assert (f["a.pdf"].n_eof, f["a.pdf"].linearized, f["a.pdf"].producer, f["a.pdf"].modified, f["a.pdf"].creator) == (2, True, "PDFKit", "D:20240101", None)
    assert (f["c.bin"].n_eof, f["c.bin"].linearized) == (1, False)
    assert [r.forged for r in A.list_files(spark, str(tmp_path), "*.png").collect()] == [False]


def test_supplied_metadata_wins(spark, tmp_path):
    from pyspark.sql import functions as F
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 /Producer (PDFKit)")
    up = FS.read_uploads(spark, str(tmp_path)).withColumn("meta", F.create_map(F.lit("producer"), F.lit("Canva")))
    assert FS.byte_facts(up).first().producer == "Canva"


def test_ocr_tsv(spark, tmp_path):
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n"
    (tmp_path / "w.tsv").write_text(head + "5\t1\t1\t1\t1\t1\t10\t20\t30\t8\t95.5\tGross\n5\t1\t1\t1\t1\t2\t50\t20\t30\t8\t29.9\tlow\n4\t1\t1\t1\t1\t0\t0\t0\t9\t9\t-1\t\n")
    w = FS.read_ocr_words(spark, str(tmp_path / "w.tsv")).selectExpr("1L AS doc_id", "page_num AS page", "word_num AS span_no", "left", "top", "width", "height", "conf", "text")
    s = FS.ocr_spans(w, 0.5).collect()
    assert [(r.text, r.x0, r.y1) for r in s] == [("Gross", 5.0, 14.0)]


def test_manifest_and_zones(spark, tmp_path):
    (tmp_path / "m.csv").write_text(
        'image,forged,forgery annotations\na.png,1,"{\'regions\': [{\'shape_attributes\': {\'name\': \'rect\', \'x\': 1, \'y\': 2, \'width\': 3, \'height\': 4}, '
        '\'region_attributes\': {\'Original area\': \'no\'}}, {\'shape_attributes\': {\'x\': 9, \'y\': 9, \'width\': 1, \'height\': 1}, \'region_attributes\': {\'Original area\': \'yes\'}}]}"\n'
        "b.png,0,0\nc.png,1,broken\n")
    b = A.manifest_boxes(A.read_manifest(spark, str(tmp_path / "m.csv"))).collect()
    assert [tuple(r) for r in b] == [("a.png", 1.0, 2.0, 4.0, 6.0)]
    (tmp_path / "z.xml").write_text('<root><zone x="1" y="2" width="10" height="20"/><zone x="5" y="5" width="1" height="1"></zone></root>')
    z = A.read_zones(spark, str(tmp_path / "z.xml")).orderBy("x0").collect()
    assert [(r.x0, r.y0, r.x1, r.y1) for r in z] == [(1.0, 2.0, 11.0, 22.0), (5.0, 5.0, 6.0, 6.0)]


def test_schema_evolution(spark, tmp_path):
    p = str(tmp_path / "t")
    spark.sql("SELECT 1L AS app_id").write.parquet(p + "/v=1")
    spark.sql("SELECT 2L AS app_id, true AS training_consent").write.parquet(p + "/v=2")
    got = {r.app_id: r.training_consent for r in sinks.read_evolving(spark, p, {"training_consent": False}).collect()}
    assert got == {1: False, 2: True}


def test_repeated_batch_counts_once(spark, tmp_path):
    from conftest import SF
    from tallywright.plans.fixtures import TODAY
    from tallywright.plans.intake import arrivals
    from tallywright.streaming import incremental as ST
    x = arrivals(spark, SF)
    store = ST.Store(str(tmp_path / "s"), 4)
    todo = x.documents.where("doc_id < 50").select("doc_id", "arrived")
    for _ in range(2):
        ST.process_batch(spark, todo, "first", store, x, TODAY)
    assert store.read(spark, "reports").count() == 50
    ST.reanalyze(spark, todo.where("doc_id < 5"), "again", store, x, TODAY)
    assert store.read(spark, "reports").count() == 55
    assert ST.documents_of(spark, store).count() == 50
