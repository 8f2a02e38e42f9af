"""The training sample is bounded in rows."""

from tallywright.llm import line_crf


def test_rows_of_one_identifier(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(line_crf, "SAMPLE_DOCUMENTS", 5)
    monkeypatch.setattr(line_crf, "fit", lambda sequences: sizes.append(sum(isinstance(y, int) for _, y in sequences)))
    docs = spark.createDataFrame([(i if i < 4 else 9, f"Text {i} of a few words.") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (9, 1)], "doc_id long, quality int")
    line_crf.train(docs, labels)
    assert sizes == [5]
