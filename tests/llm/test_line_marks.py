"""Marks of single lines: boilerplate planted into content, and content around which boilerplate stands."""

import numpy as np
from tallywright.llm import line_crf

SF = "/root/testdata/sf0.01"
PLANTED = ["### *** ### $$$ ||| ###", "www.example.com | login | sign up", "$$$ && $$$ %% ## && ||", "12 | 34 | 56 | 78 | 90 | 11", "BUY NOW!!! <<< CLICK >>> *** $$$"]


def mixed_texts(docs, rng):
    """Texts of good documents with planted runs of boilerplate, and the lines planted."""
    out = []
    for r in docs:
        lines, gold = [], []
        for line in r.text.split("\n"):
            lines.append(line)
            gold.append("c" if line.split() else "-")
            if rng.random() < 0.3:
                n = int(rng.integers(2, 6))
                lines += [PLANTED[int(i)] for i in rng.integers(0, len(PLANTED), n)]
                gold += ["b"] * n
        out.append((r.doc_id, "\n".join(lines), "".join(gold)))
    return out


def test_planted_lines(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    chain = line_crf.train(docs, labels.where("doc_id % 2 = 0"))
    good = docs.join(labels.where("doc_id % 2 = 1 and quality = 1"), "doc_id").where("size(split(text, '\n')) >= 3").orderBy("doc_id").collect()
    texts = mixed_texts(good, np.random.default_rng(5))
    marks = {r.doc_id: r for r in line_crf.judged(spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string"), chain).collect()}
    pairs = [(g, m) for d, _, gold in texts for g, m in zip(gold, marks[d].marks, strict=True)]
    hit = sum(p == ("b", "b") for p in pairs)
    recall, precision = hit / sum(g == "b" for g, _ in pairs), hit / sum(m == "b" for _, m in pairs)
    both = np.mean([{"b", "c"} <= set(marks[d].marks) for d, _, gold in texts if "b" in gold])
    print(f"planted lines: recall {recall:.3f}, precision {precision:.3f}, both labels in {both:.3f} of {len(texts)} texts")
    assert recall > 0.9 and precision > 0.85 and both > 0.8
    assert all((g == "-") == (m == "-") for g, m in pairs)


def test_mixed_training_texts_hold_every_line_once():
    good, bad = np.arange(100, 130), np.arange(200, 217)
    (bits, labels), = line_crf.interleaved([(good, 1), (bad, 0), (np.arange(3), 1), (np.zeros(0, int), 0)])
    assert bits[labels == 1].tolist() == good.tolist() and bits[labels == 0].tolist() == bad.tolist()
    assert (np.diff(labels) != 0).sum() > 3
    assert line_crf.interleaved([(good, 1)]) == []


def test_stretch_of_a_long_text():
    text = "\n".join(map(str, range(1000)))
    own = line_crf.stretch(text, 7).split("\n")
    assert len(own) == line_crf.SAMPLE_LINES and own == [str(i) for i in range(int(own[0]), int(own[0]) + len(own))]
    assert line_crf.stretch("a\nb", 7) == "a\nb" and line_crf.stretch(None, 7) == ""


def test_moves_between_labels_are_learned():
    chain = line_crf.fit([(np.array([1, 1, 3, 3, 1, 1]), np.array([0, 0, 1, 1, 0, 0])), (np.array([3, 3, 1]), np.array([1, 1, 0])), (np.array([1, 1]), 0)])
    assert [list(x) for x in line_crf.viterbi([chain.scores(np.array([1, 1, 3, 3]))], chain.move)] == [[0, 0, 1, 1]]
