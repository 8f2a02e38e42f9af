"""Line labelling, weak labels, sentence spans and language ID against slow versions and held-out figures."""

import itertools
import re
import zlib
from collections import Counter

import numpy as np
from conftest import SF
from llm_rows import ROWS, none, odd, schema  # noqa: F401

from tallywright.llm import language_id, line_crf, sentence_spans, weak_labels

SF_MORE = SF.replace("sf0.001", "sf0.01")


def slow_base(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    count = Counter(windows)
    covered = {j for i, x in enumerate(windows) if count[x] > 1 for j in (i, i + 1, i + 2)}
    seen, again = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), again, len(covered)


def test_base_figures(spark, odd, none):
    chain = line_crf.Chain()
    for r in line_crf.judged(odd, chain).collect():
        text = next(x[1] for x in ROWS if x[0] == r.doc_id and (x[0] is not None or len(re.findall(r"\S+", x[1] or "")) == r.n_words))
        assert tuple(r[1:6]) == slow_base(text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed)  # without weights every line is content
    assert line_crf.judged(none, chain).count() == 0
    for t in (None, "", "a a a a", "a b a b a b", "x\nx\n\n\n y\n y\r\n", "\x1c\x85  a", "nbsp\xa0x\n\n"):
        assert line_crf.describe(t)[0] == slow_base(t)


def test_viterbi_finds_the_best_labelling():
    rng = np.random.default_rng(3)
    sequences = [rng.normal(size=n) for n in (0, 1, 2, 5, 8, 8)]
    move = rng.normal(size=(2, 2))
    for scores, got in zip(sequences, line_crf.viterbi(sequences, move), strict=True):
        def value(labels, scores=scores):
            return sum(s * y for s, y in zip(scores, labels, strict=True)) + sum(move[a, b] for a, b in itertools.pairwise(labels))
        if len(scores):
            assert np.isclose(value(got), max(value(p) for p in itertools.product((0, 1), repeat=len(scores))))
        else:
            assert len(got) == 0


def test_gradient_reaches_a_separating_chain():
    chain = line_crf.fit([(np.array([1, 1, 3]), 1), (np.array([5, 5]), 0), (np.array([1]), 1), (np.array([5, 4, 5, 5]), 0)])
    assert [list(x) for x in line_crf.viterbi([chain.scores(np.array(b)) for b in ([1, 3], [5, 5, 5])], chain.move)] == [[1, 1], [0, 0, 0]]
    assert not line_crf.fit([]).emit.any()


def test_line_labels_on_documents_not_trained_on(spark):
    docs, labels = (spark.read.parquet(f"{SF_MORE}/{t}.parquet") for t in ("documents", "labels"))
    chain = line_crf.train(docs, labels.where("doc_id % 2 = 0"))
    rows = line_crf.judged(docs, chain).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.2
    assert not line_crf.train(docs, labels.limit(0)).emit.any()


def test_weak_labels(spark, odd, none):
    docs, labels = (spark.read.parquet(f"{SF_MORE}/{t}.parquet") for t in ("documents", "labels"))
    weights, belief, rate = weak_labels.train(docs)
    assert (rate[:, 1] > rate[:, 0]).all()  # every labeller votes good more often on good documents
    rows = weak_labels.scored(docs, weights, belief).join(labels, "doc_id").collect()
    assert np.mean([r.kept for r in rows if r.quality == 1]) > 0.98 and np.mean([r.kept for r in rows if r.quality == 0]) < 0.1
    assert weak_labels.scored(odd, weights, belief).count() == len(ROWS)
    assert all(r.kept is False and r.score == 0 for r in weak_labels.scored(odd, weights, belief).where("doc_id in (3, 4)").collect())
    empty, belief, _ = weak_labels.train(none)
    assert not empty.any() and belief == {} and weak_labels.scored(none, empty, belief).count() == 0


def test_em_finds_the_planted_accuracies():
    rng = np.random.default_rng(2)
    truth = rng.random(40_000) < 0.7
    hit = np.linspace(0.6, 0.95, len(weak_labels.LABELLERS))
    votes = Counter()
    for y in truth:
        right, silent = rng.random(len(hit)) < hit, rng.random(len(hit)) < 0.2
        votes["".join("-" if s else "g" if r == y else "b" for r, s in zip(right, silent, strict=True))] += 1
    share, rate, _ = weak_labels.accuracies(votes)
    assert abs(share - 0.7) < 0.02 and np.abs(rate[:, 1] - hit).max() < 0.03 and np.abs(rate[:, 0] - (1 - hit)).max() < 0.04


def slow_clean(rows):
    """Sentences covered by a run that a smaller document, or an earlier place, has as well."""
    first, out = {}, []
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        s = [t[a:b] for a, b in sentence_spans.sentences(t or "")]
        gone = set()
        plain = [" ".join(x.lower().split()) for x in s]
        for i in range(len(s)):
            # the shortest run with enough words, and the shortest one that also has enough sentences
            ends = [k for k in range(i + 1, len(s) + 1) if len(" ".join(plain[i:k]).split()) >= sentence_spans.LEAST_WORDS]
            for end in {*ends[:1], *[k for k in ends if k - i >= sentence_spans.RUN][:1]}:
                if first.setdefault(" ".join(plain[i:end]), (d, i)) != (d, i):
                    gone |= set(range(i, end))
        out.append((d, [x for i, x in enumerate(s) if i not in gone], len(gone)))
    return out


def test_sentence_spans(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r for r in sentence_spans.op9_sentence_spans(spark, SF).collect()}
    removed = 0
    for d, kept, gone in slow_clean(rows):
        assert [got[d].text[a:b] for a, b in sentence_spans.sentences(got[d].text)] == kept
        removed += gone > 0
        if not gone:
            assert got[d].text == dict(rows)[d]
    assert removed > 10
    assert sentence_spans.cleaned(none).count() == 0
    out = sentence_spans.cleaned(odd)
    assert out.columns[:len(odd.columns)] == odd.columns and out.count() == len(ROWS)
    by_id = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    assert by_id[3].text is None and by_id[4].text == "" and by_id[7].text == "" and by_id[6].text.count("Long") <= 3


def test_sentence_spans_of_a_passage(spark):
    passage = "The first of these sentences is here. The second one follows it right away! Is there a third one? There is, and it is rather long as well."
    docs = spark.createDataFrame([(1, f"Begin. {passage} End."), (2, f"{passage} Other words."), (3, "Nothing of that."), (4, f"Mine.\n{passage.upper()}")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in sentence_spans.cleaned(docs).collect()} == {1: f"Begin. {passage} End.", 2: "Other words.", 3: "Nothing of that.", 4: "Mine.\n"}


def slow_trigrams(text):
    symbols = []
    for c in f"\n{text.lower()}\n":
        if c.isalpha():
            symbols.append(ord(c))
        elif not symbols or symbols[-1]:
            symbols.append(0)
    return Counter(zip(symbols, symbols[1:], symbols[2:], strict=False))


def test_language_bundles():
    texts = ["Hello, World", "", None, "12 !", "Ünïcödé ß 中文", "a", "hello hello hello " * 50]
    for t, row in zip(texts, language_id.bundles(texts), strict=True):
        want = np.zeros(language_id.DIMENSIONS)
        for (a, b, c), n in slow_trigrams(t or "").items():
            want += n * np.roll(language_id.letter_vector(a), 2).astype(int) * np.roll(language_id.letter_vector(b), 1) * language_id.letter_vector(c)
        assert (row == (want if any(ch.isalpha() for ch in t or "") else 0)).all()


def test_language_id(spark, odd, none):
    docs = spark.read.parquet(f"{SF_MORE}/documents.parquet")
    rows = language_id.op10_language_id(spark, SF_MORE).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == r.lang for r in rows if r.held_out]) > 0.98
    prototypes = language_id.learn(docs)
    told = language_id.identified(odd, prototypes)
    assert told.count() == len(ROWS) and {r.lang_pred for r in told.where("doc_id in (3, 4, 5, 9)").collect()} == {"und"}
    assert {r.lang_pred for r in language_id.identified(odd, language_id.learn(none)).collect()} == {"und"}
    assert language_id.identified(none, prototypes).count() == 0
