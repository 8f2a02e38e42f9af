"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or not at all on every document. Expectation-maximisation over the counts of vote
patterns (at most 3^LABELLERS, over all documents) estimates how often each labeller votes good on good and on bad documents; that
gives every pattern the probability of being good. These posterior labels train a linear scorer over hashed features: character
trigrams and a few graded facts of the text. The scorer judges every document, also where all labellers abstain.

Pattern counts cover all documents. The scorer alone is fitted to a bounded sample: the SAMPLE documents with the least hash of their
identifier, whose features (BUCKETS numbers each) meet on the driver.

Defined cases: a null or empty text gets no votes and score 0, and is dropped; without any document nothing is learned; a tie of
hashes is broken by identifier; repeated rows are separate documents (in the sample as well); null identifiers are not sampled; an
empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.common import by_arrow, documents, stored
from tallywright.llm.line_crf import DOUBLED, SPACES, SYMBOLS, WORDLESS, kinds_by_line, repeated_words

SAMPLE = 3000
BUCKETS = 4096
PIECE = 1_000_000
#: Words that only part others, as in menus.
SEPARATORS = frozenset(m.encode() for m in ("|", "/", "\\", "-", "–", "—", "·", "•", "»", ">", "::", "||"))
GOOD, BAD, NONE = "g", "b", "-"
#: (fact, votes good up to, votes bad from); a labeller whose first bound is the larger one reads the fact the other way round.
LABELLERS = (
    ("symbol_share", 0.01, 0.05),
    ("doubled_share", 0.02, 0.2),
    ("upper_share", 0.15, 0.5),
    ("wordless_share", 0.05, 0.2),
    ("separator_share", 0.05, 0.2),
    ("repeated_share", 0.2, 0.5),
    ("distinct_share", 0.35, 0.2),
    ("closed_lines", 0.6, 0.1),
    ("letter_share", 0.7, 0.55),
    ("copied_lines", 0.1, 0.4),
)


def facts(text: str) -> dict[str, float]:
    """Shares in 0 .. 1 that the labellers look at."""
    words = text.encode("utf-8", "replace").split()
    n, chars = len(words) or 1, len(text) or 1
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    letters, upper, _ = kinds_by_line([text])[0].tolist()
    return {
        "symbol_share": sum(text.count(c) for c in SYMBOLS) / chars,
        "doubled_share": sum(w.endswith(DOUBLED) for w in words) / n,
        "upper_share": upper / (letters or 1),
        "wordless_share": sum(WORDLESS(w) is not None for w in words) / n,
        "separator_share": sum(w in SEPARATORS for w in words) / n,
        "repeated_share": repeated_words(words) / n,
        "distinct_share": len(set(words)) / n,
        "closed_lines": sum(line.rstrip(SPACES).endswith((".", "!", "?", "…")) for line in lines) / (len(lines) or 1),
        "letter_share": letters / chars,
        "copied_lines": 1 - len(set(lines)) / (len(lines) or 1),
    }


def votes(found: dict[str, float]) -> str:
    out = []
    for name, good, bad in LABELLERS:
        x = found[name]
        out.append(GOOD if (x <= good if good < bad else x >= good) else BAD if (x >= bad if good < bad else x <= bad) else NONE)
    return "".join(out)


def features(text: str, found: dict[str, float]) -> np.ndarray:
    """BUCKETS numbers of length 1: square roots of the counts of hashed trigrams, and the graded facts."""
    counts = np.zeros(BUCKETS)
    for at in range(0, len(text), PIECE):
        c = np.frombuffer(text[at:at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        mixed = (c[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ c[2:] * np.uint64(0x165667B19E3779F9)) * np.uint64(0xD6E8FEB86659FD93)
        counts += np.bincount((mixed >> np.uint64(40)).astype(np.int64) % (BUCKETS - 128), minlength=BUCKETS)
    row = np.sqrt(counts)
    row /= np.linalg.norm(row) or 1
    for k, (name, _, _) in enumerate(LABELLERS):
        row[BUCKETS - 128 + 11 * k + round(10 * min(1.0, max(0.0, found[name])))] = 0.5
    return row


def accuracies(patterns: dict[str, int], rounds: int = 200) -> tuple[float, np.ndarray, dict[str, float]]:
    """(share of good documents, chance of a good vote on bad and on good documents, chance of being good by pattern).

    Votes are independent given the class, and abstaining says nothing. Starts from the majority of each pattern's votes.
    """
    names = sorted(patterns)
    if not names:
        return 0.5, np.full((len(LABELLERS), 2), 0.5), {}
    n = np.array([patterns[p] for p in names], float)
    cast = np.array([[v != NONE for v in p] for p in names], float)
    good = np.array([[v == GOOD for v in p] for p in names], float)
    majority = (good.sum(1) + 1) / (cast.sum(1) + 2)
    belief = np.where(majority > 0.5, 0.9, np.where(majority < 0.5, 0.1, 0.5))
    for _ in range(rounds):
        weight = np.stack([n * (1 - belief), n * belief])
        share = float(np.clip((weight[1].sum() + 1) / (n.sum() + 2), 1e-4, 1 - 1e-4))
        rate = np.clip(((weight @ good + np.array([[1.0], [3.0]])) / (weight @ cast + 4)), 1e-3, 1 - 1e-3)
        log = good @ np.log(rate).T + (cast - good) @ np.log(1 - rate).T + np.log([1 - share, share])
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -60, 60)))
        if np.abs(new - belief).max() < 1e-9:
            break
        belief = new
    return share, rate.T, dict(zip(names, belief.tolist(), strict=True))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 2.0, decay: float = 1e-4) -> np.ndarray:
    """Weights (the last one is the constant) of a logistic scorer for probabilities y; both classes weigh the same in total."""
    w, pull = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    if not len(x):
        return w
    weight = np.where(y > 0.5, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum()))
    for _ in range(rounds):
        error = weight * (y - 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -60, 60))))
        pull = 0.9 * pull + np.r_[x.T @ error, error.sum()] - decay * w
        w = w + rate * pull
    return w


def vote(docs: DataFrame) -> DataFrame:
    """(doc_id, votes) of every document; null where there is no text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([votes(facts(t.as_py())) if t.as_py() else None for t in b.column(1)], pa.string())], ["doc_id", "votes"])

    return by_arrow(docs.select("doc_id", "text"), run, "doc_id long, votes string")


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, dict[str, float], np.ndarray]:
    """(weights of the scorer, chance of being good by pattern, accuracies of the labellers)."""
    voted = stored(vote(docs), "votes")
    counts = {r.votes: r.n for r in voted.where("votes is not null").groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    _, rate, belief = accuracies(counts)
    chosen = voted.where("votes is not null and doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                found = facts(t)
                row = features(t, found)
                rows.append((votes(found), np.flatnonzero(row).astype(np.int32), row[np.flatnonzero(row)].astype(np.float32)))
            pattern, at, value = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pattern, pa.string()), pa.array(at, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))], ["doc_id", "votes", "at", "value"])

    met = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("length(text) > 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = by_arrow(met, run, "doc_id long, votes string, at array<int>, value array<float>").collect()  # `sample` rows at most
    rows.sort(key=lambda r: (r.doc_id, r.votes, r.at))
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, r in enumerate(rows):
        x[i, r.at] = r.value
    return fit(x, np.array([belief[r.votes] for r in rows])), belief, rate


def scored(docs: DataFrame, weights: np.ndarray, belief: dict[str, float]) -> DataFrame:
    """(doc_id, votes, posterior, score, kept) of every document; kept from a score of one half."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pattern, posterior, score = [], [], []
            for t in b.column(1).to_pylist():
                found = facts(t) if t else None
                pattern.append(votes(found) if found else None)
                posterior.append(belief.get(pattern[-1]) if found else None)
                score.append(1 / (1 + float(np.exp(-np.clip(features(t, found) @ weights[:-1] + weights[-1], -60, 60)))) if found else 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pattern, pa.string()), pa.array(posterior, pa.float64()), pa.array(score, pa.float64()), pa.array([s >= 0.5 for s in score], pa.bool_())],
                                             ["doc_id", "votes", "posterior", "score", "kept"])

    return by_arrow(docs.select("doc_id", "text"), run, "doc_id long, votes string, posterior double, score double, kept boolean")


def op5_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    weights, belief, _ = train(docs)
    return scored(docs, weights, belief)
