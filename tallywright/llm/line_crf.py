"""Quality rules over line sequences: a linear-chain conditional random field marks every line as content or boilerplate.

A line is described by FEATURES yes-or-no features; a two-label chain scores them together with the transitions between neighbouring
lines, and Viterbi decoding finds the best labelling of the whole text. A document stays if it passes the base rules and at least
KEEP_SHARE of its words stand in content lines.

Weights are fitted here, by gradient ascent on the conditional likelihood, to a bounded sample of labelled documents: SAMPLE_DOCUMENTS
of them, chosen by a hash of the identifier, and of each a stretch of at most SAMPLE_LINES lines, whose place is drawn from the identifier.
Lines of documents of quality 1 count as content, of quality 0 as boilerplate. So that labels change within a text, stretches of the one
kind are interleaved with stretches of the other (`interleaved`); the chain learns from these mixed texts and from the whole ones.
Decoding runs over every line of every document, many documents side by side; `judged` returns the mark of every line.

Defined cases: a null or empty text has no words, fails the base rules and is dropped; without labelled documents every line counts
as content and the base rules alone decide; of two scores that are equal the label content wins; repeated rows are separate documents;
null identifiers are not learned from; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.common import by_arrow, documents

SAMPLE_DOCUMENTS, SAMPLE_LINES = 3000, 200
KEEP_SHARE = 0.5
#: Longest stretch of one label inside a mixed training text.
STRETCH = 4
SPACES, SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
NOTICE = re.compile(r"https?:|www\.|@\w|©|\b(?:copyright|licen[cs]ed?|cookies?|privacy|subscribe|newsletter|log ?in|sign ?up|javascript|all rights)\b", re.IGNORECASE)
WORDLESS = re.compile(rb"[^A-Za-z\x80-\xff]+\Z").match
#: Marks that stand twice at the end of a word.
DOUBLED = tuple(bytes((c, c)) for c in b"!?#*$%&|<>=-_~")
FEATURES = 16


# ---- features of lines and texts

@cache
def character_kinds() -> np.ndarray:
    """For every code point: 1 if a letter, plus 2 if upper case, plus 4 if a digit."""
    return np.fromiter((c.isalpha() + 2 * c.isupper() + 4 * c.isdigit() for c in map(chr, range(0x110000))), np.uint8, 0x110000)


def kinds_by_line(lines: list[str]) -> np.ndarray:
    """Letters, upper-case letters and digits of each line, as rows."""
    kinds = character_kinds()[np.frombuffer("\n".join([*lines, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)]
    ends = np.cumsum([len(line) + 1 for line in lines])
    starts = np.r_[0, ends[:-1]]
    return np.stack([np.add.reduceat(kinds & bit, starts, dtype=np.int64) // bit for bit in (1, 2, 4)], axis=1)


def line_features(line: str, words: list[bytes], again: bool, letters: int, upper: int, digits: int) -> int:
    """The features of a line with words, as bits."""
    n, chars = len(words), len(line)
    symbols = sum(line.count(c) for c in SYMBOLS)
    tests = (
        True, n < 3, n >= 8, n >= 25,
        symbols * 50 > chars, symbols * 10 > chars, letters * 10 < chars * 6, again,
        2 * upper > letters > 0, 5 * digits > chars,
        line.rstrip(SPACES).endswith((".", "!", "?", "…")), 2 * len(set(words)) < n, 4 * sum(w.endswith(DOUBLED) or WORDLESS(w) is not None for w in words) > n,
        chars > 13 * n, chars < 3 * n, NOTICE.search(line) is not None,
    )
    return sum(1 << i for i, t in enumerate(tests) if t)


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of three words that the text has at least twice."""
    if len(words) < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    v = len(numbers)
    pair = ids[:-1] * v + ids[1:]
    if v >= 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    _, which, counts = np.unique(pair[:-1] * v + ids[2:], return_inverse=True, return_counts=True)
    again = counts[which] > 1
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift:shift + len(again)] |= again
    return int(covered.sum())


def describe(text: str | None) -> tuple[tuple[int, ...], np.ndarray, np.ndarray, np.ndarray]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), and features, word counts and numbers of the lines that have words."""
    text = text or ""
    words = text.encode("utf-8", "replace").split()
    seen: set[str] = set()
    bits, sizes, numbers, again = [], [], [], 0
    lines = text.split("\n")
    for number, (line, kinds) in enumerate(zip(lines, kinds_by_line(lines).tolist(), strict=True)):
        own = line.encode("utf-8", "replace").split()
        if own:
            old = line in seen
            again += old
            seen.add(line)
            bits.append(line_features(line, own, old, *kinds))
            sizes.append(len(own))
            numbers.append(number)
    base = (len(words), len(text) - sum(text.count(c) for c in SPACES), sum(text.count(c) for c in SYMBOLS), again, repeated_words(words))
    return base, np.array(bits, np.int64), np.array(sizes, np.int64), np.array(numbers, np.int64)


def stretch(text: str | None, doc_id: int) -> str:
    """At most SAMPLE_LINES neighbouring lines of a text, from a place drawn from the identifier."""
    lines = (text or "").split("\n")
    at = zlib.crc32(str(doc_id).encode()) % max(len(lines) - SAMPLE_LINES + 1, 1)
    return "\n".join(lines[at:at + SAMPLE_LINES])


def as_matrix(bits: np.ndarray) -> np.ndarray:
    return (bits[:, None] >> np.arange(FEATURES) & 1).astype(np.float64)


# ---- the chain

class Chain:
    """emit[f] and move[a, b]: weights of a feature for label 1 (content) over 0, and of label a followed by b."""

    def __init__(self, emit: np.ndarray | None = None, move: np.ndarray | None = None):
        self.emit = np.zeros(FEATURES) if emit is None else emit
        self.move = np.zeros((2, 2)) if move is None else move

    def scores(self, bits: np.ndarray) -> np.ndarray:
        return as_matrix(bits) @ self.emit


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sequences of numbers as columns of one array, the longest first, and their lengths in that order."""
    lengths = np.array([len(r) for r in rows])
    out = np.zeros((int(lengths.max(initial=0)), len(rows)))
    for i, r in enumerate(rows):
        out[:len(r), i] = r
    return out, lengths


def viterbi(scores: list[np.ndarray], move: np.ndarray) -> list[np.ndarray]:
    """The best labels of each sequence of label-1 scores; a tie goes to label 1.

    Sequences advance together, one line a step, those of like length side by side.
    """
    order = np.argsort([-len(s) for s in scores], kind="stable")
    labels: list[np.ndarray] = [np.zeros(0, np.int8)] * len(scores)
    for at in range(0, len(order), 512):
        own = order[at:at + 512]
        grid, lengths = padded([scores[i] for i in own])
        steps = len(grid)
        back = np.zeros((steps, 2, len(own)), np.int8)
        best = np.stack([np.zeros(len(own)), grid[0]]) if steps else np.zeros((2, len(own)))
        for t in range(1, steps):
            live = int(np.searchsorted(-lengths, -t))  # sequences longer than t come first
            from0, from1 = best[0, :live] + move[0][:, None], best[1, :live] + move[1][:, None]
            back[t, :, :live] = from1 >= from0
            best[:, :live] = np.maximum(from0, from1)
            best[1, :live] += grid[t, :live]
        now = (best[1] >= best[0]).astype(np.int8)
        out = np.zeros((steps, len(own)), np.int8)
        for t in range(steps - 1, -1, -1):
            live = int(np.searchsorted(-lengths, -t))
            out[t, :live] = now[:live]
            now[:live] = back[t][now[:live], np.arange(live)]
        for k, i in enumerate(own):
            labels[i] = out[:lengths[k], k]
    return labels


def interleaved(sequences: list[tuple[np.ndarray, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Mixed texts: stretches of one to STRETCH lines of a sequence with label 1 alternate with such of one with label 0, in order, until
    one of the two is used up; the rest of the other ends the text. The draws depend on the place in the list alone."""
    kinds = [[bits for bits, y in sequences if y == label and len(bits)] for label in (0, 1)]
    out = []
    for k, pair in enumerate(zip(*kinds, strict=False)):
        rng = np.random.default_rng(k)
        at, label, parts = [0, 0], int(rng.integers(2)), []
        while min(len(pair[0]) - at[0], len(pair[1]) - at[1]) > 0:
            part = pair[label][at[label]:at[label] + int(rng.integers(1, STRETCH + 1))]
            parts.append((part, label))
            at[label] += len(part)
            label = 1 - label
        parts += [(pair[y][at[y]:], y) for y in (0, 1) if at[y] < len(pair[y])]
        out.append((np.concatenate([part for part, _ in parts]), np.concatenate([np.full(len(part), y) for part, y in parts])))
    return out


def fit(sequences: list[tuple[np.ndarray, int | np.ndarray]], rounds: int = 200, rate: float = 0.5, decay: float = 1e-3) -> Chain:
    """Maximum conditional likelihood by gradient ascent with momentum; a sequence of features has one label for all its lines, or one for each."""
    sequences = sorted((s for s in sequences if len(s[0])), key=lambda s: -len(s[0]))
    if not sequences:
        return Chain()
    features = [as_matrix(bits) for bits, _ in sequences]
    lengths = np.array([len(f) for f in features])
    steps, n, total = int(lengths[0]), len(sequences), int(lengths.sum())
    cube, gold = np.zeros((steps, n, FEATURES)), np.zeros((steps, n))
    gold_move = np.zeros((2, 2))
    for i, (f, (_, y)) in enumerate(zip(features, sequences, strict=True)):
        cube[:len(f), i] = f
        gold[:len(f), i] = y
        own = gold[:len(f), i].astype(int)
        np.add.at(gold_move, (own[:-1], own[1:]), 1)
    live = [int(np.searchsorted(-lengths, -t)) for t in range(steps)]
    gold_emit = np.einsum("tnf,tn->f", cube, gold)
    emit, move = np.zeros(FEATURES), np.zeros((2, 2))
    pull_emit, pull_move = np.zeros(FEATURES), np.zeros((2, 2))
    for _ in range(rounds):
        grid = cube @ emit
        ahead = np.zeros((steps, 2, n))
        ahead[0, 1] = grid[0]
        for t in range(1, steps):
            k = live[t]
            ahead[t, :, :k] = np.logaddexp(ahead[t - 1, 0, :k] + move[0][:, None], ahead[t - 1, 1, :k] + move[1][:, None])
            ahead[t, 1, :k] += grid[t, :k]
        after = np.zeros((steps, 2, n))
        want_move = np.zeros((2, 2))
        last = lengths - 1
        whole = np.logaddexp(ahead[last, 0, np.arange(n)], ahead[last, 1, np.arange(n)])
        for t in range(steps - 2, -1, -1):
            k = live[t + 1]
            ahead_one = np.stack([after[t + 1, 0, :k], after[t + 1, 1, :k] + grid[t + 1, :k]])
            for a in (0, 1):
                both = ahead_one + move[a][:, None]
                after[t, a, :k] = np.logaddexp(both[0], both[1])
                want_move[a] += np.exp(ahead[t, a, :k] + both - whole[:k]).sum(axis=1)
        on = np.exp(ahead[:, 1] + after[:, 1] - whole)
        for t in range(steps):
            on[t, live[t]:] = 0
        pull_emit = 0.9 * pull_emit + (gold_emit - np.einsum("tnf,tn->f", cube, on)) / total - decay * emit
        pull_move = 0.9 * pull_move + (gold_move - want_move) / total - decay * move
        emit, move = emit + rate * pull_emit, move + rate * pull_move
    return Chain(emit, move)


# ---- the operator

def train(docs: DataFrame, labels: DataFrame) -> Chain:
    """A chain fitted to the bounded sample described above."""
    sample = (labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCUMENTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = [describe(stretch(t, d))[1].tolist() for d, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lines, pa.list_(pa.int32()))], ["doc_id", "quality", "bits"])

    # an identifier may have any number of rows: cut again, by rows, in the same order
    chosen = (docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(SAMPLE_DOCUMENTS)
              .select("doc_id", "quality", "text"))
    rows = by_arrow(chosen, run, "doc_id long, quality int, bits array<int>").collect()  # at most SAMPLE_DOCUMENTS rows, SAMPLE_LINES numbers each
    whole = [(np.array(r.bits, np.int64), r.quality) for r in sorted(rows, key=lambda r: (r.doc_id, r.bits))]
    return fit([*whole, *interleaved(whole)])


def judged(docs: DataFrame, chain: Chain, keep_share: float = KEEP_SHARE) -> DataFrame:
    """One row a document: the base figures, content_lines, content_share, base_failed and kept, and marks: a letter for every line of
    the text (split at line feeds), c for content, b for boilerplate and - for a line without words."""
    schema = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
              "n_lines long, content_lines long, content_share double, kept boolean, marks string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                told = [describe(t.as_py()) for t in b.column(1)]
                marks = viterbi([chain.scores(bits) for _, bits, _, _ in told], chain.move)
                rows = []
                for text, (base, bits, sizes, numbers), on in zip(b.column(1).to_pylist(), told, marks, strict=True):
                    share = float((sizes * on).sum() / sizes.sum()) if len(sizes) else 0.0
                    failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
                    letters = np.full((text or "").count("\n") + 1, ord("-"), np.uint8)
                    letters[numbers] = np.where(on == 1, ord("c"), ord("b"))
                    rows.append((*base, failed, len(bits), int(on.sum()), share, not failed and share >= keep_share, letters.tobytes().decode("ascii")))
                columns = list(zip(*rows, strict=True)) if rows else [()] * 11
                kinds = [pa.int64()] * 5 + [pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.string()]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [c.split()[0] for c in schema.split(", ")])

    return by_arrow(docs.select("doc_id", "text"), run, schema)


def op1_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return judged(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
