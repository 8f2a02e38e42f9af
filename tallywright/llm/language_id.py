"""Language identification with hyperdimensional profiles.

Every letter has a random vector of DIMENSIONS signs, drawn from the seed and its code point alone. A trigram binds the vectors of its
letters, permuted by their place (a rotation), with an elementwise product; a document bundles (adds up) the vectors of all its
trigrams, and a language bundles its documents, each scaled to the same length. The predicted language is the prototype with the
largest cosine. Bundling is linear, so a batch of documents is its matrix of trigram counts times the matrix of trigram vectors.

Letters are lower-cased; every run of other characters counts as one boundary symbol, and a text has one at either end. Texts longer
than PIECE characters are bundled piece by piece, each with its own boundaries. Prototypes are sums of whole numbers, so the order in
which tasks arrive does not matter; one row a task, language and dimension is all that is shuffled, and languages x DIMENSIONS numbers
reach the driver.

Defined cases: a null text or one without letters is `und` with score 0, as is every text if nothing could be learned; rows with a
null language are not learned from; a null identifier has the text '' for the split (held out); ties go to the language that sorts
first; repeated rows are separate documents; an empty table gives an empty table; extra columns are carried along by `identified`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.common import by_arrow, documents, fresh

DIMENSIONS = 1024
SEED = 20
FOLDS = 5
PIECE = 1_000_000
UNIT = 1_000_000
UNKNOWN = "und"
_IS_LETTER: list[np.ndarray] = []
_LETTERS: dict[int, np.ndarray] = {}


def is_letter(code_points: np.ndarray) -> np.ndarray:
    if not _IS_LETTER:
        _IS_LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _IS_LETTER[0][code_points]


def letter_vector(code_point: int) -> np.ndarray:
    """The signs of a letter; code point 0 is the boundary."""
    if code_point not in _LETTERS:
        if len(_LETTERS) > 20_000:
            _LETTERS.clear()
        raw = np.random.PCG64([SEED, code_point]).random_raw(DIMENSIONS // 64)
        _LETTERS[code_point] = np.unpackbits(raw.view(np.uint8)).astype(np.int8) * 2 - 1
    return _LETTERS[code_point]


def trigrams(pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per occurrence the number of its piece and of its trigram, and the trigrams themselves as rows of three code points."""
    lowered = [f"\n{p.lower()}\n" for p in pieces]
    symbols = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(p) for p in lowered])
    letter = is_letter(symbols)
    start = np.zeros(len(symbols), bool)
    start[np.cumsum(lengths) - lengths] = True
    keep = letter | start
    keep[1:] |= letter[:-1]
    piece = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)[keep]
    alphabet, small = ranked(np.where(letter, symbols, 0)[keep])
    k = len(alphabet)
    small = small.astype(np.int64)
    whole = piece[2:] == piece[:-2]
    code = ((small[:-2] * k + small[1:-1]) * k + small[2:])[whole]
    if k ** 3 <= 1 << 22:
        present = np.flatnonzero(np.bincount(code, minlength=k ** 3))
        rank = np.zeros(k ** 3, np.int32)
        rank[present] = np.arange(len(present))
        number = rank[code]
    else:
        present, number = np.unique(code, return_inverse=True)
    return piece[2:][whole], number, alphabet[np.stack([present // (k * k), present // k % k, present % k], axis=1)]


def ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with inverse for code points, by a table instead of a sort."""
    seen = np.zeros(0x110000, bool)
    seen[values] = True
    alphabet = np.flatnonzero(seen)
    rank = np.zeros(0x110000, np.int32)
    rank[alphabet] = np.arange(len(alphabet))
    return alphabet, rank[values]


def bundles(texts: list[str | None]) -> np.ndarray:
    """One row of DIMENSIONS sums a text; zeros if it has no letters. The sums are whole and exact in 32-bit floats up to 2^24."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    pieces, owner, filled = [], [], 0
    for i, t in enumerate([*texts, None]):
        for at in range(0, len(t or ""), PIECE):
            pieces.append(t[at:at + PIECE])
            owner.append(i)
            filled += len(pieces[-1])
        if pieces and (filled >= PIECE or i == len(texts)):
            _bundle(pieces, owner, out)
            pieces, owner, filled = [], [], 0
    return out


def _bundle(pieces: list[str], owner: list[int], out: np.ndarray) -> None:
    piece, number, grams = trigrams(pieces)
    has_letter = np.flatnonzero(np.any(grams != 0, axis=1))
    if not len(has_letter):
        return
    alphabet, which = np.unique(grams, return_inverse=True)
    letters = np.stack([letter_vector(int(c)) for c in alphabet])
    a, b, c = which.reshape(grams.shape).T
    vectors = (np.roll(letters, 2, axis=1)[a] * np.roll(letters, 1, axis=1)[b] * letters[c]).astype(np.float32)
    v = len(grams)
    step = max(1, (1 << 21) // v)
    edges = np.searchsorted(piece, np.arange(0, len(pieces) + step, step))
    for n, at in enumerate(range(0, len(pieces), step)):
        rows = min(step, len(pieces) - at)
        one = slice(edges[n], edges[n + 1])
        counts = np.bincount((piece[one] - at).astype(np.int64) * v + number[one], minlength=rows * v).reshape(rows, v).astype(np.float32)
        np.add.at(out, owner[at:at + rows], counts @ vectors)


def unit_rows(sums: np.ndarray) -> np.ndarray:
    norm = np.sqrt((sums.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return sums / np.where(norm > 0, norm, 1)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Prototypes by language, of unit length, from all rows with a language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for part in slices(b):
                langs = np.array(part.column(1).to_pylist(), object)
                scaled = np.rint(unit_rows(bundles(part.column(0).to_pylist())) * UNIT).astype(np.int64)
                for name in set(langs):
                    sums[name] = sums.get(name, 0) + scaled[langs == name].sum(axis=0)
        for name, row in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * DIMENSIONS), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(row)], ["lang", "dim", "value"])

    labelled = docs.where(F.col(f"`{lang}`").isNotNull()).select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
    sums = by_arrow(labelled, run, "lang string, dim int, value long").groupBy("lang", "dim").agg(F.sum("value").alias("value")).collect()
    out: dict[str, np.ndarray] = {}
    for r in sums:  # languages x DIMENSIONS rows
        out.setdefault(r.lang, np.zeros(DIMENSIONS))[r.dim] = r.value
    return {name: row for name in sorted(out) for row in unit_rows(out[name][None, :]) if row.any()}


def identified(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", keep_text: bool = True,
               names_out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The rows of `docs` with the predicted language and its score, under the names given; columns of these names give way."""
    docs = docs.drop(*names_out)
    names, matrix = list(prototypes), np.stack([*prototypes.values(), np.zeros(DIMENSIONS)])[:-1].T
    seen, = fresh(docs, "seen")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):
                texts = part.column(part.num_columns - 1).to_pylist()
                sums = bundles(texts)
                pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if names:
                    cosine = unit_rows(sums) @ matrix
                    best = cosine.argmax(axis=1)
                    known = sums.any(axis=1)
                    pred = [names[i] if k else UNKNOWN for i, k in zip(best, known, strict=True)]
                    score = np.where(known, np.clip(cosine.max(axis=1), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                                                 [*part.schema.names[:-1], *names_out])

    carried = [F.col(f"`{c}`") for c in docs.columns if keep_text or c != text]
    frame = docs.select(*carried, F.col(f"`{text}`").alias(seen))
    fields = [*frame.schema.fields[:-1]]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"`{names_out[0]}` string, `{names_out[1]}` double"])
    return by_arrow(frame, run, schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    prototypes = learn(docs.where(~F.col("held_out")))
    return identified(docs.select("doc_id", "held_out", "text"), prototypes, keep_text=False)
