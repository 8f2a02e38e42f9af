"""Substring deduplication over sliding sentence spans.

A text is cut into sentences. From every sentence on, two runs are hashed to 128 bits, without regard to ASCII case and white space: the
shortest one with at least LEAST_WORDS words, which may be a single long sentence or many short lines, and the shortest one that also has
RUN sentences or more, where it is another. Runs are joined globally by their hash. The first of
equal runs is the one of the smallest document, and in a document the earliest; every sentence covered by a run that is not the first
of its kind is removed.

Inside a document later repeats are found on the spot, so each document sends a run's hash once. The least document of a hash is a
map-side combined minimum, and runs meet it in a plain join, which adaptive execution splits where very many documents share a run.

Defined cases: a null text stays null with nothing removed, an empty one stays empty; a null identifier counts as the largest;
documents with equal identifiers count as one when it comes to who is first; an empty table gives an empty table; extra columns are
carried along by `cleaned`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.common import by_arrow, documents, fresh, id_key, stored, text_digest

RUN = 2
LEAST_WORDS = 20
LARGEST = (1 << 63) - 1
#: Places count sentences in this base; a run has at most so many.
PLACE = 32
#: Between sentences: white space after a closing mark, or a line break.
GAP = re.compile(r"(?<=[.!?…])[ \t\v\f\r]+|[ \t\v\f\r]*\n\s*")


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text; what lies between them is white space."""
    out, at = [], 0
    for gap in [*GAP.finditer(text), None]:
        end = gap.start() if gap else len(text)
        if text[at:end].strip():
            out.append((at, end))
        at = gap.end() if gap else end
    return out


def runs(text: str, spans: list[tuple[int, int]], run: int = RUN, least_words: int = LEAST_WORDS) -> list[tuple[int, bytes]]:
    """(place, hash) of every run; a place is PLACE times the number of the first sentence, plus the number of sentences less one."""
    if max(run, least_words) > PLACE:
        raise ValueError(f"a run may need at most {PLACE} sentences")
    words = [text[a:b].encode("utf-8", "replace").lower().split() for a, b in spans]
    out = []
    for i in range(len(spans)):
        joined: list[bytes] = []
        for n, part in enumerate(words[i:i + max(run, least_words)], 1):  # every sentence has a word at least
            joined = joined + part
            if len(joined) >= least_words:
                out.append((i * PLACE + n - 1, xxhash.xxh3_128_digest(b" ".join(joined))))
                if n >= run:
                    break
    return out


def first_places(found: list[tuple[int, bytes]]) -> tuple[dict[bytes, int], list[int]]:
    """The first place of each hash, and the places that repeat an earlier one."""
    first: dict[bytes, int] = {}
    return first, [i for i, h in found if first.setdefault(h, i) != i]


def cut(text: str, places: list[int], run: int = RUN, least_words: int = LEAST_WORDS) -> tuple[str, int, list[tuple[int, int]]]:
    """The text without the sentences covered by runs at `places` or by repeats inside the text; sentences; removed spans, joined up."""
    spans = sentences(text)
    found = runs(text, spans, run, least_words)
    gone = np.zeros(len(spans), bool)
    for place in [*places, *first_places(found)[1]]:
        i, more = divmod(place, PLACE)
        gone[i:i + more + 1] = True
    removed: list[tuple[int, int]] = []
    for i in np.flatnonzero(gone).tolist():
        to = spans[i + 1][0] if i + 1 < len(spans) else len(text)
        if removed and removed[-1][1] == spans[i][0]:
            removed[-1] = (removed[-1][0], to)
        else:
            removed.append((spans[i][0], to))
    kept, at = [], 0
    for a, b in removed:
        kept.append(text[at:a])
        at = b
    return "".join([*kept, text[at:]]), len(spans), removed


def repeated_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = RUN, least_words: int = LEAST_WORDS) -> DataFrame:
    """(id, digest, place): runs, in order within their text, that a smaller document has as well."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                row, hashes, places = [], [], []
                for i, t in enumerate(b.column(2).to_pylist()):
                    first, _ = first_places(runs(t, sentences(t), run, least_words)) if t else ({}, [])
                    row += [i] * len(first)
                    hashes += first.keys()
                    places += first.values()
                halves = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(places, pa.int32())],
                                                 ["id", "digest", "h1", "h2", "place"])

    keyed = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(LARGEST)).alias("id"), text_digest(F.col(f"`{text}`")).alias("digest"), F.col(f"`{text}`").alias("text"))
    found = stored(by_arrow(keyed, emit, "id long, digest long, h1 long, h2 long, place int"), "sentence-runs")
    first = found.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("h1", "h2", "first")
    return found.join(first, ["h1", "h2"]).where("id > first").select("id", "digest", "place")


def cleaned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = RUN, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of `docs` with their text cut, n_sentences and removed (spans of the old text, in code points). Where `docs` has a column of
    such a name, in whatever case, it is carried along and the new one has an underscore in front."""
    counted, spans_out = fresh(docs, "n_sentences", "removed")
    # the runs of one document: as many as its sentences at most; rows repeated as a whole share them
    places = repeated_runs(docs, doc_id, text, run, least_words).groupBy("id", "digest").agg(F.sort_array(F.collect_set("place")).alias("places"))
    key, digest, list_, seen = fresh(docs, "key", "digest", "places", "seen")
    others = [c for c in docs.columns if c != text]
    keyed = docs.withColumns({key: F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(LARGEST)), digest: text_digest(F.col(f"`{text}`"))})
    met = keyed.join(places.select(F.col("id").alias(key), F.col("digest").alias(digest), F.col("places").alias(list_)), [key, digest], "left").select(
        *[F.col(f"`{c}`") for c in others], F.col(f"`{text}`").alias(seen), list_)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                rows = [(t, 0, []) if t is None else cut(t, p or [], run, least_words)
                        for t, p in zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True)]
                spans = pa.array([[{"start": x, "end": y} for x, y in r[2]] for r in rows], kind)
                yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), spans],
                                                 [*b.schema.names[:-2], text, counted, spans_out])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in met.schema.fields[:-2]] + [f"`{text}` string, `{counted}` long, `{spans_out}` array<struct<start:int,end:int>>"])
    return by_arrow(met, rewrite, schema).select(*[F.col(f"`{c}`") for c in docs.columns], counted, spans_out)


def op9_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", "text", "n_sentences", F.size("removed").cast("long").alias("n_removed"), "removed")
