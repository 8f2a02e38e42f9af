"""Token ids in files compressed by an adaptive, context-mixing range coder.

A block holds whole documents. Its ids are dealt into up to LANES lanes, each a stretch of consecutive ids with a range coder of its
own; lanes advance side by side and share one adaptive model, so numpy codes a whole row of lanes at once. Before each row the model
gives three predictions of every lane's next id:

* order 0: frequencies of all ids so far, renewed when the rows coded have doubled and at every RENEW-th row;
* order 1: the id that followed the last id most recently (kept while it is confirmed);
* order 2: the same for the last two ids, hashed.

They are mixed into one distribution over all ids: the two predicted ids get the share of cases in which predictions of the same
confidence have come true so far, order 0 gets the rest. The range coder narrows its interval by that distribution; every id can be
coded at any time. A block starts from an empty model and ends with a checksum, so it is read, checked and recovered alone.

Block: "TWCB", version, vocabulary size, documents, ids, lanes, rows; compressed index (identifier, null mark, ids of each document);
number of 16-bit words of each lane; the words; crc32 of everything before it. All numbers are little-endian.

Defined cases: a null text counts as empty and has the end id alone; a null identifier comes after all others; repeated rows are
separate documents; an empty table gives no blocks and no rows; extra columns are ignored.

Files: rows (file, block, documents, tokens, payload) of a Parquet table, written and committed by Spark; files and blocks ascend with
doc_id.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywright.llm.common import by_arrow, documents, stored

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
#: A block is closed by the document that fills it to so many ids.
BLOCK = 1 << 21
PIECE = 1_000_000
#: Different words are looked for in stretches of so many bytes of whole texts, and given to the library in groups of so many.
STRETCH, GROUP = 1 << 23, 100
#: So many words at most stay known to a worker.
KNOWN = 1 << 20

MAGIC, VERSION = b"TWCB", 1
LANES, LEAST_ROWS = 4096, 256
RENEW = 128
ORDER0_BITS, SHARE_BITS, HASH_BITS = 20, 8, 18
TOTAL_BITS = ORDER0_BITS + SHARE_BITS
LARGEST_VOCABULARY = 1 << 18
_HEAD = struct.Struct("<4sBIIQII")
_LOW32, _LOW48 = (1 << 32) - 1, (1 << 48) - 1


class _Model:
    """What encoder and decoder know alike before each row. All numbers are below 2^53, so quotients of floats are exact."""

    def __init__(self, vocabulary: int, lanes: int, with_slots: bool):
        self.vocabulary, self.with_slots, self.rows = vocabulary, with_slots, 0
        self.counts = np.zeros(vocabulary, np.int64)
        # a prediction and its confidence (0 to 7, the low three bits)
        self.after1, self.after2 = np.zeros(vocabulary, np.int64), np.zeros(1 << HASH_BITS, np.int64)
        self.last1, self.last2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.seen = np.zeros((3, 128), np.int64)  # by confidence and agreement: neither, order 2, order 1 came true
        self._renew()

    def _renew(self) -> None:
        spare, total = (1 << ORDER0_BITS) - self.vocabulary, max(1, int(self.counts.sum()))
        share = self.counts * spare // total + 1
        share[int(share.argmax())] += (1 << ORDER0_BITS) - int(share.sum())
        self.share = share
        self.start = np.cumsum(share) - share
        if self.with_slots:
            self.slots = np.repeat(np.arange(self.vocabulary, dtype=np.uint16 if self.vocabulary <= 1 << 16 else np.int32), share)

    def predict(self) -> None:
        self.place2 = ((self.last2 * 40503 + self.last1 * 0x9E3779B1) >> 7) & ((1 << HASH_BITS) - 1)
        one, two = self.after1.take(self.last1), self.after2.take(self.place2)
        self.id1, self.id2, self.sure1, self.sure2 = one >> 3, two >> 3, one & 7, two & 7
        self.cell = (self.sure2 << 3) + self.sure1 + ((self.id1 == self.id2).astype(np.int64) << 6)
        if self.rows % 4 == 0:
            missed, hit2, hit1 = self.seen
            base, units = missed + hit2 + hit1 + 2, (1 << SHARE_BITS) - 1
            mass1, mass2 = units * hit1 // base, units * hit2 // base
            mass1[64:] = 0  # both orders name the same id
            self.mass_of = mass1 << ORDER0_BITS, mass2 << ORDER0_BITS, (1 << SHARE_BITS) - mass1 - mass2
        self.mass1, self.mass2, self.w0 = (m.take(self.cell) for m in self.mass_of)

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of the ids in the mixed distribution."""
        start = self.start.take(ids) * self.w0 + (self.id1 < ids) * self.mass1 + (self.id2 < ids) * self.mass2
        width = self.share.take(ids) * self.w0 + (self.id1 == ids) * self.mass1 + (self.id2 == ids) * self.mass2
        return start, width

    def find(self, at: np.ndarray) -> np.ndarray:
        """The ids whose intervals hold the places `at`."""
        start1, width1 = self.interval(self.id1)
        start2, width2 = self.interval(self.id2)
        end1, end2 = start1 + width1, start2 + width2
        over1, over2 = at >= end1, at >= end2
        rest = at - over1 * self.mass1 - over2 * self.mass2
        in1, in2 = (at >= start1) & ~over1, (at >= start2) & ~over2
        slot = np.minimum((rest / self.w0).astype(np.int64), (1 << ORDER0_BITS) - 1)  # of use only outside both intervals
        return np.where(in1, self.id1, np.where(in2, self.id2, self.slots.take(slot)))

    def update(self, ids: np.ndarray, coded: np.ndarray) -> None:
        """`coded`: all rows up to now."""
        hit1, hit2 = ids == self.id1, ids == self.id2
        self.seen += np.bincount(self.cell + np.where(hit2, 128, hit1.astype(np.int64) << 8), minlength=384).reshape(3, 128)
        for table, place, old, sure, hit in ((self.after1, self.last1, self.id1, self.sure1, hit1), (self.after2, self.place2, self.id2, self.sure2, hit2)):
            kept = hit | (sure > 0)
            # a hit adds confidence, a miss takes some, and without any left the new id moves in;
            # where several lanes write one place, the last of them stays, for encoder and decoder alike
            table[place] = np.where(kept, (old << 3) + np.minimum(sure + 2 * hit - 1, 7), (ids << 3) + 1)
        self.last2, self.last1 = self.last1, ids
        self.rows += 1
        if self.rows & (self.rows - 1) == 0 if self.rows < RENEW else self.rows % RENEW == 0:
            self.counts = np.bincount(coded[:self.rows].ravel(), minlength=self.vocabulary)
            self._renew()


def encode_ids(ids: np.ndarray, vocabulary: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(lanes, rows, words of each lane, all words) of a block's ids."""
    lanes = max(1, min(LANES, len(ids) // LEAST_ROWS))
    rows = -(-len(ids) // lanes)
    grid = np.zeros(lanes * rows, np.int64)  # the last lane is filled up
    grid[:len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, rows).T)
    model = _Model(vocabulary, lanes, False)
    low, span = np.zeros(lanes, np.int64), np.full(lanes, 1 << 48)
    width_of_row = 2 * rows + 4
    words, used = np.zeros(lanes * width_of_row, np.uint32), np.arange(lanes) * width_of_row
    for row in grid:
        model.predict()
        start, width = model.interval(row)
        unit = span >> TOTAL_BITS
        low += unit * start
        span = unit * width
        if int(low.max()) > _LOW48:
            words[used[low > _LOW48] - 1] += 1  # may run over 16 bits until the end
            low &= _LOW48
        while len(short := np.flatnonzero(span <= _LOW32)):
            out, at = low.take(short), used.take(short)
            words[at] = out >> 32
            used[short] = at + 1
            low[short] = (out & _LOW32) << 16
            span[short] = span.take(short) << 16
        model.update(row, grid)
    for shift in (32, 16, 0):
        words[used] = (low >> shift) & 0xFFFF
        used += 1
    words, used = words.reshape(lanes, width_of_row), used - np.arange(lanes) * width_of_row
    while (over := words >> 16).any():
        words &= 0xFFFF
        words[:, :-1] += over[:, 1:]
    return lanes, rows, used, words[np.arange(width_of_row) < used[:, None]].astype("<u2")


def decode_ids(n: int, vocabulary: int, lanes: int, rows: int, used: np.ndarray, words: np.ndarray) -> np.ndarray:
    at = np.cumsum(used) - used
    words = np.r_[words, np.zeros(4, words.dtype)].astype(np.int64)
    code, span = (words[at] << 32) | (words[at + 1] << 16) | words[at + 2], np.full(lanes, 1 << 48)
    at += 3
    model, grid = _Model(vocabulary, lanes, True), np.zeros((rows, lanes), np.int64)
    top = (1 << TOTAL_BITS) - 1
    for r in range(rows):
        model.predict()
        unit = span >> TOTAL_BITS
        ids = model.find(np.minimum((code / unit).astype(np.int64), top))
        start, width = model.interval(ids)
        code -= unit * start
        span = unit * width
        while len(short := np.flatnonzero(span <= _LOW32)):
            place = at.take(short)
            code[short] = (code.take(short) << 16) | words.take(place, mode="clip")
            at[short] = place + 1
            span[short] = span.take(short) << 16
        grid[r] = ids
        model.update(ids, grid)
    return grid.T.ravel()[:n]


def write_block(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, vocabulary: int) -> bytes:
    if vocabulary > LARGEST_VOCABULARY or (len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < vocabulary):
        raise ValueError(f"ids must lie below the vocabulary size, and that at most at {LARGEST_VOCABULARY}")
    lanes, rows, used, words = encode_ids(ids, vocabulary)
    index = zlib.compress(np.array([d or 0 for d in doc_ids], "<i8").tobytes() + bytes(d is None for d in doc_ids) + lengths.astype("<u4").tobytes())
    body = _HEAD.pack(MAGIC, VERSION, vocabulary, len(doc_ids), len(ids), lanes, rows) + struct.pack("<I", len(index)) + index + used.astype("<u4").tobytes() + words.tobytes()
    return body + struct.pack("<I", zlib.crc32(body))


def read_block(block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, ids of each document, all ids); raises ValueError for a damaged block."""
    if len(block) < _HEAD.size + 8 or zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("damaged block: its checksum does not fit")
    magic, version, vocabulary, docs, n, lanes, rows = _HEAD.unpack_from(block)
    if magic != MAGIC or version != VERSION:
        raise ValueError(f"not a block of version {VERSION}")
    at = _HEAD.size + 4
    size = struct.unpack_from("<I", block, _HEAD.size)[0]
    index = zlib.decompress(block[at:at + size])
    at += size
    nulls = index[8 * docs:9 * docs]
    doc_ids = [None if null else d for d, null in zip(np.frombuffer(index, "<i8", docs).tolist(), nulls, strict=True)]
    used = np.frombuffer(block, "<u4", lanes, at).astype(np.int64)
    words = np.frombuffer(block, "<u2", int(used.sum()), at + 4 * lanes)
    return doc_ids, np.frombuffer(index, "<u4", docs, 9 * docs).astype(np.int64), decode_ids(n, vocabulary, lanes, rows, used, words)


# ---- files of blocks

def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def parts_of(text: str) -> Iterator[str]:
    """A long text in pieces whose ids stand in a row: no word of the pre-tokeniser holds white space after another character."""
    at = 0
    while at < len(text):
        found = re.compile(r"\S(?=\s)").search(text, at + PIECE) if len(text) > at + PIECE else None
        to = found.end() if found else len(text)
        yield text[at:to]
        at = to


_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True


def endings(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of a UTF-8 text: whether a letter, and whether a character that is no white space, is sure to end there."""
    letter, ink = _LETTER[data], (data > 32) & (data < 127)
    # two bytes from U+00C0 on: no white space; up to U+00FF letters, but for the signs of multiplication and division
    second, lead = data[1:] & 0xC0 == 0x80, data[:-1]
    ink[1:] |= second & (lead >= 0xC3) & (lead < 0xE0)
    letter[1:] |= second & (lead == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    return letter, ink


def word_starts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places in the UTF-8 bytes of texts (that end at `ends`) where the byte-level pre-tokeniser is sure to begin a word, and the end of all.

    No word holds white space after another character, or anything but letters after a letter. What is not sure stays together.
    """
    start = np.zeros(len(data) + 1, bool)
    start[0] = start[ends] = True
    letter, ink = endings(data)
    start[1:-1] |= (ink[:-1] & ((data[1:] == 32) | (data[1:] == 10))) | (letter[:-1] & ~_LETTER[data[1:]] & (data[1:] < 128))
    return np.flatnonzero(start).astype(np.int32)


class Encoder:
    """Ids of many texts: the library encodes each different word of a stretch of texts once, where words stand on their own.

    Up to KNOWN words are kept for later stretches, which only spares calls. Words stand on their own with a byte-level pre-tokeniser and nothing before it. Texts that hold an added token, and all texts under another tokeniser, are
    given to the library as they are.
    """

    def __init__(self, tokenizer, special_as_text: bool = False):
        from tokenizers import models, pre_tokenizers

        self.tokenizer, model, split = tokenizer, tokenizer.model, tokenizer.pre_tokenizer
        tokenizer.encode_special_tokens = special_as_text
        self.marks = [t.content for t in tokenizer.get_added_tokens_decoder().values() if not (special_as_text and t.special)]
        vocabulary = tokenizer.get_vocab(with_added_tokens=False)
        self.by_word = (isinstance(split, pre_tokenizers.ByteLevel) and split.use_regex and not split.add_prefix_space and isinstance(model, models.BPE)
                        and not (model.dropout or model.continuing_subword_prefix or model.end_of_word_suffix)
                        and tokenizer.normalizer is None and tokenizer.truncation is None and tokenizer.padding is None
                        and vocabulary.keys() >= set(pre_tokenizers.ByteLevel.alphabet()))
        self.known, self.ids, self.first, self.number = pa.array([], pa.binary()), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)
        # a token of the byte-level alphabet has a character for each byte
        self.bytes_of = np.zeros(max(vocabulary.values(), default=0) + 1, np.int32)
        self.bytes_of[list(vocabulary.values())] = [len(t) for t in vocabulary]

    def library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def whole(self, text: str) -> np.ndarray:
        return np.array([i for ids in self.library(list(parts_of(text))) for i in ids], np.int32)

    def joined(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids, and how many each has, of words of which each may stand after each; None if the groups' ids don't part where words do."""
        offsets, data = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1], words.buffers()[2]
        at = np.r_[offsets[:-1:GROUP], offsets[-1:]].tolist()
        groups = [data[a:b].to_pybytes().decode() for a, b in itertools.pairwise(at)]
        if any(m in g for m in self.marks for g in groups):
            return None
        ids = np.array([i for g in self.library(groups) for i in g], np.int32)
        ends, wanted = np.cumsum(self.bytes_of[ids]), offsets[1:] - offsets[0]
        last = np.searchsorted(ends, wanted)
        if len(words) and (last[-1] != len(ids) - 1 or (ends[last] != wanted).any()):
            return None
        return ids, np.diff(np.r_[0, last + 1])

    def distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, number): the ids of word i are ids[first[i]:first[i] + number[i]]."""
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2], np.uint8) if len(words) else np.zeros(0, np.uint8)
        letter, ink = endings(data)
        head, tail = data[offsets[:-1]], offsets[1:] - 1
        # between a letter and ASCII that is none, and between ink and white space, a word ends: such words may be joined in any order
        lettered = letter[tail] & ~_LETTER[head] & (head < 128)
        spaced = ink[tail] & ((head == 32) | (head == 10)) & ~lettered
        kinds = np.where(lettered, 0, np.where(spaced, 1, 2))
        ids, numbers = [], np.zeros(len(words), np.int32)
        for kind in range(3):
            some = words.filter(pa.array(kinds == kind))
            found = self.joined(some) if kind < 2 else None
            if found is None:
                single = self.library([w.decode() for w in some.to_pylist()])
                found = np.fromiter(itertools.chain.from_iterable(single), np.int32), np.fromiter(map(len, single), np.int32, len(single))
            ids.append(found[0])
            numbers[kinds == kind] = found[1]
        order = np.argsort(kinds, kind="stable")
        first = np.empty(len(words), np.int64)
        first[order] = np.cumsum(numbers[order], dtype=np.int64) - numbers[order]
        return np.concatenate(ids), first, numbers

    def looked_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As `distinct`, asking the library for words that are not known yet only."""
        place = pc.index_in(words, value_set=self.known)
        unknown = place.is_null()
        new = words.filter(unknown)
        ids, first, number = self.distinct(new)
        at = place.fill_null(0).to_numpy().astype(np.int64)
        at[unknown.to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(len(new))
        ids, first, number = np.concatenate([self.ids, ids]), np.concatenate([self.first, first + len(self.ids)]), np.concatenate([self.number, number])
        if len(number) <= KNOWN and len(ids) <= 8 * KNOWN:
            self.known, self.ids, self.first, self.number = pa.concat_arrays([self.known, new]), ids, first, number
        return ids, first[at], number[at]

    def by_words(self, texts: pa.Array) -> list[np.ndarray]:
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
        data = (texts.buffers()[2] or pa.py_buffer(b""))[int(offsets[0]):int(offsets[-1])]
        ends = offsets[1:] - offsets[0]
        starts = word_starts(np.frombuffer(data, np.uint8), ends)
        words = pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts), data]).dictionary_encode()
        ids, first, number = self.looked_up(words.dictionary)
        word = words.indices.to_numpy()
        numbers = number[word]
        after = np.r_[0, np.cumsum(numbers, dtype=np.int64)]
        found = ids[np.repeat(first[word] - after[:-1], numbers) + np.arange(after[-1])]
        bounds = after[np.searchsorted(starts, ends)].tolist()
        return [found[a:b] for a, b in itertools.pairwise([0, *bounds])]

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        texts = texts.cast(pa.string()).fill_null("")
        marked = np.full(len(texts), not self.by_word)
        for mark in self.marks if self.by_word else []:
            marked |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            if marked[at]:
                yield self.whole(texts[at].as_py())
                at += 1
                continue
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + STRETCH, side="right")))
            if marked[at:to].any():
                to = at + int(np.argmax(marked[at:to]))
            yield from self.by_words(texts[at:to].cast(pa.binary()))
            at = to


@functools.lru_cache(1)
def encoder_of(path: str, special_as_text: bool) -> Encoder:
    """One for all tasks of a worker."""
    from tokenizers import Tokenizer

    return Encoder(Tokenizer.from_file(path), special_as_text)


def encode_files(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, special_as_text: bool = False) -> DataFrame:
    """(file, block, documents, tokens, payload): every text's ids and `end_id`, in ascending doc_id order, as one table of blocks.

    A special string inside a text becomes its id, as the library does it; with `special_as_text` it is spelled like other text, so
    that no text can forge an end. Null identifiers come last; rows with equal identifiers stand in the order of a digest of their texts.
    """
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext

        encoder = encoder_of(path, special_as_text)
        vocabulary, file, block = encoder.tokenizer.get_vocab_size(), TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, np.ndarray]] = []
        filled = 0

        def close() -> pa.RecordBatch:
            payload = write_block([d for d, _ in held], np.array([len(i) for _, i in held], np.int64), np.concatenate([i for _, i in held]), vocabulary)
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([block], pa.int32()), pa.array([len(held)], pa.int64()), pa.array([filled], pa.int64()), pa.array([payload], pa.binary())],
                                              ["file", "block", "documents", "tokens", "payload"])

        for b in batches:
            for d, ids in zip(b.column(0).to_pylist(), encoder.encode(b.column(1)), strict=True):
                held.append((d, np.append(ids, np.int32(end_id))))
                filled += len(held[-1][1])
                if filled >= BLOCK:
                    yield close()
                    held, filled, block = [], 0, block + 1
        if held:
            yield close()

    key = F.col(f"`{doc_id}`").cast("long")
    order = [key.isNull().alias("last"), key.alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("digest")]
    rows = docs.select(*order, F.col(f"`{text}`").alias("text")).repartitionByRange("last", "doc_id", "digest").sortWithinPartitions("last", "doc_id", "digest")
    return stored(by_arrow(rows.select("doc_id", "text"), run, "file int, block int, documents long, tokens long, payload binary"), "token-blocks")


def decode_files(blocks: DataFrame) -> DataFrame:
    """Read blocks back: (doc_id, start, n_tokens, ids_crc32, ids) a document; start counts the ids of all documents before it."""
    before = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # totals of files are few rows; blocks are summed inside their file only
    files = blocks.groupBy("file").agg(F.sum("tokens").alias("tokens")).select("file", before(Window.orderBy("file")).alias("file_start"))
    starts = (blocks.select("file", "block", "tokens").withColumn("block_start", before(Window.partitionBy("file").orderBy("block")))
              .join(files, "file").select("file", "block", (F.col("file_start") + F.col("block_start")).alias("base")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, block, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                doc_ids, lengths, ids = read_block(payload)
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(part.astype("<u4").tobytes()) for part in np.split(ids, ends[:-1])] if len(lengths) else []
                n = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * n, pa.int32()), pa.array([block] * n, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(ids, pa.int32()))], ["file", "block", "doc_id", "inside", "n_tokens", "ids_crc32", "ids"])

    read = by_arrow(blocks.select("file", "block", "payload"), run, "file int, block int, doc_id long, inside long, n_tokens long, ids_crc32 long, ids array<int>")
    return read.join(starts, ["file", "block"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "ids")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_files(encode_files(documents(spark, sf_dir))).select("doc_id", "start", "n_tokens", "ids_crc32")
