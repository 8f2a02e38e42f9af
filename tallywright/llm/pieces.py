"""SentencePiece encoding that keeps the place of every piece in the original bytes.

A text is normalised here: at every position the longest entry of the model's compiled character map that is a prefix of what
follows is replaced by its normal form (a single character stays as it is where none matches), and each normal byte records the
source byte that it stands for. White space is then treated as the model says. The normal text is encoded with a processor of the same
vocabulary whose own normalisation is switched off, and the byte lengths of the pieces, laid along the alignment, give each piece its
span of original bytes. Ids are the same as the library gives for the original text.

Texts over PIECE characters are encoded part by part, cut in front of a space mark; that cannot change the result, because only
vocabularies in which no piece holds a space mark after another character are cut.

Defined cases: a null text counts as empty; an empty text has no ids and decodes to an empty text; repeated rows are separate
documents; an empty table gives an empty table; extra columns are carried along by `encoded`.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.common import by_arrow, documents, fresh

MODEL = "piece_bpe_32k.model"
MARK = "▁"
PIECE = 1_000_000


def model_path(name: str = MODEL) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class CharacterMap:
    """The compiled character map: a double-array trie over UTF-8 bytes, and the normal forms its leaves point to."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.forms = blob[4 + size:]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes used, normal form) of the longest entry that starts at `at`."""
        found = None
        if not self.units:
            return None
        node = self._base(self.units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._base(unit)
            if unit & 0x100:
                form = self.units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.forms[form:self.forms.index(b"\0", form)]
        return found

    @staticmethod
    def _base(unit: int) -> int:
        return (unit >> 10) << 8 if unit & 0x200 else unit >> 10


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as schema

        with open(path, "rb") as f:
            raw = f.read()
        proto = schema.ModelProto()
        proto.ParseFromString(raw)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.rules = schema.NormalizerSpec()
        self.rules.CopyFrom(proto.normalizer_spec)
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        self.map = CharacterMap(self.rules.precompiled_charsmap)
        kinds = schema.ModelProto.SentencePiece
        if any(p.type == kinds.USER_DEFINED for p in proto.pieces):
            raise ValueError("models with user-defined symbols are not supported: the map must not touch them")
        # a byte piece stands for one byte; the unknown piece has no length of its own
        self.lengths = np.array([1 if p.type == kinds.BYTE else 0 if p.type in (kinds.UNKNOWN, kinds.CONTROL) else len(p.piece.encode()) for p in proto.pieces], np.int64)
        self.may_cut = proto.trainer_spec.model_type == schema.TrainerSpec.BPE and not any(re.search(f"[^{MARK}]{MARK}", p.piece) for p in proto.pieces)
        self.unknown = self.library.unk_id()
        proto.normalizer_spec.Clear()
        proto.normalizer_spec.name, proto.normalizer_spec.add_dummy_prefix = "identity", False
        proto.normalizer_spec.remove_extra_whitespaces = proto.normalizer_spec.escape_whitespaces = False
        proto.denormalizer_spec.Clear()
        proto.trainer_spec.treat_whitespace_as_suffix = False
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())

    # ---- normalisation with alignment

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normal text, and for each of its bytes, and for its end, the place in the original bytes."""
        data = text.encode("utf-8", "replace")
        if not data:
            return "", np.zeros(1, np.int64)
        if not self.map.units and not self.rules.remove_extra_whitespaces and self.rules.escape_whitespaces:
            space = np.frombuffer(data, np.uint8) == 0x20
            source = np.repeat(np.arange(len(data) + 1), np.r_[np.where(space, 3, 1), 1])
            normal = text.replace(" ", MARK)
            return (normal, source) if not self.rules.add_dummy_prefix else (normal + MARK, np.r_[source, source[-1:].repeat(3)]) if self.suffix else (MARK + normal, np.r_[0, 0, 0, source])
        return self._normalise_by_map(data)

    def _normalise_by_map(self, data: bytes) -> tuple[str, np.ndarray]:
        out, source, at = bytearray(), [], 0
        while at < len(data):
            used, form = self.map.longest(data, at) or self._character(data, at)
            out += form
            source += [at] * len(form)
            at += used
        end = len(data)
        if self.rules.remove_extra_whitespaces:
            # runs of spaces give way to their first one; spaces at either end go
            keep = [i for i, c in enumerate(out) if c != 0x20 or (i and out[i - 1] != 0x20)]
            while keep and out[keep[-1]] == 0x20:
                end = source[keep.pop()]
            out, source = bytearray(out[i] for i in keep), [source[i] for i in keep]
        if not out:
            return "", np.array([end])
        space = MARK.encode() if self.rules.escape_whitespaces else b" "
        parts = [space if c == 0x20 else bytes((c,)) for c in out]
        place = [p for p, part in zip(source, parts, strict=True) for _ in part]
        joined = b"".join(parts)
        if self.rules.add_dummy_prefix:
            joined, place = (joined + space, place + [end] * len(space)) if self.suffix else (space + joined, [source[0]] * len(space) + place)
        return joined.decode("utf-8", "replace"), np.array([*place, end])

    @staticmethod
    def _character(data: bytes, at: int) -> tuple[int, bytes]:
        first = data[at]
        used = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        return used, data[at:at + used]

    # ---- encoding

    def encode(self, text: str | None) -> tuple[list[int], np.ndarray]:
        """Ids, and the end of each piece in the original bytes; a piece starts where the one before it ends (the first at the first byte)."""
        normal, source = self.normalise(text or "")
        ids = [i for part in self._parts(normal) for i in self.plain.encode(part)]
        if self.unknown in ids:
            lengths = np.array([p.end - p.begin for part in self._parts(normal) for p in self._pieces(part)], np.int64)
        else:
            lengths = self.lengths[ids] if ids else np.zeros(0, np.int64)
        return ids, source[np.cumsum(lengths)]

    def _pieces(self, part: str) -> list:
        return list(self.plain.encode(part, return_type="proto").pieces)

    def _parts(self, normal: str) -> Iterator[str]:
        at = 0
        while at < len(normal):
            to = at + PIECE
            if to < len(normal) and self.may_cut:
                found = re.compile(f"[^{MARK}](?={MARK})").search(normal, to)
                to = found.end() if found else len(normal)
            else:
                to = len(normal)
            yield normal[at:to]
            at = to

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids) if ids else ""


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def encoded(docs: DataFrame, path: str | None = None, text: str = "text", decoded: bool = False) -> DataFrame:
    """The rows of `docs` without their text, with n_tokens, ids and ends (of the pieces, in original bytes); with `decoded` also
    decoded_sha256, the digest of the text that the ids lead back to."""
    path = path or model_path()
    # a column of `docs` with such a name, in whatever case, is carried along, and the new one has an underscore in front
    seen, *own = fresh(docs, "seen", "n_tokens", "ids", "ends", *["decoded_sha256"] * decoded)
    carried = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                rows = [model.encode(t.as_py()) for t in b.column(b.num_columns - 1)]
                offsets = pa.array(np.cumsum([0, *(len(ids) for ids, _ in rows)]), pa.int32())
                flat = lambda k: pa.array(np.concatenate([np.asarray(r[k], np.int64) for r in rows] or [np.zeros(0, np.int64)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:-1], pa.array([len(ids) for ids, _ in rows], pa.int64()), pa.ListArray.from_arrays(offsets, flat(0)), pa.ListArray.from_arrays(offsets, flat(1)),
                     *([pa.array([hashlib.sha256(model.decode(ids).encode("utf-8", "replace")).hexdigest() for ids, _ in rows], pa.string())] if decoded else [])],
                    [*b.schema.names[:-1], *own])

    frame = docs.select(*[F.col(f"`{c}`") for c in carried], F.col(f"`{text}`").alias(seen))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields[:-1]] + [f"`{n}` {t}" for n, t in zip(own, ("long", "array<int>", "array<int>", "string"))])
    return by_arrow(frame, run, schema)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: number of ids, digests of the ids and of the decoded text, and the original bytes that the spans cover."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        names = [str(i) for i in range(model.library.get_piece_size())]
        for b in batches:
            rows = []
            for t in b.column(1):
                ids, ends = model.encode(t.as_py())
                rows.append((len(ids), hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest(),
                             hashlib.sha256(model.decode(ids).encode("utf-8", "replace")).hexdigest(), int(ends[-1]) if ids else 0))
            n, one, two, covered = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string()), pa.array(covered, pa.int64())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes"])

    return by_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, covered_bytes long")


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
