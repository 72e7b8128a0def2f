"""SentencePiece encoding with the original byte span of every piece, and decoding.

Method: a text is normalised here, by the longest prefix found in the model's compiled character map (a
double-array trie with a table of replacements), and every byte of the result remembers the byte of the text it came from. The
library then merges the normalised text, with a copy of the model whose own normalisation is switched
off; every piece covers known bytes of the normalised text and so is projected to a span of the original.
Without a character map, as in the given model, normalisation is a replacement of spaces, done at once. (Remembering the
pieces of words was measured and saves nothing over merging whole texts: half of all distinct words occur once.)

A character that becomes byte pieces gives its span to the last of them, the others are empty at its start,
as in the library. White space that the model puts in front has an empty span. Decoding is the library's.

Null texts are empty; empty texts have no pieces and decode to the empty text. Rows are independent:
repeated rows and ids and null ids all get their row. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from takeup.llm.common import bounded_batches

_MARK = "▁"
#: kinds of pieces in a model (fixed values of the file format)
_USER, _BYTE = 4, 6


class CharacterMap:
    """Compiled character map: size of the trie in bytes, the trie's units, and replacements that end with a zero byte."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4:4 + size], dtype="<u4").tolist()
        self.texts = blob[4 + size:]

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 512) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement of the longest entry that begins at a place, and the entry's length."""
        units = self.units
        node, best = self._offset(units[0]), None
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or units[node] & 0x800000FF != data[i]:
                break
            unit = units[node]
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                best = (units[node] & 0x7FFFFFFF, i + 1 - at)
        if best is None:
            return None
        begin, length = best
        return self.texts[begin:self.texts.index(0, begin)], length


def _char_bytes(first: int) -> int:
    return 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4


class Encoder:
    """A model's normalisation, merges and spans."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        self.space = _MARK.encode() if self.escape else b" "
        own = [p.piece for p in proto.pieces if p.type == _USER]
        self.user = re.compile("|".join(re.escape(p) for p in sorted(own, key=len, reverse=True)).encode()) if own else None
        spec.precompiled_charsmap, spec.normalization_rule_tsv, spec.name = b"", "", "identity"
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = False
        self.whole = SentencePieceProcessor(model_proto=model)
        self.merge = SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.is_byte = np.array([p.type == _BYTE for p in proto.pieces])
        #: bytes of normalised text that a piece covers (the unknown piece: see ``sizes``)
        self.size = np.array([1 if p.type == _BYTE else len(p.piece.encode()) for p in proto.pieces], dtype=np.int64)
        self.unknown = self.merge.unk_id()
        #: what a piece stands for in a text: a space for the mark, one byte for a byte piece
        self.token_bytes = [bytes([int(p.piece[3:-1], 16)]) if p.type == _BYTE else p.piece.replace(_MARK, " ").encode()
                            for p in proto.pieces]

    # -- normalisation -------------------------------------------------------

    def simple(self) -> bool:
        return self.map is None and self.user is None and not self.squeeze and self.escape and not self.suffix

    def normalised(self, text: str) -> str:
        if self.simple():
            return (_MARK if self.prefix and text else "") + text.replace(" ", _MARK)
        return self.aligned(text)[0].decode()

    def aligned(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each and the end the place in the text it came from."""
        data = text.encode()
        if self.simple():
            raw = np.frombuffer(data, dtype=np.uint8)
            times = np.where(raw == 32, 3, 1)
            lead = np.zeros(3 if self.prefix and text else 0, dtype=np.int64)
            places = np.concatenate([lead, np.repeat(np.arange(len(raw)), times), [len(raw)]])
            return self.normalised(text).encode(), places
        return self._walked(data)

    def _step(self, data: bytes, at: int) -> tuple[bytes, int]:
        """Replacement and length of what begins at a place."""
        if self.user is not None and (own := self.user.match(data, at)):
            return own.group(), own.end() - at
        found = self.map.longest(data, at) if self.map else None
        if found is None:
            length = _char_bytes(data[at])
            return data[at:at + length], length
        return found

    def _walked(self, data: bytes) -> tuple[bytes, np.ndarray]:
        at, out, places = 0, bytearray(), []
        if self.squeeze:
            while at < len(data):
                made, length = self._step(data, at)
                if made != b" ":
                    break
                at += length
        if at == len(data):
            return b"", np.array([at if data else 0])
        after_space = self.squeeze

        def put(text: bytes) -> None:
            out.extend(text)
            places.extend([at] * len(text))

        if self.prefix and not self.suffix:
            put(self.space)
        while at < len(data):
            made, length = self._step(data, at)
            if after_space:
                made = made.lstrip(b" ")
            if made:
                put(made.replace(b" ", self.space))
                after_space = made.endswith(b" ")
            at += length
            if not self.squeeze:
                after_space = False
        while self.squeeze and out.endswith(self.space):
            at = places[len(out) - len(self.space)]
            del out[-len(self.space):], places[-len(self.space):]
        if self.prefix and self.suffix:
            put(self.space)
        return bytes(out), np.array([*places, at])

    # -- merges --------------------------------------------------------------

    def texts_ids(self, texts: list[str]) -> list[list[int]]:
        """Piece ids of several texts, without spans."""
        return self.merge.encode([self.normalised(text) for text in texts], num_threads=1) if texts else []

    def sizes(self, normal: str, ids: np.ndarray) -> np.ndarray:
        """Bytes of normalised text under every piece. The unknown piece stands for any text: its length
        is asked of the library."""
        if self.unknown not in ids:
            return self.size[ids]
        pieces = self.merge.encode(normal, out_type="proto").pieces
        return np.array([self.size[p.id] if self.is_byte[p.id] else len(p.piece.encode()) for p in pieces], dtype=np.int64)

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the begin and end of every piece's bytes in the text."""
        text = text or ""
        data, places = self.aligned(text)
        normal = data.decode()
        ids = np.array(self.merge.encode(normal), dtype=np.int32)
        ends = np.cumsum(self.sizes(normal, ids))
        begins = ends - self.sizes(normal, ids) if len(ids) else ends
        # a fallback character's span belongs to its last byte piece
        inside = np.frombuffer(data, dtype=np.uint8) & 0xC0 == 0x80
        inside = np.append(inside, False)
        broken = self.is_byte[ids] & inside[ends] if len(ids) else np.zeros(0, dtype=bool)
        char = np.maximum.accumulate(np.where(inside, 0, np.arange(len(inside))))
        begins = np.where(self.is_byte[ids], char[begins], begins) if len(ids) else begins
        ends = np.where(broken, begins, ends)
        return ids, places[begins], places[ends]

    def decode(self, ids: np.ndarray) -> str:
        return self.whole.decode(ids.tolist()) if len(ids) else ""


def read_model(path: str) -> bytes:
    """Bytes of a small vocabulary file on the driver."""
    with open(path, "rb") as file:
        return file.read()


def encode_texts(rows: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, ``ids``, ``begins`` and ``ends`` (bytes of the text, end exclusive) and ``decoded`` of every row.

    ``model`` is the model file's path on the driver; its bytes (a vocabulary) are broadcast.
    """
    spark = rows.sparkSession
    bounded_batches(spark, 4)
    shared = spark.sparkContext.broadcast(read_model(model))

    def lists(values: list[np.ndarray]) -> pa.ListArray:
        offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values).astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            found = [encoder.encode(text) for text in batch.column(1).to_pylist()]
            decoded = pa.array([encoder.decode(ids) for ids, _, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[lists([f[k] for f in found]) for k in range(3)], decoded],
                                             names=[id_column, "ids", "begins", "ends", "decoded"])

    chosen = rows.select(F.col(id_column), F.col(text_column).cast("string").alias("_text"))
    kind = chosen.schema[id_column].dataType.simpleString()
    return chosen.mapInArrow(run, f"`{id_column}` {kind}, ids array<int>, begins array<int>, ends array<int>, decoded string")


def piece_report(rows: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Number and digest of the ids, digest of the decoded text, and the bytes that the spans cover."""
    found = encode_texts(rows, model, id_column, text_column)
    return found.select(
        id_column, F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        F.expr("aggregate(zip_with(begins, ends, (b, e) -> cast(e - b as bigint)), 0L, (a, n) -> a + n)").alias("span_bytes"))
