"""SentencePiece encoding that keeps, for every piece, its span in the original text.

Normalisation is done here: the longest prefix that the model's compiled character map
knows is replaced by its entry, anything else passes unchanged, and every normalised byte
remembers where its source begins. The bare segmentation then runs on the normalised text,
so a piece's span follows from its length alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from twinspan.llm.symbols import blocks, ranges, text_buffers

#: The mark of a space, and the normalised form of a byte that is not UTF-8.
SPACE = "▁"
BROKEN = "�".encode()

#: Words whose pieces a Python worker remembers; beyond it the memory starts anew.
REMEMBERED = 100_000


class CharacterMap:
    """The compiled map: a double-array trie over UTF-8 bytes, and replacements that end in a zero byte."""

    def __init__(self, blob: bytes):
        if blob:
            size = int.from_bytes(blob[:4], "little")
            self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
            self.texts = blob[4 + size :]
        else:
            self.units, self.texts = [], b""

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix of ``data`` from ``at`` and what replaces it."""
        if not self.units:
            return None
        found = None
        node = self._base(self.units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._base(unit)
            if unit >> 8 & 1:
                value = self.units[node] & 0x7FFFFFFF
                found = (i + 1 - at, self.texts[value : self.texts.index(b"\0", value)])
        return found

    @staticmethod
    def _base(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)


@dataclass
class Encoded:
    """Ids of several texts one after the other; text k has those from offsets[k] to offsets[k + 1]."""

    ids: np.ndarray
    offsets: np.ndarray
    #: Start and end byte in the own text for each id.
    starts: np.ndarray
    ends: np.ndarray


class Codec:
    """A model, its normaliser and its bare segmentation. Made in each task from the file's bytes."""

    def __init__(self, model: bytes):
        proto = model_pb2.ModelProto.FromString(model)
        rules = proto.normalizer_spec
        self.map = CharacterMap(rules.precompiled_charsmap)
        self.prefix, self.trim, self.mark = rules.add_dummy_prefix, rules.remove_extra_whitespaces, rules.escape_whitespaces
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        kinds = model_pb2.ModelProto.SentencePiece
        self.kept_whole = sorted((p.piece for p in proto.pieces if p.type == kinds.USER_DEFINED), key=len, reverse=True)
        self.byte_ids = {i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.lengths = np.array([1 if i in self.byte_ids else len(p.piece.encode()) for i, p in enumerate(proto.pieces)])
        self.unknown = next((i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN), -1)
        # A piece never continues over the start of a word: words can be cut one by one.
        self.by_word = self.mark and not self.suffix and proto.trainer_spec.model_type == 2 and not self.kept_whole and not any(
            SPACE in p.piece.lstrip(SPACE) for p in proto.pieces)
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=model)
        rules.precompiled_charsmap = b""
        rules.name = "identity"
        rules.add_dummy_prefix = rules.remove_extra_whitespaces = rules.escape_whitespaces = False
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        names = [f"{i},".encode() for i in range(len(proto.pieces))]
        self.name_bytes = np.frombuffer(b"".join(names), np.uint8)
        self.name_ends = np.cumsum([len(n) for n in names])
        self._forget()
        self.plain = not self.map.units and not self.trim and not self.kept_whole

    # --- normalisation -------------------------------------------------------------

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text and, for each of its bytes and its end, the byte of the original it comes from."""
        data = text.encode()
        space = SPACE.encode() if self.mark else b" "
        out, source = bytearray(), []

        def put(piece: bytes, at: int) -> None:
            out.extend(piece)
            source.extend([at] * len(piece))

        at = 0
        if self.trim:
            while at < len(data):
                used, piece = self._next(data, at)
                if piece != b" ":
                    break
                at += used
        if at >= len(data):
            return "", np.zeros(1, np.int64)
        if self.prefix and not self.suffix:
            put(space, at)
        was_space = self.trim
        while at < len(data):
            used, piece = self._next(data, at)
            while self.trim and was_space and piece[:1] == b" ":
                piece = piece[1:]
            for k in range(len(piece)):
                byte = piece[k : k + 1]
                put(space if byte == b" " else byte, at)
            if piece:
                was_space = piece[-1:] == b" "
            at += used
            if not self.trim:
                was_space = False
        if self.trim:
            while out.endswith(space):
                del out[-len(space) :]
                del source[-len(space) :]
        if self.prefix and self.suffix:
            put(space, at)
        return out.decode(), np.array([*source, at])

    def _next(self, data: bytes, at: int) -> tuple[int, bytes]:
        for whole in self.kept_whole:
            if data.startswith(kept := whole.encode(), at):
                return len(kept), kept
        found = self.map.longest(data, at)
        if found:
            return found
        lead = data[at]
        used = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return used, data[at : at + used]

    def align(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Normalised bytes of a block of texts, their offsets, and the source byte of each.

        The bytes of one character have its first byte as source. Where no rule but the marking
        of spaces is on, whole arrays take the place of the walk through the character map.
        """
        if not self.plain:
            found = [self.normalise(data[a:b].tobytes().decode()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            normal = [np.frombuffer(t.encode(), np.uint8) for t, _ in found]
            ends = np.cumsum([0, *map(len, normal)])
            return np.concatenate([*normal, np.zeros(0, np.uint8)]), ends, np.concatenate([*(s[:-1] for _, s in found), np.zeros(0, np.int64)])
        filled = np.diff(offsets) > 0
        first = np.maximum.accumulate(np.where((data & 0xC0) == 0x80, 0, np.arange(len(data)))) if len(data) else np.zeros(0, np.int64)
        source = first - np.repeat(offsets[:-1], np.diff(offsets))
        if self.prefix:
            # A space before (or behind) each text that has any character.
            at = offsets[1:][filled] if self.suffix else offsets[:-1][filled]
            source = np.insert(source, at, np.diff(offsets)[filled] if self.suffix else 0)
            data = np.insert(data, at, 0x20)
            offsets = offsets + np.append(0, np.cumsum(filled))
        if not self.mark:
            return data, offsets, source
        wide = np.where(data == 0x20, len(_MARK), 1)
        ends = np.concatenate([[0], np.cumsum(wide)])
        out = np.repeat(data, wide)
        at = np.flatnonzero(data == 0x20)
        for k, byte in enumerate(_MARK):
            out[ends[at] + k] = byte
        return out, ends[offsets], np.repeat(source, wide)

    # --- segmentation --------------------------------------------------------------

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.pool, self.pool_size = np.zeros(1 << 16, np.int32), 0
        self.pool_start, self.pool_count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _learn(self, keys: list[bytes], words: list[str]) -> None:
        """Segment words that were not met before and keep their ids."""
        found = self.bare.encode(words, num_threads=1)
        counts = np.array([len(f) for f in found], np.int64)
        ids = np.fromiter(chain.from_iterable(found), np.int32, int(counts.sum()))
        n = len(self.known)
        while self.pool_size + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while n + len(keys) > len(self.pool_start):
            self.pool_start, self.pool_count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.pool_start, self.pool_count))
        self.pool[self.pool_size : self.pool_size + len(ids)] = ids
        self.pool_start[n : n + len(keys)] = self.pool_size + np.cumsum(counts) - counts
        self.pool_count[n : n + len(keys)] = counts
        self.known.update(zip(keys, range(n, n + len(keys)), strict=True))
        self.pool_size += len(ids)

    def cut(self, normal: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block of normalised texts, and where each text's ids begin."""
        if not self.by_word:
            texts = [normal[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            found = self.bare.encode(texts, num_threads=1)
            ends = np.cumsum([0, *map(len, found)])
            return np.fromiter(chain.from_iterable(found), np.int32, int(ends[-1])), ends
        if len(self.known) > REMEMBERED:
            self._forget()
        # A word begins at a mark that no mark precedes, and at each text's start.
        padded = np.concatenate([normal, np.zeros(2, np.uint8)])
        mark = (padded[:-2] == _MARK[0]) & (padded[1:-1] == _MARK[1]) & (padded[2:] == _MARK[2])
        begin = mark.copy()
        begin[3:] &= ~mark[:-3]
        begin[offsets[:-1][offsets[:-1] < len(normal)]] = True
        starts = np.flatnonzero(begin)
        # Words lie side by side; equal ones are told by their bytes.
        words = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(normal))), pa.py_buffer(np.ascontiguousarray(normal))])
        named = words.dictionary_encode()
        keys = named.dictionary.to_pylist()
        entry = [self.known.get(k, -1) for k in keys]
        new = [i for i, e in enumerate(entry) if e < 0]
        if new:
            self._learn([keys[i] for i in new], [keys[i].decode() for i in new])
            for i in new:
                entry[i] = self.known[keys[i]]
        entry = np.array(entry, np.int64)[named.indices.to_numpy()]
        counts = self.pool_count[entry]
        ids = self.pool[ranges(self.pool_start[entry], counts)]
        id_ends = np.concatenate([[0], np.cumsum(counts)])
        return ids, id_ends[np.searchsorted(starts, offsets)]

    def encode_block(self, data: np.ndarray, offsets: np.ndarray) -> Encoded:
        """Ids of a block of texts with their spans in each text's UTF-8 bytes.

        Byte pieces of a character that falls back share its source, of which the last takes
        the bytes; a piece that comes from nothing, such as the leading mark, has an empty span.
        """
        normal, begins, source = self.align(data, offsets)
        ids, id_offsets = self.cut(normal, begins)
        sizes = self.lengths[ids]
        if (ids == self.unknown).any():
            sizes = self._with_unknown(normal, begins)
        ends = np.cumsum(sizes)
        if (len(ends) and ends[-1]) != len(normal):
            raise ValueError("the pieces don't cover the normalised text")
        # A span ends where the source of the next byte begins, at last with the text.
        source = np.append(source, 0)
        last = id_offsets[1:][np.diff(id_offsets) > 0] - 1
        end_bytes = source[ends]
        end_bytes[last] = np.diff(offsets)[np.diff(id_offsets) > 0]
        return Encoded(ids, id_offsets, source[ends - sizes], end_bytes)

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[tuple[int, int]]]]:
        """Ids and spans of each text."""
        data = [np.frombuffer(t.encode(), np.uint8) for t in texts]
        e = self.encode_block(np.concatenate([*data, np.zeros(0, np.uint8)]), np.cumsum([0, *map(len, data)]))
        cut = lambda x, k: x[e.offsets[k] : e.offsets[k + 1]].tolist()
        return [(cut(e.ids, k), list(zip(cut(e.starts, k), cut(e.ends, k), strict=True))) for k in range(len(texts))]

    def _with_unknown(self, normal: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Piece lengths where some are unknown text, from the pieces' own surface."""
        texts = [normal[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return np.array([len(p.surface.encode()) for t in texts for p in self.bare.encode(t, return_type="proto").pieces], np.int64)

    def decode(self, e: Encoded) -> list[str]:
        ids = e.ids.tolist()
        return self.whole.decode([ids[a:b] for a, b in zip(e.offsets[:-1], e.offsets[1:], strict=True)], num_threads=1)

    def written(self, e: Encoded) -> list[bytes]:
        """Each text's ids in decimal, joined by commas."""
        begins = np.append(0, self.name_ends[:-1])[e.ids]
        sizes = self.name_ends[e.ids] - begins
        data = self.name_bytes[ranges(begins, sizes)].tobytes()
        at = np.append(0, np.cumsum(sizes))[e.offsets].tolist()
        return [data[a : max(a, b - 1)] for a, b in zip(at[:-1], at[1:], strict=True)]


_MARK = SPACE.encode()


def model_bytes(path: str) -> bytes:
    """The model file, read where the job is started; half a megabyte, sent to each task."""
    with open(path, "rb") as f:
        return f.read()


_codecs: dict[str, Codec] = {}


def codec(model: bytes) -> Codec:
    """One codec per model and Python worker."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec(model)
    return _codecs[key]


def _over(docs: DataFrame, model: bytes, fields: str, summarise) -> DataFrame:
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for low, high in blocks(offsets):
                e = c.encode_block(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[low:high], *summarise(c, e)], names)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, fields)


def encode_documents(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, ids ARRAY<INT>, starts and ends ARRAY<INT> (bytes of the text) for each row.

    A null text is empty and has no ids. Rows with repeated or null ids are separate rows;
    further columns are not read.
    """

    def summarise(c: Codec, e: Encoded) -> list[pa.Array]:
        return [pa.ListArray.from_arrays(pa.array(e.offsets, pa.int32()), pa.array(x, pa.int32())) for x in (e.ids, e.starts, e.ends)]

    return _over(docs, model, "doc_id LONG, ids ARRAY<INT>, starts ARRAY<INT>, ends ARRAY<INT>", summarise)


def digest_documents(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, span_bytes for each row.

    The digests are of the decimal ids joined by commas and of the decoded text; span_bytes
    counts the bytes of the text that pieces' spans cover. Nulls and repeats as above.
    """

    def summarise(c: Codec, e: Encoded) -> list[pa.Array]:
        covered = np.append(0, np.cumsum(e.ends - e.starts))[e.offsets]
        return [
            pa.array(np.diff(e.offsets), pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in c.written(e)], pa.string()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in c.decode(e)], pa.string()),
            pa.array(np.diff(covered), pa.int64()),
        ]

    return _over(docs, model, "doc_id LONG, n_tokens LONG, ids_sha256 STRING, decoded_sha256 STRING, span_bytes LONG", summarise)
