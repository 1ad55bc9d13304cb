"""Token ids in wavelet-matrix files, one per shard, written and read by Spark.

A shard file keeps the ids of consecutive documents as bit planes, highest bit first. Each
plane holds one bit of every id; ids with a 0 move before those with a 1 for the next
plane. Counts of ones at block borders (rank) let a reader follow one id through the planes:
access, counting and the places of an id are answered from the file alone.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import stored
from .words import slices

MAGIC = b"WVM1"
BLOCK = 512  # bits between two stored ranks
SHARD_TOKENS = 1 << 21
CACHED_WORDS = 700_000  # of a worker's memory of encoded words

_STOP = re.compile(r"[.,](?<=[^\W_][.,])(?=[ \n]|\Z)")
_PLAIN_STOP = re.compile(r"[.,](?<=[A-Za-z0-9][.,])(?=[ \n]|\Z)")


# Byte-level vocabularies write a byte without a visible character of its own as 256, 257, ...
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _VISIBLE)}


class WaveletMatrix:
    """Bit planes with rank support over a sequence of ids below 2**planes."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int]):
        self.n, self.planes, self.zeros = n, planes, zeros
        self.ranks = [self._directory(p) for p in planes]

    @staticmethod
    def _directory(plane: np.ndarray) -> np.ndarray:
        step = BLOCK // 8
        padded = np.pad(plane, (0, -len(plane) % step))
        ones = np.bitwise_count(padded.reshape(-1, step)).sum(axis=1, dtype=np.int64)
        return np.concatenate(([0], np.cumsum(ones)))

    @classmethod
    def build(cls, ids: np.ndarray, width: int) -> "WaveletMatrix":
        now = ids.astype(np.uint16 if width <= 16 else np.uint32)
        planes, zeros = [], []
        for bit in range(width - 1, -1, -1):
            ones = (now & (1 << bit)).astype(bool)
            planes.append(np.packbits(ones))
            # Places cost less than masks, whose bits no processor foresees.
            low = now.take(np.flatnonzero(~ones))
            zeros.append(len(low))
            now = np.concatenate((low, now.take(np.flatnonzero(ones))))
        return cls(len(ids), planes, zeros)

    def _bits(self, level: int, at: np.ndarray) -> np.ndarray:
        return (self.planes[level][at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1

    def _ones_before(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones of a plane in front of each position."""
        out = self.ranks[level][at // BLOCK].copy()
        first = at // BLOCK * (BLOCK // 8)
        plane = self.planes[level]
        full = at >> 3
        for k in range(BLOCK // 8):
            here = first + k < full
            if not here.any():
                break
            out[here] += np.bitwise_count(plane[(first + k)[here]])
        rest = (at & 7).astype(np.uint8)
        some = rest > 0
        out[some] += np.bitwise_count(plane[full[some]] >> (8 - rest[some]))
        return out

    def access(self, positions) -> np.ndarray:
        """The ids at the positions."""
        at = np.atleast_1d(np.asarray(positions, np.int64)).copy()
        out = np.zeros(len(at), np.uint32)
        for level, zeros in enumerate(self.zeros):
            bit = self._bits(level, at).astype(np.int64)
            ones = self._ones_before(level, at)
            at = np.where(bit == 1, zeros + ones, at - ones)
            out = (out << np.uint32(1)) | bit.astype(np.uint32)
        return out

    def _span(self, symbol: int, upto: int) -> tuple[int, int]:
        low, high = np.array([0]), np.array([upto])
        if symbol >> len(self.planes):
            return 0, 0
        for level, zeros in enumerate(self.zeros):
            a, b = self._ones_before(level, low), self._ones_before(level, high)
            if symbol >> (len(self.planes) - 1 - level) & 1:
                low, high = zeros + a, zeros + b
            else:
                low, high = low - a, high - b
        return int(low[0]), int(high[0])

    def count(self, symbol: int, upto: int | None = None) -> int:
        """How often an id occurs before a position (rank)."""
        low, high = self._span(symbol, self.n if upto is None else upto)
        return high - low

    def positions(self, symbol: int) -> np.ndarray:
        """All places of an id, ascending (select of each occurrence)."""
        low, high = self._span(symbol, self.n)
        at = np.arange(low, high)
        for level in range(len(self.planes) - 1, -1, -1):
            bits = np.unpackbits(self.planes[level], count=self.n)
            if symbol >> (len(self.planes) - 1 - level) & 1:
                at = np.flatnonzero(bits)[at - self.zeros[level]]
            else:
                at = np.flatnonzero(bits == 0)[at]
        return at

    def select(self, symbol: int, k: int) -> int:
        """The place of the k-th occurrence (from 0)."""
        return int(self.positions(symbol)[k])

    def decode(self) -> np.ndarray:
        """All ids in order, rebuilt from the lowest plane upwards."""
        out = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level in range(len(self.planes) - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.n).view(bool)
            now = np.empty_like(out)
            now[np.flatnonzero(~ones)] = out[: self.zeros[level]]
            now[np.flatnonzero(ones)] = out[self.zeros[level] :] | out.dtype.type(1 << (len(self.planes) - 1 - level))
            out = now
        return out.astype(np.uint32)

    def to_bytes(self) -> bytes:
        """The file: magic, header length, JSON header, then the planes compressed one by one."""
        packed = [bytes(pa.compress(p.tobytes(), codec="zstd", asbytes=True)) for p in self.planes]
        header = json.dumps(
            {"n": self.n, "zeros": self.zeros, "sizes": [len(p) for p in packed], "crc32": [zlib.crc32(p) for p in packed]}
        ).encode()
        return MAGIC + struct.pack("<I", len(header)) + header + b"".join(packed)

    @classmethod
    def from_bytes(cls, data: bytes) -> "WaveletMatrix":
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        (length,) = struct.unpack("<I", data[4:8])
        header = json.loads(data[8 : 8 + length])
        at, planes = 8 + length, []
        for size, crc in zip(header["sizes"], header["crc32"]):
            part = data[at : at + size]
            if zlib.crc32(part) != crc:
                raise ValueError("damaged plane")
            raw = pa.decompress(part, decompressed_size=(header["n"] + 7) // 8, codec="zstd", asbytes=True)
            planes.append(np.frombuffer(raw, np.uint8))
            at += size
        return cls(header["n"], planes, header["zeros"])


class _Known(dict):
    """Ids of words, computed on first use. Of two halves the older is dropped when the newer is full."""

    def __init__(self, ids: Callable[[str], bytes]):
        super().__init__()
        self.ids, self.older = ids, {}

    def __missing__(self, word: str) -> bytes:
        if len(self) > CACHED_WORDS // 2:
            self.older = dict(self)
            self.clear()
        found = self.older.get(word)
        if found is None:
            found = self.ids(word)
        self[word] = found
        return found


class WordEncoder:
    """Ids of whole texts, with a bounded memory of words between spaces or line ends.

    The tokenizer drops white space and never joins across it, so a text's ids are those of
    its words one after the other. Nor does it join a full stop or comma between a letter or
    digit and white space with either, so that one counts as a word. A text of Latin-1 characters
    is looked up in lower case, which is what the tokenizer reads.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # The bytes of an id: two where all ids fit.
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if self.code == "H" else "<u4")
        self.known = _Known(self._ids)

    def _ids(self, word: str) -> bytes:
        letters = self._byte_letters(word)
        if letters is None:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        else:
            ids = [t.id for t in self.model.tokenize(letters)]
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    @staticmethod
    def _split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            # Letters whose lower case is not one letter, or depends on others, stay as they are.
            return _PLAIN_STOP.sub(r" \g<0>", text).replace("\n", " ").split(" ")
        return _STOP.sub(r" \g<0>", text).replace("\n", " ").split(" ")

    @staticmethod
    def _byte_letters(word: str) -> str | None:
        """The model's own spelling of a word that the steps before the model leave as it is.

        Lower-case Latin-1 letters: composed already, one run, written byte by byte.
        """
        if not word.isalpha() or word != word.lower():
            return None
        if word.isascii():
            return word
        try:
            word.encode("latin-1")
        except UnicodeEncodeError:
            return None
        return word.encode().decode("latin-1").translate(_BYTE_LETTERS)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian numbers of ``dtype``."""
        return [b"".join(map(self.known.__getitem__, self._split(t))) for t in texts]


_encoders: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


SHARD = "part long, seq long, n_tokens long, file binary"
SHARD_MAGIC = b"WVS1"


def pack_shard(doc_ids: pa.Array, lengths: list[int], matrix: WaveletMatrix) -> bytes:
    """A shard file: magic, size and Arrow stream of (doc_id, length) in order, then the matrix file."""
    table = pa.table({"doc_id": doc_ids, "length": pa.array(lengths, pa.int64())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    held = sink.getvalue().to_pybytes()
    return SHARD_MAGIC + struct.pack("<Q", len(held)) + held + matrix.to_bytes()


def unpack_shard(data: bytes) -> tuple[pa.Array, np.ndarray, WaveletMatrix]:
    """(doc_ids, lengths, matrix) of a shard file; any document's ids are at the sum of the lengths before it."""
    if data[:4] != SHARD_MAGIC:
        raise ValueError("not a shard file")
    (size,) = struct.unpack("<Q", data[4:12])
    table = pa.ipc.open_stream(data[12 : 12 + size]).read_all()
    matrix = WaveletMatrix.from_bytes(data[12 + size :])
    lengths = table.column("length").to_numpy()
    if int(lengths.sum()) != matrix.n:
        raise ValueError("documents and ids do not agree")
    return table.column("doc_id").combine_chunks(), lengths, matrix


def write_shards(
    docs: DataFrame,
    encoder: Callable[[], WordEncoder],
    end_id: int,
    width: int,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Shard files (one row each, column ``file``) in ascending (doc_id, text).

    ``docs`` is dealt out by ranges of doc_id, so (part, seq) is the order of the shards;
    n_tokens repeats what the file says, for the sums over shards. A shard ends with the
    document that reaches ``shard_tokens``. Null texts are empty and hold the end id alone; a
    null doc_id comes first; repeated rows are all kept. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        end = np.array([end_id], encode.dtype).tobytes()
        part, seq = TaskContext.get().partitionId(), 0
        ids, lengths, held, total = [], [], [], 0

        def shard(kind: pa.DataType):
            flat = np.frombuffer(b"".join(held), encode.dtype)
            file = pack_shard(pa.array(ids, kind), lengths, WaveletMatrix.build(flat, width))
            columns = [pa.array([part]), pa.array([seq]), pa.array([len(flat)]), pa.array([file], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["part", "seq", "n_tokens", "file"])

        kind = pa.int64()
        for batch in slices(batches, "text", 1 << 20):
            kind = batch.schema.field("doc_id").type
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), encode.encode(texts)):
                ids.append(doc_id)
                lengths.append(len(found) // encode.dtype.itemsize + 1)
                held += [found, end]
                total += lengths[-1]
                if total >= shard_tokens:
                    yield shard(kind)
                    seq += 1
                    ids, lengths, held, total = [], [], [], 0
        if ids:
            yield shard(kind)

    dealt = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(dealt.mapInArrow(run, SHARD), "shards")


def read_shards(shards: DataFrame, id_type: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the shard files alone.

    ``id_type`` is the Spark type of the doc_ids that were written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _encoders.clear()  # of a worker that has written shards before
        for batch in batches:
            for row in batch.to_pylist():
                doc_ids, lengths, matrix = unpack_shard(row["file"])
                ids = matrix.decode().astype("<u4")
                stops = np.cumsum(lengths)
                crc = [zlib.crc32(ids[stop - n : stop].tobytes()) for stop, n in zip(stops, lengths)]
                columns = [pa.array(stops - lengths + row["base"], pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays([doc_ids, *columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = _with_base(shards).select("file", "base")
    return files.mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def _with_base(shards: DataFrame) -> DataFrame:
    """Each shard with the number of ids before it.

    Sums run within a part; across parts there is one row for each partition of the writer.
    """
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("part_base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    small = shards.select("part", "seq", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("inner"))
    base = small.join(parts, "part").select("part", "seq", (F.col("inner") + F.col("part_base")).alias("base"))
    return shards.join(base, ["part", "seq"])
