"""Token ids in patched frame-of-reference files.

Texts are encoded by the public tokenizer file given as a parameter, documents lie in ascending order of
doc_id over all files, and every document ends with ``END``. A file is one Parquet part in the shared
folder, so Spark's commit protocol, any file system and a lost executor are no matter; its rows are
segments of whole documents with a binary payload of blocks:

    payload  = magic "PFR1", u32 block size, u64 ids, u32 blocks, u64 start of each block, blocks
    block    = u32 minimum, u8 width, u16 exceptions, packed differences, u16 positions, u32 differences

A block's minimum is subtracted; the differences are packed at the width that holds ``PERCENTILE``
percent of them, and what needs more bits is stored whole in the exception list. Block starts allow
reading a range of ids without decoding what lies before it (``read_range``).

Words are encoded once per worker: the pre-tokenizer never joins across white space, so the ids of a
text are the ids of its space-separated pieces in turn. The memo of pieces is bounded and only saves
time.

Defined results: NULL and empty texts hold the end id alone; a NULL doc_id comes first; rows that share a
doc_id follow one another in the order of their texts' hashes; an empty table gives no file rows; other columns are
ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronograin.llm.common import raw_texts
from chronograin.session import work_path

TOKENIZER = "word_bpe_49k.json"
END = 2
BLOCK = 256
PERCENTILE = 90
# ids after which a segment ends with the document at hand
SEGMENT = 1 << 16
# pieces after which a worker's memo starts anew, with what it held before still at hand once more
MEMO = 200_000

_MAGIC = b"PFR1"
_HEAD = struct.Struct("<4sIQI")
_BLOCK_HEAD = struct.Struct("<IBH")
_STORED = "shard int, segment int, start bigint, doc_ids array<bigint>, doc_tokens array<int>, payload binary"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Place of a public tokenizer file on this machine; a path is taken as it is."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_alphabet() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the
    others for the code points from 256 on, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


_ALPHABET = _byte_alphabet()


class _Memo(dict):
    """Ids of pieces, encoded when first met, or taken over from the memo before."""

    def __init__(self, encode: Callable[[bytes], bytes], before: dict[bytes, bytes]) -> None:
        self.encode, self.before = encode, before

    def __missing__(self, piece: bytes) -> bytes:
        ids = self.before.get(piece)
        self[piece] = ids = self.encode(piece) if ids is None else ids
        return ids


class Encoder:
    """Encodes whole texts as little-endian u32 ids, piece by piece with a bounded memo."""

    _tails = b".,;:!?%$&*#|()"

    def __init__(self, name: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        self.memo = _Memo(self.piece, {})

    def text(self, text: bytes | None) -> bytes:
        if not text:
            return b""
        if len(self.memo) > MEMO:
            # only the memo before is kept, not the one before that
            self.memo = _Memo(self.piece, dict(self.memo))
        # names of special tokens are matched before upper case is lowered
        pieces = (text if b"<|" in text else text.lower()).split()
        return b"".join(map(self.memo.__getitem__, pieces))

    def piece(self, piece: bytes) -> bytes:
        """Ids of one piece. ASCII punctuation behind a letter is always a pre-token of its own."""
        word = piece.rstrip(self._tails)
        text = word.decode()
        # lower-case Latin letters up to U+024F pass the normalizer unchanged and make one pre-token
        if text.isalpha() and max(text) < "\u0250" and text == text.lower():
            if word != piece:
                return self.memo[word] + self.memo[piece[len(word) :]]
            return self._pack([t.id for t in self.tokenizer.model.tokenize(word.decode("latin-1").translate(_ALPHABET))])
        return self._pack(self.tokenizer.encode(piece.decode(), add_special_tokens=False).ids)

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)


_encoders: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]


def _bit_lengths(values: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.uint8)


def pack(ids: np.ndarray, block: int = BLOCK, percentile: int = PERCENTILE) -> bytes:
    """The payload of a run of u32 ids."""
    n = len(ids)
    blocks = -(-n // block)
    if not n:
        return _HEAD.pack(_MAGIC, block, 0, 0)
    # the last block is filled up with its own last id
    rows = np.concatenate([ids, np.full(blocks * block - n, ids[-1], ids.dtype)]).astype(np.uint32).reshape(blocks, block)
    low = rows.min(1)
    rows = rows - low[:, None]
    at = min(block - 1, -(-block * percentile // 100) - 1)
    widths = _bit_lengths(np.partition(rows, at, axis=1)[:, at])
    over = (rows.astype(np.uint64) >> widths[:, None].astype(np.uint64)) != 0
    packed: list[bytes] = [b""] * blocks
    big = np.where(over, 0, rows).astype(">u4")
    for width in np.unique(widths):
        chosen = np.flatnonzero(widths == width)
        bits = np.unpackbits(big[chosen].view(np.uint8).reshape(len(chosen), block, 4), axis=2)[:, :, 32 - width :]
        for i, row in zip(chosen, np.packbits(bits.reshape(len(chosen), -1), axis=1), strict=True):
            packed[i] = row.tobytes()
    counts = over.sum(1)
    where, positions = np.nonzero(over)
    values = rows[where, positions].astype("<u4")
    positions = positions.astype("<u2")
    firsts = np.r_[0, np.cumsum(counts)]
    parts = []
    for i in range(blocks):
        a, b = firsts[i], firsts[i + 1]
        parts.append(
            _BLOCK_HEAD.pack(low[i], widths[i], b - a) + packed[i] + positions[a:b].tobytes() + values[a:b].tobytes()
        )
    head = _HEAD.size + 8 * blocks
    starts = head + np.r_[0, np.cumsum([len(p) for p in parts])[:-1]]
    return b"".join([_HEAD.pack(_MAGIC, block, n, blocks), starts.astype("<u8").tobytes(), *parts])


def unpack(payload: bytes, start: int = 0, count: int | None = None) -> np.ndarray:
    """Ids ``start .. start + count`` of a payload (all by default); only their blocks are decoded."""
    magic, block, n, blocks = _HEAD.unpack_from(payload)
    if magic != _MAGIC:
        raise ValueError("not a block payload")
    stop = n if count is None else min(n, start + count)
    if start >= stop:
        return np.empty(0, np.uint32)
    first, last = start // block, -(-stop // block)
    starts = np.frombuffer(payload, "<u8", blocks, _HEAD.size)[first:last]
    heads = [_BLOCK_HEAD.unpack_from(payload, s) for s in starts.tolist()]
    low, widths, counts = (np.array(x) for x in zip(*heads, strict=True))
    out = np.zeros((len(heads), block), dtype=np.uint32)
    sizes = -(-block * widths // 8)
    whole = np.frombuffer(payload, np.uint8)
    for width in np.unique(widths):
        if not width:
            continue
        chosen = np.flatnonzero(widths == width)
        size = -(-block * int(width) // 8)
        at = starts[chosen].astype(np.int64) + _BLOCK_HEAD.size
        raw = whole[at[:, None] + np.arange(size)]
        bits = np.unpackbits(raw, axis=1)[:, : block * width].reshape(len(chosen), block, width)
        wide = np.zeros((len(chosen), block, 32), dtype=np.uint8)
        wide[:, :, 32 - width :] = bits
        out[chosen] = np.packbits(wide, axis=2).view(">u4")[:, :, 0]
    for i in np.flatnonzero(counts):
        at = int(starts[i]) + _BLOCK_HEAD.size + int(sizes[i])
        k = int(counts[i])
        out[i, np.frombuffer(payload, "<u2", k, at)] = np.frombuffer(payload, "<u4", k, at + 2 * k)
    out += low.astype(np.uint32)[:, None]
    return out.reshape(-1)[start - first * block : stop - first * block]


def write_tokens(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end: int = END) -> None:
    """Write the documents' ids to ``path``, one file per range of doc_ids."""
    by = [F.col("doc_id").asc_nulls_first(), F.col("_hash"), F.col("_salt")]
    # the salt splits rows that are alike in both, which may then come in any order
    tagged = docs.select(
        "doc_id", "text", F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_salt")
    )
    placed = tagged.repartitionByRange(*by).sortWithinPartitions(*by).select("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_ids = encoder(tokenizer).text
        last = struct.pack("<I", end)
        shard, segment, start = TaskContext.get().partitionId(), 0, 0
        doc_ids: list[int | None] = []
        sizes: list[int] = []
        parts: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), "<u4")
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([start], pa.int64()),
                    pa.array([doc_ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())),
                    pa.array([pack(ids)], pa.binary()),
                ],
                ["shard", "segment", "start", "doc_ids", "doc_tokens", "payload"],
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), raw_texts(batch), strict=True):
                ids = text_ids(text) + last
                doc_ids.append(doc_id)
                sizes.append(len(ids) // 4)
                parts.append(ids)
                size += sizes[-1]
                if size >= SEGMENT:
                    yield flush()
                    segment, start, size = segment + 1, start + size, 0
                    doc_ids, sizes, parts = [], [], []
        if doc_ids:
            yield flush()

    placed.mapInArrow(encode, _STORED).write.parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    stored = spark.read.schema(_STORED).parquet(path)
    # one number for each file: files are as many as the write had partitions
    ends = stored.groupBy("shard").agg(F.max(F.col("start") + F.aggregate("doc_tokens", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("n"))
    offsets, total = {}, 0
    for row in ends.orderBy("shard").collect():
        offsets[row["shard"]] = total
        total += row["n"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["payload"]).astype("<u4")
                stops = np.cumsum(row["doc_tokens"])
                starts = stops - row["doc_tokens"]
                raw = memoryview(ids).cast("B")
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(starts + (row["start"] + offsets[row["shard"]]), pa.int64()),
                        pa.array(row["doc_tokens"], pa.int64()),
                        pa.array(crcs, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    few = stored.select("shard", "start", "doc_ids", "doc_tokens", "payload")
    return few.mapInArrow(decode, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def read_range(spark, path: str, shard: int, start: int, count: int) -> list[int]:
    """Ids ``start .. start + count`` of one file, through the block index."""
    size = F.aggregate("doc_tokens", F.lit(0).cast("bigint"), lambda a, x: a + x)
    rows = (
        spark.read.schema(_STORED)
        .parquet(path)
        .where((F.col("shard") == shard) & (F.col("start") < start + count) & (F.col("start") + size > start))
        .orderBy("start")
        .select("start", "payload")
    )
    out: list[int] = []
    for row in rows.toLocalIterator():
        skip = max(0, start - row["start"])
        out += unpack(bytes(row["payload"]), skip, start + count - row["start"] - skip).tolist()
    return out


def token_files(docs: DataFrame, tokenizer: str = TOKENIZER, path: str | None = None) -> DataFrame:
    """Write the ids of all documents and return what is read back of each."""
    spark = docs.sparkSession
    path = work_path(spark, "tokens") if path is None else path
    write_tokens(docs, path, tokenizer)
    return read_tokens(spark, path)
