"""Token counts of whole texts, without the tokens.

Texts arrive in Arrow batches bounded by bytes. A long text is cut into slices at safe boundaries, places that no
token of the tokenizer can span, and every slice into pieces at such boundaries too. The pieces that a worker has not
met yet are encoded in batches of about the same number of bytes (not of rows), and only their lengths are kept: the
count of a text is the sum over its pieces. The memo of lengths is bounded and only saves time.

Safe boundaries, by tokenizer file:

* ``word_bpe_49k.json``: before ASCII white space, which its normalizer folds and its pre-tokenizer drops, and before
  an ASCII digit, which is always a pre-token of its own; no character composes with either from the left, and the
  special strings hold neither.
* ``byte_bpe_50k.json``: before a single space between two visible ASCII characters, where its pre-tokenizer always
  begins a pre-token.
* any other file (``.json`` or ``.model``): none is known, so texts are encoded whole.

Special strings inside texts are handled as the library does by default; begin and end tokens are never added.

Defined results: NULL and empty texts have 0 bytes and 0 tokens; rows are counted one by one, so NULL or repeated ids, ties
and repeated rows are no matter; a text of any length is counted whole, in slices; an empty table gives no rows;
other columns are ignored unless named in ``keep``, whatever they are called.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from chronograin.llm.common import per_batch, raw_texts, settle

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
# bytes of a text that are cut into pieces at once, and of a piece that is cut further
SLICE_BYTES = 1 << 20
PIECE_BYTES = 1 << 12
# bytes of new pieces that are encoded by one call
ENCODE_BYTES = 1 << 16
# pieces after which a worker's memo starts anew, and bytes above which a piece is not remembered
MEMO = 400_000
MEMO_BYTES = 64


@dataclass(frozen=True)
class Boundaries:
    """Where a text may be cut (at the start of a match), and how a slice falls into pieces."""

    cut: re.Pattern[bytes]
    pieces: Callable[[bytes], list[bytes]]


SAFE = {
    "word_bpe_49k.json": Boundaries(re.compile(rb"[\x09-\x0D\x20]|[0-9]"), bytes.split),
    "byte_bpe_50k.json": Boundaries(
        re.compile(rb"(?<=[!-~])\x20(?=[!-~])"), re.compile(rb"(?<=[!-~])(?=\x20[!-~])").split
    ),
}


def slices(text: bytes, size: int, cut: re.Pattern[bytes]) -> Iterator[bytes]:
    """The text in parts of ``size`` bytes, each prolonged to the next safe boundary (or the end)."""
    start = 0
    while len(text) - start > size:
        found = cut.search(text, start + size)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:] if start else text


def byte_batches(pieces: list[bytes], size: int) -> Iterator[list[bytes]]:
    """The pieces in order of length, in lists of about ``size`` bytes; a longer piece comes alone."""
    batch: list[bytes] = []
    held = 0
    for piece in sorted(pieces, key=len):
        if batch and held + len(piece) > size:
            yield batch
            batch, held = [], 0
        batch.append(piece)
        held += len(piece)
    if batch:
        yield batch


def place(name: str) -> str:
    """Place of a public tokenizer file on this machine; a path is taken as it is."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def batch_lengths(name: str) -> Callable[[list[bytes]], list[int]]:
    """A function from texts to their numbers of tokens, encoded as one batch."""
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=place(name))
        return lambda texts: [len(ids) for ids in model.encode([t.decode() for t in texts], num_threads=1)]
    # a task has one core; threads of the library would only contend
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(place(name))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(e) for e in tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]


class Counter:
    """Counts the tokens of texts in one worker."""

    def __init__(self, name: str) -> None:
        self.lengths = batch_lengths(name)
        self.safe = SAFE.get(os.path.basename(name))
        self.memo: dict[bytes, int] = {}

    def encode(self, pieces: list[bytes]) -> dict[bytes, int]:
        found: dict[bytes, int] = {}
        for batch in byte_batches(pieces, ENCODE_BYTES):
            found.update(zip(batch, self.lengths(batch), strict=True))
        return found

    def learn(self, texts: list[bytes]) -> None:
        """Encode what the memo lacks of the short pieces of all texts, in one go."""
        new: set[bytes] = set()
        for text in texts:
            new.update(self.safe.pieces(text))
        new.difference_update(self.memo)
        self.memo.update(self.encode([p for p in new if len(p) <= MEMO_BYTES]))

    def pieces(self, text: bytes) -> int:
        """Tokens of one slice, whose short pieces are known."""
        pieces = self.safe.pieces(text)
        try:
            return sum(map(self.memo.__getitem__, pieces))
        except KeyError:
            # pieces too long to remember are few; each is cut once more where that is safe
            long = {p: list(slices(p, PIECE_BYTES, self.safe.cut)) for p in pieces if p not in self.memo}
        parts = self.encode(list({part for found in long.values() for part in found}))
        return sum(self.memo[p] if p in self.memo else sum(map(parts.__getitem__, long[p])) for p in pieces)

    def count(self, texts: list[bytes | None]) -> list[int]:
        if self.safe is None:
            known = self.encode(list({t for t in texts if t}))
            return [known[t] if t else 0 for t in texts]
        if len(self.memo) > MEMO:
            self.memo = {}
        self.learn([t for t in texts if t and len(t) <= SLICE_BYTES])
        return [(self.pieces(t) if len(t) <= SLICE_BYTES else self.long_text(t)) if t else 0 for t in texts]

    def long_text(self, text: bytes) -> int:
        total = 0
        for part in slices(text, SLICE_BYTES, self.safe.cut):
            self.learn([part])
            total += self.pieces(part)
        return total


_counters: dict[str, Counter] = {}


def counter(name: str) -> Counter:
    if name not in _counters:
        _counters[name] = Counter(name)
    return _counters[name]


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = LIMIT, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_bytes, n_tokens and whether n_tokens is above ``limit``, for every row; no shuffle."""
    settle(docs.sparkSession)
    new = T.StructType(
        [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    )

    def count(batch: pa.RecordBatch) -> dict[str, list]:
        texts = raw_texts(batch)
        tokens = counter(tokenizer).count(texts)
        return {"n_bytes": [len(t or b"") for t in texts], "n_tokens": tokens, "over_limit": [n > limit for n in tokens]}

    return per_batch(docs.select(*keep, "text"), count, new, list(keep))
