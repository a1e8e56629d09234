"""Byte-level BPE with a sentencepiece model that is written straight from a rank file.

Each byte of a token becomes one letter, so that every token is a piece of letters; its score is its negative rank, so that
the model merges in the order of ranks. The model normalises nothing and adds nothing. Texts are split into pre-tokens by the
pattern of the vocabulary, each is mapped, encoded and given back as ranks; a pre-token that is a token itself is that token, as
in the library of the rank files. Decoding maps pieces back to bytes.

Every row is handled where it lies: nothing is shuffled, and a task holds the model, about ``BLOCK_BYTES`` of text (or one
longer text) and the pre-tokens of ``KEPT`` remembered ids. The driver reads the rank file and sends the model, whose size is that of
the vocabulary.

Defined cases: a null or empty text has no ids and decodes to no bytes; ids without a piece raise; repeated rows are each encoded;
an empty table gives no rows; all columns ride along in ``row``, whatever their names.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from roadrisk.llm.shared import text_blocks, with_small_batches

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
KEPT = 1_000_000  # ids that a task remembers between blocks of text

FIRST_LETTER = 0x100  # the letter of byte 0
LETTERS = {byte: FIRST_LETTER + byte for byte in range(256)}
BYTES = {letter: byte for byte, letter in LETTERS.items()}
UNKNOWN = "⁇"  # the model needs one; no byte is mapped to it

# Letters and digits of Unicode versions after 16.0. The vocabulary's library takes them for other characters,
# the pattern engine used here knows some of them already.
LATER = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 "
    "10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 "
    "16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 "
    "1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 "
    "1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
OTHER = "\ue000"  # a character that is no letter, digit or space in any version
FIRST_LATER_BYTE = 0xD5  # the first byte of U+0558


def vocabulary(path: str = RANKS) -> dict[bytes, int]:
    """Token to rank."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


# --- the model -------------------------------------------------------------------------------------


def _number(value: int) -> bytes:
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    return bytes([*out, value])


def _field(number: int, value: int | float | str | bytes) -> bytes:
    """A field of a protocol buffer message."""
    if isinstance(value, float):
        return _number(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _number(number << 3) + _number(value & (1 << 64) - 1)
    data = value.encode() if isinstance(value, str) else value
    return _number(number << 3 | 2) + _number(len(data)) + data


def letters(token: bytes) -> str:
    return token.decode("latin-1").translate(LETTERS)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model whose piece k is the token with the k-th smallest rank."""
    order = sorted(ranks, key=ranks.__getitem__)
    normal, unknown, bpe = 1, 2, 2
    pieces = [_field(1, _field(1, letters(t)) + _field(2, -float(ranks[t])) + _field(3, normal)) for t in order]
    pieces.append(_field(1, _field(1, UNKNOWN) + _field(2, 0.0) + _field(3, unknown)))
    absent = -1
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(order)) + _field(41, absent) + _field(42, absent) + _field(43, absent)
    as_is = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)  # no prefix, all spaces kept, none escaped
    return b"".join(pieces) + _field(2, trainer) + _field(3, as_is)


# --- pre-tokens ------------------------------------------------------------------------------------


class Splitter:
    """Matches of the pattern in a text."""

    def __init__(self, pattern: str):
        self.pattern = regex.compile(pattern)
        ranges = "".join("-".join(f"\\U{int(end, 16):08X}" for end in part.split("-")) for part in LATER.split())
        self.later = regex.compile(f"[{ranges}]")

    def __call__(self, data: bytes) -> list[str]:
        text = data.decode("utf-8", "replace")
        if (np.frombuffer(data, np.uint8) >= FIRST_LATER_BYTE).any() and self.later.search(text):
            shown = self.later.sub(OTHER, text)
            return [text[m.start() : m.end()] for m in self.pattern.finditer(shown)]
        return [m.group() for m in self.pattern.finditer(text)] if self.pattern.groups else self.pattern.findall(text)


class Encoder:
    """Ids of pre-tokens, remembered up to a bound."""

    def __init__(self, model: bytes, ranks: list[int]):
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.ranks = ranks
        self.known: dict[str, tuple[int, ...]] = {}
        self.held = 0  # ids in ``known``

    def learn(self, words: set[str]) -> None:
        """Adds the ids of all words at once."""
        if self.held > KEPT:
            self.known.clear()
            self.held = 0
        new = [word for word in words if word not in self.known]
        mapped = [letters(word.encode()) for word in new]
        whole = self.pieces.piece_to_id(mapped)
        for word, piece, found in zip(new, whole, self.pieces.encode(mapped, num_threads=1), strict=True):
            found = found if piece == len(self.ranks) else [piece]
            self.known[word] = tuple(map(self.ranks.__getitem__, found))
            self.held += len(self.known[word])

    def __call__(self, texts: list[list[str]]) -> list[np.ndarray]:
        self.learn(set().union(*texts))
        return [np.fromiter(chain.from_iterable(map(self.known.__getitem__, words)), np.int32) for words in texts]


# --- operators -------------------------------------------------------------------------------------


def _kind(df: DataFrame) -> str:
    return df.schema["row"].dataType.simpleString()


def encoded(docs: DataFrame, path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """``row`` (all columns of a document) and ``ids``, the tokens of its whole text."""
    ranks = vocabulary(path)
    model, numbers = model_bytes(ranks), sorted(ranks.values())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, ids_of = Splitter(pattern), Encoder(model, numbers)
        whole = (pa.RecordBatch.from_arrays([b.column(0), b.column(0).field("text")], ["row", "text"]) for b in batches)
        for batch, texts in text_blocks(whole):
            rows = ids_of([split(t) if t else [] for t in texts])
            ends = np.cumsum([0, *map(len, rows)])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["row", "ids"])

    held = with_small_batches(docs).select(F.struct("*").alias("row"))
    return held.mapInArrow(encode, f"row {_kind(held)}, ids array<int>")


def decoded(rows: DataFrame, path: str = RANKS) -> DataFrame:
    """``rows`` (row, ids) with ``decoded``, the bytes that the ids stand for."""
    ranks = vocabulary(path)
    model, numbers = model_bytes(ranks), sorted(ranks.values())

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        bytes_of = {rank: pieces.id_to_piece(k).translate(BYTES).encode("latin-1") for k, rank in enumerate(numbers)}
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("ids"))
            ends, values = column.offsets.to_numpy(), column.values.to_numpy().tolist()
            texts = [b"".join(map(bytes_of.__getitem__, values[a:b])) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], [*batch.schema.names, "decoded"])

    return rows.mapInArrow(decode, f"row {_kind(rows)}, ids array<int>, decoded binary")


def report(rows: DataFrame) -> DataFrame:
    """The digest of ``decoded`` for each document."""
    return rows.select(
        "row.doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
