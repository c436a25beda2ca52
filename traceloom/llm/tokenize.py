"""Encoding of the whole corpus with a public tokenizer (problem 7): the tokenizers library over Arrow batches.

Whole texts go to the library. For a tokenizer whose own settings say that it is a plain byte-level BPE (no normalizer,
the library's own pretoken pattern, no prefix space, no word ends, no dropout) most of a text takes a shorter way with the
same ids: the text is cut where a token ends whatever surrounds it, ASCII pieces are cut into pretokens by the published
pattern and looked up in a bounded memo that the library fills, once per distinct pretoken. The settings are read from
the tokenizer itself; any other tokenizer gets whole texts only.

Offsets come from the ids: the byte table turns each id into its bytes, their running length meets the byte at which each
character of the text starts. Decoding reverses the byte table and joins bytes before it reads characters.

The driver reads the tokenizer's file and broadcasts its text (the file's size, under 2 MB for the public ones), so the
executors need no copy of the file.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.operators.shared import spread

# The pretoken pattern of the byte-level vocabularies for ASCII text, and a line end that is a token of its own.
ASCII_PRETOKEN = r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
SAFE_CUT = r"(?<=[!-~]\n)(?=[!-~])"

MEMO_ENTRIES = 200_000
MEMO_CHARS = 256
BATCH_CHARS = 1 << 20


def tokenizer_path(name: str = "byte_bpe_50k") -> str:
    """Place of a public tokenizer's file; ``TRACELOOM_TOKENIZERS`` names another folder. Only the driver reads it."""
    folder = os.environ.get("TRACELOOM_TOKENIZERS", "/opt/tokenizers")
    return os.path.join(folder, f"{name}.json")


@lru_cache(maxsize=4)
def parsed(text: str):
    """The tokenizer of a file's text; one per worker process. Special tokens' strings count as ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(text)
    tok.encode_special_tokens = True
    tok.no_truncation()
    tok.no_padding()
    return tok


def load(path: str):
    """The tokenizer of a file."""
    return parsed(Path(path).read_text(encoding="utf-8"))


def shared_text(df: DataFrame, path: str | None) -> Broadcast[str]:
    """The text of the tokenizer's file (default: ``byte_bpe_50k``) for the executors."""
    return df.sparkSession.sparkContext.broadcast(Path(path or tokenizer_path()).read_text(encoding="utf-8"))


def plain_byte_level(settings: dict) -> bool:
    """Whether ids of ASCII text follow from its pretokens alone, by the published byte-level pattern."""
    before, model = settings.get("pre_tokenizer") or {}, settings["model"]
    own_pattern = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
    affixes = any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
    # an added token that isn't special is found inside texts before they are cut
    added = all(t["special"] for t in settings.get("added_tokens") or [])
    whole_alphabet = byte_alphabet().keys() <= model.get("vocab", {}).keys()
    return bool(own_pattern and model.get("type") == "BPE" and not affixes and added and whole_alphabet and settings.get("normalizer") is None)


class Encoder:
    """Ids of whole texts by the tokenizers library, with a memo of bounded size where pretokens decide the ids."""

    def __init__(self, text: str):
        self.tok = parsed(text)
        self.by_pretoken = plain_byte_level(json.loads(text))
        self.memo: dict[str, bytes] = {}
        self.pretokens = re.compile(ASCII_PRETOKEN, re.ASCII).findall
        self.cut = re.compile(SAFE_CUT).split

    def _library(self, pieces: list[str]) -> Iterator[bytes]:
        """The library's own encoding, in batches of bounded size."""
        batch, chars = [], 0
        for i, t in enumerate(pieces):
            batch.append(t)
            chars += len(t)
            if chars >= BATCH_CHARS or i == len(pieces) - 1:
                for e in self.tok.encode_batch_fast(batch, add_special_tokens=False):
                    yield np.array(e.ids, np.int32).tobytes()
                batch, chars = [], 0

    def _pieces(self, text: str) -> list[str]:
        if text.isascii():
            return self.pretokens(text)
        out: list[str] = []
        for p in self.cut(text):
            if p.isascii():
                out += self.pretokens(p)
            else:
                out.append(p)
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Int32 bytes of every text's ids; none for an empty or null text."""
        if not self.by_pretoken:
            return list(self._library([t or "" for t in texts]))
        cut = [self._pieces(t) if t else [] for t in texts]
        if len(self.memo) > MEMO_ENTRIES:
            self.memo = {}
        known = self.memo
        new = list(set().union(*cut).difference(known))
        long = {}
        for piece, ids in zip(new, self._library(new)):
            (known if len(piece) <= MEMO_CHARS else long)[piece] = ids
        table = known | long if long else known
        return [b"".join(map(table.__getitem__, pieces)) for pieces in cut]


@lru_cache(maxsize=4)
def encoder(text: str) -> Encoder:
    return Encoder(text)


def _texts(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """The column in runs of bounded size; a longer text is a run of its own."""
    start, chars, run = 0, 0, []
    for i, v in enumerate(column):
        t = v.as_py()
        run.append(t)
        chars += len(t) if t else 0
        if chars >= BATCH_CHARS:
            yield start, run
            start, chars, run = i + 1, 0, []
    if run:
        yield start, run


def _over(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], id_col: str, schema: str) -> DataFrame:
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, {schema}").withColumnRenamed("_id", id_col)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)))


def encode_ids(docs: DataFrame, path: str | None = None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``id_col`` and ``ids`` (list of int32) of every row, without special tokens.

    Null and empty texts have the empty list; blank ones are encoded like any other; texts of any length are encoded
    whole; every input row gives a row; further columns are left out. No shuffle beyond spreading a small scan.
    """
    held = shared_text(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(held.value)
        for b in batches:
            for start, texts in _texts(b.column(1)):
                ids = _lists([np.frombuffer(p, np.int32) for p in enc.encode(texts)])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(ids)), ids], ["_id", "ids"])

    rows = spread(docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")))
    return _over(rows, run, id_col, "ids array<int>")


def count_tokens(docs: DataFrame, path: str | None = None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``id_col`` and ``n_tokens`` of every row; 0 for null and empty texts. As ``encode_ids``, but only sizes leave the worker."""
    held = shared_text(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(held.value)
        for b in batches:
            for start, texts in _texts(b.column(1)):
                sizes = pa.array([len(p) // 4 for p in enc.encode(texts)], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(sizes)), sizes], ["_id", "n_tokens"])

    rows = spread(docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")))
    return _over(rows, run, id_col, "n_tokens bigint")


def byte_alphabet() -> dict[str, int]:
    """Character of the byte-level alphabet to its byte: printable bytes stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=4)
def token_bytes(text: str) -> list[bytes]:
    """The bytes of every id: the vocabulary's strings with the byte table reversed. A word end gives a space, special
    tokens their own text."""
    tok, table = parsed(text), byte_alphabet()
    settings = json.loads(text)
    ends, added = settings["model"].get("end_of_word_suffix") or "", {t["id"] for t in settings.get("added_tokens") or []}
    out = []
    for i in range(tok.get_vocab_size(with_added_tokens=True)):
        s = tok.id_to_token(i) or ""
        tail = b" " if ends and i not in added and s.endswith(ends) else b""
        s = s[: len(s) - len(ends)] if tail else s
        out.append(bytes(table[c] for c in s) + tail if i not in added and all(c in table for c in s) else s.encode() + tail)
    return out


def spans(text: str, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and end (exclusive) of each token, for ids whose bytes together are the text's bytes."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    of_byte = np.cumsum((raw & 0xC0) != 0x80) - 1  # the character that each byte belongs to
    ends = np.cumsum(sizes[ids])
    return of_byte[ends - sizes[ids]], of_byte[ends - 1] + 1


def encode_offsets(docs: DataFrame, path: str | None = None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """As ``encode_ids`` with ``starts`` and ``ends`` of each token in characters of the text.

    For a byte-level tokenizer the spans come from the byte lengths of the ids, so they follow one another, cover the
    whole text, and the tokens of a character that is split over several have that character's span each. Other
    tokenizers change the text before they cut it; for those the library traces each token back.
    """
    held = shared_text(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(held.value)
        sizes = np.array([len(x) for x in token_bytes(held.value)], np.int64)
        for b in batches:
            for start, texts in _texts(b.column(1)):
                if enc.by_pretoken:
                    ids = [np.frombuffer(p, np.int32) for p in enc.encode(texts)]
                    both = [spans(t, i, sizes) if len(i) else (i, i) for t, i in zip(texts, ids)]
                else:
                    found = enc.tok.encode_batch([t or "" for t in texts], add_special_tokens=False)
                    ids = [np.array(e.ids, np.int32) for e in found]
                    both = [tuple(np.array(e.offsets, np.int32).reshape(-1, 2).T) for e in found]
                made = [_lists(ids), _lists([x for x, _ in both]), _lists([y for _, y in both])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(ids)), *made], ["_id", "ids", "starts", "ends"])

    rows = spread(docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")))
    return _over(rows, run, id_col, "ids array<int>, starts array<int>, ends array<int>")


def decode_ids(encoded: DataFrame, path: str | None = None, ids: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """``id_col`` and ``text`` from ids. Bytes are joined before they are read as UTF-8, so characters split over tokens
    come back whole; bytes that aren't UTF-8 (ids cut inside a character) become U+FFFD. Null ids and an empty list give
    the empty text; ids outside the vocabulary give U+FFFD. A tokenizer that changes texts (lower case, white space) gives
    the changed text back, with a space after each word."""
    held = shared_text(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(held.value)
        for b in batches:
            out = [
                b"".join(table[k] if k is not None and 0 <= k < len(table) else b"\xef\xbf\xbd" for k in (v.as_py() or [])).decode("utf-8", "replace")
                for v in b.column(1)
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["_id", "text"])

    return _over(encoded.select(F.col(id_col).alias("_id"), F.col(ids).alias("_ids")), run, id_col, "text string")
