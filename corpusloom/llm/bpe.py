"""Byte-level BPE: encoding and decoding by the ranks of a vocabulary file."""

from __future__ import annotations

import base64
import functools
import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import others
from ._words import lists, pieces

#: Distinct spans whose ids a task keeps, those met first; others are encoded each time.
KEPT_SPANS = 300_000


@functools.cache
def byte_chars() -> list[str]:
    """The printable character of each byte: bytes that print stand for themselves, the others for 256 and up in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[str, str]]:
    """All pairs of tokens that make a token, by its rank: a merge by ranks takes any such pair."""
    chars = byte_chars()
    spell = {t: "".join(chars[b] for b in t) for t in ranks}
    out = []
    for token in sorted((t for t in ranks if len(t) > 1), key=ranks.__getitem__):
        out += [(spell[token[:i]], spell[token[i:]]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
    return out


#: White space as the split pattern means it (the Unicode property).
_SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class Coder:
    """The tokenizers library's BPE with the vocabulary and merges of ``ranks``, and its table turned round.

    Most texts are made of spans seen before, so the ids of each span between spaces are kept. A match of the pattern
    never goes on after a space that follows other characters, so spans can be split and encoded for themselves.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        chars = byte_chars()
        vocab = {"".join(chars[b] for b in t): i for t, i in ranks.items()}
        size = max(ranks.values()) + 1
        # the spelling of bytes has no space, so a space between matches is a token of its own that tells them apart
        self.between = size
        self.tokenizer = Tokenizer(models.BPE(vocab=vocab | {" ": size}, merges=merges_of(ranks), ignore_merges=True, cache_capacity=0))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Split(" ", "isolated")
        self.table = {b: c for b, c in enumerate(chars)}
        self.byte_of = {c: b for b, c in enumerate(chars)}
        self.matches = regex.compile(pattern).findall
        self.spans = re.compile(f"[{_SPACES}]+(?![^{_SPACES}])| ?[^{_SPACES}]+|[{_SPACES}]+").findall
        self.known: dict[str, bytes] = {}
        bytes_of = [b""] * size
        for spelled, i in vocab.items():
            bytes_of[i] = bytes(map(self.byte_of.__getitem__, spelled))
        self.length_of = np.array([len(b) for b in bytes_of], np.int64)
        self.start_of = np.cumsum(self.length_of) - self.length_of
        self.all_bytes = np.frombuffer(b"".join(bytes_of), np.uint8)

    def learned(self, spans: list[str]) -> dict[str, bytes]:
        """Ids of new spans: their matches spelled as byte characters, encoded many at a time."""
        made = {}
        for at in range(0, len(spans), 1000):
            some = spans[at:at + 1000]
            found = [self.matches(s) for s in some]
            if any("\0" in s for s in some):  # that character can't part matches then
                spelled = " ".join(m.encode("utf-8").decode("latin-1").translate(self.table) for f in found for m in f)
            else:
                spelled = "\0".join(["\0".join(f) for f in found]).encode("utf-8").decode("latin-1").translate(self.table | {0: " "})
            ids = np.array(self.tokenizer.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, "<u4")
            gaps = np.append(np.flatnonzero(ids == self.between), len(ids))
            last = np.cumsum([len(f) for f in found]) - 1  # the last match of each span
            counts = np.diff(gaps[last] - last, prepend=0).tolist()  # its ids, without those between matches
            raw, begin = ids[ids != self.between].tobytes(), 0
            for s, n in zip(some, counts, strict=True):
                made[s] = raw[begin:begin + 4 * n]
                begin += 4 * n
        return made

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        found = [self.spans(t) for t in texts]
        new = self.learned([s for s in dict.fromkeys(chain.from_iterable(found)) if s not in self.known])
        if len(self.known) + len(new) <= KEPT_SPANS:
            self.known.update(new)
            return [b"".join(map(self.known.__getitem__, f)) for f in found]
        kept = self.known.get
        return [b"".join([kept(s) or new[s] for s in f]) for f in found]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids, one after the other; a character split over tokens is whole again once they are joined."""
        length = self.length_of[ids]
        end = np.cumsum(length)
        return self.all_bytes[np.repeat(self.start_of[ids] - (end - length), length) + np.arange(int(end[-1]) if len(end) else 0)]


@functools.cache
def coder(path: str, pattern: str) -> Coder:
    return Coder(read_ranks(path), pattern)


def encode_batches(path: str, pattern: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, texts, replaced by ids and ends, in pieces of a MB of text."""
    c = coder(path, pattern)
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        for lo, hi in pieces(texts):
            coded = c.encode_all([t or "" for t in texts.slice(lo, hi - lo).to_pylist()])
            counts = np.array([len(x) // 4 for x in coded], np.int64)
            ids = np.frombuffer(b"".join(coded), "<u4").astype(np.int32)
            ends = np.concatenate([[0], np.cumsum(c.length_of[ids])])
            within = (ends[1:] - np.repeat(ends[np.cumsum(counts) - counts], counts)).astype(np.int32)
            rest = [x.slice(lo, hi - lo) for x in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*rest, lists(ids, counts, pa.int32()), lists(within, counts, pa.int32())], names=[*batch.schema.names[:-1], "ids", "ends"])


def decode_batches(path: str, pattern: str, ids_col: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``decoded``; ids of some 2000 rows at a time."""
    c = coder(path, pattern)
    for whole in batches:
        for at in range(0, whole.num_rows, 2000):
            batch = whole.slice(at, 2000)
            ids = batch.column(batch.schema.get_field_index(ids_col))
            ids = ids.fill_null([]) if ids.null_count else ids
            offsets = ids.offsets.to_numpy().astype(np.int64)
            values = ids.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
            ends = np.concatenate([[0], np.cumsum(c.length_of[values])])[offsets - offsets[0]]
            made = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(c.decode(values))])
            yield pa.RecordBatch.from_arrays([*batch.columns, made.cast(pa.binary())], names=[*batch.schema.names, "decoded"])


def digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n_tokens, ids_sha256 and decoded_sha256 in place of ids, ends and decoded."""
    for batch in batches:
        ids, raw = batch.column(batch.schema.get_field_index("ids")), batch.column(batch.schema.get_field_index("decoded"))
        values, offsets = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
        counts = np.diff(offsets).astype(np.int64)
        sums = [hashlib.sha256(values[a:b].tobytes()).hexdigest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        bytes_too = [hashlib.sha256(x.as_py() or b"").hexdigest() for x in raw]
        rest = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in ("ids", "ends", "decoded")}
        yield pa.RecordBatch.from_arrays([*rest.values(), pa.array(counts), pa.array(sums), pa.array(bytes_too)], names=[*rest, "n_tokens", "ids_sha256", "decoded_sha256"])


def _kind(df: DataFrame, cols: list[str], more: str) -> str:
    return ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols), more])


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array of int) in place of the text, and ``ends`` (array of int): where each token ends in its bytes.

    ``path``: a rank file that every executor has. Each match of ``pattern`` is encoded for itself, without special
    tokens. Null and empty texts have no tokens. Columns named ids or ends are replaced. No rows: no rows.
    """
    cols = others(docs, text_col, "ids", "ends")
    return docs.select(*[F.col(f"`{c}`") for c in cols], text_col).mapInArrow(functools.partial(encode_batches, path, pattern), _kind(docs, cols, "ids array<int>, ends array<int>"))


def decode(tokens: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """``tokens`` with ``decoded`` (binary): the bytes that the ids stand for; null ids have none. The ids stay."""
    cols = others(tokens, "decoded")
    return tokens.select(*[F.col(f"`{c}`") for c in cols]).mapInArrow(functools.partial(decode_batches, path, pattern, ids_col), _kind(tokens, cols, "decoded binary"))


def round_trip(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """Each row of ``docs``, its text replaced by n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit) and decoded_sha256.

    Encoding, decoding and digests run one after the other in the same task, so that ids don't travel in between.
    """
    cols = others(docs, text_col, "ids", "ends", "decoded", "n_tokens", "ids_sha256", "decoded_sha256")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return digest_batches(decode_batches(path, pattern, "ids", encode_batches(path, pattern, batches)))

    return docs.select(*[F.col(f"`{c}`") for c in cols], text_col).mapInArrow(run, _kind(docs, cols, "n_tokens bigint, ids_sha256 string, decoded_sha256 string"))
