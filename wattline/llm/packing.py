"""Packing by power-of-two decomposition: binary-length pieces, bucketed by length, one document a sequence."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from wattline.llm.runtime import checkpointed, lean, session_of, ship
from wattline.llm.slots import gapless
from wattline.llm.textkit import as_array, buffers, runs, slices, span_hash

U64 = np.uint64
_ASCII_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = np.array([ord(chr(c).lower()) if c < 128 else c for c in range(256)], dtype=np.uint8)
#: Kinds of bytes: 0 blank, 1 letter, 2 any other ASCII character; fragments with bytes that are special are all of kind 3.
_SPECIAL = (np.arange(256) >= 128) | np.isin(np.arange(256), [39, 28, 29, 30, 31])
_KIND = np.array([0 if _ASCII_BLANK[c] else 1 if c < 128 and chr(c).isalpha() else 2 for c in range(256)], dtype=np.uint8)
_SPECIAL_KIND = 3
#: All else that str.split() takes for a blank, and the first bytes of their UTF-8.
_BLANKS = np.array([c for c in range(0x10000) if chr(c).isspace() and c not in (9, 10, 11, 12, 13, 32)])
_LEADS = np.isin(np.arange(256), list({chr(c).encode()[0] for c in _BLANKS.tolist()}))


def _codes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The code points that start at these bytes, for up to three bytes."""
    one, two, three = (np.append(data, (0, 0))[at + k].astype(np.int64) for k in range(3))
    return np.where(one < 0x80, one, np.where(one < 0xE0, (one & 0x1F) << 6 | two & 0x3F, (one & 0x0F) << 12 | (two & 0x3F) << 6 | three & 0x3F))



DEFAULT_END = 2
LONG_TEXT = 1 << 20
_TOKENIZERS: dict[str, Encoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Memory:
    """Ids of the units seen so far, by 128 bits of hash: sorted arrays of at most ``most`` entries, and a small recent part."""

    def __init__(self, most: int, recent: int = 1 << 16):
        self.most, self.recent = most, recent
        self.clear()

    def clear(self) -> None:
        self.names, self.order = np.zeros(0, U64), np.zeros(0, np.int32)
        self.late: dict[int, int] = {}
        # Of each unit, as they came: second hash, begin and number of ids; and all ids together.
        self.second, self.begin, self.size, self.ids = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def find(self, names: np.ndarray) -> np.ndarray:
        """The number of each unit, -1 where it is new."""
        at = np.searchsorted(self.names, names)
        at[at == len(self.names)] = 0
        known = self.names[at] == names if len(self.names) else np.zeros(len(names), bool)
        found = np.where(known, self.order[at] if len(self.order) else -1, -1).astype(np.int64)
        if self.late:
            rest = np.flatnonzero(~known)
            found[rest] = np.fromiter((self.late.get(x, -1) for x in names[rest].tolist()), np.int64, len(rest))
        return found

    def add(self, names: np.ndarray, second: np.ndarray, ids: list[bytes]) -> np.ndarray:
        size = np.array([len(x) // 4 for x in ids], np.int32)
        numbers = len(self.begin) + np.arange(len(ids))
        begin = len(self.ids) + np.cumsum(size, dtype=np.int64) - size
        self.ids = np.concatenate((self.ids, np.frombuffer(b"".join(ids), "<u4")))
        self.second, self.begin, self.size = (np.concatenate(x) for x in ((self.second, second), (self.begin, begin), (self.size, size)))
        self.late.update(zip(names.tolist(), numbers.tolist()))
        if len(self.late) > self.recent:
            late = np.fromiter(self.late.keys(), U64, len(self.late)), np.fromiter(self.late.values(), np.int32, len(self.late))
            names = np.concatenate((self.names, late[0]))
            by = np.argsort(names)
            self.names, self.order, self.late = names[by], np.concatenate((self.order, late[1]))[by], {}
        return numbers


class Encoder:
    """Ids of whole texts by a tokenizer file, with a bounded memory of what their units give.

    Where the tokenizer drops white space and splits letters from all else (the
    pattern below), a text's ids are those of its blank-free fragments one after
    another, and an ASCII fragment without apostrophes falls into runs of letters
    and of all else, in lower case. Such units are looked up in a memory of at
    most ``most`` entries. Any other tokenizer, and a text with the separators
    U+001C to U+001F, is encoded whole.
    """

    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    #: str.split() takes these for white space, the tokenizer does not.
    SEPARATORS = re.compile("[\x1c-\x1f]")
    CLOSING = ".,!|*%$&#?;:"

    def __init__(self, path: str, most: int = 1_000_000):
        import json

        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        splitter = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        kinds = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.by_fragment = splitter[0].get("pattern") == {"Regex": self.SPLIT} and splitter[0].get("behavior") == "Removed" and kinds == ["NFC", "Replace", "Lowercase"]
        self.model, self.memory = self.whole.model, Memory(most)
        self.closings: dict[str, bytes] = {}
        # The merges see bytes as letters: printable ones as themselves, the others from U+0100 on.
        printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        others = (b for b in range(256) if b not in printable)
        self.letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}

    def _encoded(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _unit(self, unit: str) -> bytes:
        """Ids of a fragment or a part of one; letters go straight to the merges, closing punctuation goes by itself."""
        core = unit.rstrip(self.CLOSING)
        if not core.isalpha():
            return self._encoded(unit)
        shown = core.lower()
        if not core.isascii():
            if len(shown) != len(core) or "\u03a3" in core or not (unicodedata.is_normalized("NFC", core) and unicodedata.is_normalized("NFC", shown)):
                return self._encoded(unit)
            shown = shown.encode().decode("latin-1").translate(self.letters)
        ids = np.array([x.id for x in self.model.tokenize(shown)], dtype="<u4").tobytes()
        if len(core) == len(unit):
            return ids
        closing = unit[len(core) :]
        if (more := self.closings.get(closing)) is None:
            more = self._encoded(closing)
            if len(closing) <= 4:  # these are few
                self.closings[closing] = more
        return ids + more

    def of_batch(self, texts: pa.Array) -> Iterator[bytes]:
        """``ids`` of each text, null being empty; the units of many texts are looked up together."""
        for a, b in slices(texts):
            part = texts.slice(a, b - a)
            found = self._together(part) if self.by_fragment else None
            if found is None:
                yield from (self.ids(x or "") for x in part.to_pylist())
                continue
            ids, cuts, odd = found
            for i in range(b - a):
                yield self.ids(part[i].as_py()) if odd[i] else ids[cuts[i] : cuts[i + 1]].tobytes()

    def _units(self, data: np.ndarray, offsets: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes to be looked up, and starts and ends of the units of the texts that are not ``odd``."""
        starts, ends = runs(~_ASCII_BLANK[data], offsets)
        if odd.any():
            usual = ~odd[np.searchsorted(offsets, starts, side="right") - 1]
            starts, ends = starts[usual], ends[usual]
        # Fragments with other characters, or apostrophes, stay whole and in their own case.
        special = np.unique(np.searchsorted(starts, np.flatnonzero(_SPECIAL[data]), side="right") - 1)
        special = special[special >= 0]
        size = ends[special] - starts[special]
        inside = np.repeat(starts[special] - np.cumsum(size) + size, size) + np.arange(size.sum())
        low = _LOWER[data]
        low[inside] = data[inside]
        kind = _KIND[data]
        kind[inside] = _SPECIAL_KIND
        turns = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)) + 1
        fragment = np.searchsorted(starts, turns, side="right") - 1
        turns = turns[(fragment >= 0) & (turns > starts[fragment]) & (turns < ends[fragment])] if len(starts) else turns[:0]
        return low, np.sort(np.concatenate((starts, turns))), np.sort(np.concatenate((ends, turns)))

    def _together(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids of all texts, where each text's start, and which texts have blanks other than ASCII's or are very long; None if hashes fail."""
        data, offsets = buffers(texts)
        odd = np.diff(offsets) > LONG_TEXT
        wide = np.flatnonzero(_LEADS[data])
        odd[np.searchsorted(offsets, wide[np.isin(_codes(data, wide), _BLANKS)], side="right") - 1] = True
        low, starts, ends = self._units(data, offsets, odd)
        name, second = span_hash(low, starts, ends), span_hash(low, starts, ends, seed=0xA24BAED4963EE407)
        names, first, which = np.unique(name, return_index=True, return_inverse=True)
        if (second != second[first][which]).any():
            return None
        m = self.memory
        if len(m.begin) > m.most:
            m.clear()
        at = m.find(names)
        new = np.flatnonzero(at < 0)
        if len(new):
            raw = low.tobytes()
            at[new] = m.add(names[new], second[first[new]], [self._unit(raw[x:y].decode()) for x, y in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
        if (m.second[at] != second[first]).any():
            return None
        sizes = m.size[at][which].astype(np.int64)
        until = np.concatenate(([0], np.cumsum(sizes)))
        out = m.ids[np.repeat(m.begin[at][which] - until[:-1], sizes) + np.arange(until[-1])]
        return out, until[np.searchsorted(starts, offsets)], odd

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not self.by_fragment or self.SEPARATORS.search(text):
            return self._encoded(text)
        out, at = [], 0
        while at < len(text):
            end = text.find(" ", at + LONG_TEXT) + 1 or len(text)
            out.append(self._by_fragment(text[at:end]))
            at = end
        return b"".join(out)

    def _by_fragment(self, text: str) -> bytes:
        parts = text.split()
        of = {x: self._unit(x) for x in set(parts)}
        return b"".join(map(of.__getitem__, parts))


def encoder(path: str) -> Encoder:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Encoder(path)
    return _TOKENIZERS[path]


def binary_pieces(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the powers of two, largest first, none over ``longest``, that add up to ``n``."""
    out, at = [], 0
    while at < n:
        length = min(longest, 1 << ((n - at).bit_length() - 1))
        out.append((at, length))
        at += length
    return out


def cut_into_pieces(docs: DataFrame, tokenizer: str, longest: int = 4096, end_id: int = DEFAULT_END, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, and the document's ``carry`` (longs).

    Null and empty texts have one piece, the end id; very long texts are encoded
    in parts of about 1 MB where that gives the same ids; repeated rows and null
    ids are cut like any others; an empty table gives no rows; other columns are
    ignored.
    """
    ship(session_of(docs))
    tail = np.array([end_id], dtype="<u4").tobytes()
    kept = list(carry or {})
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *kept]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            carried = list(zip(*(batch.column(c).to_pylist() for c in kept))) if kept else [()] * batch.num_rows
            found = encoder(tokenizer).of_batch(as_array(batch.column("text")))
            for doc, ids, own in zip(batch.column("doc_id").to_pylist(), found, carried):
                data = ids + tail
                n = len(data) // 4
                for start, length in binary_pieces(n, longest):
                    for column, value in zip(out, (doc, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), n, *own)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(c.alias(k) for k, c in (carry or {}).items())).mapInArrow(run, StructType([StructField(x, LongType()) for x in names]))


def pack_by_powers_of_two(docs: DataFrame, tokenizer: str | None = None, longest: int = 4096, end_id: int = DEFAULT_END, position: str | None = None, positions: int = 0) -> DataFrame:
    """Pack whole documents into sequences of at most ``longest`` tokens without crossing documents or padding.

    A document of n ids (its text's ids and the end id) is cut into pieces whose
    lengths are the powers of two that add up to n (``longest`` at most, itself
    a power of two); each piece is a sequence of its own, in the bucket of its
    length, so batches are drawn from one bucket and nothing is padded.
    Sequences are numbered from 0 without gaps, bucket by bucket from the
    longest. Within a bucket they stand in the order of a hash, or of ``position``,
    a column of whole numbers from 0 to below ``positions``. Columns: doc_id, start,
    length, ids_crc32, doc_tokens, sequence_id, offset (always 0).

    Null and empty texts hold the end id alone; repeated rows and null ids are
    packed like any others; an empty table gives no rows; other columns are
    ignored.
    """
    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    bucket, order = (-F.col("length")).cast("int"), ["doc_id", "start", "ids_crc32"]
    if position is not None:
        pieces = checkpointed(cut_into_pieces(docs, tokenizer or default_tokenizer(), longest, end_id, carry={"position": F.col(f"`{position}`")}))
        numbered = gapless(pieces, "sequence_id", bucket, order, rank="position", ranks=positions).drop("position")
    else:
        pieces = checkpointed(cut_into_pieces(docs, tokenizer or default_tokenizer(), longest, end_id))
        numbered = gapless(pieces, "sequence_id", bucket, order)
    return numbered.withColumn("offset", F.lit(0).cast("long"))
