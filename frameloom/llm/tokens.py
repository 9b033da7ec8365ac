"""Ids of whole texts by a tokenizer file of the ``tokenizers`` library.

A byte-level BPE file without normalizer encodes the pieces of its fixed split
pattern one by one. Texts are therefore split first, each distinct piece of about
``AT_ONCE`` bytes is looked up once, and encoded once per worker process; the ids are those
of encoding the text whole. Texts of line feeds, printable ASCII and Latin letters up to U+017E are split
by the classes of their bytes, a batch at a time, others by the pattern. Files of any
other kind, and texts that hold a token added to the vocabulary, are encoded whole, as the
library does by default.
"""

from __future__ import annotations

import codecs
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Fixed value: the split pattern of byte-level BPE pre-tokenizers.
BYTE_LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Pieces that a worker remembers; later new ones are encoded each time.
REMEMBERED = 500_000
#: Bytes of texts that are split and looked up together, about.
AT_ONCE = 4 * 1024 * 1024
#: Kinds of characters in the split pattern; ``SPLIT_BY_PATTERN`` marks those of texts that are no Latin ones.
WHITE, LETTER, NUMBER, OTHER, SPLIT_BY_PATTERN = range(5)


def _kind(c: str) -> int:
    if c in "\n " or "!" <= c <= "~" or "\xa1" <= c <= "\u017e":
        return WHITE if c in "\n " else LETTER if regex.match(r"\p{L}", c) else NUMBER if regex.match(r"\p{N}", c) else OTHER
    return SPLIT_BY_PATTERN


#: By ASCII byte, and by the two bytes of characters from U+0080 to U+017F (of UTF-8).
ONE_BYTE = np.array([_kind(chr(i)) if i < 128 else SPLIT_BY_PATTERN for i in range(256)], np.uint8)
TWO_BYTES = np.array([_kind(chr(i)) for i in range(0x80, 0x180)], np.uint8)

_encoders: dict[str, Encoder] = {}


def public_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _shown_bytes() -> dict[int, str]:
    """Of byte-level models: bytes that aren't visible Latin-1 characters are shown as U+0100 onwards, in order."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(256 + i) for i, b in enumerate(hidden)}


class Remembered:
    """Pieces of the split (UTF-8) with their ids by a byte-level model, which sees bytes as characters; in flat arrays."""

    def __init__(self, model) -> None:
        self.model, shown = model, _shown_bytes()
        self.shown = "".join(shown.get(b, chr(b)) for b in range(256))
        self.pieces, self.ids, self.lengths = pa.array([], pa.large_binary()), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def ids_of(self, pieces: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, and where those of each of the distinct ``pieces`` start in them, and how many they are."""
        at = pc.index_in(pieces, self.pieces)
        known = at.is_valid().to_numpy(zero_copy_only=False)
        new = pieces.filter(pa.array(~known))
        found = [[t.id for t in self.model.tokenize(p)] for p in self._shown(new)]
        ids = np.concatenate([self.ids, np.array([i for f in found for i in f], np.uint32)])
        lengths = np.concatenate([self.lengths, np.fromiter(map(len, found), np.int64, len(found))])
        where = np.empty(len(pieces), np.int64)
        where[known] = at.drop_null().to_numpy()
        where[~known] = np.arange(len(self.pieces), len(lengths))
        starts = np.cumsum(lengths) - lengths
        room = REMEMBERED - len(self.pieces)
        if len(new) and room > 0:
            self.pieces, self.lengths = pa.concat_arrays([self.pieces, new.slice(0, room)]), lengths[:REMEMBERED]
            self.ids = ids[: self.lengths.sum()]
        return ids, starts[where], lengths[where]

    def _shown(self, pieces: pa.LargeBinaryArray) -> list[str]:
        joined = pieces.to_numpy(zero_copy_only=False).tolist()
        text = codecs.charmap_decode(b"".join(joined), "strict", self.shown)[0]  # a character a byte
        ends = np.cumsum([0, *map(len, joined)]).tolist()
        return [text[a:b] for a, b in zip(ends, ends[1:])]


def split_latin(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces of the split start in the bytes ``data`` of texts that begin and end at ``offsets``; and which texts are no Latin ones, so that their starts don't count.

    A piece is a run of one kind of character, with one space before it; of white space before
    something else, the last character is no part of the rest; contractions are pieces.
    """
    kind = ONE_BYTE[data]
    lead = np.flatnonzero((data >= 0xC2) & (data <= 0xC5))
    kind[lead] = kind[lead + 1] = TWO_BYTES[(data[lead].astype(np.intp) - 0xC2) * 64 + data[lead + 1] - 0x80]
    odd = np.zeros(len(offsets) - 1, bool)
    odd[np.searchsorted(offsets, np.flatnonzero(kind == SPLIT_BY_PATTERN), "right") - 1] = True
    first = np.zeros(len(data) + 1, bool)  # one more: what follows the last byte begins another text
    first[offsets] = True
    starts = first.copy()
    starts[1:-1] |= kind[1:] != kind[:-1]
    white = kind == WHITE
    last = np.flatnonzero(white[:-1] & ~white[1:] & ~first[1:-1])
    starts[last] = True
    spaces = last[data[last] == 0x20]
    starts[spaces + 1] = False
    at = np.flatnonzero((data == 0x27) & starts[:-1])
    if len(at):
        after = np.concatenate([data, np.zeros(2, np.uint8)])
        one, two = after[at + 1], after[at + 2]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8)) & ~first[at + 1]
        at, one, two, short = (x[~first[at + 1]] for x in (at, one, two, short))
        long = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        long &= ~first[np.minimum(at + 2, len(data))]
        starts[at[short | long] + 1] = False
        starts[at[short] + 2] = starts[at[long] + 3] = True
    return starts[:-1], odd


def gathered(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of runs that begin at ``starts``, one run after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        split = said.get("pre_tokenizer") or {}
        self.by_piece = (
            said.get("normalizer") is None and said["model"].get("type") == "BPE" and not said["model"].get("dropout")
            and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        )
        self.remembered = Remembered(self.tokenizer.model)
        added = [t["content"] for t in said.get("added_tokens") or [] if t["content"]]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; null is empty."""
        if not self.by_piece:
            return self._plain([t or "" for t in (texts.to_pylist() if isinstance(texts, pa.Array) else texts)])
        column = pc.fill_null(texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()), "")
        column.validate(full=True)  # of UTF-8
        offsets = np.frombuffer(column.buffers()[1], "<i8")[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        cuts = np.unique(np.searchsorted(offsets, np.arange(offsets[0], offsets[-1], AT_ONCE))).tolist()
        return [ids for a, b in zip([0, *cuts], [*cuts, len(column)]) if a < b for ids in self._part(column.slice(a, b - a), offsets[a : b + 1])]

    def _part(self, column: pa.LargeStringArray, offsets: np.ndarray) -> list[bytes]:
        if offsets[0] == offsets[-1]:
            return [b""] * len(column)
        data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        starts, odd = split_latin(data, offsets)
        whole = np.zeros(len(column), bool)
        if self.added is not None:
            whole = pc.match_substring_regex(column, self.added.pattern).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(starts)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype("<i8")), pa.py_buffer(data)])
        left_out = odd | whole
        if left_out.any():
            kept = ~left_out[np.searchsorted(offsets, starts, "right") - 1]
            pieces, starts = pieces.filter(pa.array(kept)), starts[kept]
        out = self._joined(pieces, np.searchsorted(starts, offsets))
        by_pattern = np.flatnonzero(odd & ~whole).tolist()
        split = [[p.encode() for p in BYTE_LEVEL.findall(column[i].as_py())] for i in by_pattern]
        for i, ids in zip(by_pattern, self._joined(pa.array([p for s in split for p in s], pa.large_binary()), np.cumsum([0, *map(len, split)])), strict=True):
            out[i] = ids
        for i in np.flatnonzero(whole).tolist():
            out[i] = self._plain([column[i].as_py()])[0]
        return out

    def _joined(self, pieces: pa.LargeBinaryArray, until: np.ndarray) -> list[bytes]:
        """The ids of texts, each of which has the pieces from one number in ``until`` to the next."""
        if not len(pieces):
            return [b""] * (len(until) - 1)
        pieces = pieces.dictionary_encode()
        ids, starts, lengths = self.remembered.ids_of(pieces.dictionary)
        codes = pieces.indices.to_numpy()
        taken = ids[gathered(starts[codes], lengths[codes])]
        ends = np.append(0, np.cumsum(lengths[codes]))[until].tolist()
        return [taken[a:b].tobytes() for a, b in zip(ends, ends[1:])]


def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget() -> None:
    """Drop a reused worker's encoders, for stages that need the memory and no ids."""
    _encoders.clear()
