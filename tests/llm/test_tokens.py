"""The split of texts and the lookup of their pieces against the tokenizers library and the pattern."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa
import tokenizers

from frameloom.llm import tokens

PATH = tokens.public_path()


def test_a_piece_is_encoded_once_for_all_texts_together(monkeypatch):
    """Also where the worker remembers nothing more."""
    calls, library = [], tokenizers.Tokenizer

    class Counted:
        def __init__(self, inner):
            self.inner = inner

        def tokenize(self, piece):
            calls.append(piece)
            return self.inner.tokenize(piece)

    class File:
        @staticmethod
        def from_file(path):
            found = library.from_file(path)
            return type("Found", (), {"model": Counted(found.model), "encode_batch_fast": found.encode_batch_fast})()

    monkeypatch.setattr(tokenizers, "Tokenizer", File)
    monkeypatch.setattr(tokens, "REMEMBERED", 0)
    texts = ["the quick fox and the quick dog"] * 50
    got = tokens.Encoder(PATH).encode(texts)
    assert len(calls) == len({"the", " quick", " fox", " and", " the", " dog"})
    assert np.frombuffer(got[49], "<u4").tolist() == library.from_file(PATH).encode(texts[0], add_special_tokens=False).ids


def test_split_by_classes_equals_the_pattern():
    for n in range(1, 5):
        texts = ["".join(x) for x in itertools.product("'slre \n1!é", repeat=n)]
        column = pa.array(texts, pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], "<i8")[: len(texts) + 1]
        data = np.frombuffer(column.buffers()[2], np.uint8)[: offsets[-1]]
        starts, odd = tokens.split_latin(data, offsets)
        ends = [*np.flatnonzero(starts).tolist(), len(data)]
        assert [data[a:b].tobytes().decode() for a, b in zip(ends, ends[1:])] == [p for t in texts for p in tokens.BYTE_LEVEL.findall(t)]
        assert not odd.any()


def test_ids_equal_the_library_in_parts_and_slices(monkeypatch):
    rng, parts = random.Random(1), [*"'slre \n1!é\tžſ中²\x7f\x85\xa0’", "\U0001f600", "<|endoftext|>", "'ll", "'re", "  ", "\r\n"]
    texts = [None, "", "a<|endo", "ftext|>", *("".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(3000))]
    plain = tokenizers.Tokenizer.from_file(PATH)
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(tokens, "AT_ONCE", 1000)
    monkeypatch.setattr(tokens, "REMEMBERED", 40)
    for given, wanted in ((texts, want), (pa.array(texts).slice(5, 900), want[5:905])):
        assert [np.frombuffer(b, "<u4").tolist() for b in tokens.Encoder(PATH).encode(given)] == wanted
    assert tokens.Encoder(PATH).encode([]) == [] and tokens.Encoder(PATH).encode([None, ""]) == [b"", b""]
