"""Token counts of documents under a unigram model, with scores shared along a trie.

A pre-token is a maximal run of characters without white space, with the word mark in
front. The model's pieces are those of a public vocabulary file, each with the log
probability of its rank under Zipf's law; a character that no piece covers falls back
to one token a UTF-8 byte. A pre-token's tokens are those of its most probable
segmentation, the fewest among equals.

The distinct new pre-tokens of a batch are taken in trie order, which is sorted order:
the forward scores (best log probability and its token count at every position) of the
prefix shared with the one before stay, only the rest is computed, and the last
position's count is stored with the pre-token. Every task has its own store, bounded
by ``REMEMBERED`` entries, so nothing is shuffled.

Defined results: a null or empty text, or one of white space, has no tokens; repeated
rows are counted each; null ids are kept; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Log probability of a byte of a character that no piece covers.
BYTE_SCORE = -25.0
REMEMBERED = 400_000

_counters: dict[str, TrieCounter] = {}


def load_scores(path: str) -> dict[str, float]:
    """Piece to log probability, from a sentencepiece file: rank r gets -ln(r) - ln(H), H the harmonic sum."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    total = math.log(sum(1 / r for r in range(1, len(kept) + 1)))
    return {p: -math.log(r) - total for r, p in enumerate(kept, 1)}


class TrieCounter:
    def __init__(self, scores: dict[str, float], remembered: int = REMEMBERED) -> None:
        self.scores, self.longest, self.remembered = scores, max(map(len, scores), default=1), remembered
        self.known: dict[str, int] = {}

    def terminal_counts(self, tokens: list[str]) -> dict[str, int]:
        """Of distinct pre-tokens, in any order."""
        scores, longest, out = self.scores, self.longest, {}
        best, count, before = [0.0], [0], ""
        for token in sorted(tokens):
            shared, most = 0, min(len(before), len(token))
            while shared < most and before[shared] == token[shared]:
                shared += 1
            del best[shared + 1 :], count[shared + 1 :]
            for i in range(shared + 1, len(token) + 1):
                width = len(token[i - 1].encode("utf-8", "surrogatepass"))
                top, few = best[i - 1] + BYTE_SCORE * width, count[i - 1] + width
                for j in range(max(0, i - longest), i):
                    s = scores.get(token[j:i])
                    if s is not None:
                        s += best[j]
                        if s > top or (s == top and count[j] + 1 < few):
                            top, few = s, count[j] + 1
                best.append(top)
                count.append(few)
            out[token], before = count[-1], token
        return out

    def count(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(pre-tokens, tokens) of each text."""
        split = [t.split() if t else [] for t in texts]
        known = self.known
        new = {w for words in split for w in words if w not in known}
        if new:
            found = self.terminal_counts([MARK + w for w in new])
            found = {w[1:]: c for w, c in found.items()}
            if len(known) + len(found) <= self.remembered:
                known.update(found)
            else:
                return [(len(words), sum(known[w] if w in known else found[w] for w in words)) for words in split]
        return [(len(words), sum(map(known.__getitem__, words))) for words in split]


def counter(path: str) -> TrieCounter:
    """One per worker process and file."""
    if path not in _counters:
        _counters[path] = TrieCounter(load_scores(path))
    return _counters[path]


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pretokens, n_tokens of every row of ``docs`` (doc_id, text)."""

    def run(batches):
        count = counter(path).count
        for batch in batches:
            found = [x for a in range(0, len(batch), 500) for x in count(batch.column(1).slice(a, 500).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["doc_id", "n_pretokens", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")
