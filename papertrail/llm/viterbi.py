"""Token counts of a unigram tokenizer without building tokens: count-only Viterbi.

A text is cut as the tokenizer cuts it, before every blank, which becomes the mark ``▁``; the distinct pieces of a batch are
counted once. For a piece an Aho-Corasick automaton over the vocabulary enumerates all matches, and dynamic programming over
their ends carries the best score and the number of tokens on that path, nothing else.

The tokenizer's rules decide ties and unknown characters: of equal scores at one end the match with the earliest start stays;
a character that no single-character token covers may also be unknown, at the lowest score of the vocabulary less ten;
neighbouring unknown characters are one token; with byte fallback that token becomes its UTF-8 bytes.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertrail.llm.common import bounded_batches

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Pieces remembered per worker.
CACHE_PIECES = 500_000


class Counter:
    """Counts tokens of pieces with a vocabulary of (token, score); ``unknown`` is the number of the unknown token."""

    def __init__(self, vocabulary: list[tuple[str, float]], unknown: int, byte_fallback: bool = True, limit: int = CACHE_PIECES):
        self.automaton = ahocorasick.Automaton()
        last = {token: score for token, score in vocabulary}  # of equal tokens the last one stays
        for token, score in last.items():
            if token:
                self.automaton.add_word(token, (len(token), score))
        self.automaton.make_automaton()
        self.single = {token for token in last if len(token) == 1}
        self.unknown_score = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        self.as_bytes = byte_fallback and all(f"<0x{b:02X}>" in last for b in range(256))
        self.limit = limit
        self.known: dict[str, int] = {}

    def piece(self, text: str) -> int:
        """Tokens on the best path through a piece."""
        size = len(text)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(size)]
        for end, match in self.automaton.iter(text):
            ends[end].append(match)
        best, count = [0.0] * (size + 1), [0] * (size + 1)
        open_ = [0] * (size + 1)  # bytes of the unknown run that the path ends with
        reached = [True] + [False] * size
        for end in range(1, size + 1):
            score, tokens, run = 0.0, -1, 0
            for length, value in sorted(ends[end - 1], reverse=True):  # the earliest start first
                start = end - length
                if reached[start] and (tokens < 0 or best[start] + value > score):
                    score, tokens, run = best[start] + value, count[start] + 1, 0
            char = text[end - 1]
            if char not in self.single and reached[end - 1] and (tokens < 0 or best[end - 1] + self.unknown_score > score):
                score, before = best[end - 1] + self.unknown_score, open_[end - 1]
                width = len(char.encode("utf-8", "surrogatepass"))
                run = before + width
                tokens = count[end - 1] + (width if self.as_bytes else not before)
            if tokens >= 0:
                reached[end], best[end], count[end], open_[end] = True, score, tokens, run
        return count[size]

    def text(self, text: str | None) -> int:
        """Tokens of a text; none of a null or empty one."""
        if not text:
            return 0
        text = text.replace(" ", MARK)
        pieces = (text if text[0] == MARK else MARK + text).split(MARK)
        known, total = self.known, 0
        for p in pieces[1:]:
            n = known.get(p)
            if n is None:
                n = self.piece(MARK + p)
                if len(known) >= self.limit:
                    known.clear()
                known[p] = n
            total += n
        return total


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """A counter with the pieces and scores of a sentencepiece model; control tokens never match a text."""
    return Counter(*vocabulary(path))


def vocabulary(path: str) -> tuple[list[tuple[str, float]], int]:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())], model.unk_id()


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` (``text``) with ``n_tokens`` in place of the text; the model's pieces are read as a unigram vocabulary.

    A null or empty text has no tokens; texts of any length are counted whole; other columns are kept, except one named
    n_tokens; repeated rows are each counted; an empty table gives an empty one.
    """
    bounded_batches(docs.sparkSession)
    own = [c for c in docs.columns if c not in ("text", "n_tokens")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(path).text
        for batch in batches:
            counts = [tokens(t) for t in batch["__text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in own], pa.array(counts, pa.int64())], names=[*own, "n_tokens"])

    return docs.select(*own, F.col("text").alias("__text")).mapInArrow(count, docs.select(own).schema.add("n_tokens", "long"))
