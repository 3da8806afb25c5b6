"""Token counts of a unigram tokenizer without making the tokens.

Aho-Corasick lists the vocabulary pieces that end at each character, the longest first;
dynamic programming carries only the best score and the piece count of the path there.
A path replaces another only when its score is higher, so of equal paths the one whose
last piece starts first wins, as in the tokenizer.  A character that is no piece itself
may also be crossed as unknown, at ``UNKNOWN_PENALTY`` below the lowest score;
neighbouring unknown characters count as one token.

Words are independent (a text is cut before each space), so a task scores a distinct
word once; it remembers up to ``MEMORY_WORDS`` and then starts anew.

Defined results: null or empty text has no tokens; every row is counted, repeated or not.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from boxlore.llm.common import small_batches

UNKNOWN_PENALTY = 10.0
MEMORY_WORDS = 400_000
SPACE = "▁"


def read_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a model file; control, unknown and byte pieces match no text and are left out."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return [(model.id_to_piece(i), model.get_score(i)) for i in plain]


class Counter:
    def __init__(self, pieces: list[tuple[str, float]]):
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.longest = max(len(piece) for piece, _ in pieces)
        self.endings = ahocorasick.Automaton()
        for piece, score in pieces:
            self.endings.add_word(piece, (len(piece), score))
        self.endings.make_automaton()
        self.words: dict[str, int] = {}

    def count_word(self, word: str) -> int:
        """Tokens of the best path through one word."""
        size = self.longest + 1  # a ring: a piece reaches back no further than this
        scores, counts, unknown_last = [0.0] * size, [0] * size, [False] * size
        filled = 0  # ends of which the path is final

        def advance(end: int, matches: list[tuple[int, float]]) -> None:
            best, count, crossed, single = None, 0, False, False
            for length, score in matches:
                at = (end - length) % size
                if best is None or scores[at] + score > best:
                    best, count, crossed = scores[at] + score, counts[at] + 1, False
                single = single or length == 1
            if not single:
                at = (end - 1) % size
                if best is None or scores[at] + self.unknown > best:
                    best, count, crossed = scores[at] + self.unknown, counts[at] + (not unknown_last[at]), True
            at = end % size
            scores[at], counts[at], unknown_last[at] = best, count, crossed

        matches: list[tuple[int, float]] = []
        for last, match in self.endings.iter(word):
            if last + 1 != filled + 1:
                filled += 1
                advance(filled, matches)
                matches = []
                while filled < last:
                    filled += 1
                    advance(filled, [])
            matches.append(match)
        for end in range(filled + 1, len(word) + 1):
            advance(end, matches)
            matches = []
        return counts[len(word) % size]

    def count(self, text: str) -> int:
        """Tokens of a whole text, with a space put before it as the tokenizer does."""
        if not text:
            return 0
        text = text.replace(SPACE, " ")
        words = (text if text[0] == " " else " " + text).split(" ")[1:]
        known = self.words
        try:
            return sum([known[word] for word in words])
        except KeyError:
            if len(known) > MEMORY_WORDS:
                known.clear()
            for word in set(words):
                if word not in known:
                    known[word] = self.count_word(SPACE + word)
            return sum([known[word] for word in words])


@lru_cache(maxsize=1)
def counter(path: str) -> Counter:
    return Counter(read_pieces(path))


def count_tokens(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens) per row over its whole text."""
    kind = docs.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(model)
        for batch in small_batches(batches):
            counts = [tokens.count(value) for value in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["key", "n_tokens"])

    return docs.select(key, text).mapInArrow(work, f"key {kind}, n_tokens long").withColumnRenamed("key", key)
