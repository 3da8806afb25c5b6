"""Byte-level BPE encoding and decoding by prefix-sharing trie traversal.

BPE gives a prefix of a word one encoding, whatever follows in a longer prefix is
built on: the last token of a prefix is the longest token that ends there and that
BPE would leave next to the last token of what precedes it.  So the distinct words
of a batch, sorted, form a trie in depth-first order; every node needs only its last
token, words that share a prefix share its nodes, and a word is read off by walking
back from its end.  Long words cost time in proportion to their length.

Words already seen by a task are remembered; once there are ``MEMORY_WORDS`` of them, the next
batch begins a new generation, which takes over only what is met again and changes no
result.  So a task holds two generations and the words of one batch of ``BATCH_BYTES``.

Defined results: null text counts as empty; the empty text has no ids; the text of a
special token is that token's id wherever it occurs.  Repeated rows are encoded each.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from boxlore.llm.common import small_batches

#: the pattern of this family of tokenizers that cuts text into words (fixed value)
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMORY_WORDS = 120_000
BATCH_BYTES = 2 << 20
NEVER = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file, reversed."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabulary:
    """Tokens as bytes, merge ranks and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_alphabet()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {as_bytes(t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self._merges = spec["model"]["merges"]
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for token, i in self.ids.items():
            self.bytes[i] = token
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.size = [len(token) for token in self.bytes]
        self.single = [self.ids.get(bytes([b]), 0) for b in range(256)]
        self._whole: dict[int, bool] = {}
        self._pairs: dict[int, bool] = {}

    @cached_property
    def ranks(self) -> dict[tuple[bytes, bytes], int]:
        letters = byte_alphabet()
        pairs = (m.split(" ") if isinstance(m, str) else m for m in self._merges)
        return {tuple(bytes(letters[c] for c in part) for part in pair): rank for rank, pair in enumerate(pairs)}

    @cached_property
    def made(self) -> dict[bytes, tuple[bytes, bytes, int]]:
        """The last merge inside each token: left part, right part, rank."""
        return {a + b: (a, b, rank) for (a, b), rank in self.ranks.items()}

    @cached_property
    def endings(self) -> ahocorasick.Automaton:
        """Finds every token of two bytes or more that ends at a byte, longest first."""
        found = ahocorasick.Automaton()
        for token, i in self.ids.items():
            if len(token) > 1:
                found.add_word(token.decode("latin-1"), i)
        found.make_automaton()
        return found

    def whole(self, i: int) -> bool:
        """Whether plain BPE (join the pair of lowest rank, leftmost first) turns a token's bytes into it."""
        if (known := self._whole.get(i)) is None:
            parts = [bytes([b]) for b in self.bytes[i]]
            while len(parts) > 1:
                rank, at = min((self.ranks.get(pair, NEVER), k) for k, pair in enumerate(zip(parts, parts[1:])))
                if rank == NEVER:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            known = self._whole[i] = len(parts) == 1
        return known

    def _edge(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """The parts at one end of a token from its byte upwards, each with the rank at which it is merged away."""
        out = [(token, NEVER)]
        while len(token) > 1:
            *parts, rank = self.made[token]
            token = parts[side]
            out.append((token, rank))
        return out[::-1]

    def neighbours(self, left: int, right: int) -> bool:
        """Whether BPE leaves two tokens side by side: no merge across their border comes before those inside."""
        key = left * len(self.bytes) + right
        if (known := self._pairs.get(key)) is None:
            if len(self._pairs) > MEMORY_WORDS:
                self._pairs.clear()
            known = self._pairs[key] = self.whole(right) and self._border_holds(self.bytes[left], self.bytes[right])
        return known

    def _border_holds(self, left: bytes, right: bytes) -> bool:
        lefts, rights = self._edge(left, 1), self._edge(right, 0)
        i = j = 0
        while True:
            (a, a_ends), (b, b_ends) = lefts[i], rights[j]
            across = self.ranks.get((a, b), NEVER)
            if across < a_ends and across <= b_ends and across < NEVER:  # of equal pairs the leftmost is joined first
                return False
            if a_ends == b_ends == NEVER:
                return True
            if a_ends <= b_ends:
                i += 1
            else:
                j += 1


def encode_words(vocabulary: Vocabulary, words: Iterable[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """Each word with its ids (little-endian unsigned 32 bits), in sorted order of the words."""
    size, single, neighbours, whole = vocabulary.size, vocabulary.single, vocabulary.neighbours, vocabulary.whole
    pairs, width = vocabulary._pairs, len(vocabulary.bytes)
    last: list[int] = []  # last[k]: last token of the path's first k + 1 bytes
    before = b""
    for word in sorted(words):
        shared, top = 0, min(len(word), len(before))
        while shared < top and word[shared] == before[shared]:
            shared += 1
        last[shared:] = [single[b] for b in word[shared:]]
        found = shared - 1
        for end, token in vocabulary.endings.iter(word.decode("latin-1")):
            if end <= found:
                continue
            start = end - size[token]
            if start < 0:
                good = whole(token)
            elif (good := pairs.get(last[start] * width + token)) is None:
                good = neighbours(last[start], token)
            if good:
                last[end] = token
                found = end
        tokens, end = [], len(word)
        while end:
            tokens.append(last[end - 1])
            end -= size[last[end - 1]]
        tokens.reverse()
        yield word, pack(f"<{len(tokens)}I", *tokens)
        before = word


class Encoder:
    """Encodes batches of texts; keeps words and space-separated chunks it has seen.

    A word never holds a space between two other characters, so a text is cut at its
    spaces into chunks that are encoded apart, each with the space before it.
    """

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.cut = regex.compile(WORDS)
        self.special = regex.compile("|".join(map(regex.escape, self.vocabulary.special)) or r"(?!)")
        self.words: dict[str, bytes] = {}
        #: chunk without the space before it -> ids with that space; None if its white space needs its surroundings
        self.chunks: dict[str, bytes | None] = {}
        self.old_words: dict[str, bytes] = {}
        self.old_chunks: dict[str, bytes | None] = {}

    def _cut_chunk(self, chunk: str) -> list[str] | None:
        if chunk.isalpha():
            return [" " + chunk]
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            return None
        return self.cut.findall(" " + chunk)

    def _spell(self, words: Iterable[str]) -> None:
        """Encode the words not seen before, all in one traversal."""
        old, spelled = self.old_words, {}
        for word in words:
            if word not in self.words:
                if (known := old.get(word)) is not None:
                    self.words[word] = known
                else:
                    spelled[word.encode()] = word
        for word, encoded in encode_words(self.vocabulary, spelled):
            self.words[spelled[word]] = encoded

    def _next_generation(self) -> None:
        """Between batches: beyond the memory's bound, words not met again are forgotten."""
        if len(self.chunks) > MEMORY_WORDS:
            self.chunks, self.old_chunks = {}, self.chunks
        if len(self.words) > MEMORY_WORDS:
            self.words, self.old_words = {}, self.words

    def _learn(self, chunks: Iterable[str]) -> None:
        """Afterwards all these chunks are known."""
        cut, old = {}, self.old_chunks
        for chunk in chunks:
            if chunk in old:
                self.chunks[chunk] = old[chunk]
            elif chunk not in self.chunks:
                cut[chunk] = self._cut_chunk(chunk)
        self._spell({word for words in cut.values() if words for word in words})
        known = self.words
        for chunk, words in cut.items():
            self.chunks[chunk] = None if words is None else b"".join([known[word] for word in words])

    def _by_words(self, text: str) -> bytes:
        words = self.cut.findall(text)
        self._spell(set(words))
        return b"".join([self.words[word] for word in words])

    def _plain(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        first, *rest = text.split(" ")
        known = self.chunks
        try:
            ids = b"".join([known[chunk] for chunk in rest])
        except KeyError:
            self._learn(set(rest))
            return self._plain(text)
        except TypeError:  # white space of several characters
            return self._by_words(text)
        if rest and first[-1:].isspace():
            return self._by_words(text)
        return self._by_words(first) + ids

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if (found := self.special.search(text)) is None:
            return self._plain(text)
        out, at = [], 0
        while found is not None:
            out += [self._plain(text[at : found.start()]), pack("<I", self.vocabulary.special[found[0]])]
            at = found.end()
            found = self.special.search(text, at)
        return b"".join([*out, self._plain(text[at:])])

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Learn the distinct new chunks of the batch in one traversal, then spell every text."""
        self._next_generation()
        known = self.chunks
        fresh: set[str] = set()
        for text in texts:
            fresh.update(text.split(" ")[1:])
        self._learn(fresh - known.keys())
        return [self.encode(text) for text in texts]

    def decode(self, ids: bytes) -> str:
        """Text of ids; bytes that are no UTF-8 become replacement characters."""
        spell = self.vocabulary.bytes
        return b"".join([spell[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The worker's encoder; the vocabulary is read once per Python worker."""
    return Encoder(path)


def encode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids) per row; ``ids`` are little-endian unsigned 32-bit integers of the whole text."""
    kind = docs.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in small_batches(batches, BATCH_BYTES):
            ids = bpe.encode_batch([value or "" for value in batch.column(1).to_pylist()])
            counts = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, pa.array(ids, pa.binary())], ["key", "n_tokens", "ids"])

    made = docs.select(key, text).mapInArrow(work, f"key {kind}, n_tokens long, ids binary")
    return made.withColumnRenamed("key", key)


def decode(encoded: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids in place of them; null ids give the empty text."""
    others = [name for name in encoded.columns if name != ids]
    fields = ", ".join(f"`{n}` {encoded.schema[n].dataType.simpleString()}" for n in others)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in small_batches(batches):
            made = pa.array([bpe.decode(value or b"") for value in batch.column(batch.num_columns - 1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], [*others, out])

    return encoded.select(*others, ids).mapInArrow(work, f"{fields}, `{out}` string")
