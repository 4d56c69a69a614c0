"""Byte-level BPE, encoded by backtracking over longest matches and decoded by an offset table.

A sequence of tokens is what BPE's merges give if and only if each two neighbours are compatible:
merging the concatenation of both gives just the two. So the encoder walks the text with the
longest token that matches (all matches of a word come from one pass of an Aho-Corasick
automaton), checks each new neighbour pair in a memoised compatibility table, and steps back to
the next shorter token where the pair fails. A byte position that failed is never tried again,
which bounds the work by the number of matches: linear in the text, however long a word is.

Words repeat, so each worker keeps the ids of the words it has met, in a table of bounded size.
Decoding gathers token bytes from one blob by an offset table, in numpy.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import Remembered

#: The byte-level pre-tokeniser's pattern, as public byte-level BPE vocabularies use it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The code points with the property White_Space.
WHITE = "\t-\r \x85\xa0  -     　"

#: Pieces between which no token can stretch: a run without white space and a space before it, or white space as the pattern cuts it.
PIECES = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?=[{WHITE}]|$(?![\\s\\S]))|[{WHITE}]")

#: Entries that a worker's table of known pieces may hold.
KNOWN_PIECES = 400_000

#: Pairs of tokens that a worker remembers the compatibility of.
KNOWN_PAIRS = 1_000_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte: itself, or the next free one from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, more = {chr(b): b for b in plain}, 256
    for b in range(256):
        if b not in plain:
            out[chr(more)] = b
            more += 1
    return out


class ByteBpe:
    """A byte-level BPE vocabulary with its encoder and decoder; ``path`` names a tokenizers JSON file."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, model = byte_alphabet(), spec["model"]
        as_bytes = lambda s: bytes(alphabet[c] for c in s)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        vocab = {as_bytes(s): i for s, i in model["vocab"].items() if s not in self.special}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [b""] * size
        for b, i in [*vocab.items(), *((s.encode(), i) for s, i in self.special.items())]:
            self.tokens[i] = b
        self.offsets = np.zeros(size + 1, np.int64)
        np.cumsum([len(b) for b in self.tokens], out=self.offsets[1:])
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        # what each token was merged from, and when
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b = as_bytes(a), as_bytes(b)
            key, whole = (vocab[a], vocab[b]), vocab[a + b]
            self.rank[key], self.made[key] = r, whole
            self.parts.setdefault(whole, key)
        self.usable = {i for i in vocab.values() if self._reached(i)}
        self.automaton = ahocorasick.Automaton()
        for b, i in vocab.items():
            if i in self.usable:
                self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()
        self.pairs = Remembered(KNOWN_PAIRS)
        self.words = regex.compile(PATTERN)
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.forget()

    def forget(self) -> None:
        """Empties the tables of pieces and words: a worker that waits for its next task should not hold them."""
        self.known, self.known_words = Remembered(KNOWN_PIECES), Remembered(KNOWN_PIECES)

    def _merge(self, ids: list[int]) -> list[int]:
        """Plain BPE merging, for the tables only."""
        while len(ids) > 1:
            best = min(range(len(ids) - 1), key=lambda k: self.rank.get((ids[k], ids[k + 1]), 1 << 60))
            pair = (ids[best], ids[best + 1])
            if pair not in self.rank:
                break
            ids = [*ids[:best], self.made[pair], *ids[best + 2 :]]
        return ids

    def _single(self) -> list[int]:
        found = self.__dict__.setdefault("_bytes", [0] * 256)
        if not any(found):
            for i, b in enumerate(self.tokens):
                if len(b) == 1 and i not in self.special.values():
                    found[b[0]] = i
        return found

    def _reached(self, i: int) -> bool:
        """Whether merging a token's own bytes gives that token."""
        single = self._single()
        return self._merge([single[b] for b in self.tokens[i]]) == [i]

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves the border between two neighbouring tokens alone, from the table of pairs met lately."""
        key, pairs = (a, b), self.pairs
        got = pairs.now.get(key)
        if got is None:
            got = pairs.old.get(key)
            pairs.turn()
            pairs.now[key] = got = self._border_stays(a, b) if got is None else got
        return got

    def _border_stays(self, a: int, b: int) -> bool:
        """Undoes both tokens' merges from the latest on; a merge across the border that would have come first breaks it."""
        before = 1 << 60  # the rank that undone merges must stay below
        while True:
            across = self.rank.get((a, b))
            if across is not None and across < before:
                return False
            left, right = self.parts.get(a), self.parts.get(b)
            if left is None and right is None:
                return True
            left_rank = self.rank[left] if left else -1
            right_rank = self.rank[right] if right else -1
            # the left token's last merge comes later, or at the same rank stands left of the border: undo the later one
            if left_rank > right_rank:
                a, before = left[1], left_rank
            elif right_rank > left_rank:
                b, before = right[0], right_rank + 1
            else:  # the same merge on both sides: the left one is done first, so the right one is undone first
                b, before = right[0], right_rank + 1

    def word_ids(self, word: bytes) -> list[int]:
        """The ids of one pre-token."""
        n = len(word)
        starts: list[list[int]] = [[] for _ in range(n)]
        for end, (size, token) in self.automaton.iter(word.decode("latin-1")):
            starts[end - size + 1].append(token)  # of one start, longer tokens end later: ascending by length
        out: list[int] = []
        tried: list[int] = []  # for each token of out, how many of its start's matches are left
        at, left = 0, len(starts[0]) if n else 0
        dead = bytearray(n + 1)
        while at < n:
            here = starts[at]
            while left:
                left -= 1
                token = here[left]
                end = at + len(self.tokens[token])
                if not dead[end] and (not out or self.compatible(out[-1], token)):
                    out.append(token)
                    tried.append(left)
                    at = end
                    left = len(starts[at]) if at < n else 0
                    break
            else:
                dead[at] = 1
                token, left = out.pop(), tried.pop()
                at -= len(self.tokens[token])
        return out

    def piece_ids(self, piece: str) -> bytes:
        """The ids of a piece as unsigned 32-bit little-endian numbers."""
        words, out = self.known_words, []
        for word in self.words.findall(piece):
            ids = words.now.get(word)
            if ids is None:
                ids = words.old.get(word)
                if ids is None:
                    ids = np.array(self.word_ids(word.encode()), "<u4").tobytes()
                if len(word) <= 64:
                    words.now[word] = ids
            out.append(ids)
        return b"".join(out)

    def _plain(self, text: str) -> list[bytes]:
        known, pieces = self.known, PIECES.findall(text)
        known.turn()
        self.known_words.turn()
        now = known.now
        try:
            return list(map(now.__getitem__, pieces))
        except KeyError:
            out = []
            for piece in pieces:
                ids = now.get(piece)
                if ids is None:
                    ids = known.old.get(piece) or self.piece_ids(piece)
                    if len(piece) <= 64:
                        now[piece] = ids
                out.append(ids)
            return out

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text; strings of special tokens become those tokens."""
        if self.split_special is None or not any(s in text for s in self.special):
            return np.frombuffer(b"".join(self._plain(text)), "<u4")
        out: list[bytes] = []
        for part in self.split_special.split(text):
            out += [np.array([self.special[part]], "<u4").tobytes()] if part in self.special else self._plain(part)
        return np.frombuffer(b"".join(out), "<u4")

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """Token bytes gathered through the offset table."""
        ids = ids.astype(np.int64, copy=False)
        if not len(ids):
            return b""
        first = self.offsets[ids]
        size = self.offsets[ids + 1] - first
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(first - (ends - size), size)
        return self.blob[at].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def loaded(path: str) -> ByteBpe:
    """A worker's tokenizer; a worker that serves many tasks loads it once."""
    return ByteBpe(path)


def bpe_round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids binary, decoded string): each whole text encoded, then decoded again.

    ids are unsigned 32-bit little-endian numbers. A null text counts as empty; rows with a null
    doc_id and repeated rows come out as they stand; extra columns are ignored. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for small in _slices(batch):
                ids = [bpe.encode(t or "") for t in small.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [small.column(0), pa.array([i.tobytes() for i in ids], pa.binary()), pa.array([bpe.decode(i) for i in ids], pa.string())],
                    ["doc_id", "ids", "decoded"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids binary, decoded string")


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the same round trip, without moving ids and texts back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        bpe = loaded(path)
        digits = np.array([str(i) for i in range(len(bpe.tokens))], dtype=object)
        for batch in batches:
            n, one, two = [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py() or "")
                n.append(len(ids))
                one.append(sha256(",".join(digits[ids].tolist()).encode()).hexdigest())
                two.append(sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        bpe.forget()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def _slices(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)
