"""Bounded-space online packing of token sequences.

Each partition keeps at most ``open_windows`` open windows. A document's full windows are cut off
and stand alone; its rest goes to the open window that it fills best; when none has room, the
fullest is emitted and a new one takes its place. What is still open at the end of a partition is
a leftover. Leftovers of up to ``merge_fan`` partitions meet in one group, which pours their pieces
into full windows, cutting freely, so that a group ends with one padded sequence at most.
"""

from __future__ import annotations

import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import Remembered, give_back, materialize

_OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_OUT_ARROW = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

#: The id that ends each document.
END_ID = 2

#: Entries that a generation of a task's table of known words may hold.
KNOWN_WORDS = 500_000

#: Words that the tokenizer is shown at a time; it takes longer runs at a worse rate.
RUN = 1000

#: Bytes of text that are encoded at a time.
PART_BYTES = 4 << 20

_TAIL = ".,;:!?"


class WordTokenizer:
    """A tokenizers file whose tokens never cross ASCII white space; each task keeps the ids of words it has met.

    The file's normaliser and pre-tokeniser treat white space as a border, so a text's ids are those
    of its words in order; words not met before go to the tokenizers library, many at a time.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known = Remembered(KNOWN_WORDS)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        from tokenizers import normalizers, pre_tokenizers

        self.whole = (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)
        self.bare = (normalizers.Sequence([]), pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]))
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def encode_batch(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """The ids of each text, and END_ID after them, as unsigned 32-bit little-endian numbers; all are parts of one array.

        Arrow splits and numbers the words, so only distinct ones become Python strings; a text's ids are gathered by its
        words' numbers from the ids of the distinct ones.
        """
        split = pc.ascii_split_whitespace(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        coded = split.flatten().dictionary_encode()
        own = _strings(coded.dictionary)
        known = self.known
        known.turn()
        known.now[""] = b""  # what the splitter finds at a text's ends
        # difference() of a dictionary asks it for each word; that of its keys would walk all of them
        self._learn(set(own).difference(known.now))
        found = list(map(known.now.__getitem__, own))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        word = coded.indices.to_numpy(zero_copy_only=False)
        each = sizes[word]
        last = np.concatenate(([0], np.cumsum(each)))
        # where a word's ids lie among those of the distinct ones, less where they come to lie; Arrow's strings hold under 2 GiB, so 32 bits do
        place = np.repeat(((np.cumsum(sizes) - sizes)[word] - last[:-1]).astype(np.int32), each)
        place += np.arange(len(place), dtype=np.int32)
        ids = np.frombuffer(b"".join(found), "<u4")[place]
        del own, found, word, each, place
        ends = last[np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))]
        return np.split(np.insert(ids, ends, END_ID), ends + np.arange(1, len(ends) + 1))[:-1]

    def _learn(self, words: set[str]) -> None:
        """Ids of words not known yet. Letters and punctuation after them are pre-tokens of their own, so they are learnt apart."""
        now, old, cut = self.known.now, self.known.old, []
        if old:
            hits = words & old.keys()
            now.update(zip(hits, map(old.__getitem__, hits), strict=True))
            words -= hits
        for w in [w for w in words if w[-1] in _TAIL]:
            core = w.rstrip(_TAIL)
            if (core.isascii() and core.isalpha()) or _letters(core):
                cut.append((w, core, w[len(core) :]))
                words.discard(w)
        for _, core, tail in cut:
            words.update(x for x in (core, tail) if x not in now)
        plain = [w for w in words if w.isascii() and w.isalpha()]
        words.difference_update(plain)
        # ASCII letters are one pre-token and normalise by lower-casing, so the costly steps are left out for them
        self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = self.bare
        words.update(self._runs([w.lower() for w in plain], plain))
        self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = self.whole
        letters = [w for w in words if not w.isascii() and _letters(w)]
        words.difference_update(letters)
        words.update(self._runs(letters, letters))
        rest = list(words)
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False) if rest else [], strict=True):
            now[w] = np.array(e.ids, "<u4").tobytes()
        for w, core, tail in cut:
            now[w] = now[core] + now[tail]

    def _runs(self, shown: list[str], words: list[str]) -> list[str]:
        """Learns words many at a time, as they are shown to the tokenizer; returns those whose borders can't be told."""
        now, failed = self.known.now, []
        for k in range(0, len(words), RUN):
            part = words[k : k + RUN]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(shown[k : k + RUN])], add_special_tokens=False)[0].ids, "<u4")
            borders = np.flatnonzero(self.ends[ids]) + 1
            if len(borders) != len(part):  # a word that the normaliser splits
                failed += part
                continue
            raw, at = ids.tobytes(), 0
            for w, to in zip(part, (4 * borders).tolist(), strict=True):
                now[w] = raw[at:to]
                at = to
        return failed


def _strings(words: pa.Array) -> list[str]:
    """Words without line ends as Python strings, cut from one string, which is far cheaper than one by one."""
    return pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), "\n")[0].as_py().split("\n") if len(words) else []


def _letters(word: str) -> bool:
    """Whether a word is still nothing but letters when the normaliser has been over it, and so one pre-token."""
    return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha())


@lru_cache(maxsize=2)
def loaded(path: str) -> WordTokenizer:
    return WordTokenizer(path)


class Windows:
    """The open windows of one partition; a piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.serial = size, most, 0
        self.free: list[tuple[int, int]] = []  # (room left, window), ascending
        self.held: dict[int, list] = {}

    def place(self, piece: tuple) -> list | None:
        """Best fit; returns the pieces of a window that had to be emitted or became full."""
        n = len(piece[2])
        k = bisect_left(self.free, (n, -1))
        out = None
        if k < len(self.free):
            room, w = self.free.pop(k)
        else:
            if len(self.free) >= self.most:
                _, w = self.free.pop(0)  # the fullest has the least room
                out = self.held.pop(w)
            self.serial += 1
            room, w = self.size, self.serial
            self.held[w] = []
        self.held[w].append(piece)
        if room == n:
            return self.held.pop(w)  # it was not new unless n == size, and then nothing was emitted: see pack()
        insort(self.free, (room - n, w))
        return out

    def rest(self) -> list[list]:
        return [self.held[w] for _, w in self.free]


def _rows(pieces: list, sequence: int, out: dict[str, list]) -> None:
    at = 0
    for doc, start, ids, total in pieces:
        for c, v in zip(_OUT_ARROW.names, (doc, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, at), strict=True):
            out[c].append(v)
        at += len(ids)


def _emit(out: dict[str, list], left: list[tuple] | None = None) -> pa.RecordBatch:
    left = left or []
    n, m = len(out["doc_id"]), len(left)
    columns = [pa.array(out[c] + [None] * m, pa.int64()) for c in _OUT_ARROW.names]
    part, order, doc, start, total, ids = zip(*left, strict=True) if left else ((),) * 6
    columns[0] = pa.array(out["doc_id"] + list(doc), pa.int64())
    columns[1] = pa.array(out["start"] + list(start), pa.int64())
    columns[4] = pa.array(out["doc_tokens"] + list(total), pa.int64())
    columns += [pa.array([None] * n + list(part), pa.int64()), pa.array([None] * n + list(order), pa.int64()), pa.array([None] * n + list(ids), pa.binary())]
    return pa.RecordBatch.from_arrays(columns, [*_OUT_ARROW.names, "part", "place", "ids"])


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of PART_BYTES bytes of text, or one row, at most."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
    first, held = 0, 0
    for k, n in enumerate(sizes):
        if k > first and held + n > PART_BYTES:
            yield batch.slice(first, k - first)
            first, held = k, 0
        held += n
    if batch.num_rows:
        yield batch.slice(first)


def pack(docs: DataFrame, path: str, size: int = 4096, open_windows: int = 32, merge_fan: int = 16) -> DataFrame:
    """Packs every document's tokens into sequences of at most ``size`` tokens.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A
    null text is empty and still has its end token; rows are documents, so repeated rows are packed
    as often as they stand there, and null doc_ids stay null; extra columns are ignored; an empty
    table gives an empty result. Sequence ids are unique, not gapless. Memory: one Arrow batch and
    ``open_windows`` windows per task, and ``merge_fan * open_windows`` windows per merging group.
    """

    def online(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenizer, part = loaded(path), TaskContext.get().partitionId()
        windows, serial = Windows(size, open_windows), part << 32
        for batch in batches:
            for small in _parts(batch):
                out: dict[str, list] = {c: [] for c in _OUT_ARROW.names}
                for doc, ids in zip(small.column(0).to_pylist(), tokenizer.encode_batch(pc.fill_null(small.column(1), "")), strict=True):
                    whole = len(ids) // size * size
                    for at in range(0, whole, size):
                        _rows([(doc, at, ids[at : at + size], len(ids))], serial, out)
                        serial += 1
                    if whole < len(ids) and (done := windows.place((doc, whole, ids[whole:].copy(), len(ids)))):
                        _rows(done, serial, out)
                        serial += 1
                yield _emit(out)
        del tokenizer
        loaded.cache_clear()
        give_back()
        left = [(part, n, doc, start, total, ids.tobytes()) for n, pieces in enumerate(windows.rest()) for doc, start, ids, total in pieces]
        yield _emit({c: [] for c in _OUT_ARROW.names}, left)

    def merge(left: pa.Table) -> pa.Table:
        """A group's leftovers, poured in order into windows that are filled to the last token."""
        left = left.sort_by([("part", "ascending"), ("place", "ascending"), ("doc_id", "ascending"), ("start", "ascending")])
        out: dict[str, list] = {c: [] for c in _OUT_ARROW.names}
        serial, held, room = (1 << 62) + (left["group"][0].as_py() << 32), [], size
        for batch in left.to_batches(max_chunksize=1000):
            for doc, start, total, blob in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")), strict=True):
                ids = np.frombuffer(blob, "<u4")
                while len(ids):
                    take = ids[:room]
                    held.append((doc, start, take, total))
                    ids, start, room = ids[len(take) :], start + len(take), room - len(take)
                    if not room:
                        _rows(held, serial, out)
                        serial, held, room = serial + 1, [], size
        if held:
            _rows(held, serial, out)
        return pa.Table.from_pydict(out, schema=_OUT_ARROW)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = materialize(docs.mapInArrow(online, f"{_OUT}, part long, place long, ids binary"), "packed")
    left = first.where(F.col("part").isNotNull()).select(
        F.expr(f"part div {merge_fan}").alias("group"), "part", "place", "doc_id", "start", "doc_tokens", "ids"
    )
    merged = left.groupBy("group").applyInArrow(merge, _OUT)
    return first.where(F.col("part").isNull()).select(*_OUT_ARROW.names).unionByName(merged)
