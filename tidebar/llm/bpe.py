"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over a text's bytes cuts it where its content says so, so
documents that share a passage share whole chunks whatever stands before it.
Within a task the ids of chunks met lately are reused: those of the last
``MEMO_BYTES`` at least, which is a few MB of text. Where two chunks meet, the ids may differ from those of the unbroken text; the join
is repaired by encoding a window around it again, wider on both sides until its
outer pieces agree exactly with the ids of the chunks, and splicing it in.

The ids are those of the ``tokenizers`` library, special-token strings in a
text included. The library encodes each new word once: a space between two
characters that are not white space always begins a new piece of the byte-level
pattern, so words may be encoded together, apart from their texts, and
remembered by a 64-bit hash and their first 8 bytes; texts with other spacing
go to the library whole.

Defined cases: a null text is empty; an empty text has no ids and decodes to
the empty text. Rows are independent, so repeated rows and null ids are kept as
they are. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .. import ship
from .shared import table
from .words import U64, Words, cut_bytes, frugal, slices, utf8

#: Chunks end where the rolling hash has this many zero bits at its end, within these lengths in bytes.
CHUNK_BITS, CHUNK_LEAST, CHUNK_MOST = 12, 1 << 10, 1 << 15
_REACH = 32
#: Words, and bytes of chunks, that a worker remembers at most, about.
MEMO_WORDS, MEMO_BYTES = 500_000, 16 << 20


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_IDS_AT_ONCE = 1 << 16
#: Everything but the space; and the first bytes of characters that may be white space.
_UNSPACED = np.array([b != 0x20 for b in range(256)])
_MARK = np.array([b in b".,;:!?" for b in range(256)])
_ALPHA = np.array([0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A for b in range(256)])
_ODD = np.array([b <= 0x20 or b in (0xC2, 0xE1, 0xE2, 0xE3) for b in range(256)])


def _blank(c: str) -> bool:
    return c.isspace() or c == "᠎"


def _without_ends(words: Words, spaced: np.ndarray) -> tuple[Words, np.ndarray]:
    """Cuts one mark off the ends of words with a letter before it, which is where the pattern cuts too, so fewer words differ."""
    data, start, end = words.data, words.start, words.end
    before = data[np.maximum(end - 2, 0)]
    latin = (end - start > 2) & (data[np.maximum(end - 3, 0)] == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)
    cut = np.flatnonzero((end - start > 1) & _MARK[data[end - 1]] & (_ALPHA[before] | latin))
    at = end[cut] - 1
    return Words(data, np.insert(start, cut + 1, at), np.insert(end, cut, at), words.offsets + np.searchsorted(cut, words.offsets)), np.insert(spaced, cut + 1, False)


def _gathered(ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of ``ids`` that begin at ``start`` and are ``size`` long, one after another."""
    upto = np.concatenate([[0], np.cumsum(size)])
    return ids[np.repeat(start - upto[:-1], size) + np.arange(upto[-1])]


class _Known:
    """Ids of words met before, by the words' hashes in ascending order. When full, the half that was met longest ago goes."""

    def __init__(self):
        self.keys, self.first = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.ids, self.start, self.size = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.met, self.now = np.zeros(0, np.int64), 0

    def rows(self, keys: np.ndarray, first: np.ndarray, learn) -> np.ndarray:
        """The row of each key, until the next call. Keys ascend; ``first`` has their words' first bytes; those that are new are learned together."""
        self.now += 1
        if len(self.keys) > MEMO_WORDS:
            self._forget()
        at = np.searchsorted(self.keys, keys)
        hit = at < len(self.keys)
        hit[hit] = self.keys[at[hit]] == keys[hit]
        if len(new := np.flatnonzero(~hit)):
            ids, size = learn(new)
            held = np.maximum(size, 0)
            start = len(self.ids) + np.cumsum(held) - held
            to = at[new]
            self.ids = np.concatenate([self.ids, ids])
            self.keys, self.first = np.insert(self.keys, to, keys[new]), np.insert(self.first, to, first[new])
            self.start, self.size, self.met = np.insert(self.start, to, start), np.insert(self.size, to, size), np.insert(self.met, to, 0)
            at = np.searchsorted(self.keys, keys)
        self.met[at] = self.now
        return at

    def _forget(self) -> None:
        stay = self.met > np.median(self.met)
        self.keys, self.first, self.size, self.met = self.keys[stay], self.first[stay], self.size[stay], self.met[stay]
        held = np.maximum(self.size, 0)
        self.ids = _gathered(self.ids, self.start[stay], held)
        self.start = np.cumsum(held) - held


class Encoder:
    """Ids of texts as little-endian 32-bit integers, and back."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.known = _Known()
        size = self.library.get_vocab_size()
        plain = {c: b for b, c in enumerate(_byte_letters())}
        pieces = []
        for i in range(size):
            piece = self.library.id_to_token(i) or ""
            pieces.append(bytes(plain[c] for c in piece) if all(c in plain for c in piece) else piece.encode())
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        """By the library, each text as a whole."""
        return [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: Words, spaced: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, and how many; -1 if a word's ends depend on what stands beside it. With ``spaced`` the space before it is part of it."""
        data, start, end, spaced = words.data, words.start[new], words.end[new], spaced[new]
        sure = np.ones(len(new), bool)
        lead, trail = data[start], data[end - 1]
        wide = (trail >= 0x80) & (_ODD[data[np.maximum(end - 2, 0)]] | _ODD[data[np.maximum(end - 3, 0)]])
        for i in np.flatnonzero((spaced & _ODD[lead]) | (_ODD[trail] & (trail < 0x80)) | wide):
            word = data[start[i] : end[i]].tobytes().decode()
            sure[i] = not ((spaced[i] and _blank(word[0])) or _blank(word[-1]))
        size = np.full(len(new), -1)
        # one text of all of them: no piece reaches over a space between two characters that are not white space
        some = np.flatnonzero(spaced & sure)
        width = end[some] - start[some] + 1
        joined = self._ids([_gathered(data, start[some] - 1, width).tobytes().decode()])[0]
        size[some] = np.diff(np.searchsorted(np.cumsum(self.lengths[joined]), np.cumsum(width), side="right"), prepend=0)
        first = np.flatnonzero(~spaced & sure)
        single = self._ids([data[start[i] : end[i]].tobytes().decode() for i in first])
        size[first] = [len(x) for x in single]
        upto = np.concatenate([np.cumsum(size[some]) - size[some], len(joined) + np.cumsum(size[first]) - size[first]])
        order = np.argsort(np.concatenate([some, first]))
        return _gathered(np.concatenate([joined, *single]), upto[order], size[sure]), size

    def flat(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a string column, one text after another, and how many each text has. Nulls are empty."""
        data, offsets = utf8(column)
        words = cut_bytes(data, offsets, _UNSPACED)
        # a text's first word may have no space before it and is then a word of its own kind
        spaced = np.ones(len(words.start), bool)
        begins = words.offsets[:-1][words.counts > 0]
        spaced[begins[words.start[begins] == offsets[:-1][words.counts > 0]]] = False
        words, spaced = _without_ends(words, spaced)
        n = len(words.start)
        keys = words.hashes()
        keys[~spaced] ^= U64(0x9E3779B97F4A7C15)
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        first = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))[words.start] if n else np.zeros(0, np.uint64)
        first = first & (U64(0xFFFFFFFFFFFFFFFF) >> (U64(64) - (np.minimum(words.end - words.start, 8).astype(np.uint64) << U64(3))))
        order = np.argsort(keys)
        head = np.ones(n, bool)
        head[1:] = keys[order[1:]] != keys[order[:-1]]
        at = order[head]
        index = np.empty(n, np.int64)
        index[order] = np.cumsum(head) - 1
        rows = self.known.rows(keys[at], first[at], lambda new: self._learn(words, spaced, at[new]))
        size = self.known.size[rows]
        held = np.maximum(size, 0)
        ids = _gathered(self.known.ids, self.known.start[rows], held)
        edges = 4 * np.concatenate([[0], np.cumsum(held)]).astype(np.int64)
        taken = pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(edges), pa.py_buffer(ids)]).take(pa.array(index))
        upto = np.frombuffer(taken.buffers()[1], np.int64)[: n + 1] // 4 if n else np.zeros(1, np.int64)
        ids = np.frombuffer(taken.buffers()[2], "<u4")[: upto[-1]] if upto[-1] else np.zeros(0, "<u4")
        upto = upto[words.offsets]
        # texts with a space beside other white space or at their end go to the library whole, as do words that are not those of their hash
        unsure = (size < 0)[index] | (self.known.first[rows][index] != first)
        whole = np.zeros(len(offsets) - 1, bool)
        doc = lambda places: np.searchsorted(offsets, places, side="right") - 1
        whole[doc(words.start[unsure])] = True
        blank = data == 32
        whole[doc(np.flatnonzero(blank[:-1] & blank[1:]))] = True
        ended = np.flatnonzero(offsets[1:] > offsets[:-1])
        whole[ended[blank[offsets[1:][ended] - 1]]] = True
        if not whole.any():
            return ids, np.diff(upto)
        places = np.flatnonzero(whole)
        rest = dict(zip(places.tolist(), self._ids([data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in places]), strict=True))
        parts = [rest[i] if w else ids[a:b] for i, (w, a, b) in enumerate(zip(whole.tolist(), upto[:-1].tolist(), upto[1:].tolist(), strict=True))]
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        ids, sizes = self.flat(pa.array(texts, pa.large_binary()))
        return np.split(ids, np.cumsum(sizes)[:-1]) if len(texts) else []

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and where each id's begin (one more entry than ids)."""
        parts = [_gathered(self.bytes, self.starts[x], self.lengths[x]) for x in np.split(ids, range(_IDS_AT_ONCE, len(ids), _IDS_AT_ONCE))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(self.lengths[ids])])


def _byte_letters() -> list[str]:
    """The letter that byte-level BPE writes for each byte: printable ones stand for themselves, the rest follow from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    return Encoder(path)


# -- chunks --------------------------------------------------------------------------

def rolling_hash(data: np.ndarray) -> np.ndarray:
    """At each byte a hash of the 32 bytes that end there."""
    gear = np.random.default_rng(7).integers(0, 2**32, 256, dtype=np.uint32)
    h, reach = gear[data], 1
    while reach < _REACH:
        older = h[:-reach] << np.uint32(reach)
        h[reach:] += older
        reach *= 2
    return h


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """For each text the ends of its chunks, as places in ``data``; never within a character."""
    hit = np.flatnonzero((rolling_hash(data) >> np.uint32(32 - CHUNK_BITS)) == 0) + 1
    hit = hit[hit < len(data)]
    hit = hit[(data[hit] & 0xC0) != 0x80]
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        ends, at = [], a
        own = hit[np.searchsorted(hit, a + _REACH) : np.searchsorted(hit, b)].tolist()
        for end in [*own, b]:
            while end - at > CHUNK_MOST:
                at += CHUNK_MOST
                while data[at] & 0xC0 == 0x80:
                    at -= 1
                ends.append(at)
            if end - at >= CHUNK_LEAST and end < b:
                ends.append(end)
                at = end
        ends.append(b)
        out.append(ends)
    return out


class Chunk:
    """A chunk's ids, the byte each ends at, and the places where a piece surely begins in any text."""

    __slots__ = ("ends", "ids", "safe", "size")

    def __init__(self, raw: bytes, ids: np.ndarray, lengths: np.ndarray):
        self.size = len(raw)
        self.ids = ids.copy()
        self.ends = np.cumsum(lengths[self.ids])
        self.safe = (raw, None)

    def places(self) -> list[int]:
        if isinstance(self.safe, tuple):
            text = np.frombuffer(self.safe[0], np.uint8)
            begins = np.maximum.accumulate(np.where((text & 0xC0) != 0x80, np.arange(len(text)), 0))
            solid = _SOLID[text[begins]]  # by the first byte of each byte's character
            self.safe = (np.flatnonzero(solid[:-2] & (text[1:-1] == 32) & solid[2:]) + 1).tolist() if len(text) > 2 else []
        return self.safe

    def before(self, place: int) -> int:
        """How many ids end at or before a place."""
        return int(np.searchsorted(self.ends, place, side="right"))


#: First bytes of characters that are never white space: ASCII letters and digits, and most beyond ASCII.
_SOLID = np.array([0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or (b > 0xC2 and b not in (0xE1, 0xE2, 0xE3)) for b in range(256)])


class ChunkedEncoder:
    """Encodes texts chunk by chunk. Beyond ``MEMO_BYTES`` the chunks met become the memo before, whose chunks come over when they are met again."""

    def __init__(self, plain: Encoder):
        self.plain = plain
        self.memo: dict[bytes, Chunk] = {}
        self.before: dict[bytes, Chunk] = {}
        self.held = 0
        self.chunks = self.encoded = 0

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        raw = data.tobytes()
        texts = []
        for a, ends in zip(offsets[:-1].tolist(), chunk_ends(data, offsets), strict=True):
            parts = []
            for b in ends:
                parts.append(raw[a:b])
                a = b
            texts.append(parts)
        if self.held > MEMO_BYTES:
            self.before, self.memo, self.held = self.memo, {}, 0
        new = []
        for p in dict.fromkeys(p for parts in texts for p in parts):
            if p in self.memo:
                continue
            if p in self.before:
                self.memo[p] = self.before[p]
            else:
                new.append(p)
            self.held += 10 * len(p)
        for p, ids in zip(new, self.plain.encode(new), strict=True):
            self.memo[p] = Chunk(p, ids, self.plain.lengths)
        self.chunks += sum(map(len, texts))
        self.encoded += len(new)
        return self._joined(texts)

    def _joined(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Joins the chunks of each text; joins that don't agree yet are tried again with wider windows."""
        memo = self.memo
        pending = {(t, j): 2 for t, parts in enumerate(texts) for j in range(len(parts) - 1)}
        splices: dict[tuple[int, int], tuple] = {}
        whole: set[int] = set()
        while pending:
            windows = []
            for (t, j), reach in pending.items():
                left, right = memo[texts[t][j]], memo[texts[t][j + 1]]
                a, b = left.places(), right.places()
                # a middle chunk is shared by two windows, which must not meet
                if len(a) < reach or len(b) < reach or (j and len(a) < 2 * reach) or (j + 2 < len(texts[t]) and len(b) < 2 * reach):
                    whole.add(t)
                    continue
                windows.append((t, j, reach, a[-reach], a[1 - reach], b[reach - 2], b[reach - 1]))
            encoded = self.plain.encode([texts[t][j][p:] + texts[t][j + 1][:q] for t, j, _, p, _, _, q in windows])
            again = {}
            for (t, j, reach, p, inner_p, inner_q, q), ids in zip(windows, encoded, strict=True):
                left, right = memo[texts[t][j]], memo[texts[t][j + 1]]
                a, a_inner, b_inner, b = left.before(p), left.before(inner_p), right.before(inner_q), right.before(q)
                head, tail = left.ids[a:a_inner], right.ids[b_inner:b]
                agree = len(ids) >= len(head) + len(tail) and np.array_equal(ids[: len(head)], head) and np.array_equal(ids[len(ids) - len(tail) :], tail)
                # the pieces compared must also begin and end where ids do
                agree = agree and all(k == 0 or c.ends[k - 1] == at for c, k, at in ((left, a, p), (left, a_inner, inner_p), (right, b_inner, inner_q), (right, b, q)))
                if agree:
                    splices[t, j] = (a, ids, b)
                else:
                    again[t, j] = reach * 2
            pending = {k: v for k, v in again.items() if k[0] not in whole}
        rest = sorted(whole)
        for t, ids in zip(rest, self.plain.encode([b"".join(texts[t]) for t in rest]), strict=True):
            splices[t, -1] = (0, ids, 0)
        out = []
        for t, parts in enumerate(texts):
            if (t, -1) in splices:
                out.append(splices[t, -1][1])
                continue
            pieces, start = [], 0
            for j, p in enumerate(parts):
                ids = memo[p].ids
                if j + 1 < len(parts):
                    end, middle, after = splices[t, j]
                    pieces += [ids[start:end], middle]
                    start = after
                else:
                    pieces.append(ids[start:])
            out.append(np.concatenate(pieces) if len(pieces) > 1 else pieces[0])
        return out


# -- operators -----------------------------------------------------------------------

def _coded(path: str, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = encoder(path)
        chunked = ChunkedEncoder(plain)
        for batch in batches:
            for part in slices(batch, limit=2 << 20):
                ids = chunked.encode(*utf8(part.column("text")))
                n = np.array([len(x) for x in ids], np.int64)
                data, upto = plain.decode(np.concatenate(ids)) if n.sum() else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
                at = upto[np.concatenate([[0], np.cumsum(n)])]
                raw = data.tobytes()
                decoded = [raw[a:b].decode(errors="replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                if digests:
                    columns = [pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string())]
                else:
                    columns = [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), *columns], names=["doc_id", "n_tokens", *_NAMES[digests]])

    return run


_NAMES = {True: ["ids_sha256", "decoded_sha256"], False: ["ids", "decoded"]}


def encode_and_decode(docs: DataFrame, path: str | None = None, digests_only: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids, decoded; or the digests of the last two."""
    ship(docs.sparkSession)
    kinds = "ids_sha256 string, decoded_sha256 string" if digests_only else "ids array<int>, decoded string"
    return docs.select("doc_id", "text").mapInArrow(frugal(_coded(path or tokenizer_path(), digests_only)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, {kinds}")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    return encode_and_decode(table(spark, sf_dir, "documents"), digests_only=True)
