"""Packing token sequences: first-fit decreasing with a tournament tree.

Documents are dealt into groups at random. In each group the pieces are
placed, longest first, into the first bin with room; a tournament tree over
the bins' free space finds it in logarithmic time. The gaps that remain are
then filled with the contents of the emptiest bins, cut to measure, so that
at most one sequence of a group is short.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, Words, binary_column, chunks, ids

#: Bytes of text for each group: a group's token ids fit easily in a task.
GROUP_BYTES = 12 << 20
#: Rows of each group, however short their texts.
GROUP_ROWS = 20_000
#: Words that a worker remembers.
CACHE_WORDS = 250_000
_encoders: dict[str, "WordEncoder"] = {}


_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: ASCII punctuation next to which a word may be cut; not the apostrophe (contractions) or the bar (special tokens).
_POINT = np.zeros(256, dtype=bool)
_POINT[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in "'|"]] = True


#: A text whose ids are put together from words and compared with the tokenizer's own, before it is trusted.
PROBE = "It's a Test: (words),  CASES-and 12.5% of \"quoted\"\ttext... naïve café/Ünï; x_y=z*2 <b>don't</b> #7 a.b@c.d e\u0301 你好 \u00d7 ok!\n\nEnd."


class WordEncoder:
    """Token ids of texts, each distinct word encoded once.

    For tokenizers that drop white space, lower-case, and let no token cross
    white space or go from letters to punctuation, the ids of a text are
    those of its parts in order; so are ``word_bpe_49k.json``'s. Parts are
    words between ASCII white space, cut further between an ASCII or Latin-1
    letter and ASCII punctuation. A tokenizer for which this does not hold on
    a probing text is refused.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()
        raw = np.frombuffer(PROBE.encode(), dtype=np.uint8)
        found, _ = self.encode(raw, np.array([0, len(raw)]))
        if found.tolist() != self.tokenizer.encode(PROBE, add_special_tokens=False).ids:
            raise ValueError(f"{path} lets tokens cross word borders, so its ids can't be put together from those of words")
        self.clear()

    @classmethod
    def of(cls, path: str) -> "WordEncoder":
        """The worker's own encoder, which keeps what it knows from task to task."""
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.flat = np.empty(1 << 16, dtype=np.uint32)
        self.ends = np.zeros(1 << 16, dtype=np.int64)  # ends[k + 1]: past the ids of word k

    def learn(self, words: list[str]) -> None:
        """Encode new words, many in one call; a token belongs to the word where it starts."""
        for k in range(0, len(words), 2000):
            part = words[k : k + 2000]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            new = np.array(found.ids, dtype=np.uint32)
            first = np.array([a for a, _ in found.offsets], dtype=np.int64)
            border = np.cumsum([len(w) + 1 for w in part])
            n = len(self.number)
            while n + len(part) + 1 > len(self.ends):
                self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
            used = self.ends[n]
            while used + len(new) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
            self.flat[used : used + len(new)] = new
            self.ends[n + 1 : n + 1 + len(part)] = used + np.searchsorted(first, border)
            self.number.update(zip(part, range(n, n + len(part))))

    def parts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, starts and ends of parts); the index of each text's first part is found from the starts."""
        if b"<|" not in data.tobytes():
            data = _LOWER[data]
        words = Words(data, offsets)
        letter, point = _LETTER[data], _POINT[data]
        latin = np.zeros(len(data), dtype=bool)
        lead = np.flatnonzero(data[:-1] == 0xC3)
        latin[lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]] = True
        ends_letter = letter.copy()
        ends_letter[1:] |= latin[:-1]
        cuts = np.flatnonzero((ends_letter[:-1] & point[1:]) | (point[:-1] & (letter | latin)[1:])) + 1
        begin, end = np.zeros((2, len(data) + 1), dtype=bool)
        begin[words.starts], end[words.ends] = True, True
        begin[cuts], end[cuts] = True, True
        return data, np.flatnonzero(begin), np.flatnonzero(end)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of each text in them)."""
        data, begin, end = self.parts(data, offsets)
        if not len(begin):
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        lengths = end - begin
        past = np.cumsum(lengths)
        packed = data[np.repeat(begin - (past - lengths), lengths) + np.arange(past[-1])]
        column = pa.Array.from_buffers(pa.string(), len(lengths), [None, pa.py_buffer(np.concatenate([[0], past]).astype(np.int32)), pa.py_buffer(packed)])
        coded = column.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.number) > CACHE_WORDS:
            self.clear()
        self.learn([w for w in distinct if w not in self.number])
        number = self.number
        own = np.array([number[w] for w in distinct])
        which = own[coded.indices.to_numpy(zero_copy_only=False)]
        start = self.ends[which]
        count = self.ends[which + 1] - start
        past = np.cumsum(count)
        out = self.flat[np.repeat(start - (past - count), count) + np.arange(past[-1])]
        return out, np.concatenate([[0], past])[np.searchsorted(begin, offsets)]


def _encoder(path: str, end_id: int):
    """doc_id, bytes of an id, which copy of an equal row in its batch this is, and the ids as little-endian integers."""

    def work(batches):
        encoder = WordEncoder.of(path)
        for batch in batches:
            key = ids(batch)
            seen: dict[tuple, int] = {}
            for row, past, data, offsets in chunks(batch, "text"):
                found, at = encoder.encode(data, offsets)
                full = np.insert(found, at[1:], end_id).astype(np.uint32)
                at = at + np.arange(len(at))
                small = full.max(initial=0) < 1 << 16
                blob = binary_column((full.astype(np.uint16) if small else full).view(np.uint8), at * (2 if small else 4))
                n = past - row
                copy = np.zeros(n, np.int32)
                for k, x in enumerate(zip(key.slice(row, n).to_pylist(), map(hash, blob.to_pylist()))):
                    copy[k] = seen[x] = seen.get(x, -1) + 1
                yield pa.RecordBatch.from_arrays([key.slice(row, n), pa.array(np.full(n, 2 if small else 4, np.int32)), pa.array(copy), blob], names=["doc_id", "width", "copy", "tokens"])

    return work


class Tournament:
    """First fit over bins: each node holds the largest free space below it."""

    def __init__(self, bins: int, room: int):
        self.size = 1 << max(0, (bins - 1).bit_length())
        self.free = [room] * (2 * self.size)

    def place(self, need: int) -> int:
        """Index of the first bin with ``need`` free, which it takes."""
        free, k = self.free, 1
        while k < self.size:
            k *= 2
            if free[k] < need:
                k += 1
        free[k] -= need
        at = k - self.size
        k //= 2
        while k:
            best = free[2 * k] if free[2 * k] >= free[2 * k + 1] else free[2 * k + 1]
            if free[k] == best:
                break
            free[k] = best
            k //= 2
        return at


def pack(sizes: list[int], room: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start, length) that hold all items; all but at most one are full."""
    done: list[list[tuple[int, int, int]]] = []
    rest: list[tuple[int, int, int]] = []
    for item, n in enumerate(sizes):
        whole = n // room * room
        done.extend([(item, s, room)] for s in range(0, whole, room))
        if n > whole:
            rest.append((item, whole, n - whole))
    rest.sort(key=lambda x: -x[2])
    bins: list[list[tuple[int, int, int]]] = []
    tree = Tournament(len(rest), room)
    for piece in rest:
        at = tree.place(piece[2])
        if at == len(bins):
            bins.append([])
        bins[at].append(piece)
    fill = [sum(x[2] for x in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda b: -fill[b])
    front, back = 0, len(order) - 1
    while front < back:
        b, d = order[front], order[back]
        gap = room - fill[b]
        if gap == 0:
            front += 1
            continue
        item, start, n = bins[d].pop()
        take = min(gap, n)
        bins[b].append((item, start, take))
        if take < n:
            bins[d].append((item, start + take, n - take))
        fill[b] += take
        fill[d] -= take
        if not bins[d]:
            back -= 1
    return done + [b for b in bins if b]


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tokens binary"


def _packer(room: int, with_tokens: bool):
    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        group = key[0].as_py()
        doc = table.column("doc_id").to_pylist()
        blobs = [np.frombuffer(x.as_py(), dtype=np.uint16 if w == 2 else np.uint32).astype("<u4") for x, w in zip(table.column("tokens"), table.column("width").to_pylist())]
        order = sorted(range(len(doc)), key=lambda k: (doc[k] is None, doc[k] or 0, len(blobs[k])))
        rows: list[list] = [[] for _ in range(8)]
        for number, sequence in enumerate(pack([len(blobs[k]) for k in order], room)):
            offset = 0
            for item, start, n in sequence:
                own = blobs[order[item]]
                part = own[start : start + n].tobytes()
                for to, value in zip(rows, (doc[order[item]], start, n, zlib.crc32(part), len(own), (group << 32) + number, offset, part if with_tokens else None)):
                    to.append(value)
                offset += n
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tokens"]
        return pa.table({c: pa.array(v, pa.binary() if c == "tokens" else pa.int64()) for c, v in zip(names, rows)})

    return work


def pack_documents(docs: DataFrame, tokenizer: str, room: int = 4096, end_id: int = 2, with_tokens: bool = True) -> DataFrame:
    """One row for each piece: where it starts in its document's ids, its ids, and its place in a sequence.

    A document is its text's ids and ``end_id``; null or empty text has
    ``end_id`` alone. Documents longer than ``room`` are cut into full
    sequences and a rest. ``tokens`` holds the ids as little-endian 32-bit
    integers (null unless ``with_tokens``). Rows without doc_id or with a
    repeated one are packed like any other. The number of groups follows
    from the bytes and the rows of all texts, and equal rows are dealt over
    groups like others, so a task's group does not grow with the input; an
    empty table gives an empty table.
    """
    total, rows = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    groups = max(1, -(-(total or 0) // GROUP_BYTES), -(-rows // GROUP_ROWS))
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    coded = held.mapInArrow(_encoder(tokenizer, end_id), "doc_id long, width int, copy int, tokens binary")
    dealt = coded.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", F.lit(17), "tokens", "copy"), F.lit(groups))).drop("copy")
    return dealt.groupBy("pack_group").applyInArrow(_packer(room, with_tokens), PIECE)
