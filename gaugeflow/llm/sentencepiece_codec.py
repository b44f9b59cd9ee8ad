"""SentencePiece encoding and decoding by suffix-array matching.

The distinct segments of a batch of texts are put one after another and
indexed with a suffix array. Every piece of the vocabulary is looked up by
binary search; the ranges found are all its occurrences, each an edge from
where it starts to where it ends. The edges are sorted by position and
relaxed from left to right.

The public model is a byte-pair one. Its encoding of a prefix ends with the
one piece that, joined to the encoding of what is before it, is left alone by
the merges; so an edge relaxes its end if its piece may follow the last piece
of its start. That gives the library's own ids. Characters that no piece
holds become byte pieces.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_column, chunks, ids
from .html_text import suffix_array

NORMAL, BYTE = 1, 6
#: Segments that a worker remembers.
KNOWN = 250_000
_models: dict[str, "Model"] = {}


class Model:
    """Pieces and scores of a byte-pair model with byte fallback and no normalisation."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm = spec.normalizer_spec
        if spec.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces):
            raise ValueError("a byte-pair model with identity normalisation and dummy prefix is needed")
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        self.text: list[bytes] = []
        for k, p in enumerate(spec.pieces):
            if p.type == NORMAL:
                piece = p.piece.replace("▁", " ")
                self.score[piece], self.id[piece] = p.score, k
                self.text.append(piece.encode())
            elif p.type == BYTE:
                self.bytes[int(p.piece[3:5], 16)] = k
                self.text.append(bytes([int(p.piece[3:5], 16)]))
            else:
                self.text.append(b"")
        if any(" " in p.lstrip(" ") for p in self.score):
            raise ValueError("a piece goes across a space, so texts can't be cut there")
        #: Last byte of a character and first byte of the next inside some piece; between others no merge ever happens.
        self.joined = np.zeros((256, 256), dtype=bool)
        self.joined[:, 0x80:0xC0] = True  # inside a character
        for piece in self.score:
            for a, b in zip(piece, piece[1:]):
                self.joined[a.encode()[-1], b.encode()[0]] = True
        #: Pieces that merging makes of their own characters; others never come out.
        self.pieces = [p for p in self.score if self.merge(p) == [p]]
        width = max(map(len, self.pieces))
        self.lengths = np.array([len(p) for p in self.pieces])
        self.codes = np.zeros((len(self.pieces), width), dtype=np.int64)
        for k, p in enumerate(self.pieces):
            self.codes[k, : len(p)] = [ord(c) for c in p]
        #: A symbol is a piece, or a character by itself; both have numbers.
        self.symbols: list[str] = list(self.pieces)
        self.number = {p: k for k, p in enumerate(self.pieces)}
        #: Pairs of symbols that were asked for, hashed with linear probing: twice the pair, and one more if it may stand.
        self.pairs = np.full(1 << 16, -1, dtype=np.int64)
        self.asked = 0
        self.spelled: list[np.ndarray] = []
        self.clear()

    @classmethod
    def of(cls, path: str) -> "Model":
        if path not in _models:
            _models[path] = cls(path)
        return _models[path]

    def merge(self, text: str) -> list[str]:
        """Byte-pair merging of a short text: the best-scored pair first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, before: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Whether each symbol may stand after the one before it (-1: the start of a segment)."""
        out = np.ones(len(symbol), dtype=bool)
        inner = np.flatnonzero(before >= 0)
        if not len(inner):
            return out
        key = before[inner] << 31 | symbol[inner]
        answer = self.look_up(key)
        lost = np.flatnonzero(answer < 0)
        if len(lost):
            new = np.unique(key[lost])
            may = []
            for k in new.tolist():
                a, b = self.symbols[k >> 31], self.symbols[k & 0x7FFFFFFF]
                may.append(self.merge(a + b) == [a, b])
            self.remember(new << 1 | np.array(may))
            answer[lost] = self.look_up(key[lost])
        out[inner] = answer & 1
        return out

    def slots(self, key: np.ndarray) -> np.ndarray:
        """Where the search for each pair begins in ``pairs``."""
        bits = len(self.pairs).bit_length() - 1
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def look_up(self, key: np.ndarray) -> np.ndarray:
        """What ``pairs`` holds for each pair, -1 for one not asked for yet."""
        at = self.slots(key)
        out = self.pairs[at]
        open_ = np.flatnonzero((out >> 1 != key) & (out >= 0))
        at = at[open_]
        while len(open_):
            at = (at + 1) & (len(self.pairs) - 1)
            held = self.pairs[at]
            out[open_] = held
            more = (held >> 1 != key[open_]) & (held >= 0)
            open_, at = open_[more], at[more]
        return out

    def remember(self, entries: np.ndarray) -> None:
        """Put distinct new entries into ``pairs``, which stays at most a quarter full."""
        self.asked += len(entries)
        if 4 * self.asked > len(self.pairs):
            entries = np.concatenate([self.pairs[self.pairs >= 0], entries])
            self.pairs = np.full(1 << (8 * self.asked).bit_length(), -1, dtype=np.int64)
        at = self.slots(entries >> 1)
        while len(entries):
            free = self.pairs[at] < 0
            self.pairs[at[free]] = entries[free]
            more = self.pairs[at] != entries
            entries, at = entries[more], (at[more] + 1) & (len(self.pairs) - 1)

    def single(self, code: int) -> int:
        c = chr(code)
        if c not in self.number:
            self.number[c] = len(self.symbols)
            self.symbols.append(c)
        return self.number[c]

    def expand(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols, byte pieces for characters that are none, and the ids of each run of ``counts`` symbols."""
        if len(self.spelled) < len(self.symbols):
            for s in self.symbols[len(self.spelled) :]:
                self.spelled.append(np.array([self.id[s]] if s in self.id else [self.bytes[b] for b in s.encode()], dtype=np.uint32))
            self.size = np.fromiter(map(len, self.spelled), dtype=np.int64, count=len(self.spelled))
            self.spelling = np.concatenate(self.spelled)
        start = np.cumsum(self.size) - self.size
        n = self.size[symbols]
        past = np.cumsum(n)
        out = self.spelling[np.repeat(start[symbols] - (past - n), n) + np.arange(past[-1] if len(past) else 0)]
        edges = np.concatenate([[0], past])[np.concatenate([[0], np.cumsum(counts)])]
        return out, np.diff(edges)

    def clear(self) -> None:
        """Forget what segments were encoded to."""
        self.encoded: dict[str, int] = {}
        self.flat = np.empty(1 << 16, dtype=np.uint32)
        self.ends = np.zeros(1 << 16, dtype=np.int64)

    def learn(self, segments: list[str]) -> None:
        ids_, sizes = encode_segments(self, segments)
        n = len(self.encoded)
        while n + len(segments) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        used = self.ends[n]
        while used + len(ids_) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[used : used + len(ids_)] = ids_
        self.ends[n + 1 : n + 1 + len(segments)] = used + np.cumsum(sizes)
        self.encoded.update(zip(segments, range(n, n + len(segments))))


def occurrences(text: np.ndarray, pieces: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(piece, start) of every occurrence of every piece in ``text``: one binary search for each piece.

    The search narrows a range of the suffix array first by as many characters
    of the piece as a 64-bit number holds, then by one after another, for all
    pieces together.
    """
    depth = int(lengths.max())
    order, _ = suffix_array(text, depth)
    padded = np.concatenate([text, np.full(depth, -1)])
    own = np.unique(padded)
    base = len(own) + 1
    width = min(depth, int(62 / np.log2(base)))
    # Numbers of characters begin with 0 for -1; a piece with a character that the text has not is nowhere.
    number = np.searchsorted(own, padded)
    at = np.searchsorted(own, pieces[:, :width])
    at[at == len(own)] = 0
    here = np.arange(width) < lengths[:, None]
    known = ((own[at] == pieces[:, :width]) | ~here).all(axis=1)
    head, least, most = np.zeros(len(text), np.int64), np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
    for d in range(width):
        head = head * base + number[d : d + len(text)]
        least = least * base + np.where(here[:, d], at[:, d], 0)
        most = most * base + np.where(here[:, d], at[:, d], base - 1)
    head = head[order]
    low = np.searchsorted(head, least, side="left")
    high = np.where(known, np.searchsorted(head, most, side="right"), low)
    for d in range(width, depth):
        live = np.flatnonzero((lengths > d) & (low < high))
        if not len(live):
            break
        want = pieces[live, d]
        for side in ("left", "right"):
            a, b = low[live].copy(), high[live].copy()
            while True:
                open_ = np.flatnonzero(a < b)
                if not len(open_):
                    break
                mid = (a[open_] + b[open_]) // 2
                c = padded[order[mid] + d]
                less = c < want[open_] if side == "left" else c <= want[open_]
                a[open_[less]] = mid[less] + 1
                b[open_[~less]] = mid[~less]
            if side == "left":
                start = a
            else:
                low[live], high[live] = start, a
    count = high - low
    piece = np.repeat(np.arange(len(pieces)), count)
    return piece, order[np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())]


def encode_segments(model: Model, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids of each segment); segments stand between characters that no piece crosses."""
    codes = np.frombuffer("".join(segments).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    sizes = np.fromiter(map(len, segments), dtype=np.int64, count=len(segments))
    # A mark between segments, which no piece holds, keeps edges inside them.
    text = np.insert(codes, np.cumsum(sizes)[:-1], -1) if len(segments) > 1 else codes
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    piece, start = occurrences(text, model.codes, model.lengths)
    inside = np.flatnonzero(text >= 0)
    own, back = np.unique(text[inside], return_inverse=True)
    singles = np.array([model.single(int(c)) for c in own])[back]
    lone = singles >= len(model.pieces)  # single characters that are pieces are among the occurrences
    symbol = np.concatenate([piece, singles[lone]])
    start = np.concatenate([start, inside[lone]])
    length = np.concatenate([model.lengths[piece], np.ones(int(lone.sum()), dtype=np.int64)])
    origin = np.repeat(begin, sizes + 1)[: len(text)]
    end = start + length
    step = end - origin[start]
    order = np.argsort(step * (int(model.lengths.max()) + 1) - length)
    symbol, start, end, step = symbol[order], start[order], end[order], step[order]
    # Positions are between characters; that before a segment's first has no last symbol.
    last = np.full(len(text) + 1, -2, dtype=np.int64)
    last[begin] = -1
    came = np.zeros(len(text) + 1, dtype=np.int64)
    edges = np.flatnonzero(np.concatenate([[True], step[1:] != step[:-1]]))
    for a, b in zip(edges, np.append(edges[1:], len(step))):
        # All edges that end a given number of characters into their segment.
        s, e, t = start[a:b], end[a:b], symbol[a:b]
        ok = model.follows(last[s], t)
        s, e, t = s[ok][::-1], e[ok][::-1], t[ok][::-1]
        last[e], came[e] = t, s
    at = begin + sizes
    live = np.flatnonzero(sizes > 0)
    owner, tokens = [], []
    while len(live):
        # One token of every segment, from its end back.
        owner.append(live)
        tokens.append(last[at[live]])
        at[live] = came[at[live]]
        live = live[at[live] > begin[live]]
    owner, tokens = np.concatenate(owner)[::-1], np.concatenate(tokens)[::-1]
    order = np.argsort(owner, kind="stable")
    return model.expand(tokens[order], np.bincount(owner, minlength=len(segments)))


def _segments(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Segments of all texts, each text with its dummy space, and the index of each text's first.

    A text is cut between two characters that stand together in no piece.
    """
    marked = data.tobytes().replace("▁".encode(), b"\x20\x20\x20") if b"\xe2\x96\x81" in data.tobytes() else None
    if marked is not None:
        texts = [data[a:b].tobytes().replace("▁".encode(), b" ") for a, b in zip(offsets[:-1], offsets[1:])]
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    full = np.diff(offsets) > 0
    wide = np.insert(data, offsets[:-1][full], 32)
    at = offsets + np.concatenate([[0], np.cumsum(full)])
    starts = np.zeros(len(wide), dtype=bool)
    starts[1:] = ~model.joined[wide[:-1], wide[1:]]
    starts[at[:-1][full]] = True
    begin = np.flatnonzero(starts)
    column = pa.Array.from_buffers(pa.string(), len(begin), [None, pa.py_buffer(np.append(begin, len(wide)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(wide))])
    return column, np.searchsorted(begin, at)


def encode_texts(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets of each text in them) of a run of texts."""
    column, first = _segments(model, data, offsets)
    if not len(column):
        return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
    coded = column.dictionary_encode()
    distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    if len(model.encoded) > KNOWN:
        model.clear()
    which = np.array([model.encoded.get(s, -1) for s in distinct])
    new = np.flatnonzero(which < 0)
    if len(new):
        which[new] = len(model.encoded) + np.arange(len(new))
        model.learn([distinct[k] for k in new.tolist()])
    which = which[coded.indices.to_numpy(zero_copy_only=False)]
    start = model.ends[which]
    count = model.ends[which + 1] - start
    past = np.cumsum(count)
    out = model.flat[np.repeat(start - (past - count), count) + np.arange(past[-1])]
    return out, np.concatenate([[0], past])[first]


def decode_ids(model: Model, found: np.ndarray) -> bytes:
    """UTF-8 bytes that ids stand for; control pieces stand for nothing, and the dummy space goes."""
    text = b"".join(map(model.text.__getitem__, found.tolist()))
    return text[1:] if text[:1] == b" " else text


def _encode(path: str):
    def work(batches):
        model = Model.of(path)
        for batch in batches:
            key = ids(batch)
            for row, past, data, offsets in chunks(batch, "text", limit=2 << 20):
                found, at = encode_texts(model, data, offsets)
                yield pa.RecordBatch.from_arrays([key.slice(row, past - row), binary_column(found.astype("<u4").view(np.uint8), at * 4)], names=["doc_id", "ids"])

    return work


def _decode(path: str):
    def work(batches):
        model = Model.of(path)
        for batch in batches:
            blobs = batch.column(batch.schema.get_field_index("ids"))
            texts = [decode_ids(model, np.frombuffer(b.as_py() or b"", dtype="<u4")).decode("utf-8", "replace") for b in blobs]
            yield pa.RecordBatch.from_arrays([ids(batch), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return work


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): each whole text's ids, as little-endian 32-bit integers.

    Null and empty texts have no ids. Rows without doc_id or with a repeated
    one are encoded like any other; an empty table gives an empty table. A
    literal U+2581 is a space to the model, as the library has it.
    """
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return held.mapInArrow(_encode(path), "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of ``encode``'s rows; null ids are empty text, byte pieces that are no UTF-8 give U+FFFD."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(path), "doc_id long, text string")


def _round_trip(path: str):
    def work(batches):
        model = Model.of(path)
        for batch in batches:
            key = ids(batch)
            for row, past, data, offsets in chunks(batch, "text", limit=2 << 20):
                found, at = encode_texts(model, data, offsets)
                rows = []
                for k in range(past - row):
                    own = found[at[k] : at[k + 1]].astype("<u4")
                    text = decode_ids(model, own)
                    rows.append((len(own), zlib.crc32(own.tobytes()), hashlib.sha256(text).hexdigest(), text == data[offsets[k] : offsets[k + 1]].tobytes()))
                n, crc, sha, same = zip(*rows)
                yield pa.RecordBatch.from_arrays([key.slice(row, past - row), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha), pa.array(same)], names=["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "same"])

    return work


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Each text encoded and decoded again: doc_id, n_ids, ids_crc32, decoded_sha256, same (the text came back)."""
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return held.mapInArrow(_round_trip(path), "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, same boolean")
