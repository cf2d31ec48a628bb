"""Vectorised word scanning over Arrow string columns.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D.  A word's 64-bit
hash takes its length and its bytes (optionally with A-Z lowered), eight at a
time, through a bit mixer after each step; very long words go through a
cryptographic hash.  Equal words have equal hashes in every process.  Whole
texts are scanned, in segments of bounded size that end between words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 20
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_P = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Bit mixer on uint64 (a bijection for each salt)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((salt * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) & _MASK)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words that a table holds.
MOST_BYTES = 1 << 26
#: Words of more bytes than this are hashed one by one.
LONG = 512
#: Keeps the first n of eight little-endian bytes.
_FIRST = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if n == 0:
        return data[:0], np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each word; a text's end also ends a word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~SPACES[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first] = inside[first]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    ends[last] = inside[last]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of data[start:end] for sorted, disjoint spans."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + SEGMENT, "right")))
        hi = int(ends[j - 1])
        part = _LOWER[data[lo:hi]] if lower else data[lo:hi]
        eight = _eight(part)
        at, left = starts[i:j] - lo, ends[i:j] - starts[i:j]
        h = mix(left.astype(np.uint64), 17)
        for k in np.flatnonzero(left > LONG).tolist():
            h[k] = int.from_bytes(hashlib.blake2b(part[at[k] : at[k] + left[k]].tobytes(), digest_size=8).digest(), "little")
        todo = np.flatnonzero((left > 0) & (left <= LONG))
        at, left = at[todo], left[todo]
        while len(todo):
            h[todo] = mix(h[todo] ^ mix(eight[at] & _FIRST[np.minimum(left, 8)], 18), 19)
            more = left > 8
            todo, at, left = todo[more], at[more] + 8, left[more] - 8
        out[i:j] = h
        i = j
    return out


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lowered."""
    return _LOWER[data]


def owners(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index of the text that holds each start."""
    return np.searchsorted(offsets, starts, "right") - 1


def word_hashes(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, word offsets per text: n + 1 values)."""
    data, offsets = utf8(column)
    starts, ends = word_bounds(data, offsets)
    return hashes(data, starts, ends, lower), np.searchsorted(starts, offsets)


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = True


def cut_at_punctuation(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Also end a word where an ASCII letter is followed by ASCII punctuation
    other than an apostrophe.  (starts, ends, whether a word begins there)."""
    if not len(starts):
        return starts, ends, np.zeros(0, bool)
    cuts = np.flatnonzero(_LETTER[data[:-1]] & _PUNCT[data[1:]]) + 1
    within = owners(cuts, starts)  # the word that a cut falls into
    cuts = cuts[(within >= 0) & (cuts > starts[within]) & (cuts < ends[within])]
    begins = np.ones(len(starts) + len(cuts), bool)
    all_starts = np.concatenate([starts, cuts])
    order = np.argsort(all_starts, kind="stable")
    begins[len(starts) :] = False
    return all_starts[order], np.sort(np.concatenate([ends, cuts])), begins[order]


def _eight(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of ``data`` on (zeros behind its end)."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return _places(padded)


def _places(padded: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, without a copy."""
    return np.ndarray(shape=(len(padded) - 7,), dtype="<u8", buffer=padded.data, strides=(1,))


def _put(pool: np.ndarray, used: int, new: np.ndarray, spare: int = 0) -> np.ndarray:
    """``pool`` with ``new`` behind its ``used`` values; it grows by half."""
    need = used + len(new) + spare
    if need > len(pool):
        larger = np.zeros(max(need, len(pool) * 3 // 2), pool.dtype)
        larger[:used] = pool[:used]
        pool = larger
    pool[used : used + len(new)] = new
    return pool


class WordTable:
    """Token ids of words, each encoded once: open addressing over numpy arrays
    by 64-bit hash, with the words' bytes beside, which are compared.

    ``encode`` turns a list of words into (all ids, number of ids per word).
    The table starts afresh when it holds ``limit`` words or more than
    ``MOST_BYTES`` bytes of words, so its memory is bounded and what it returns does not depend on it.
    """

    def __init__(self, encode, limit: int = 1 << 19):
        self.encode, self.limit = encode, limit
        self.slots = 2 * limit
        self.clear()

    def clear(self) -> None:
        self.key = np.zeros(self.slots, np.uint64)
        self.row = np.zeros(self.slots, np.int32)
        self.size = 0
        # of each row, where its ids and its bytes begin; the pools behind them
        self.at, self.begin = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.ids_of, self.bytes_of = np.zeros(1 << 14, np.uint32), np.zeros(1 << 14, np.uint8)
        self.apart: dict[bytes, int] = {}  # words whose hash is another's

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where it is not held."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        place = (keys % np.uint64(self.slots)).astype(np.int64)
        while len(todo):
            held = self.key[place[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self.row[place[todo[hit]]]
            todo = todo[~hit & (held != 0)]
            place[todo] = (place[todo] + 1) % self.slots
        return out

    def _hold(self, words: list[bytes]) -> np.ndarray:
        """New rows for words."""
        ids, n = self.encode([w.decode() for w in words])
        first, size = self.size, self.size + len(words)
        lengths = np.array([len(w) for w in words], np.int64)
        self.ids_of = _put(self.ids_of, int(self.at[first]), ids.astype(np.uint32))
        self.bytes_of = _put(self.bytes_of, int(self.begin[first]), np.frombuffer(b"".join(words), np.uint8), 8)
        self.at = _put(self.at, first + 1, self.at[first] + np.cumsum(n))
        self.begin = _put(self.begin, first + 1, self.begin[first] + np.cumsum(lengths))
        self.size = size
        return np.arange(first, size)

    def _add(self, keys: np.ndarray, words: list[bytes]) -> None:
        rows = self._hold(words)
        place = (keys % np.uint64(self.slots)).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            free = self.key[place[todo]] == 0
            _, first = np.unique(place[todo], return_index=True)
            mine = np.zeros(len(todo), bool)
            mine[first] = True
            mine &= free
            self.key[place[todo[mine]]] = keys[todo[mine]]
            self.row[place[todo[mine]]] = rows[todo[mine]]
            todo = todo[~mine]
            place[todo] = (place[todo] + 1) % self.slots

    def rows(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, spaced: np.ndarray | None = None) -> np.ndarray:
        """Row of each word data[start:end] (``spaced``: a space goes before
        it); rows hold until the next call."""
        keys = hashes(data, starts, ends, lower=False)
        first = np.zeros(len(starts), bool) if spaced is None else spaced
        keys = np.where(first, ~keys, keys)
        keys = np.where(keys == 0, np.uint64(1), keys)
        raw = data.tobytes()
        word = lambda i: (b" " if first[i] else b"") + raw[starts[i] : ends[i]]
        found = self._find(keys)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new, one = np.unique(keys[missing], return_index=True)
            if self.size + len(new) > self.limit or self.begin[self.size] > MOST_BYTES:
                self.clear()
                missing = np.arange(len(keys))
                new, one = np.unique(keys, return_index=True)
            for i in range(0, len(new), self.limit):
                self._add(new[i : i + self.limit], [word(k) for k in missing[one[i : i + self.limit]].tolist()])
            found[missing] = self._find(keys[missing])
        for k in np.flatnonzero(~self._same(found, data, starts, ends, first)).tolist():
            w = word(k)
            if w not in self.apart:
                self.apart[w] = int(self._hold([w])[0])
            found[k] = self.apart[w]
        return found

    def _same(self, rows: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Whether the rows' bytes are those of the words."""
        held, left = self.begin[rows], ends - starts
        same = self.begin[rows + 1] - held == left + first
        same &= ~first | (self.bytes_of[held] == 32)
        eight, pool = _eight(data), _places(self.bytes_of)
        todo = np.flatnonzero(same & (left > 0))
        mine, theirs, left = starts[todo], held[todo] + first[todo], left[todo]
        while len(todo):
            equal = (eight[mine] ^ pool[theirs]) & _FIRST[np.minimum(left, 8)] == 0
            same[todo[~equal]] = False
            more = equal & (left > 8)
            todo, mine, theirs, left = todo[more], mine[more] + 8, theirs[more] + 8, left[more] - 8
        return same

    def ids(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the rows one after another, number of ids per row)."""
        at = self.at[rows]
        n = self.at[rows + 1] - at
        total = np.cumsum(n)
        return self.ids_of[np.repeat(at - total + n, n) + np.arange(int(n.sum()))], n


def slices(batch: pa.RecordBatch, column: str | int, limit: int = SEGMENT):
    """Cut a batch into runs of rows whose texts hold about ``limit`` bytes."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total, begin = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > limit:
            yield batch.slice(begin, i - begin)
            total, begin = 0, i
        total += n + 64
    if begin < batch.num_rows:
        yield batch.slice(begin)
