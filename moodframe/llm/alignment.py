"""Cross-tokenizer alignment of token sequences over their byte offsets.

Each text is encoded by two public tokenizers; its two lists of token ends are
intersected by galloping: the shorter list drives, and for each stride of it an
exponential search widens a window of the longer one until it holds the stride,
which a binary search then places.  The common ends cut both sequences into
groups; differences of their ranks say which tokens of either side share one.

An id pair is linked where two tokens share a group, and its count is the
number of documents that hold it linked.  The ids are written once; a pass over
them counts pairs in tasks and adds them up by key, and a second one aligns
again and looks counts up.  The
most frequent pairs, at most ``shared_pairs``, are broadcast; the others meet
their counts in a join by key.  By the choice of the bound a pair beyond it
occurs in at most twice as many documents as the average broadcast one, so
neither side of that join has a hot key, and no pair is left out.

Each different chunk between two safe places is encoded once by a worker as
long as it remembers it; a text is aligned as a whole, and links of a very long
one are made in blocks.

Defined results: a null or empty text, and one whose pieces do not give its
bytes back, has no tokens: zeros and an empty digest; null and repeated ids are
rows of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodframe.llm.store import drop, written_at
from moodframe.llm.words import slices

#: Values of the shorter list that are searched at once.
STRIDE = 512
#: Bytes of text aligned at once (a longer text is alone).
SLICE = 1 << 19
#: Links that are made at once, and different pairs that a task holds.
LINKS, HELD = 1 << 21, 1 << 21
#: Groups with more links than this are counted by their different ids.
WIDE = 64


def common(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in both ascending lists of the values they share."""
    if len(short) > len(long):
        b, a = common(long, short)
        return a, b
    mine, theirs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at = 0
    for lo in range(0, len(short), STRIDE):
        part = short[lo : lo + STRIDE]
        reach = len(part)
        while at + reach < len(long) and long[at + reach - 1] < part[-1]:
            reach *= 2
        window = long[at : at + reach]
        place = np.searchsorted(window, part)
        inside = np.flatnonzero(place < len(window))
        hit = inside[window[place[inside]] == part[inside]]
        mine.append(lo + hit)
        theirs.append(at + place[hit])
        at += int(place[-1])
    return np.concatenate(mine), np.concatenate(theirs)


def byte_alphabet() -> dict[str, int]:
    """The character of each byte in byte-level vocabularies: printable ones
    stand for themselves, the others follow from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


#: Bytes of different chunks that a worker remembers, and of a text for the
#: tokenizers.
REMEMBERED, TOGETHER = 6 << 20, 1 << 15
_GRAPHIC = np.zeros(256, bool)
_GRAPHIC[0x21:0x7F] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: First bytes of the two-byte letters U+00C0 to U+023F (two signs among them excepted).
_LATIN = np.zeros(256, bool)
_LATIN[0xC3:0xC9] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True


class Tokenizers:
    """Both tokenizers, the bytes of their entries, and the ids of the chunks
    met so far; a worker keeps one.

    A chunk ends before a space or line feed that follows a letter or ASCII
    sign, and before a mark that follows a letter.  The first tokenizer splits
    there by its rules; the second has no entry that reaches across, which is
    checked in its vocabulary.  So a text's ids are those of its chunks.
    """

    def __init__(self, byte_path: str, piece_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        alphabet = byte_alphabet()
        entries = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.bytes_a[i] = bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()
        self.quick = _quick(json.loads(self.a.to_str()), self.bytes_a)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces
        ]
        self.size_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        # entries in a list of groups: within it, last of a side
        self.shown = [f"{i}{end}" for n, last in ((len(self.bytes_a), "|"), (len(pieces), ";")) for end in (",", last) for i in range(n)]
        self.spaces = np.zeros(256, bool)
        for c in b" \n":
            self.spaces[c] = not any(c in x.lstrip(bytes([c])) for x in self.bytes_b)
        self.marks = _MARK.copy()
        for c in b".,;:!?":
            self.marks[c] = not any(re.search(rb"[A-Za-z\x80-\xff]" + re.escape(bytes([c])), x) for x in self.bytes_b)
        self.clear()

    def clear(self) -> None:
        """Forget all chunks; row 0 stands for one that does not come back."""
        self.row: dict[bytes, int] = {}
        self.held = 0
        self.parts: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
        self.at = [np.zeros(2, np.int64), np.zeros(2, np.int64)]

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Places in UTF-8 bytes before which a chunk may begin."""
        if len(data) < 2:
            return np.zeros(0, np.int64)
        before = data[:-1]
        latin = np.zeros(len(before), bool)
        latin[1:] = _LATIN[data[:-2]] & (before[1:] >= 0x80) & ~((data[:-2] == 0xC3) & ((before[1:] == 0x97) | (before[1:] == 0xB7)))
        here = self.spaces[data[1:]] & (_GRAPHIC[before] | latin) | self.marks[data[1:]] & (_LETTER[before] | latin)
        return np.flatnonzero(here) + 1

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first ids, second ids, where each text begins in either) of the
        texts one after another; a text whose bytes do not come back has none."""
        if self.held > REMEMBERED:
            self.clear()
        raw = [b" " + t.encode() if t else b"" for t in texts]
        data = b"".join(raw)
        begins = np.cumsum([0, *[len(r) for r in raw]])
        here = np.zeros(len(data) + 1, bool)
        here[begins] = here[self.cuts(np.frombuffer(data, np.uint8))] = True
        places = np.flatnonzero(here)
        chunks = [data[i:j] for i, j in zip(places[:-1].tolist(), places[1:].tolist())]
        known = self.row
        new = [c for c in dict.fromkeys(chunks) if c not in known]
        if new:
            self._add(new)
        rows = np.fromiter(map(known.__getitem__, chunks), np.int64, len(chunks))
        text = np.searchsorted(begins, places[:-1], "right") - 1
        lost = np.zeros(len(texts), bool)
        lost[text[rows == 0]] = True
        rows, text = rows[~lost[text]], text[~lost[text]]
        out, bounds = [], []
        for parts, at in zip(self.parts, self.at):
            if len(parts) > 1:
                parts[:] = [np.concatenate(parts)]
            ids = parts[0]
            n = at[rows + 1] - at[rows]
            total = np.cumsum(n)
            out.append(ids[np.repeat(at[rows] - total + n, n) + np.arange(int(n.sum()))])
            bounds.append(np.concatenate([[0], total])[np.searchsorted(text, np.arange(len(texts) + 1))])
        return out[0], out[1], bounds[0], bounds[1]

    def _add(self, chunks: list[bytes]) -> None:
        """Encode new chunks, many in one text.  " a" goes before a chunk that
        begins with a mark, and before the first; a chunk that does not end in
        a letter or ASCII sign is a text of its own."""
        self.held += sum(map(len, chunks))
        many: dict[bool, list[bytes]] = {False: [], True: []}
        size = {False: 0, True: 0}
        for c in chunks:
            if c[-1] >= 0x80 and not (len(c) > 1 and _LATIN[c[-2]] and c[-2:] not in (b"\xc3\x97", b"\xc3\xb7")) or c[-1] in b" \t\n\r\x0b\x0c":
                self._alone(c)
                continue
            plain = self.quick is not None and _PLAIN.fullmatch(c) is not None
            many[plain].append(c)
            size[plain] += len(c)
            if size[plain] > TOGETHER:
                self._together(many[plain], plain)
                many[plain], size[plain] = [], 0
        for plain, rest in many.items():
            self._together(rest, plain)

    def _keep(self, chunks: list[bytes], sides: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Rows for chunks: (their ids one after another, number of ids) of either side."""
        first = len(self.at[0]) - 1
        self.row.update(zip(chunks, range(first, first + len(chunks))))
        for side, (ids, n) in enumerate(sides):
            self.parts[side].append(ids)
            self.at[side] = np.concatenate([self.at[side], self.at[side][-1] + np.cumsum(n)])

    def _ids(self, raw: bytes, plain: bool = False) -> tuple[list[int], list[int]]:
        """Ids of a text that begins with a space, which the second tokenizer adds."""
        text = raw.decode()
        if plain:
            return self.quick.encode_ordinary(text), self.b.encode(text[1:])
        return self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text[1:])

    def _alone(self, c: bytes) -> None:
        """A chunk as it stands after a letter (or begins its text, which is the
        same)."""
        a, b = self._ids(b" a" + c)
        whole = b" a" + c
        back = b"".join([self.bytes_a[i] for i in a]) == whole == b"".join([self.bytes_b[i] for i in b])
        if back and self.bytes_a[a[0]] == self.bytes_b[b[0]] == b" a":
            self._keep([c], [(np.array(x[1:], np.int64), np.array([len(x) - 1])) for x in (a, b)])
        else:
            self.row[c] = 0

    def _together(self, chunks: list[bytes], plain: bool) -> None:
        if not chunks:
            return
        parts = [b" a"]
        for c in chunks:
            if c[:1] not in (b" ", b"\n"):
                parts.append(b" a")
            parts.append(c)
        own = np.zeros(len(parts), bool)
        own[np.cumsum([1 if c[:1] in (b" ", b"\n") else 2 for c in chunks])] = True
        whole = b"".join(parts)
        ends = np.cumsum([len(p) for p in parts])
        sides = []
        for ids, sizes, entries in zip(self._ids(whole, plain), (self.size_a, self.size_b), (self.bytes_a, self.bytes_b)):
            ids_of = np.array(ids, np.int64)
            stops = np.cumsum(sizes[ids_of])
            at = np.searchsorted(stops, ends)
            if at[-1] >= len(stops) or (stops[at] != ends).any() or b"".join([entries[i] for i in ids]) != whole:
                for c in chunks:  # some chunk does not come back: one by one
                    self._alone(c)
                return
            n = np.diff(at, prepend=-1)
            sides.append((ids_of[np.repeat(own, n)], n[own]))
        self._keep(chunks, sides)


#: White space, printable ASCII and two-byte Latin letters: characters that all
#: engines put into the same classes.
_PLAIN = re.compile(rb"(?:[\t\n\r\x20-\x7e]|[\xc4-\xc8][\x80-\xbf]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])*")


def _quick(described: dict, entries: list[bytes]):
    """The first tokenizer's own merges and split rule in a faster engine, for
    plain chunks; None where its ids are not in the order of its merges."""
    import tiktoken
    from public_tokenizers import PATTERN

    merges = [m if isinstance(m, list) else m.split(" ") for m in described["model"]["merges"]]
    vocab = described["model"]["vocab"]
    own = described["pre_tokenizer"] or {}
    if own.get("type") != "ByteLevel" or not own.get("use_regex", True) or described["normalizer"] or any(vocab["".join(m)] != 256 + i for i, m in enumerate(merges)):
        return None
    ranks = {entries[i]: i for i in vocab.values()}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if len(ranks) == 256 + len(merges) else None


_loaded: dict[tuple[str, str], Tokenizers] = {}


def tokenizers(*paths: str) -> Tokenizers:
    if paths not in _loaded:
        _loaded[paths] = Tokenizers(*paths)
    return _loaded[paths]


class Aligned:
    """Texts aligned end to end: ids of both sides, and per group its first
    and next token on either side; ``bounds_*`` say where each text begins."""

    def __init__(self, tok: Tokenizers, a: np.ndarray, b: np.ndarray, bounds_a: np.ndarray, bounds_b: np.ndarray):
        self.tok, self.a, self.b, self.bounds_a, self.bounds_b = tok, a, b, bounds_a, bounds_b
        last_a, last_b = common(np.cumsum(tok.size_a[self.a]), np.cumsum(tok.size_b[self.b]))
        self.end_a, self.end_b = last_a + 1, last_b + 1
        self.begin_a = np.concatenate([[0], self.end_a[:-1]]).astype(np.int64) if len(last_a) else last_a
        self.begin_b = np.concatenate([[0], self.end_b[:-1]]).astype(np.int64) if len(last_b) else last_b
        # ends of texts are common, so each group lies in one text
        self.bounds = np.searchsorted(self.end_a, self.bounds_a[:-1], "right")
        self.bounds = np.append(self.bounds, len(self.end_a))
        self.owner = np.searchsorted(self.bounds_a, self.begin_a, "right") - 1
        self.many = (self.end_a - self.begin_a) * (self.end_b - self.begin_b)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of a group's value over each text."""
        total = np.concatenate([[0], np.cumsum(values)])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]

    def groups(self) -> Iterator[Iterator[str]]:
        """For each text its list of groups, in blocks that end with a sign."""
        n_a, n_b = len(self.tok.bytes_a), len(self.tok.bytes_b)
        code_a, code_b = self.a.copy(), self.b + 2 * n_a
        code_a[self.end_a - 1] += n_a
        code_b[self.end_b - 1] += n_b
        both = np.empty(len(code_a) + len(code_b), np.int64)
        width_a, width_b = self.end_a - self.begin_a, self.end_b - self.begin_b
        both[np.arange(len(code_a)) + np.repeat(self.begin_b, width_a)] = code_a
        both[np.arange(len(code_b)) + np.repeat(self.end_a, width_b)] = code_b
        at = self.bounds_a + self.bounds_b
        shown = self.tok.shown
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
            yield ("".join([shown[c] for c in both[i : min(i + LINKS, hi)].tolist()]) for i in range(lo, hi, LINKS))

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, times linked there), each pair of a text once, by text."""
        n_b = len(self.tok.bytes_b)
        shift = np.int64(n_b) * len(self.tok.bytes_a)
        keys: list[np.ndarray] = []
        times: list[np.ndarray] = []
        narrow = np.flatnonzero(self.many <= WIDE)
        total = np.cumsum(self.many[narrow])
        lo = 0
        while lo < len(narrow):
            hi = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + LINKS, "right"))
            hi = max(hi, lo + 1)
            g = narrow[lo:hi]
            n = self.many[g]
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            wide = np.repeat(self.end_b[g] - self.begin_b[g], n)
            a = self.a[np.repeat(self.begin_a[g], n) + nth // wide]
            b = self.b[np.repeat(self.begin_b[g], n) + nth % wide]
            key, count = np.unique(np.repeat(self.owner[g], n) * shift + a * n_b + b, return_counts=True)
            keys.append(key)
            times.append(count)
            lo = hi
        for g in np.flatnonzero(self.many > WIDE).tolist():
            a, many_a = np.unique(self.a[self.begin_a[g] : self.end_a[g]], return_counts=True)
            b, many_b = np.unique(self.b[self.begin_b[g] : self.end_b[g]], return_counts=True)
            keys.append((self.owner[g] * shift + (a[:, None] * n_b + b[None, :])).ravel())
            times.append((many_a[:, None] * many_b[None, :]).ravel())
        key, count = (keys[0], times[0]) if len(keys) == 1 else _added(keys, times)
        return key // shift, key % shift, count


def _added(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, with their summed times."""
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, time = np.concatenate(keys), np.concatenate(times)
    if not len(key):
        return key, time
    order = np.argsort(key, kind="stable")
    key, time = key[order], time[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(time, first)


def encoded(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, a, b): the ids of either tokenizer as unsigned numbers of
    two bytes (four for a larger vocabulary); ``row`` tells rows apart once the
    table is written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizers(byte_path, piece_path)
        for batch in batches:
            for b in slices(batch, "text", SLICE):
                sides = tok.encode(b.column("text").to_pylist())
                columns = []
                for ids, bounds, size in ((sides[0], sides[2], len(tok.bytes_a)), (sides[1], sides[3], len(tok.bytes_b))):
                    raw = ids.astype(_width(size))
                    columns.append(pa.array([raw[i:j].tobytes() for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.binary()))
                yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), *columns], names=["row", "doc_id", "a", "b"])

    kept = [F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text")]
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), *kept)
    return numbered.mapInArrow(run, "row long, doc_id long, a binary, b binary")


def _width(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def _aligned(tok: Tokenizers, batch: pa.RecordBatch) -> Aligned:
    sides = []
    for name, size in (("a", len(tok.bytes_a)), ("b", len(tok.bytes_b))):
        raw = batch.column(name).to_pylist()
        kind = np.dtype(_width(size))
        sides.append((np.frombuffer(b"".join(raw), kind).astype(np.int64), np.cumsum([0, *[len(r) for r in raw]]) // kind.itemsize))
    return Aligned(tok, sides[0][0], sides[1][0], sides[0][1], sides[1][1])


def count_pairs(coded: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """(pair, n): documents of an ``encoded`` table that hold each id pair
    linked; ``pair`` is the first side's id times the second's vocabulary size
    plus the second's id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizers(byte_path, piece_path)
        held: tuple[np.ndarray, np.ndarray] = np.zeros(0, np.int64), np.zeros(0, np.int64)
        fresh: list[np.ndarray] = []

        def added() -> tuple[np.ndarray, np.ndarray]:
            key, n = np.unique(np.concatenate(fresh), return_counts=True) if fresh else held
            return _added([held[0], key], [held[1], n]) if fresh else held

        for batch in batches:
            for b in slices(batch, "a", SLICE):
                fresh.append(_aligned(tok, b).links()[1])
                if sum(map(len, fresh)) > HELD:
                    held, fresh = added(), []
                    if len(held[0]) > HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], names=["pair", "n"])
                        held = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held = added()
        yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], names=["pair", "n"])

    found = coded.select("a", "b").mapInArrow(run, "pair long, n long")
    return found.groupBy("pair").agg(F.sum("n").alias("n"))


def align(
    docs: DataFrame,
    byte_path: str,
    piece_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    shared_pairs: int = 1 << 20,
    keep_groups: bool = False,
) -> DataFrame:
    """One row a document: doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256, with ``keep_groups`` also the groups as text."""
    spark = docs.sparkSession
    tok = tokenizers(byte_path, piece_path)
    n_b = len(tok.bytes_b)
    coded, _ = written_at(encoded(docs, byte_path, piece_path, id_col, text_col), "align-ids")
    counts, path = written_at(count_pairs(coded, byte_path, piece_path), "align-counts")
    # at most as many rows as the first vocabulary
    most = counts.groupBy(F.expr(f"pair div {n_b}").alias("first")).agg(F.max("n").alias("most"))
    judged = counts.join(F.broadcast(most), F.expr(f"pair div {n_b}") == F.col("first")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    # pairs by the power of two of their count, at most 63 rows
    by_power = {r["power"]: r["pairs"] for r in counts.groupBy(F.floor(F.log2("n") + 1e-9).alias("power")).agg(F.count(F.lit(1)).alias("pairs")).collect()}
    taken, least = 0, 62
    for power in sorted(by_power, reverse=True):
        if taken + by_power[power] > shared_pairs:
            break
        taken, least = taken + by_power[power], power
    all_shared = taken == sum(by_power.values())
    frequent = judged.filter(F.col("n") >= F.lit(0 if all_shared else 1 << least)).orderBy("pair").toArrow()
    shared = spark.sparkContext.broadcast(tuple(frequent[c].to_numpy() for c in ("pair", "n", "best")))
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizers(byte_path, piece_path)
        pairs, number, best = shared.value
        for batch in batches:
            for b in slices(batch, "a", SLICE):
                yield _looked_up(tok, b, pairs, number, best, names, keep_groups)

    kinds = "row long, doc_id long, " + ", ".join(f"{c} long" for c in names[2:8]) + ", groups_sha256 string, rest array<struct<pair: long, times: long>>"
    found = coded.mapInArrow(run, kinds + (", groups string" if keep_groups else ""))
    shown = [*names[1:], *(["groups"] if keep_groups else [])]
    if all_shared:
        drop(spark, path)
        return found.select(*shown)
    rows, _ = written_at(found, "align-rows")
    rest = rows.select("row", F.explode("rest").alias("r")).select("row", "r.pair", "r.times")
    met = rest.join(judged.filter(F.col("n") < F.lit(1 << least)), "pair")
    more = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    both = rows.drop("rest").join(more, "row", "left")
    both = both.withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0)))
    return both.select(*shown)


def _looked_up(tok: Tokenizers, batch: pa.RecordBatch, pairs: np.ndarray, number: np.ndarray, best: np.ndarray, names: list[str], keep_groups: bool) -> pa.RecordBatch:
    found = _aligned(tok, batch)
    text, pair, times = found.links()
    place = np.searchsorted(pairs, pair)
    known = place < len(pairs)
    known[known] = pairs[place[known]] == pair[known]
    at = place[known]
    edges = np.arange(batch.num_rows + 1)

    def per_text(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        return np.diff(total[np.searchsorted(text[known], edges)])

    digests, lists = [], []
    for blocks in found.groups():
        sha, tail, some = hashlib.sha256(), "", []
        for block in blocks:
            sha.update((tail + block[:-1]).encode())
            tail = block[-1]
            if keep_groups:
                some.append(block)
        digests.append(sha.hexdigest() if tail else "")
        lists.append("".join(some)[:-1])
    missing = ~known
    entries = pa.StructArray.from_arrays([pa.array(pair[missing]), pa.array(times[missing])], names=["pair", "times"])
    rest = pa.ListArray.from_arrays(pa.array(np.searchsorted(text[missing], edges).astype(np.int32)), entries)
    columns = [
        np.diff(found.bounds_a), np.diff(found.bounds_b), np.diff(found.bounds), found.sums(found.many),
        per_text(times[known] * best[at]), per_text(times[known] * number[at]),
    ]
    arrays = [batch.column("row"), batch.column("doc_id"), *[pa.array(c.astype(np.int64)) for c in columns], pa.array(digests, pa.string()), rest]
    if keep_groups:
        return pa.RecordBatch.from_arrays([*arrays, pa.array(lists, pa.string())], names=[*names, "rest", "groups"])
    return pa.RecordBatch.from_arrays(arrays, names=[*names, "rest"])
