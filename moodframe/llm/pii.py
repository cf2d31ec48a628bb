"""Personal data: base patterns plus a semi-Markov conditional random field.

Base spans are regular-expression matches (email, ip, card, phone), kept as
they are.  Around digits and ``@`` a text has regions; a region is cut into
atoms (letter runs, digit runs, single other characters) and a semi-Markov CRF
scores whole candidate segments with whole-span features and a transition
score between neighbouring labels.  A segment holds at most ``MAX_ATOMS``
atoms, so the dynamic programme is linear in the text.  It chooses boundaries
and types of all segments of a region jointly; those that overlap no base span
are added.

The field is fitted by conditional likelihood (forward-backward over segments)
on pieces of regions of about ``sample_rows`` documents chosen by the hash of
their id and text, a documented bound.  Their base spans are the labels; copies of the regions
in which a phone lacks its ``+`` or a card is spaced carry the same labels, and
copies with a broken check digit, a part too large or a date instead carry
none, so the model learns such forms.  All rows are searched over their whole
texts.

Defined results: null text has no spans; repeated rows and ties give equal
results; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodframe.llm.store import with_columns
from moodframe.llm.words import slices

KINDS = ("email", "ip", "card", "phone")
MAX_ATOMS = 24
#: Characters of a training piece, and pieces that a document gives at most.
PIECE, EACH = 256, 4
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Digits that are nobody's: put in the place of a span, they are negative examples.
PLAIN = ("2031-05-17 08:45:10", "4.11.2 2030-09-28", "19.20.21", "1 200 300", "20310517084510")
_ATOM = re.compile(r"[A-Za-z]+|[0-9]+|.", re.S)
_CHUNK = re.compile(r"[0-9@][^\s]*")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def _card_ok(s: str) -> bool:
    d = s.replace(" ", "").replace("-", "")
    return 12 <= len(d) <= 19 and luhn(d)


def _ip_ok(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def _phone_ok(s: str) -> bool:
    return 9 <= sum(c.isdigit() for c in s) <= 15


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches of the email pattern, found from their ``@``."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            yield begin, m.end(), "email"
            done = m.end()
        at = text.find("@", max(at + 1, done))


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of four numbers joined by dots: of a whole dotted run
    of numbers, each next four."""
    for m in _DOTTED.finditer(text):
        at, run = m.start(), m.group()
        if run.count(".") < 3:
            continue
        numbers = run.split(".")
        for i in range(0, len(numbers) - 3, 4):
            size = sum(map(len, numbers[i : i + 4])) + 3
            yield at, at + size
            at += size + 1


def base_spans(text: str) -> list[Span]:
    out = list(emails(text))
    if _DIGITS.search(text):
        out += [(a, b, "ip") for a, b in ips(text) if _ip_ok(text[a:b])]
        for kind, pattern, ok in (("card", _CARD, _card_ok), ("phone", _PHONE, _phone_ok)):
            out += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if ok(m.group())]
    return in_order(out)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def regions(text: str) -> list[tuple[int, int]]:
    """Runs of words holding a digit or ``@``; one space joins two of them."""
    out: list[tuple[int, int]] = []
    for m in _CHUNK.finditer(text):
        a, b = m.span()
        limit = out[-1][1] if out else 0
        while a > limit and not text[a - 1].isspace():
            a -= 1
        if out and a - out[-1][1] <= 1:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


FEATURES = 26


def candidates(s: str, bounds: list[tuple[int, int]]) -> list[tuple[int, int, np.ndarray]]:
    """(first atom, atom after the last, whole-span features) of the segments
    that can be an entity: they begin and end beside a non-alphanumeric, and
    hold either ``@`` with letters around it or digits without letters."""
    n = len(bounds)
    text = [s[a:b] for a, b in bounds]
    alnum = [t[0].isascii() and t[0].isalnum() for t in text]
    out = []
    for i in range(n):
        first = text[i][0]
        if not (alnum[i] or first in "+(") or (i and alnum[i - 1] and alnum[i]):
            continue
        letters = digits = ats = dots = others = groups = 0
        longest = 0
        for j in range(i, min(n, i + MAX_ATOMS)):
            t = text[j]
            c = t[0]
            if "0" <= c <= "9":
                digits += len(t)
                groups += 1
                longest = max(longest, len(t))
            elif alnum[j]:
                letters += len(t)
            elif c == "@":
                ats += 1
            elif c == ".":
                dots += 1
            elif c not in " ()-+_%":
                others += 1
            if others or ats > 1:
                break
            if not alnum[j] or (j + 1 < n and alnum[j + 1]):
                continue
            mail = ats == 1 and letters > 0
            if not mail and (letters or digits < 7):
                continue
            raw = s[bounds[i][0] : bounds[j][1]]
            f = np.zeros(FEATURES)
            f[0] = 1
            f[1] = ats == 1
            f[2] = letters > 0
            f[3] = first == "+"
            f[4] = first == "("
            f[5] = dots == 3 and groups == 4 and digits + 3 == len(raw)
            f[6] = bool(f[5]) and _ip_ok(raw)
            f[7] = digits <= 19 and not letters and not ats and _card_ok(raw)
            f[8] = dots > 0
            f[9] = dots > 1
            f[10] = mail and "." in raw[raw.index("@") :]
            f[11] = "(" in raw and ")" in raw
            f[12] = "-" in raw
            f[13] = " " in raw
            f[14] = groups == 1
            f[15] = 2 <= groups <= 3
            f[16] = groups >= 4
            f[17] = longest >= 12
            f[18] = longest <= 4
            f[19] = 7 <= digits <= 8
            f[20] = 9 <= digits <= 11
            f[21] = 12 <= digits <= 19
            f[22] = digits > 19
            f[23] = i > 0 and text[i - 1] in "#=$:"
            f[24] = j + 1 < n and text[j + 1] in "#=$:"
            f[25] = raw[-4:].isdigit() and not raw[-5:].isdigit() and groups > 1
            out.append((i, j + 1, f))
    return out


Candidate = tuple[int, int, np.ndarray]


def lattice(n: int, cands: list[Candidate]) -> tuple[list[int], list[Candidate]]:
    """The atom boundaries at which a candidate begins or ends (with 0 and n),
    and the candidates numbered by them.  What lies between two neighbouring
    boundaries is one outside step."""
    at = sorted({0, n, *(i for i, _, _ in cands), *(j for _, j, _ in cands)})
    number = {x: i for i, x in enumerate(at)}
    return at, [(number[i], number[j], f) for i, j, f in cands]


class SemiCRF:
    """Weights: (features x kinds) for segments and label-to-label transitions
    (label 0: an outside step)."""

    def __init__(self) -> None:
        self.w = np.zeros((FEATURES, len(KINDS)))
        self.t = np.zeros((len(KINDS) + 1, len(KINDS) + 1))

    def _by_end(self, n: int, cands) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
        ends: list[list] = [[] for _ in range(n + 1)]
        for i, j, f in cands:
            ends[j].append((i, f, f @ self.w))
        return ends

    def decode(self, n: int, cands) -> list[tuple[int, int, int]]:
        """Best segmentation: entity segments (first, after last, kind)."""
        if not cands:
            return []
        ends = self._by_end(n, cands)
        best = np.full((n + 1, len(KINDS) + 1), -np.inf)
        best[0, 0] = 0
        back: dict[tuple[int, int], tuple[int, int]] = {}
        for j in range(1, n + 1):
            k = int(np.argmax(best[j - 1] + self.t[:, 0]))
            best[j, 0] = best[j - 1, k] + self.t[k, 0]
            back[j, 0] = (j - 1, k)
            for i, _, score in ends[j]:
                into = best[i][:, None] + self.t[:, 1:]
                k = np.argmax(into, 0)
                got = into[k, np.arange(len(KINDS))] + score
                for y in np.flatnonzero(got > best[j, 1:]):
                    best[j, y + 1] = got[y]
                    back[j, int(y) + 1] = (i, int(k[y]))
        j, y = n, int(np.argmax(best[n]))
        out = []
        while j:
            i, k = back[j, y]
            if y:
                out.append((i, j, y - 1))
            j, y = i, k
        return out[::-1]

    def gradient(self, n: int, cands, gold: dict[tuple[int, int], int]) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood of the labelled segmentation and its gradient."""
        m = len(KINDS) + 1
        segs: list[list[tuple[int, np.ndarray | None, np.ndarray]]] = [[] for _ in range(n + 1)]
        for j in range(1, n + 1):
            segs[j].append((j - 1, None, np.array([0.0, *[-np.inf] * len(KINDS)])))
        for i, j, f in cands:
            segs[j].append((i, f, np.array([-np.inf, *(f @ self.w)])))
        alpha = np.full((n + 1, m), -np.inf)
        alpha[0, 0] = 0
        for j in range(1, n + 1):
            parts = [_lse(alpha[i][:, None] + self.t, 0) + s for i, _, s in segs[j]]
            alpha[j] = _lse(np.array(parts), 0)
        z = _lse(alpha[n], 0)
        beta = np.full((n + 1, m), -np.inf)
        beta[n] = 0
        gw, gt = np.zeros_like(self.w), np.zeros_like(self.t)
        for j in range(n, 0, -1):
            for i, f, s in segs[j]:
                through = self.t + (s + beta[j])[None, :]
                beta[i] = np.logaddexp(beta[i], _lse(through, 1))
                p = np.exp(alpha[i][:, None] + through - z)
                gt -= p
                if f is not None:
                    gw -= np.outer(f, p.sum(0)[1:])
        value, at, label = -z, 0, 0
        features = {(i, j): f for i, j, f in cands}
        start = {i: (j, k) for (i, j), k in gold.items()}
        while at < n:
            j, k = start.get(at, (at + 1, -1))
            value += self.t[label, k + 1]
            gt[label, k + 1] += 1
            if k >= 0:
                value += features[at, j] @ self.w[:, k]
                gw[:, k] += features[at, j]
            at, label = j, k + 1
        return value, gw, gt

    def fit(self, data, epochs: int = 30, rate: float = 0.2, l2: float = 0.002) -> SemiCRF:
        """Adam on the penalised mean log-likelihood."""
        if not data:
            return self
        params = [self.w, self.t]
        m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, epochs + 1):
            g = [np.zeros_like(p) for p in params]
            for n, cands, gold in data:
                _, gw, gt = self.gradient(n, cands, gold)
                g[0] += gw
                g[1] += gt
            for p, x, a, b in zip(params, g, m1, m2):
                x = x / len(data) - l2 * p
                a += 0.1 * (x - a)
                b += 0.01 * (x * x - b)
                p += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
        return self


def _lse(x: np.ndarray, axis: int):
    top = np.max(x, axis=axis, keepdims=True)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        out = np.log(np.sum(np.exp(x - safe), axis=axis, keepdims=True)) + safe
    return np.squeeze(out, axis)


def atoms(s: str) -> list[tuple[int, int]]:
    return [m.span() for m in _ATOM.finditer(s)]


def pieces(text: str) -> Iterator[tuple[str, list[Span]]]:
    """The text's regions with their base spans, long ones cut between spans
    into pieces of about ``PIECE`` characters."""
    base = base_spans(text)
    for a, b in regions(text):
        inside = [s for s in base if a <= s[0] and s[1] <= b]
        while a < b:
            end = min(b, a + PIECE)
            for x, y, _ in inside:
                if x < end < y:
                    end = y
            yield text[a:end], [(x - a, y - a, k) for x, y, k in inside if a <= x and y <= end]
            a = end


def examples(s: str, inside: list[Span]) -> Iterator[tuple[int, list, dict]]:
    """Training examples from a piece: with its base spans as labels, and as
    altered copies if it has one."""
    yield from _example(s, inside)
    if len(inside) == 1:
        x, y, k = inside[0]
        span = s[x:y]
        likewise, not_so = [], []
        if k == "phone":
            likewise = [span[1:], span[1:].partition(" ")[2]]
            not_so = [span[:6]]
        elif k == "card":
            digits = span.replace(" ", "").replace("-", "")
            likewise = [" ".join(digits[i : i + 4] for i in range(0, len(digits), 4))]
            not_so = [span[:-1] + str((int(span[-1]) + 1) % 10)]
        elif k == "ip":
            not_so = [span.rpartition(".")[0], "9" + span.replace(".", "99.")]
        for other in likewise:
            if other and _DIGITS.match(other[-1:]):
                yield from _example(s[:x] + other + s[y:], [(x, x + len(other), k)])
        for other in [*not_so, *PLAIN]:
            yield from _example(s[:x] + other + s[y:], [])


def _example(s: str, spans: list[Span]) -> Iterator[tuple[int, list, dict]]:
    bounds = atoms(s)
    cands = candidates(s, bounds)
    if not cands:
        return
    begin = {a: i for i, (a, _) in enumerate(bounds)}
    end = {b: i + 1 for i, (_, b) in enumerate(bounds)}
    known = {(i, j) for i, j, _ in cands}
    gold: dict[tuple[int, int], int] = {}
    last = 0
    for x, y, k in sorted(spans):
        at = (begin.get(x, -1), end.get(y, -1))
        if at in known and at[0] >= last:
            gold[at] = KINDS.index(k)
            last = at[1]
    at, cands = lattice(len(bounds), cands)
    yield len(at) - 1, cands, {(at.index(i), at.index(j)): k for (i, j), k in gold.items()}


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_rows: int = 1500,
    max_regions: int = 500,
) -> SemiCRF:
    """Fit on at most ``max_regions`` pieces of regions, at most ``EACH`` a
    document, of about ``sample_rows`` documents of any length that hold a digit
    or ``@``; documents and pieces are chosen by hash."""
    drawn = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))
    rows = docs.select(drawn.alias("rank"), F.col(text_col).alias("text")).filter(F.col("text").rlike("[0-9@]"))
    n = rows.count()
    share = F.pmod("rank", F.lit(1 << 30)) / float(1 << 30)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch, 1)):
            out: list[tuple[int, str, str]] = []
            for rank, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                # a few pieces of each text, by hash
                keyed = ((zlib.crc32(f"{rank}:{i}".encode()), s, joined(spans)) for i, (s, spans) in enumerate(pieces(text)))
                out += heapq.nsmallest(EACH, keyed)
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), *[pa.array([o[k] for o in out], pa.string()) for k in (1, 2)]], names=["rank", "piece", "spans"])

    found = rows.filter(share <= F.lit(sample_rows / max(1, n))).mapInArrow(cut, "rank long, piece string, spans string")
    data: list = []
    for r in found.orderBy("rank", "piece").limit(max_regions).collect():  # <= max_regions pieces
        spans = [(int(x), int(y), k) for k, x, y in (s.split(":") for s in r["spans"].split(",") if s)]
        data.extend(examples(r["piece"], spans))
        if len(data) >= max_regions:
            break
    return SemiCRF().fit(data[:max_regions])


def find(text: str | None, model: SemiCRF) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of one text."""
    if not text:
        return [], []
    base = base_spans(text)
    added = []
    for a, b in regions(text):
        s = text[a:b]
        bounds = atoms(s)
        cands = candidates(s, bounds)
        if not cands:
            continue
        at, cands = lattice(len(bounds), cands)
        for i, j, k in model.decode(len(at) - 1, cands):
            x, y = a + bounds[at[i]][0], a + bounds[at[j] - 1][1]
            if all(y <= p or q <= x for p, q, _ in base):
                added.append((x, y, KINDS[k]))
    return base, in_order(base + added) if added else base


def redact(text: str, spans: list[Span]) -> str:
    """Overlapping spans merge into one mark, named after the first."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, model: SemiCRF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base_spans, spans) as strings ``kind:start:end,...`` plus base
    counts by kind."""
    frame = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast((model.w, model.t))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = SemiCRF()
        crf.w, crf.t = shared.value
        for b in (part for batch in batches for part in slices(batch, 1)):
            found = [find(t, crf) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([joined(x) for x, _ in found], pa.string()),
                    pa.array([joined(y) for _, y in found], pa.string()),
                    *[pa.array([sum(s[2] == k for s in x) for x, _ in found], pa.int64()) for k in KINDS],
                ],
                names=["doc_id", "base_spans", "spans", *[f"n_{k}" for k in KINDS]],
            )

    counts = [F.lit(0).cast("bigint").alias(f"n_{k}") for k in KINDS]
    schema = frame.select("doc_id", F.lit("").alias("base_spans"), F.lit("").alias("spans"), *counts).schema
    return frame.mapInArrow(run, schema)


def redact_pii(docs: DataFrame, model: SemiCRF, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by ``[KIND]``."""
    shared = docs.sparkSession.sparkContext.broadcast((model.w, model.t))
    crf = SemiCRF()

    def each(batch: pa.RecordBatch, at: int) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        crf.w, crf.t = shared.value
        for b in slices(batch, at):
            yield b, [pa.array([t if t is None else redact(t, find(t, crf)[1]) for t in b.column(at).to_pylist()], pa.string())]

    others = [c for c in docs.columns if c != text_col]
    out = with_columns(docs, text_col, others, {"__redacted": "string"}, each)
    return out.select(*[F.col("__redacted").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
