"""Cross-tokenizer alignment against a plain Python version."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from moodframe.llm import alignment
from moodframe.llm.queries import QUERIES, tokenizer_path

PATHS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain_tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    shown = {}  # the byte-level alphabet, taken from the tokenizer itself
    for i in range(256):
        if i < 128:
            shown[a.encode(chr(i), add_special_tokens=False).tokens[0]] = i
    for i in range(0x80, 0x800):
        pieces = "".join(a.encode(chr(i), add_special_tokens=False).tokens)
        for c, byte in zip(pieces, chr(i).encode()):
            shown[c] = byte

    def bytes_a(i):
        return bytes(shown.get(c, 255) for c in a.id_to_token(i))

    def bytes_b(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()

    return a, b, bytes_a, bytes_b


def plain(texts, tools):
    """Rows in the order of the texts."""
    a, b, bytes_a, bytes_b = tools
    aligned = []
    for text in texts:
        groups = []
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            ends_a = np.cumsum([len(bytes_a(i)) for i in ids_a]).tolist()
            ends_b = np.cumsum([len(bytes_b(i)) for i in ids_b]).tolist()
            raw = (" " + text).encode()
            if b"".join(map(bytes_b, ids_b)) == raw and ends_a[-1] == len(raw):
                both = sorted(set(ends_a) & set(ends_b))
                lo_a = lo_b = 0
                for end in both:
                    hi_a, hi_b = ends_a.index(end, lo_a) + 1, ends_b.index(end, lo_b) + 1
                    groups.append((ids_a[lo_a:hi_a], ids_b[lo_b:hi_b]))
                    lo_a, lo_b = hi_a, hi_b
        aligned.append(groups)
    links = [Counter((x, y) for g in groups for x in g[0] for y in g[1]) for groups in aligned]
    count = Counter(p for one in links for p in one)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for groups, one in zip(aligned, links):
        shown = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((
            sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(one.values()),
            sum(n for p, n in one.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in one.items()),
            hashlib.sha256(shown.encode()).hexdigest() if shown else "",
        ))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(3)
    alphabet = "aeét ōß日本語  　\n\t\r.,'0129<s>#🙂🇫🇷é‍{}*\x00"
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 90))) for _ in range(120)]
    return [
        None, "", " ", "  ", "a ", " a", "a  b   c", "<|endoftext|> </s> <s>", "▁ bar", "foo▁bar", "the cat sat on the mat", "the cat sat on the mat",
        "Tab\tand\r\nlines\n\n", "🙂" * 400, "aaaaaaa" * 300, "0123456789" * 50, "word " * 30000 + "end", "x  y" * 20000, "a" * 70000, " a", "a.", " a. a", "é.è, ×. ÷ б. 日。x", "it's.I'll", "a.\n b", "no\u00a0 break", "a\u180e b", *made,
    ]


def rows_of(df):
    return Counter(tuple(r) for r in df.select("doc_id", *COLUMNS).collect())


@pytest.mark.parametrize("shared", [1 << 20, 200, 0])
def test_equals_plain(spark, odd, plain_tokenizers, shared):
    """With all, with some and without any counts broadcast."""
    ids = [None if i == 10 else i % 60 for i in range(len(odd))]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in zip(ids, odd)], "doc_id long, text string, n_links int, row string").repartition(5)
    want = Counter((i, *row) for i, row in zip(ids, plain(odd, plain_tokenizers)))
    assert rows_of(alignment.align(docs, *PATHS, shared_pairs=shared)) == want


def test_blocks_do_not_matter(spark, odd, plain_tokenizers, monkeypatch):
    monkeypatch.setattr(alignment, "LINKS", 7)
    monkeypatch.setattr(alignment, "WIDE", 2)
    monkeypatch.setattr(alignment, "STRIDE", 3)
    monkeypatch.setattr(alignment, "TOGETHER", 20)
    monkeypatch.setattr(alignment, "REMEMBERED", 50)
    texts = [t for t in odd if not t or len(t) < 500]
    tok = alignment.Tokenizers(*PATHS)
    found = alignment.Aligned(tok, *tok.encode(texts))
    want = plain(texts, plain_tokenizers)
    assert np.diff(found.bounds).tolist() == [w[2] for w in want]
    assert found.sums(found.many).tolist() == [w[3] for w in want]
    text, _, times = found.links()
    assert np.bincount(text, times, len(texts)).tolist() == [w[3] for w in want]
    assert [hashlib.sha256(s[:-1].encode()).hexdigest() if s else "" for s in map("".join, found.groups())] == [w[6] for w in want]


def test_chunks_are_those_of_whole_texts(plain_tokenizers):
    """Random texts of every kind of boundary, encoded in chunks and whole."""
    a, b, _, bytes_b = plain_tokenizers
    tok = alignment.Tokenizers(*PATHS)
    assert tok.spaces[[32, 10]].all() and tok.marks.any()
    rng = random.Random(9)
    units = ["a", "The", "é", "ß", "ŝ", "б", "日", "×", "'s", "'ll", "12", ".", ",", "!?", ";", ":", "-", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\u00a0", "\u3000", "\u200b", "🙂", "<s>"]
    texts = ["".join(rng.choice(units) for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    ids_a, ids_b, at_a, at_b = tok.encode(texts)
    for i, t in enumerate(texts):
        want_a, want_b = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        if b"".join(map(bytes_b, want_b)) != (" " + t).encode():
            want_a = want_b = []
        assert ids_a[at_a[i] : at_a[i + 1]].tolist() == want_a and ids_b[at_b[i] : at_b[i + 1]].tolist() == want_b, repr(t)


def test_groups_and_empty_table(spark, plain_tokenizers):
    docs = spark.createDataFrame([(1, "the cat"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in alignment.align(docs, *PATHS, keep_groups=True).collect()}
    assert hashlib.sha256(got[1]["groups"].encode()).hexdigest() == got[1]["groups_sha256"] and got[2]["groups"] == ""
    assert alignment.align(docs.limit(0), *PATHS).collect() == []


def test_common_positions():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a = np.unique(rng.integers(0, 4000, rng.integers(0, 3000)))
        b = np.unique(rng.integers(0, 4000, rng.integers(0, 40)))
        at_a, at_b = alignment.common(a, b)
        assert a[at_a].tolist() == b[at_b].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_query_equals_plain(spark, plain_tokenizers):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = Counter((r["doc_id"], *w) for r, w in zip(rows, plain([r["text"] for r in rows], plain_tokenizers)))
    assert rows_of(QUERIES["op11_galloping_alignment"](spark, sf)) == want
