"""Every stage of the corpus pipeline against a plain Python version."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_set_operators import WORD, brute_text, packed_rows, targets

import corpus_pipeline as pipeline
from moodframe.llm import langid, pii
from moodframe.llm.queries import tokenizer_path
from moodframe.sources.tables import load_table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    """The small table with awkward rows and columns that clash with the operators' own."""
    docs = load_table(spark, SF, "documents")
    text = docs.first()["text"]
    rows = [(900, None, "en", "src0", 0), (901, "", None, None, 0), (902, " 12 34 ", "en", "src1", 7), (903, text, "fr", None, 5), (903, text, "fr", None, 5),
            (None, "of the people, by the people and for the people of the land", "en", "src0", 4), (904, "x " * 9000 + "end", "en", "src2", 1)]
    more = spark.createDataFrame(rows, docs.schema)
    return docs.unionByName(more).select("*", F.lit("own").alias("score"), F.lit(1).alias("row"), F.lit(2).alias("component_id"), F.lit("t").alias("the.text"))


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def test_language_stage(spark, documents):
    kept = pipeline.language(spark, documents, SF)
    assert kept.columns == documents.columns
    train = documents.filter(~langid.held_out("doc_id", 4, 2))
    d = langid.fit_dictionaries(train)
    coders = langid.compressors(d, langid.LEVEL), langid.compressors(d, langid.SHORT_LEVEL)
    want = Counter()
    for r in documents.collect():
        lang, margin, compared = langid.classify([r["text"]], *coders)[0]
        if compared and margin >= 0.004:
            want[tuple(r)] += 1
    assert rows_of(kept) == want and 900 not in {r["doc_id"] for r in kept.collect()}


def test_near_duplicate_stage(spark, documents):
    kept = pipeline.near_duplicates(spark, documents, SF)
    assert kept.columns == documents.columns
    _, classes = brute_text([(r["doc_id"], r["text"]) for r in documents.filter("doc_id is not null").collect()])
    want = Counter({tuple(r): 1 for r in documents.collect() if r["doc_id"] is None or classes[r["doc_id"]] == r["doc_id"]})
    assert rows_of(kept) == want


def test_personal_data_stage(spark, documents):
    clean = pipeline.personal_data(spark, documents, SF)
    assert clean.columns == documents.columns
    model = pii.fit(documents)
    want = Counter()
    for r in documents.collect():
        text = None if r["text"] is None else pii.redact(r["text"], pii.find(r["text"], model)[1])
        want[tuple({**r.asDict(), "text": text, "n_chars": None if text is None else len(text)}.values())] += 1
    assert rows_of(clean) == want


def test_mixing_stage(spark, documents):
    mixed = pipeline.mix(spark, documents, SF)
    assert mixed.columns == documents.columns
    before, after = rows_of(documents), rows_of(mixed)
    assert all(n <= 3 * before[row] for row, n in after.items())
    size = lambda text: len(WORD.findall(text or ""))
    sizes, taken = Counter(), Counter()
    for row, n in before.items():
        sizes[row[3]] += n * size(row[1])
    for row, n in after.items():
        taken[row[3]] += n * size(row[1])
    longest = max(size(row[1]) for row in before)
    for source, want in targets(dict(sizes)).items():
        assert abs(taken[source] - want) <= longest


def test_whole_pipeline(spark, documents, tmp_path):
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    got = pipeline.run(spark, str(tmp_path)).collect()
    docs = load_table(spark, str(tmp_path), "documents")
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    ids = {r["doc_id"]: [*t.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    packed_rows(got, ids, 2048)
    assert {r["doc_id"] for r in got} == set(ids)


def test_empty_table(spark, documents):
    docs = documents.limit(0)
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == documents.columns and docs.collect() == []
    assert pipeline.pack(spark, docs, SF).collect() == []
