"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import crf_langid, hmm_lm, iblt, mixing, multi_index, sentencepiece_nbest, sharding, simhash, toxicity, wrapper
from quillon.llm.common import vocabulary_path

LONG = "lorem ipsum dolor sit amet " * 4000
ROWS = [
    (1, "the cat sat on the mat", "en", "a", 1), (2, "the cat sat on the mat", "en", "a", 1), (2, "the cat sat on the mat", "en", "a", 1), (3, None, None, None, None), (4, "", "en", "b", 0),
    (5, " \n\t ", "fr", None, 0), (6, LONG, "fr", "a", len(LONG)), (7, "le chat et la souris dans la maison", "fr", "b", 3), (None, "a row without an id", "en", "a", 5), (8, "***", "en", "c", 3), (9, "x" * 30000, None, "c", 9),
]
EXTRA = "shard int, slot int, key int, score int, component int, node int, fp int, size int, label_id int"


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return d.select("*", *[F.lit(7).cast("int").alias(x.split()[0]) for x in EXTRA.split(", ")])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (6, 1, 0), (7, None, None), (None, 1, 1), (2, 0, 1)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "op1": lambda d, y: simhash.near_duplicates(d), "op1 wide": lambda d, y: simhash.near_groups(d).selectExpr("*", "explode(sequence(1, cast(n as int))) as nth"), "op2": lambda d, y: sentencepiece_nbest.digest(d, vocabulary_path()), "op2 encode": lambda d, y: sentencepiece_nbest.encode(d, vocabulary_path()),
    "op3": lambda d, y: crf_langid.identify(d), "op4": lambda d, y: mixing.mix(d, mixing.quality_of(y)), "op5": lambda d, y: hmm_lm.score(d), "op7": lambda d, y: sharding.shard(d, 4), "op8": lambda d, y: toxicity.classify(d, toxicity.fit(d, y)), "op9": lambda d, y: iblt.fingerprint_edits(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_document(docs, labels, name):
    got = OPERATORS[name](docs, labels).collect()
    assert sorted(map(str, [r["doc_id"] for r in got])) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_no_documents(docs, labels, name):
    assert OPERATORS[name](docs.limit(0), labels.limit(0)).count() == 0


def test_defined_results(docs, labels):
    one = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert one[3]["fingerprint"] == one[4]["fingerprint"] == one[5]["fingerprint"] == "0" * 16
    assert {one[k]["component_id"] for k in (3, 4, 5)} == {3} and one[2]["component_id"] == 1 and one[None]["component_id"] is None
    three = {r["doc_id"]: r for r in crf_langid.identify(docs).collect()}
    assert [three[k]["lang_pred"] for k in (3, 4, 5, 8)] == ["und"] * 4
    five = {r["doc_id"]: r for r in hmm_lm.score(docs).collect()}
    assert five[3]["n_tokens"] == five[4]["n_tokens"] == 1 and five[6]["n_tokens"] == 20001
    assert all(r["decoded_ok"] for r in sentencepiece_nbest.digest(docs, vocabulary_path()).collect())
    assert all(0 <= r["score"] <= 1 for r in toxicity.classify(docs, toxicity.fit(docs, labels)).collect())
    nine = [r for r in iblt.fingerprint_edits(docs).collect() if r["doc_id"] in (1, 2)]
    assert len({r["fingerprint"] for r in nine}) == 1


def test_vectors(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [0.999, 0.01], 1), (4, [0.0, 1.0], 1), (5, None, 1), (6, [0.0, 0.0], 1), (7, [float("nan"), 1.0], 1), (8, [None, 1.0], 1), (9, [], 1), (10, [1.0, 0.0, 0.0], 1), (None, [0.0, 1.0], 1), (4, [0.0, -1.0], 1)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit(1))
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in multi_index.near_duplicates(d).collect()), key=str)
    want = [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 1, 4, True), (4, 0, 4, True), (None, 1, 4, False)] + [(k, 0, k, True) for k in (5, 6, 7, 8, 9, 10)]
    assert got == sorted(want, key=str)
    assert multi_index.near_duplicates(d.limit(0)).count() == 0


def test_pages(spark):
    rows = [(1, None, None, 1), (2, "", "", 1), (3, "http://a.b/x", "<p>one", 1), (3, "http://a.b/x", "<p>one", 1), (4, "not a url", "plain &amp; text<br>next", 1), (None, "http://a.b/y", "<script>x</script><article><p>two  words</p></article>", 1), (5, "http://a.b/z", "<p>" * 3000 + "deep " * 20000, 1)]
    got = sorted((str(r["page_id"]), r["text"][:20], r["n_chars"]) for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host int")).collect())
    assert ("1", "", 0) in got and ("2", "", 0) in got and got.count(("3", "one", 3)) == 2 and ("4", "plain & text\nnext", 17) in got and ("None", "two words", 9) in got and ("5", "deep deep deep deep ", 99999) in got
    assert wrapper.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, docs, labels, tmp_path, empty):
    d = docs.select("doc_id", "text", "lang", "source", "n_chars")
    d = d.limit(0) if empty else d
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, d, str(tmp_path))
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert out.columns == d.columns
        d = out
    assert empty == (d.count() == 0)
