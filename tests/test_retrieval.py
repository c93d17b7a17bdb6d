import random
import struct
import sys

import pytest

from quillon.operators import index, layout, retrieval
from quillon.plans import pruned
from quillon.sources import collection
from quillon.streaming.incremental import follow

TEXTS = ["a b a c", "b c", "a d d d e", "c", "e f b"]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def test_worked_example(spark, docs):
    q = retrieval.query_table(spark, ["a b", "c c", "d e d", "b c", ""])
    docs = index.Index.of(docs)
    for every, want in ((False, [4, 3, 2, 4, 0]), (True, [1, 3, 1, 2, 0])):
        got = {r[0]: r[1] for r in retrieval.boolean(docs, q, every, False).collect()}
        assert [got[k] for k in range(5)] == want
    top = [tuple(r) for r in retrieval.ranked(docs, q).orderBy("query_id", "rank").collect()]
    assert [(d, round(s, 6)) for i, _, d, s in top if i == 0][:2] == [(0, 0.435436), (2, 0.284707)]
    assert [d for i, _, d, _ in top if i == 1] == [3, 1, 0]
    assert [(d, round(s, 6)) for i, _, d, s in top if i == 2] == [(2, 3.437247), (4, 0.336472)]
    for plan in (pruned.wand, pruned.maxscore):
        assert [tuple(r) for r in plan(docs, q).orderBy("query_id", "rank").collect()] == top
        assert plan(docs, q, 1).count() == 4


def test_null_empty_and_no_documents(spark, docs):
    odd = docs.unionByName(spark.createDataFrame([(9, None), (10, "")], "doc_id long, text string"))
    q = retrieval.query_table(spark, ["a", "zz"])
    assert {r["doc_id"]: r["doc_len"] for r in index.doc_stats(odd).collect()}[9] == 0
    none = index.Index.of(docs.limit(0))
    assert retrieval.ranked(none, q).count() == 0 and pruned.wand(none, q).count() == 0 and pruned.maxscore(none, q).count() == 0
    assert retrieval.boolean(none, q, True, True).count() == 2


def test_queries_with_unknown_tokens_are_left_out(spark, docs):
    m = retrieval.map_queries(retrieval.query_table(spark, ["A b", "a zz", "f"]), index.lexicon(docs))
    assert sorted(map(tuple, m.collect())) == [(0, 0, 0), (0, 1, 1), (2, 0, 5)]


def test_collection_files(spark, docs, tmp_path):
    p = index.postings(docs).join(index.lexicon(docs), "term").select("term_id", "doc_id", "freq")
    base = str(tmp_path / "c")
    collection.write_collection(p, index.doc_stats(docs), len(TEXTS), base)
    back, sizes = collection.read_collection(spark, base)
    assert sorted(map(tuple, back.select("term_id", "doc_id", "freq").collect())) == sorted(map(tuple, p.collect()))
    assert [r["doc_len"] for r in sizes.orderBy("doc_id").collect()] == [4, 2, 5, 1, 3]
    words = lambda *v: struct.pack(f"<{len(v)}I", *v)
    assert [s.tolist() for s in collection.sequences(words(1, 5, 0, 2, 7, 8, 4, 9))] == [[5], [7, 8], [9]]
    (tmp_path / "c.docs").write_bytes(words(2, 5, 6, 1, 0))
    with pytest.raises(Exception, match="number of documents"):
        collection.read_collection(spark, base)[0].collect()


def test_files_of_queries_and_terms(spark, tmp_path):
    (tmp_path / "v").write_text("a\nb\na\n")
    assert sorted(map(tuple, collection.read_vocabulary(spark, str(tmp_path / "v")).select("term", "term_id").collect())) == [("a", 2), ("b", 1)]
    (tmp_path / "q").write_text("a b\n\nb\n")
    q = retrieval.read_queries(spark, str(tmp_path / "q"))
    assert [tuple(r) for r in q.orderBy("query_id").collect()] == [(0, "a b"), (1, "b")]
    (tmp_path / "ids").write_text("5 7\n\n3 x 4\n4294967296 1\n4294967295\n")
    assert [r["terms"] for r in retrieval.read_id_queries(spark, str(tmp_path / "ids")).orderBy("query_id").collect()] == [[5, 7], [], [3], [], [4294967295]]
    some = spark.createDataFrame([(0, "cats"), (1, "running"), (2, "cats"), (3, "dog")], "term_id long, term string")
    stems = spark.createDataFrame([(8, "cat"), (9, "run")], "term_id long, term string")
    m = retrieval.map_queries(retrieval.query_table(spark, ["cats running", "dog", "Running", "zz cats"]), some, stems)
    assert sorted(map(tuple, m.collect())) == [(0, 0, 2, 8), (0, 1, 1, 9), (2, 0, 1, 9)]
    collection.write_mapped_queries(m, str(tmp_path / "o1"), str(tmp_path / "o2"))
    assert [[r[0] for r in spark.read.text(str(tmp_path / o)).collect()] for o in ("o1", "o2")] == [["2\t1", "1"], ["8\t9", "9"]]
    m = retrieval.map_queries(q, collection.read_vocabulary(spark, str(tmp_path / "v")))
    collection.write_mapped_queries(m, str(tmp_path / "out"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["2\t1", "1"]


def test_pruned_plans_and_many_partitions(spark):
    """Any order of rows and any number of partitions gives the ranks of exhaustive ranking, to the last tie."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(rng.choices(words, [1 / (k + 1) for k in range(60)], k=rng.randrange(1, 30)))) for k in range(700)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    q = retrieval.query_table(spark, [" ".join(rng.choices(words, k=rng.randrange(1, 6))) for _ in range(40)])
    want = sorted(map(tuple, retrieval.ranked(index.Index.of(d), q).collect()))
    for n in (1, 13):
        i = index.Index.of(d.repartition(n))
        for plan in (retrieval.ranked, pruned.wand, pruned.maxscore):
            assert sorted(map(tuple, plan(i, q).collect())) == want
    w = pruned._bounded(i, q, 10)
    assert pruned._promising(i, w).count() < retrieval.contributions(i, retrieval.weights(i, q)).count()


def test_index_round_trip_and_stream(spark, docs, tmp_path):
    p = index.postings(docs)
    i = index.Index.build(docs, str(tmp_path / "i"))
    assert tuple(index.verify(p, i.postings).first()) == (0, 0)
    q = retrieval.query_table(spark, ["a b", "d e d"])
    assert retrieval.ranked(i, q).collect() == retrieval.ranked(index.Index.of(docs), q).collect()
    assert "In(term" in i.postings.where("term in ('a', 'b')")._jdf.queryExecution().executedPlan().toString()
    docs.coalesce(1).write.parquet(str(tmp_path / "in"))
    follow(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), str(tmp_path / "s"), str(tmp_path / "ck")).awaitTermination()
    assert tuple(index.verify(p, spark.read.parquet(str(tmp_path / "s"))).first()) == (0, 0)


def test_next_geq(spark):
    d = spark.createDataFrame([(0, 3, 1, 20), (0, 7, 2, 20), (1, 19, 1, 20)], "term_id long, doc_id long, freq long, num_docs long")
    got = {(r["term_id"], r["probe"]): (r["doc_id"], r["position"]) for r in layout.next_geq(d, 4).collect()}
    assert got[0, 0] == (3, 0) and got[0, 5] == (7, 1) and got[0, 10] == (20, 2) and got[1, 15] == (19, 0) and got[1, 20] == (20, 1)


def test_quantiles(spark):
    v = [float(x % 37) / 3 for x in range(1000)]
    r = layout.quantiles(spark.createDataFrame([(x,) for x in v], "value double")).first()
    assert (r["q50"], r["q90"], r["q95"]) == tuple(sorted(v)[p * 10] for p in (50, 90, 95))


def test_entry_works_without_the_subpackage(monkeypatch):
    for name in ("corpus_pipeline", "quillon.llm", "quillon.llm.queries"):
        monkeypatch.setitem(sys.modules, name, None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    import __spark_entry__ as entry

    assert "ranked_or" in entry.queries() and not any(x.startswith("op") and x[2].isdigit() for x in entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
