import pytest

import corpus_pipeline
from chartloom.llm.decontaminate import find_leaks
from chartloom.llm.jaccard_join import near_copies
from chartloom.session import read_table


def test_stages_in_turn(spark, sf_dir, tmp_path):
    docs, kept = read_table(spark, sf_dir, "documents"), []
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        if at < 4:
            assert docs.columns == before.columns
        kept.append(docs.select("doc_id").distinct().count())
        if name == "jaccard_join":
            near = near_copies(before)
            assert docs.count() == near.select("component_id").distinct().count()
        if name == "decontamination":
            assert find_leaks(docs, read_table(spark, sf_dir, "benchmark")).count() == 0
    assert kept[0] >= kept[1] >= kept[2] >= kept[3] == kept[4] > 0
    assert corpus_pipeline.run(spark, sf_dir).count() == docs.count()


@pytest.mark.parametrize("rows", [[], [(1, None), (None, ""), (2, "one two"), (2, "one two")]])
def test_odd_documents(spark, sf_dir, make_docs, rows):
    docs = make_docs(rows)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.select("doc_id").distinct().count() == (1 if rows else 0)


def passage(word, n=80):
    return " ".join(f"{word}{i} und der die" for i in range(n // 4))


def test_rows_that_share_an_id_are_judged_by_their_own_text(spark, sf_dir, make_docs):
    repeat, clean = passage("lied"), passage("anders", 100)
    docs = make_docs([(1, repeat + " " + passage("eins")), (2, repeat + " " + passage("zwei")), (2, clean), (None, clean + " mehr")])
    rows = [(r.doc_id, r.text) for r in corpus_pipeline.substring_dedup(spark, docs, sf_dir).collect()]
    assert (2, clean) in rows  # its namesake's passage is not cut from it
    assert sum(repeat in text for _, text in rows) == 1


def test_leaks_go_whatever_their_id(spark, sf_dir, make_docs):
    item = max((r.text for r in read_table(spark, sf_dir, "benchmark").collect()), key=len)
    clean = passage("ruhig", 200)
    docs = make_docs([(None, clean + " " + item + " " + clean), (3, clean), (3, item), (None, clean), (4, None)])
    rows = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.decontamination(spark, docs, sf_dir).where("text is not null").collect())
    assert rows == [(0, clean), (3, clean)]


def test_near_copies_without_ids_keep_one(spark, sf_dir, make_docs):
    text = passage("kopie", 200)
    docs = make_docs([(None, text), (5, text), (5, passage("neu", 60)), (7, text), (None, passage("frei", 60)), (None, passage("frei", 60))])
    rows = [(r.doc_id, r.text) for r in corpus_pipeline.jaccard_join(spark, docs, sf_dir).collect()]
    assert sorted(rows, key=str) == sorted([(7, text), (5, passage("neu", 60)), (None, passage("frei", 60))], key=str)
