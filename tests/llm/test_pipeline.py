"""Each stage's result on what its predecessor kept, and the whole run: token files of the mixed documents without gaps."""

import zlib

import numpy as np
import pytest
from test_ngram_join import brute

import corpus_pipeline as P
from tallymark.llm import decontamination, quality, vocabulary
from tallymark.session import cut


@pytest.fixture(scope="module")
def stages(spark, sf):
    """The documents before the first stage, and after each."""
    docs = [spark.read.parquet(f"{sf}/documents.parquet")]
    for _, stage in P.STAGES[:-1]:
        docs.append(cut(stage(spark, docs[-1], sf)))
    return docs


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_all_but_the_last_keep_the_columns_of_documents(stages):
    assert all(sorted(d.columns) == sorted(stages[0].columns) for d in stages)


def test_quality_keeps_what_the_rules_keep(stages):
    kept = {r.doc_id for r in quality.quality_report(stages[0]).filter("kept").collect()}
    assert texts(stages[1]) == {i: t for i, t in texts(stages[0]).items() if i in kept} and 0 < len(kept) < stages[0].count()


def test_one_of_each_group_of_near_duplicates_stays(stages):
    before = texts(stages[1])
    groups = brute(before, 80, 5)
    assert texts(stages[2]) == {i: before[i] for i, (n, least) in groups.items() if not n or least == i}
    assert len(texts(stages[2])) < len(before)


def test_documents_with_benchmark_passages_go(spark, sf, stages):
    bad = {r.doc_id for r in decontamination.contaminated(stages[2], spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert texts(stages[3]) == {i: t for i, t in texts(stages[2]).items() if i not in bad}


def test_copies_are_whole_documents(stages):
    before = texts(stages[3])
    rows = stages[4].collect()
    assert rows and all(before[r.doc_id] == r.text for r in rows)
    assert [r.doc_id for r in rows] != sorted(r.doc_id for r in rows)


def test_run_writes_every_copy_once(spark, sf, stages):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary.default_path())
    copies = [r.doc_id for r in stages[4].collect()]
    rows = sorted(P.run(spark, sf).collect(), key=lambda r: r.start)
    assert sorted(r.doc_id for r in rows) == sorted(copies)
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows[:-1]]]).tolist()
    own = {i: np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in texts(stages[4]).items()}
    assert all((r.n_tokens, r.ids_crc32) == (len(own[r.doc_id]), zlib.crc32(own[r.doc_id].tobytes())) for r in rows)
