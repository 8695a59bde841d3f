"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest

import corpus_pipeline
from tallymark.llm import decontamination, line_templates, mixing, near_dedup, passages, quality, secrets, token_counts, token_files, urls
from tallymark.llm.queries import QUERIES
from tallymark.session import cut, shared_dir

LONG = " ".join(f"word{i % 977} of{i % 31}" for i in range(20_000))
PROSE = " ".join(f"alpha{i * i % 89} beta{i % 53}" for i in range(60))
ROWS = [(1, PROSE, "en", "a"), (2, None, None, None), (3, "", "en", "a"), (4, LONG, None, "b"), (None, PROSE, "en", None), (5, PROSE, "en", "a"), (5, PROSE, "en", "a"), (6, "one", "de", "b"), (7, " \n\t ", "de", "b")]
#: Extra columns that clash with names the operators use themselves.
EXTRA = "doc_id long, text string, lang string, source string, n_words int, node string, w string, x string, row string, tie int, kept string, level int, rate int, copy int"


def table(spark, rows):
    return spark.createDataFrame([(*r, *[None] * 10) for r in rows], EXTRA)


ITEMS = "item_id long, text string, n string, g string"
OPS = {
    "quality": lambda d, i: quality.quality_report(d),
    "near": lambda d, i: near_dedup.near_duplicates(d, k=2),
    "contaminated": lambda d, i: decontamination.contaminated(d, i),
    "lines": lambda d, i: line_templates.drop_templates(d),
    "mixing": lambda d, i: mixing.mix(d, mixing.tempered(d)),
    "passages": lambda d, i: passages.repeated_passages(d),
    "secrets": lambda d, i: secrets.secret_spans(d),
    "counts": lambda d, i: token_counts.token_counts(d),
}
PER_ROW = {"quality", "near", "lines", "secrets", "counts"}


@pytest.mark.parametrize("name", OPS)
def test_odd_rows_and_empty_tables(spark, name):
    items = spark.createDataFrame([(1, PROSE[:200], None, None), (2, None, None, None), (None, "", None, None)], ITEMS)
    got = OPS[name](table(spark, ROWS), items).collect()
    if name in PER_ROW:
        assert len(got) == len(ROWS)
    assert OPS[name](table(spark, []), items.limit(0)).collect() == []


def test_results_of_odd_rows(spark):
    d = table(spark, ROWS)
    near = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_dedup.near_duplicates(d, k=2).collect()}
    n = max(k[1] for k in near if k[0] == 1)
    assert near[(1, n)] == (1, True) and near[(5, n)] == (1, False) and near[(None, n)] == (1, False)
    assert near[(2, 0)] == (2, True) and near[(3, 0)] == (3, True) and near[(6, 1)] == (6, True) and near[(7, 0)] == (7, True)
    assert {(r.doc_id, r.n_tokens) for r in token_counts.token_counts(d).collect()} >= {(2, 0), (3, 0)}
    bad = {r.doc_id for r in decontamination.contaminated(d, spark.createDataFrame([(9, PROSE, None, None)], ITEMS)).collect()}
    assert bad == {1, 5, None}
    pairs = {(r.doc_id, r.other_id, r.end) for r in passages.repeated_passages(d).collect()}
    assert pairs == {(5, 1, 120), (None, 1, 120)}


def test_files_of_odd_rows(spark):
    out = f"{shared_dir(spark)}/odd"
    token_files.write_tokens(table(spark, ROWS), out)
    got = token_files.token_digests(spark, out).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == sorted((r[0] is not None, r[0] or 0) for r in ROWS)
    assert {r.n_tokens for r in got if r.doc_id in (2, 3)} == {1}
    token_files.write_tokens(table(spark, []), out + "-empty")
    assert token_files.token_digests(spark, out + "-empty").count() == 0


def test_stages_of_odd_rows(spark, sf):
    docs = table(spark, ROWS)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        for rows in (docs, docs.limit(0)):
            out = cut(stage(spark, rows, sf))
            assert name == "token output" or out.columns == columns
            if not rows.take(1):
                assert out.count() == 0


def test_urls_of_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "no scheme/here", "x"), (4, "http://A.ORG", "x"), (5, "http://a.org/", "x"), (5, "http://a.org/", "x"), (6, "x://spam.b.net/p", "x")], "page_id long, url string, host string")
    got = {r["page_id"]: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, None).select("row.page_id", "host", "path", "rule", "verdict").collect()}
    assert got == {1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"), 4: ("a.org", "", None, "allow"), 5: ("a.org", "/", "org/", "allow"), 6: ("spam.b.net", "/p", None, "allow")}
    assert urls.train(urls.labelled_urls(pages.limit(0))) is None


def test_every_operator_is_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 11))
