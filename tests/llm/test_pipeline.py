"""Each stage of the pipeline against brute force on its own input, and the queries against SQL."""

import sys
from collections import Counter

import duckdb
import llm_cases
import pytest
from test_decontaminate import brute as overlaps
from test_partenum import brute as classes
from test_token_files import brute as token_rows

import corpus_pipeline
from codeassay.llm import decontaminate, host_rules, mixing, queries
from codeassay.session import stable

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """The input of each stage and the last one's result."""
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(stable(stage(spark, docs[-1], SF)))
    return docs


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "mixture", "token_output"]
    assert all(d.columns == COLUMNS for d in stages[:-1])
    assert stages[-1].columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_quality(stages):
    want = host_rules.host_rules(stages[0]).filter("kept")
    assert ids(stages[1]) == ids(want) and 0 < stages[1].count() < stages[0].count()


def test_near_duplicates(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    want = {c for _, n, c in classes(rows) if n}
    assert ids(stages[2]) == Counter(want) and len(want) < len(rows)
    assert {c for _, n, c in classes([(r.doc_id, r.text) for r in stages[2].collect()])} == want


def test_decontamination(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = ({r.doc_id: r for r in d.collect()} for d in stages[2:4])
    hit = {i: overlaps(r.text, items)[:2] for i, r in before.items()}
    assert after.keys() == {i for i, (n, h) in hit.items() if 100 * h <= 50 * n}
    assert any(h for _, h in hit.values())
    for i, r in after.items():
        assert r.text == before[i].text if not hit[i][1] else overlaps(r.text, items)[1] == 0
        assert r.n_chars == len(r.text)


def test_mixture(stages):
    want = {r.doc_id: r.epochs for r in mixing.mix(stages[3]).collect()}
    assert ids(stages[4]) == Counter(want)
    texts = {r.doc_id: r.text for r in stages[3].collect()}
    assert all(texts[r.doc_id] == r.text for r in stages[4].collect())


def test_token_output(stages):
    got = sorted((r.start, r.n_tokens, r.ids_crc32) for r in stages[5].collect())
    want = sorted(r[1:] for r in token_rows([(r.doc_id, r.text) for r in stages[4].collect()]))
    assert got == want


def test_run(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages[5].collect()))


def test_odd_rows_pass_every_stage(spark):
    for start in (llm_cases.table(spark), llm_cases.empty(spark)):
        docs = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stable(stage(spark, docs, SF))
            assert docs.columns == start.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_against_sql(spark, name):
    sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
    from check_sql import rows

    con = duckdb.connect()
    for table in ("documents", "benchmark", "labels"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(con.execute(queries.ORACLES[name]).df())


def test_removed_spans_leave_nothing(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    cut = decontaminate.decontaminate(docs, items)
    assert decontaminate.find_overlaps(cut, items).filter("size(overlap.spans) > 0").count() == 0
