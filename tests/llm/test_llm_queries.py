"""Queries of the llm folder on the test tables, against their SQL where there is some."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from relata.llm.queries import ORACLES, QUERIES
from tests.conftest import rows


def comparable(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([str(row[i]) for i in order] for row in data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, data, name):
    connection = duckdb.connect()
    for table in ("documents", "conversations"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    found = connection.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    df = QUERIES[name](spark, data)
    assert sorted(df.columns) == sorted(columns)
    assert comparable(df.columns, df.collect()) == comparable(columns, found.fetchall())


def test_there_is_a_query_for_each_operator():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)} | {"pipeline"}


def test_stages_work_on_what_the_one_before_kept(spark, data):
    documents = spark.read.parquet(f"{data}/documents.parquet")
    before = {r.doc_id: r.text for r in documents.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.settle(
            stage(spark, spark.createDataFrame(list((i, t, "en", "src1", 1) for i, t in before.items()),
                                               documents.schema), data), name)
        assert docs.columns[:5] == documents.columns
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(before) and after
        if name not in ("quality_rules", "line_dedup"):
            assert all(before[i] == t for i, t in after.items())
        before = after


def test_stages_take_an_empty_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert rows(stage(spark, docs, data)) == []


@pytest.mark.parametrize("every", [20, 8])
def test_boilerplate_in_a_part_of_a_hot_source_goes(spark, every):
    names = [f"{a}{b}" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    body = [" ".join(f"w{names[(i * 7 + k) % 676]}" for k in range(60)) + f" {names[i]}" for i in range(600)]
    line = "Read more on our site"
    data = [(i, f"{line}\n{b}" if i % every == 0 else b, "en", "hot", 1) for i, b in enumerate(body)]
    data += [(1000 + i, f"{line}\n{body[i]}", "en", "other", 1) for i in range(3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    got = corpus_pipeline.quality_rules(spark, spark.createDataFrame(data, schema), "").collect()
    assert {r.doc_id for r in got} == {d[0] for d in data}
    assert all(r.text == body[r.doc_id] for r in got if r.doc_id < 1000)
    assert all(r.text.startswith(line) for r in got if r.doc_id >= 1000)


def test_turn_orders_of_all_kinds_get_the_verdict_of_the_sql(spark, tmp_path):
    orders = ["s", "u", "ua", "sua", "uau", "a", "au", "uu", "su", "ss", "us", "ux", "xu", "uaa", "suaua", "uas"]
    names = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    data = [(c, k, names[r], "ok") for c, roles in enumerate(orders) for k, r in enumerate(roles)]
    data += [(50, 0, None, "ok"), (51, 0, "user", None), (52, 1, "user", "b"), (52, None, "system", "a")]
    path = f"{tmp_path}/conversations.parquet"
    spark.createDataFrame(data, "conv_id long, turn long, role string, text string").write.parquet(path)
    name = "op10_chat_formatting"
    got = QUERIES[name](spark, str(tmp_path))
    valid = {r.conv_id for r in got.where("valid").collect()}
    assert valid == {-1, 51, 52, *[c for c, o in enumerate(orders) if o in ("u", "ua", "sua", "uau", "su", "suaua")]}
    assert "final_state" in got.columns and "aggregate(" in got._jdf.queryExecution().optimizedPlan().toString()
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    # DuckDB puts a null turn last
    found = connection.execute(ORACLES[name].replace("ORDER BY turn,", "ORDER BY turn NULLS FIRST,"))
    columns = [c[0] for c in found.description]
    assert comparable(got.columns, got.collect()) == comparable(columns, found.fetchall())


def test_lines_that_a_small_part_of_a_host_repeats_are_in_the_query(spark, tmp_path):
    names = [f"{a}{b}" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    lines = [" ".join(f"{w}{names[k]}" for w in ("read", "more", "on", "our", "site")) for k in range(12)]
    data = []
    for i in range(400):
        body = " ".join(f"w{names[(i * 7 + k) % 676]}" for k in range(60)) + f" {names[i]}"
        data.append((i, f"{lines[i % 12]}\n{body}", "hot"))
    data += [(500, "\n".join(lines) + "\none two three", "hot")]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(data, "doc_id long, text string, source string").write.parquet(path)
    name = "op4_quality_rules"
    got = QUERIES[name](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.removed_words for r in got if r.removed_words} == {**{i: 5 for i in range(400)}, 500: 60}
    assert {r.doc_id for r in got if not r.kept} == {500} and not any(r.base_failed for r in got)
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    found = connection.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    assert comparable(list(got[0].asDict()), got) == comparable(columns, found.fetchall())
