"""Whole runs over small texts, the settings, and the contract with the driver."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lectern import golden
from lectern.config import Config, ConfigError, from_file
from lectern.fixtures import TEXTS
from lectern.functions.tables import phrases
from lectern.operators import profile as P
from lectern.operators.registry import ENTRIES
from lectern.plans import lint
from lectern.queries import fixture_findings


@pytest.fixture(scope="module")
def found(spark):
    return [tuple(x) for x in fixture_findings(spark).collect()]


def test_fixture_texts(found):
    assert sorted(map(repr, found)) == sorted(map(repr, golden.FINDINGS))


def test_every_finding_is_well_formed(found):
    text = {i: t for i, _, t in TEXTS}
    for i, code, severity, start, end, line, col, suggestion, applicability in found:
        assert code in ENTRIES and severity in ("info", "warning", "error")
        assert (applicability == "advisory") == (suggestion is None)
        assert 0 <= start <= end <= len(text[i])
        assert line == text[i].count("\n", 0, start) + 1 and col == start - (text[i].rfind("\n", 0, start) + 1) + 1


def test_selection():
    assert "NB501" not in Config().enabled() and "NB501" in Config(extend_select=("NB5",)).enabled()
    assert Config(select=("NB2",), ignore=("NB202",)).enabled() == {"NB201", "NB203"}
    assert "NB308" not in Config(target="essay").reported() and "NB308" in Config(target="essay").enabled()
    for bad in ({"target": "x"}, {"max_grade": "high"}, {"budgets": {"NB999": 1}}, {"budgets": {"NB301": -1}}, {"backend": "oracle"}):
        with pytest.raises(ConfigError):
            Config(**bad)


def test_settings_files(tmp_path):
    (tmp_path / ".lectern.toml").write_text('target = "email"\nextend-select = ["NB5"]\n')
    (tmp_path / "a").mkdir()
    c = from_file(tmp_path / "a", extend_select=("NB315",), max_grade=9)
    assert c.target == "EMAIL" and c.extend_select == ("NB5", "NB315") and c.max_grade == 9


def test_catalogue():
    assert len(ENTRIES) == 60 and sum(e.default for e in ENTRIES.values()) >= 26
    assert len(phrases("complex")) == 228 and len(phrases("acronym")) == 133 and len(phrases("connector")) == 25


def test_profiles(spark):
    data = [(i, a, f"And so the cat sat on the mat. But the dog, who was here, ran off. It is what it is; so be it. {'Then we went to the sea. ' * 90}") for i, a in enumerate("aabbbbbbbbbbbbbbbbbb")]
    got = {x["author"]: x for x in P.build_profiles(spark.createDataFrame(data, "doc_id bigint, who string, text string"), author="who").collect()}
    assert got["a"]["docs"] == 2 and got["b"]["delta"] is not None or got["b"]["delta_blocks"] is None
    style = P.as_style(got["b"])
    assert style["corpus"]["docs"] == 18 and style["connectors_per_1000_sentences"]["then"] > 900 and "Connectors" in P.profile_card(style)
    plain = [(1, "However, it rained! And it poured! Wow! " + "A word here and there. " * 8)]
    codes = {x["code"] for x in lint.findings(lint.analyze(spark.createDataFrame(plain, "doc_id bigint, text string"), Config(select=("NB7",), style=style))).collect()}
    assert "NB701" in codes and "NB703" in codes


def test_divergence(spark):
    mine = spark.createDataFrame([(1, "a", 1), (1, "b", 1)], "doc_id bigint, trigram string, n bigint")
    same = P.trigram_divergence(mine, spark.createDataFrame([("a", 0.5), ("b", 0.5)], "trigram string, share double")).first()[1]
    apart = P.trigram_divergence(mine, spark.createDataFrame([("c", 1.0)], "trigram string, share double")).first()[1]
    assert abs(same) < 1e-12 and abs(apart - 1.0) < 1e-12


def test_reports_and_sources(spark, tmp_path):
    from lectern.sources.documents import from_text, kind_of, read_files

    (tmp_path / "a.md").write_text("﻿The the cat.", encoding="utf-8")
    (tmp_path / "b.bin").write_text("no")
    docs = read_files(spark, str(tmp_path))
    assert [x["text"] for x in docs.collect()] == ["The the cat."] and docs.first()["kind"] == "markdown"
    assert from_text(spark, "x", "p.HTM").first()["kind"] == "html" and kind_of(F.lit("x")) is not None
    a = lint.analyze(docs, Config(select=("NB306",), max_grade=0), name="name", all_stats=True)
    line = lint.report_lines(lint.findings(a)).first()["value"]
    assert line.endswith("a.md:1:1: NB306 repeated word 'The the' → The")
    assert lint.workflow_lines(lint.findings(a)).first()["value"].startswith("::warning file=")
    payload = json.loads(lint.json_reports(a).first()["value"])
    assert payload["summary"]["words"] == 3 and payload["diagnostics"][0]["suggestion"] == "The"
    assert {x["code"]: x["n"] for x in lint.statistics(a).collect()} == {"NB306": 1}
    assert "grade=" in lint.documents_stats_lines(a).first()["value"]


def test_narrow_plan(spark):
    """All rules together: no shuffle, and the document is scanned once."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang = 'en'")
    plan = lint.findings(lint.analyze(docs, Config(extend_select=("NB5",))))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("FileScan") == 1 and "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in plan


def test_stream(spark, tmp_path):
    from lectern.streaming.lint import run_available

    df = spark.createDataFrame([(1, "The the end."), (2, "Fine.")], "doc_id bigint, text string").coalesce(1)
    df.write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        run_available(spark, f"{tmp_path}/in", df.schema, f"{tmp_path}/out", f"{tmp_path}/check", Config(select=("NB306",))).awaitTermination()
    assert [x["code"] for x in spark.read.parquet(f"{tmp_path}/out").collect()] == ["NB306"]


def test_contract(spark):
    import __spark_entry__ as E

    queries, oracle = E.queries(), E.oracle_sql()
    assert oracle.keys() <= queries.keys() and E.entry(spark).count() > 0
