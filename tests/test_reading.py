"""The kernel that reads documents against the columns whose definitions it shares, and what queries ask of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.reading import Reading

TEXTS = ["", "one", "a\n\nb\n \nc", "Hello there. Is it (really) so? \"Yes.\" No…\nnext line", " ".join(f"w{i}." for i in range(300)), "été déjà-vu don't 3.5 -- a--b 😀 x_y _", "- one\n- two\n* three", "A.\nB.\nC.\nD.\nE", "  lead $5 + x̂; İstanbul ½ a²", "end._ Foo  bar!? (baz) ...\r\nQux"]


def columns(spark, **built):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string").coalesce(1)
    return df.select("i", *(c.alias(k) for k, c in built.items())).orderBy("i").collect()


def test_reading_equals_the_columns(spark):
    """Offsets, words, letters, segments and paragraphs, one kernel and one interpreted expression each."""
    t = F.col("text")
    rows = columns(spark, sentences=T.sentences(t), words=T.words(t), segments=F.flatten(F.transform(T.sentences(t), lambda s: T.segments(s["text"]))), paras=T.paragraphs(t), alpha=T.alpha_tokens(t))
    for x, text in zip(rows, TEXTS):
        r = Reading(text)
        assert [(s.start, s.end, s.text, s.n, s.letters) for s in r.sentences] == [tuple(s) for s in x["sentences"]]
        assert (r.words, r.segments, r.alpha) == (x["words"], x["segments"], x["alpha"])
        assert r.paragraphs == [(p["start"], p["end"]) for p in x["paras"]]


def test_stats_lines_runs_no_rules(spark):
    """lines of statistics hold no findings, so no rule runs for them."""
    from lectern.queries import stats_lines

    plan = stats_lines(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "regexp_extract_all" not in plan


def test_rules_share_one_kernel(spark):
    """F2 to F6, F8, F9: rules, statistics and post-passes are one kernel; no interpreted rule and no second one is left."""
    from lectern.queries import lint_findings, lint_hotspots, lint_statistics, lint_workflow_lines

    for query, kernels in ((lint_findings, 1), (lint_statistics, 1), (lint_workflow_lines, 1), (lint_hotspots, 2)):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == kernels and "EvalPython" not in plan and "regexp_extract_all" not in plan


def test_batches_are_read_in_parts():
    """F5, F6, F8, F9, F12: what a worker holds beside a batch doesn't grow with the rows of the batch."""
    import pyarrow as pa

    from lectern.functions.reading import ROWS, slices

    parts = [len(x) for x in slices(pa.array(["a"] * (3 * ROWS + 1)))]
    assert parts == [ROWS, ROWS, ROWS, 1]


def test_one_document_is_held_at_a_time(monkeypatch):
    """the words of a document are let go before the next one is read, in statistics and in rules."""
    import weakref

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    from lectern.config import Config
    from lectern.functions import reading as R
    from lectern.operators import postpass as O

    live, most = weakref.WeakSet(), []

    def watched(made):
        class Watched(made):
            def __init__(self, *args):
                super().__init__(*args)
                live.add(self)
                most.append(len(live))

        return Watched

    monkeypatch.setattr(R, "Reading", watched(R.Reading))
    monkeypatch.setattr(O, "Document", watched(O.Document))
    texts = pa.array(["Two words here. And more of them."] * (R.ROWS + 5))
    names = (*R.MEASURES, *R.VOCABULARY)
    assert len(R.told_of(texts, names, "NORMAL")) == len(texts) == len(most) and max(most) <= 2
    schema = to_arrow_schema(_parse_datatype_string(f"_original string, name string, n_words bigint, findings {O.SETTLED}, counts map<string,int>"), prefers_large_types=False)
    rows = O.analyzed_part(pa.RecordBatch.from_arrays([texts, texts], names=["_original", "name"]), Config(), "text", ("n_words",), schema)
    assert rows.column("n_words").to_pylist() == [7] * len(texts) and len(most) == 2 * len(texts) and max(most) <= 2


def test_shapes_are_not_lost_to_the_words_looked_for():
    """A pattern is only searched for in texts that hold its words; white space and case must not hide them."""
    from lectern.config import Config
    from lectern.operators.rules import Document, found

    c = Config(select=("NB5",))
    texts = {"It's\tnot a bug, it's one.": "NB501", "We need\nno tools,\nno time, just luck.": "NB501", "They DON'T mean it. Sometimes it can mean more.": "NB501", "This is\nCROSS-team": "NB515", "It could\n\tPerhaps work.": "NB520", "Recently, I was reading that.": "NB531", "More of this, more of that, and more of all things": "NB523"}
    for text, code in texts.items():
        assert code in {f["code"] for f in found(Document(text, text, [], None, "text", c), frozenset(c.reported()))}, text


def test_markup_is_blanked_in_the_kernel(spark):
    """pages go to the rules' kernel as they are; no interpreted step over matches is left."""
    from lectern.queries import html_blank, pages_lint

    plan = pages_lint(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan and "regexp_extract" not in plan and "aggregate(" not in plan
    plan = html_blank(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract" not in plan and plan.count("ArrowEvalPython") == 1


def test_markup_in_plain_python():
    """marks and blanks at equal length, by hand."""
    from lectern.operators.markup import marked

    page = "<p>é<IMG alt = 'a b'>\n<script>x\n</script><!-- - -->z<br"
    text, marks = marked(page, "html")
    assert text == "   é                 \n         \n                   z<br"
    assert [(m["kind"], page[m["start"] : m["end"]]) for m in marks] == [("html", "<p>"), ("image", "<IMG alt = 'a b'>"), ("html", "<IMG alt = 'a b'>"), ("image-alt", "a b"), ("html", "<script>x\n</script>"), ("html", "<!-- - -->")]
    note = "# Head\n- one ![a](b) [c](d)\n| x | y |"
    text, marks = marked(note, "markdown")
    assert text == "  Head\n\n one   a      c    \n  x   y  "
    assert [(m["kind"], note[m["start"] : m["end"]]) for m in marks] == [("heading-marker", "# "), ("heading", "Head"), ("list-marker", "- "), ("image", "![a](b)"), ("image-alt", "a"), ("link-url", "b"), ("link-text", "c"), ("link-url", "d"), ("table-row", "| x | y |")]
    assert marked("<b>", "text") == ("<b>", [])


def test_profile_counts_come_from_the_kernel(spark):
    """openers, connectors and pairs are counted in the reading, not by interpreted expressions over words."""
    from lectern.operators import profile

    r = Reading("However, it rained. And then it rained. In fact it rained ½ a day.")
    assert r.connectors[0] == (0, "however") and [o[0] for o in r.openings] == ["however", "and", "in"]
    assert ("it rained", 3, 1) in r.bigrams and all(" ½" not in k for k, _, _ in r.bigrams)
    df = spark.createDataFrame([(1, "a", r.text)], "doc_id bigint, who string, text string").coalesce(1)
    docs = profile.prepare(df, "text", F.col("who"), "doc_id", ("connectors", "bigrams"))
    for counts in (profile.opener_counts(docs, connectors=True), profile.bigram_counts(docs.withColumn("id", F.explode(F.array(F.lit(1), F.lit(2)))))):
        assert "filter(" not in counts._jdf.queryExecution().optimizedPlan().toString() and counts.count()
