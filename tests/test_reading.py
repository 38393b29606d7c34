"""Text of pages, statements, tables, masks, excerpts, JSON replies, packets: what is expected is written out."""

import datetime as dt

import pandas as pd
from helpers import same_rows
from pyspark.sql import functions as F

from tidecast.functions import text as X
from tidecast.plans import catalog
from tidecast.sources import corpora as C


def value(spark, column, **cells):
    names = list(cells)
    return spark.createDataFrame([tuple(cells.values())], ", ".join(f"{n} string" for n in names)).select(column.alias("x")).first().x


def test_text_of_a_page(spark):
    page = '<html><nav>x</nav><p>A&amp;B &lt;c&gt;&nbsp;&eacute;&#8217;</p><div>two</div><script>var t="</p>";</script>end<br/>\n\n z </html>'
    assert value(spark, X.html_to_text(F.col("h")), h=page) == "A&B <c> é’\n two\n end\n z"
    assert value(spark, X.html_to_text(F.col("h")), h=None) is None and value(spark, X.html_to_text(F.col("h")), h="") == ""


def test_names_without_their_semicolon(spark):
    page = "<p>AT&ampT &amp &am &copy;&copy &notit; &ampx; &#38;&#38 &#x26;&#x26 &bogus; &amp;quot; &amp&amp;</p>"
    assert value(spark, X.html_to_text(F.col("h"), closed=True), h=page) == "AT&ampT &amp &am ©&copy &notit; &ampx; &&#38 &&#x26 &bogus; &quot; &amp&"
    assert value(spark, X.html_to_text(F.col("h")), h=page) == "AT&T & &am ©© ¬it; &x; && && &bogus; &quot; &&"
    assert value(spark, X.html_to_text(F.col("h"), closed=True), h=None) is None and value(spark, X.html_to_text(F.col("h"), closed=True), h="") == ""


def test_pages_cut_within_a_name_and_odd_white_space_agree_with_sql(spark, tmp_path):
    cut = [f"<p>les&amp;{name} De &quot;x&quot; &copy;</p>" for name in ("&amp", "&am", "&a", "&", "&quot", "&quo", "&copy", "&ampT", "&amp;quot", "&amp&amp;")]
    odd = ["a \u2028", "a\n\n\x85", "\x0ba \x0b", "a\n\x0b\n\nb", "a<nav\xe9>b</nav>c", "a<nav_>b</nav>c", "a<NAV\n>b</Nav>c", "\f\r a \xa0\t", "", None]
    pd.DataFrame({"page_id": range(len(cut + odd)), "html": cut + odd}).to_parquet(tmp_path / "pages.parquet")
    same_rows(catalog.QUERIES["s16_html_text"](spark, str(tmp_path)), catalog.SQL["s16_html_text"], tmp_path)


def test_statements_are_cut_out_of_pages(spark):
    new = f'<p>The Federal Reserve</p><div {X.MAIN_COLUMN}><p>Rates stay.</p>Implementation Note issued</div>'
    old = "<nav>Home</nav>Press <b>Information received</b> since March.<br>Voting for this action: all."
    assert value(spark, X.statement(F.col("h")), h=new) == "Rates stay."
    assert value(spark, X.statement(F.col("h")), h=old) == "Information received since March."
    assert value(spark, X.statement(F.col("h")), h="x" * 7000) == "x" * X.UNCLOSED


def test_rate_changes_take_the_last_heading_before_their_table(spark):
    row = lambda *c: "<tr>" + "".join(f"<td>{x}</td>" for x in c) + "</tr>"
    page = (
        "<table>" + row("May 1", 25, 0, "1.00") + "</table><h4> 2008 </h4><b>1999</b> x <h4>2008</h4><table>" + row("Date", "Up", "Down", "Level")
        + row("December 16*", "...", "75-100", "0-0.25") + row("October 29", 0) + "</table>" + "y" * 3100 + "<table>" + row("May 2", 25, 0, "1.00") + "</table>"
    )
    got = value(spark, X.rate_changes(F.col("h")), h=page)
    assert [tuple(x) for x in got] == [(dt.date(2008, 12, 16), -75, 0.25)]


def test_masks(spark):
    t = "On 2024-03-05 and 5/4/99 Vice Chair Clarida, in Sept. x and May 2020 (Q2 2020, the 1990s), saw COVID-19, 9/11 and Fiscal Cliff; Kingston did not. June"
    # a short month name is one only where a word follows its stop at once, as its pattern asks; 9/11 is no date
    assert value(spark, X.mask(F.col("t")), t=t) == "On [DATE] and [DATE] [PERSON] [PERSON], in Sept. x and [MONTH] [YEAR] ([PERIOD], the [YEAR]), saw [EVENT], [EVENT] and [EVENT]; Kingston did not. [MONTH]"


def test_excerpts_and_long_texts(spark):
    cut = lambda kind, t: value(spark, X.excerpt(F.col("k"), F.col("t")), k=kind, t=t)
    long = "w" * 9000
    assert [len(cut(k, long)) for k in ("fomc_minutes", "beige_book", "macro_release", "fomc_statement", "landmark", "speech")] == [4000, 3500, 2800, 3800, 3500, 4500]
    minutes = cut("fomc_minutes", "# source: a\nIntro " + X.SECTIONS[1][0] + " a" * 2000 + " Committee Policy Action was taken " + "b" * 3000)
    first, second = minutes.split(X.GAP)
    assert len(first) == 2600 and first.startswith("Participants'") and len(second) == 1800 and second.startswith("Committee Policy Action was taken")
    assert cut("fomc_statement", "We act.  See https://x.y/z now.\n\n\n" + X.VOTES + " A") == "We act. See now.\n"
    whole, over = "a" * 24000 + "b" * 6000, "a" * 24000 + "c" + "b" * 6000
    assert value(spark, X.head_and_tail(F.col("t")), t=whole) == whole and value(spark, X.head_and_tail(F.col("t")), t=over) == "a" * 24000 + "…" + "b" * 6000


def test_first_json_object(spark):
    first = lambda t: value(spark, X.first_object(F.col("t")), t=t)
    assert first('a {b} ```json\n{"x": [1, 2,], "y": "} \\" {",}\n``` {"z": 1}') == '{"x":[1,2],"y":"} \\" {"}'
    assert first('{"open": {"in": 1} and more') == '{"in":1}' and first("none") is None and first(None) is None and first("{") is None


def test_packets_cut_the_document_that_crosses_the_budget(spark):
    rows = [("u", k, "d", dt.date(2020, 1, k), str(k) * n) for k, n in ((1, 50), (2, 500), (3, 100), (4, 30), (5, 0))] + [("v", 1, "d", dt.date(2020, 1, 1), "v")]
    docs = spark.createDataFrame(rows, "unit string, id int, doc_type string, timestamp date, text string")
    taken = C.within_budget(docs, "unit", [F.desc("timestamp")], per_doc=100, budget=200)
    got = {(r.unit, r.id): r.body for r in taken.collect()}
    assert got == {("u", 4): "4" * 30, ("u", 3): "3" * 100, ("u", 2): "2" * 70, ("v", 1): "v"}
    packet = {r.unit: (r.n_docs, r.packet) for r in C.packets(taken, F.lit("2020-01-10").cast("date"), True).collect()}
    assert packet["v"] == (1, "doc_type: d\ndate: T-9 calendar days\n\nv") and packet["u"][0] == 3


def test_statements_by_index_or_by_name(spark):
    files = spark.createDataFrame([("a", "x.txt", "one\n two"), ("a", "fomc_statement_20200101.txt", "no"), ("b", "fomc_statement-2020-02-03.txt", "b"), ("b", "fomc_statement.txt", "undated"), ("c", "note.txt", "c")], "unit string, file string, text string")
    index = spark.createDataFrame([("a", "x.txt", "fomc_statement", "2020-05-06T00:00"), ("c", "note.txt", "note", "2020-01-01")], "unit string, file string, doc_type string, timestamp string")
    got = sorted(tuple(r) for r in C.statements(files, index).collect())
    assert got == [("a", dt.date(2020, 5, 6), "x.txt", "one two"), ("b", dt.date(2020, 2, 3), "fomc_statement-2020-02-03.txt", "b")]


def test_facts_are_reduced_in_order_and_cut(spark):
    facts = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x" * 30), ("a", 3, None), ("b", 1, None)], "unit string, d int, fact string")
    assert [tuple(r) for r in C.reduced(facts, ["unit"], ["d"], "fact", 33).collect()] == [("a", 2, "[" + "x" * 30 + ", ")]


def test_balances_count_each_list(spark):
    df = spark.createDataFrame([("Up up down",), ("",), (None,)], "text string")
    assert [r.tone for r in X.balances(df, "text", tone=(["up"], ["down"])).collect()] == [0.25, 0.0, None]
