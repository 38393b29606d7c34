"""Units on disk, walks, the model client and the stream."""

import datetime
import json

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from tidecast.operators import walks as W
from tidecast.sources import files
from tidecast.sources import sinks as K
from tidecast.sources import units as U
from tidecast.sources.files import Refused
from tidecast.streaming import events as E

CARD = '[task]\nid = "{}"\n[targets]\nasset_ids = ["a", "b"]\nhorizons = [1, 3]\n[provenance]\ndata_cutoff = "2024-05-01"\n'


def test_cards(spark, tmp_path):
    for k in ("u1", "u2"):
        (tmp_path / k).mkdir()
        (tmp_path / k / "card.toml").write_text(CARD.format(k))
    rows = U.scan_cards(spark, str(tmp_path)).orderBy("unit_id").collect()
    assert [r.unit_id for r in rows] == ["u1", "u2"] and rows[0].asof == datetime.date(2024, 5, 1) and rows[0].joint == "variogram"
    (tmp_path / "u2" / "card.toml").write_text(CARD.format("u2").replace("[1, 3]", "[1, 1]"))
    with pytest.raises(Refused):
        U.scan_cards(spark, str(tmp_path))


def test_corpus(spark, tmp_path):
    (tmp_path / "text").mkdir()
    (tmp_path / "text" / "a.txt").write_text("one\ntwo")
    index = {"documents": [{"doc_id": "1", "timestamp": "2024-01-02T03:04:05Z", "doc_type": "speech", "file": "a.txt"}, {"doc_id": "2", "timestamp": "2024-01-03", "file": "missing.txt"}]}
    (tmp_path / "text" / "corpus_index.json").write_text(json.dumps(index))
    rows = U.scan_corpus(spark, str(tmp_path / "text" / "corpus_index.json")).collect()
    assert [(r.doc_id, str(r.timestamp), r.text) for r in rows] == [("1", "2024-01-02", "one\ntwo")]


def test_scales_and_evidence(spark, tmp_path):
    for k in ("u1", "u2"):
        (tmp_path / k).mkdir()
        (tmp_path / k / "ref_scale.json").write_text(json.dumps({"marginal": 1.5, "tail": 0.5}))
    pattern, roster = str(tmp_path / "*" / "ref_scale.json"), spark.createDataFrame([("u1",), ("u2",)], "handle string")
    with pytest.raises(Refused) as e:
        U.verified_scales(spark, pattern, roster, "?")
    expected = str(e.value).split()[-1]
    assert U.verified_scales(spark, pattern, roster, expected).count() == 2
    with pytest.raises(Refused):
        U.verified_scales(spark, pattern, roster.limit(1), expected)
    (tmp_path / "u2" / "ref_scale.json").write_text(json.dumps({"marginal": -1, "tail": 0.5}))
    with pytest.raises(Refused):
        U.verified_scales(spark, pattern, roster, expected)


def test_evidence_is_staged_scored_twice_and_compared(spark, tmp_path):
    for k in ("u1", "u2"):
        (tmp_path / k).mkdir()
        (tmp_path / k / "ref_scale.json").write_text(json.dumps({"marginal": 1.5, "unit": k}))
    pattern, score = str(tmp_path / "*" / "ref_scale.json"), lambda p: spark.read.json(p).select("unit", "marginal")
    rows, found = U.with_evidence(spark, pattern, str(tmp_path / "a" / "stage"), score)
    assert found.sound and found.files == 2 and not found.rankable and {r.unit for r in rows.collect()} == {"u1", "u2"}
    copies = list((tmp_path / "a" / "stage").glob("*/ref_scale.json"))
    assert len(copies) == 2 and all(c.stat().st_mode & 0o222 == 0 for c in copies)

    def meddle(p):
        (tmp_path / "u2" / "ref_scale.json").write_text("{}")
        return score(p)

    _, found = U.with_evidence(spark, pattern, str(tmp_path / "b" / "stage"), meddle)
    assert found.source_changed == 2 and not found.copies_changed and not found.sound
    runs = []
    _, found = U.with_evidence(spark, pattern, str(tmp_path / "c" / "stage"), lambda p: runs.append(p) or spark.range(len(runs)))
    assert found.rows_differ == 1 and not found.sound


def test_forecasts_are_written_with_sidecar_and_rationale(spark, tmp_path):
    draws = spark.createDataFrame([(u, i, a, 5, float(i), "engine") for u in ("u", "v") for i in range(5) for a in ("x", "y")], "unit_id string, draw int, asset string, horizon int, value double, method string")
    cards = spark.createDataFrame([("u", datetime.date(2020, 1, 1), "level"), ("v", datetime.date(2020, 1, 2), "level")], "unit_id string, as_of date, target string")
    notes = spark.createDataFrame([("v", "A release moved the anchor.")], "unit_id string, note string")
    K.write_forecasts(draws, cards, str(tmp_path / "out"), notes)
    assert spark.read.parquet(str(tmp_path / "out" / "draws")).groupBy("unit_id").count().collect()[0]["count"] == 10
    meta = json.loads(next((tmp_path / "out" / "meta" / "unit_id=u").glob("*.txt")).read_text())
    assert meta == {"unit_id": "u", "asof": "2020-01-01", "representation": "samples", "asset_ids": ["x", "y"], "horizons": [5], "n_draws": 5, "target": "level", "rationale": {"file": "forecast_rationale.md"}}
    text = next((tmp_path / "out" / "rationale" / "unit_id=v").glob("*.txt")).read_text()
    assert "| x | 5 | 0.200000 | 2.00000 | 3.80000 |" in text and "A release moved the anchor." in text and "Method: engine." in text
    assert (tmp_path / "out" / "draws").stat().st_mode & 0o777 == 0o755 and next((tmp_path / "out" / "draws").rglob("*.parquet")).stat().st_mode & 0o777 == 0o644
    with pytest.raises(Exception):
        K.write_forecasts(draws, cards, str(tmp_path / "out"))


def test_dumps_and_caches(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2]), (2, None)], "k int, v array<int>")
    K.write_dumps(df, str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d" / "parquet")).count() == 2 and spark.read.json(str(tmp_path / "d" / "json")).filter("size(v) = 2").count() == 1
    assert {r.v for r in spark.read.option("header", True).csv(str(tmp_path / "d" / "csv")).collect()} == {"[1,2]", None}
    built = []
    for _ in range(2):
        assert K.cached(spark, str(tmp_path / "c"), lambda: built.append(1) or df).count() == 2
    assert len(built) == 1


def test_footers(spark, tmp_path):
    spark.range(1000).withColumn("b", F.lit("x")).coalesce(1).write.parquet(str(tmp_path / "p"))
    facts = files.inspect_parquet(spark, str(tmp_path / "p")).first()
    assert (facts.n_rows, facts.n_columns, facts.row_groups, facts.fault) == (1000, 2, 1, None) and facts.uncompressed > 0
    assert [files.inspect_parquet(spark, str(tmp_path / "p"), **m).first().fault for m in ({"max_rows": 9}, {"max_columns": 1}, {"max_row_groups": 0}, {"max_bytes": 9})] == ["rows", "columns", "row_groups", "bytes"]


def test_results(spark, tmp_path):
    (tmp_path / "r.csv").write_text("k,v\na,1.5\n")
    assert U.scan_results(spark, str(tmp_path / "r.csv"), "csv", "k string, v double").first().v == 1.5
    (tmp_path / "bad.json").write_text('{"k": 1,\n')
    with pytest.raises(Exception):
        U.scan_results(spark, str(tmp_path / "bad.json"), "json", "k string").collect()


def test_walks(spark):
    rng = np.random.default_rng(1)
    h = 100 + np.cumsum(rng.normal(size=(300, 2)), axis=0)
    x = W.walk(h, [1, 4], 4000, "u")
    assert np.allclose(x.mean(axis=0), h[-1][:, None], atol=0.2) and np.allclose(x[:, :, 1].std(axis=0) / x[:, :, 0].std(axis=0), 2, atol=0.15)
    m = W.monthly_walk(h, np.array([[1, 2], [2, 3]]), 500, "u")
    assert m.shape == (500, 2, 2) and np.array_equal(m, W.monthly_walk(h, np.array([[1, 2], [2, 3]]), 500, "u"))
    assert W.blended_walk(h, [1, 4], 100, "u").shape == (100, 2, 2)
    rows = pd.DataFrame([("u", f"a{c}", pd.Timestamp("2020-01-01") + pd.Timedelta(days=i), float(h[i, c]), [1, 4]) for i in range(300) for c in range(2)], columns=["unit_id", "asset", "date", "value", "horizons"])
    got = W.forecast(spark.createDataFrame(rows), W.walk, 50)
    assert got.count() == 200 and {r.method for r in got.select("method").distinct().collect()} == {"walk"}


def test_garch_finds_persistence():
    rng = np.random.default_rng(2)
    x, v = [], 1.0
    for _ in range(3000):
        x.append(rng.normal() * np.sqrt(v))
        v = 0.05 + 0.1 * x[-1] ** 2 + 0.85 * v
    _, alpha, beta = W.garch(np.array(x))
    assert 0.03 < alpha < 0.2 and 0.75 < beta < 0.96


def test_client_stops_after_failures(spark):
    def connect():
        def client(text):
            if text == "bad":
                raise OSError
            return text.upper()

        return client

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "bad", "b", "bad", "bad", "bad", "c"])], "i int, t string").coalesce(1)
    assert [r.answer for r in W.with_client(rows, "t", connect).orderBy("i").collect()] == ["A", None, "B", None, None, None, None]


def test_stream_gives_the_closed_windows_of_the_batch(spark, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    table = spark.read.parquet(path)
    (tmp_path / "in").mkdir()
    table.repartition(2).write.mode("overwrite").parquet(str(tmp_path / "in"))
    E.run_once(E.windowed(E.read_events(spark, str(tmp_path / "in"), table.schema)), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r.start, r.event_type, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.start, r.event_type, r.n) for r in E.windowed(table.withColumn("ts", table.ts.cast("timestamp"))).collect()}
    assert got and got <= want
