"""Row-level functions and metrics on hand-made edges."""

import json
import math
import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridex.functions import SQL_FUNCTIONS, answers, fuzzy, pages, register, retrieval, text
from veridex.operators import curation, metrics
from veridex.plans.binding import features
from veridex.sources import connectors, json_files, sinks
from veridex.streaming.metrics import calibration_error, windowed


def value(spark, sql, **columns):
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} string" for k in columns)) if columns else spark.range(1)
    return df.select(F.expr(sql)).first()[0]


@pytest.mark.parametrize(("x", "n"), [("American cannot", 2), ("uncertain", 2), ("from what I can tell", 1), ("Maybe; it is likely", 3), (None, 0), ("", 0)])
def test_hedges(spark, x, n):
    assert value(spark, text.term_count("x", text.HEDGE_TERMS), x=x) == n


@pytest.mark.parametrize(("x", "yes"), [("i DON'T know?", True), ("I don’t know", False), (None, False), ("", False)])
def test_refusals(spark, x, yes):
    assert value(spark, text.is_refusal("x"), x=x) is yes


def test_overlaps(spark):
    assert value(spark, text.token_overlap("a", "b"), a="red green blue", b="red green") == pytest.approx(0.8)
    assert value(spark, text.token_overlap("a", "b"), a="the of", b="red") == 0
    assert value(spark, text.ngram_overlap("a", "b"), a="one two", b="one two") == 0
    assert value(spark, text.ngram_overlap("a", "b"), a="one two three", b="zero one two three") == 1
    with pytest.raises(ValueError, match="overlap"):
        text.answer_source_overlap("a", "b", "exact")


def test_soft_accuracy(spark):
    for a, b, want in [("X ", "x", 1.0), ("the x", "x", 0.8), ("a b c", "b d", 1 / 3), ("", "x", 0.0), (None, "x", 0.0)]:
        assert value(spark, text.soft_accuracy("a", "b"), a=a, b=b) == pytest.approx(want)


def chunked(sentences):
    done, cur, n = [], [], 0
    for s in sentences:
        k = len(s.split())
        if n + k > 500:
            done += [" ".join(cur)] * bool(cur)
            cur, n = [s], k
        else:
            cur, n = [*cur, s], n + k
            if n >= 300:
                done, cur, n = [*done, " ".join(cur)], [], 0
    return done + [" ".join(cur)] * bool(cur)


@pytest.mark.parametrize("sizes", [[499], [500], [501], [250, 251], [299, 1, 5], [600, 10, 290, 1], [], [100] * 13])
def test_chunks(spark, sizes):
    s = [" ".join([f"w{i}"] * n) for i, n in enumerate(sizes)]
    got = spark.createDataFrame([(s,)], "s array<string>").select(F.expr(text.chunks("s"))).first()[0]
    assert got == chunked(s)


@pytest.mark.parametrize(("response", "want"), [("Confidence: 85", 0.85), ("confidence = .4", 0.4), ("0.7 confidence", 0.7), ("none", None), ("Confidence: 0", 0.0), ("confidence level of 1", 1.0)])
def test_confidence(spark, response, want):
    got = value(spark, answers.stated_confidence("r"), r=response)
    assert got == want if want is None else got == pytest.approx(want)


def test_document_ids(spark):
    for u, want in [("http://A.b/c/?q#f", "A.b/c"), ("http://a.b", "a.b"), (" Doc 1 ", "doc 1"), ("http://a.b:80/x//", "a.b:80/x")]:
        assert value(spark, retrieval.document_id("u"), u=u) == want


def test_duplicate_documents(spark):
    d = spark.createDataFrame([(["http://a/x", "http://a/x/"], ["http://a/x"])], "r array<string>, g array<string>")
    docs = lambda c: F.expr(f"transform({c}, u -> named_struct('url', u, 'domain', '', 'category', 'reliable'))")
    d = d.select(docs("r").alias("r"), docs("g").alias("g"))
    assert tuple(d.select(F.expr(retrieval.recall("r", "g")), F.expr(retrieval.precision("r", "g")), F.expr(retrieval.diversity("r"))).first()) == (1.0, 1.0, 0.5)


def rows(spark, data):
    return spark.createDataFrame(data, "model string, confidence double, accuracy double")


def test_ece_edges(spark):
    c = [0.0, 0.1, 0.3, 0.6, 0.7, 0.95, 1.0]
    edges = [i * 0.1 for i in range(11)]
    want = 0.0
    for lo, hi in zip(edges, edges[1:], strict=False):
        inside = [x for x in c if lo <= x < hi]
        want += abs(sum(inside) / len(inside) - 0.5) * len(inside) / len(c) if inside else 0
    got = metrics.ece(rows(spark, [("m", x, 0.5) for x in c]), ["model"]).first()["ece"]
    assert got == pytest.approx(want)


def test_degenerate_groups(spark):
    d = rows(spark, [("one", 0.5, 1.0), ("flat", 0.5, 0.1), ("flat", 0.5, 0.9), ("nan", math.nan, 0.1), ("nan", 0.2, None)])
    assert {r["model"]: r["correlation"] for r in metrics.correlation(d, ["model"]).collect()} == {"one": 0.0, "flat": 0.0}
    assert {r["model"]: r["ece"] for r in metrics.ece(d, ["model"]).collect()}["one"] == 0.0
    assert metrics.ece(d.limit(0), ["model"]).count() == 0


def test_p_value():
    assert metrics.pearson_p(0.5, 10) == pytest.approx(0.1411, abs=1e-4)
    assert metrics.pearson_p(0.0, 10) == pytest.approx(1.0)
    assert metrics.pearson_p(-0.8, 20) == pytest.approx(metrics.pearson_p(0.8, 20))


def pooled(points):
    """The isotonic fit by the min-max formula: of each point, the greatest over its left of the least mean to the right."""
    xs = sorted({x for x, _ in points})
    sums = [(sum(a for y, a in points if y == x), sum(y == x for y, _ in points)) for x in xs]
    mean = lambda i, j: sum(s for s, _ in sums[i : j + 1]) / sum(n for _, n in sums[i : j + 1])
    return {x: max(min(mean(i, j) for j in range(k, len(xs))) for i in range(k + 1)) for k, x in enumerate(xs)}


def test_isotonic(spark):
    rng = random.Random(1)
    points = {m: [(rng.randrange(40) / 40, float(rng.random() < 0.5 + 0.01 * i)) for i in range(120)] for m in "ab"}
    d = rows(spark, [(m, x, a) for m, v in points.items() for x, a in v] + [("c", 0.4, 1.0), ("d", math.nan, 1.0)])
    got = metrics.isotonic(d, ["model"]).collect()
    for m, v in points.items():
        fit = pooled(v)
        want = {}
        for x, a in v:
            n, s = want.get(round(fit[x], 9), (0, 0.0))
            want[round(fit[x], 9)] = (n + 1, s + a)
        assert {round(r["fitted"], 9): (r["n"], r["a"]) for r in got if r["model"] == m} == want
    e = {r["model"]: r for r in metrics.isotonic_ece(d, ["model"]).collect()}
    assert set(e) == {"a", "b", "c"} and all(r["calibrated_ece"] <= r["ece"] and r["improvement"] == pytest.approx(r["ece"] - r["calibrated_ece"]) for r in e.values())


@pytest.mark.parametrize("few", [metrics.FEW_VALUES, 0])
def test_percentiles(spark, monkeypatch, few):
    monkeypatch.setattr(metrics, "FEW_VALUES", few)
    rng = random.Random(2)
    data = {"many": [rng.gauss(0, 1) ** 3 for _ in range(3001)], "few": [0.5] * 50 + [0.25] * 3, "one": [7.0], "two": [1.0, 2.0]}
    d = spark.createDataFrame([(g, x) for g, v in data.items() for x in v] + [("few", None), ("nan", math.nan)], "g string, x double")
    shares = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p75": 0.75, "p100": 1.0}
    got = {r["g"]: r for r in metrics.percentiles(d, ["g"], "x", shares).collect()}
    assert set(got) == set(data)
    for g, v in data.items():
        for name, p in shares.items():
            assert got[g][name] == pytest.approx(np.percentile(v, 100 * p)), (g, name)


def test_f1_from_published_counts(spark):
    """tp 14, fp 570, fn 5 give an F1 of 28/603."""
    data = [(True, 0.0)] * 14 + [(True, 1.0)] * 570 + [(False, 0.0)] * 5
    d = spark.createDataFrame([("m", i, "clear", 0.5, a, 0.0, int(h), 10, 0, False, False, 0.2) for i, (h, a) in enumerate(data)], "model string, entry_id int, set_type string, confidence double, accuracy double, recall double, hedges int, words int, confident_terms int, is_refusal boolean, refuses boolean, difficulty double")
    assert metrics.hedging(d, ["model"]).first()["hedge_f1"] == pytest.approx(28 / 603)


def test_fuzzy():
    assert fuzzy.token_set_ratio("a b c", "c b a") == 100 and fuzzy.token_set_ratio("", "a") == 0
    assert fuzzy.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100
    assert fuzzy._common("abcbdab", "bdcaba") == 4
    assert fuzzy.sequence_ratio("abcd", "bcde") == SequenceMatcher(None, "abcd", "bcde").ratio()


def test_sql_functions(spark):
    register(spark)
    assert spark.sql("SELECT normalize_text('A, b!  C') AS x, hedge_count('maybe') AS n").first()[:] == ("a b c", 2)
    r = spark.sql("SELECT keywords('What of the Vitamin?') AS k, parsed_response('Yes.\nAs said').explanation AS e, truth('llama', null, '') AS t, attribution('One claim is here.', array('one claim here is it')).coverage AS c").first()
    assert r[:] == (["vitamin"], "As said", 0.5, 1.0)
    for name in SQL_FUNCTIONS:
        assert spark.catalog.functionExists(name), name


def test_domains(spark):
    trust = spark.createDataFrame([("good.org", "reliable"), ("bad.com", "misleading")], "domain string, trust string")
    hosts = ["good.org", "a.good.org", "notgood.org", "x.edu.au", "www.bad.com", "", "WWW.GOOD.ORG"]
    d = spark.createDataFrame([(h,) for h in hosts], "domain string")
    got = {r["domain"]: r["trust"] for r in curation.classify_domains(d, trust).collect()}
    assert [got[h] == "reliable" for h in hosts] == [True, True, False, True, False, False, True]


def test_page_text():
    title, body = connectors.page_text("<html><title>A long title</title><script>x()</script><nav>menu</nav><p>One <b>two</b></p><br>three")
    assert title == "A long title" and body == "One two three"
    assert connectors.page_text(None) == ("No Title Found", "")


def test_connectors(spark):
    d = spark.createDataFrame([(1, "q"), (2, "fail")], "id long, prompt string")
    ok = connectors.call(d.where("id = 1"), lambda b: [{"response": p.upper(), "success": True} for p in b["prompt"]]).first()
    assert ok["response"] == "Q" and ok["success"]

    def broken(batch):
        raise OSError("no network")

    assert connectors.call(d.where("id = 2"), broken).first()["error"] == "no network"
    r = spark.createDataFrame([(1, "yes", True)], "id long, response string, success boolean")
    assert {x["id"]: x["success"] for x in connectors.replay(d, r, ["id"]).collect()} == {1: True, 2: False}


def test_json_and_sinks(spark, tmp_path):
    src = {"url": "u", "domain": "d", "category": "reliable", "title": "t", "text": "x", "timestamp": "", "score": "N/A"}
    e = [{"id": "a_000", "topic": "a", "question": "q", "gold_answer": "g", "source_sets": {"clear": [src, {**src, "score": 0.5}], "ambiguous": []}}]
    (tmp_path / "e.json").write_text(json.dumps(e))
    d = json_files.read_entries(spark, str(tmp_path / "e.json"))
    assert [s["score"] for s in d.first()["source_sets"]["clear"]] == [None, 0.5] and d.first()["ambiguity_type"] == "conflicting"
    assert json_files.both_sets(d).count() == 2
    (tmp_path / "t.json").write_text(json.dumps({"a": {"reliable": ["x"], "misleading": []}, "b": {"reliable": ["x"]}}))
    lists = json_files.read_trust_lists(spark, str(tmp_path / "t.json"))
    assert curation.trust_lists(lists).count() == 1
    (tmp_path / "h.json").write_text(json.dumps({"a": ["1", "2", "3"], "b": [str(i) for i in range(8)]}))
    last = {r["topic"]: r["queries"] for r in json_files.last_queries(json_files.read_histories(spark, str(tmp_path / "h.json"))).collect()}
    assert last == {"a": ["1", "2", "3"], "b": ["3", "4", "5", "6", "7"]}
    m = spark.createDataFrame([("a/b", 0.12345, True)], "model string, x double, ok boolean")
    sinks.write_per_model(m, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first()["x"] == 0.123
    assert sinks.comparison(m).first()["models_evaluated"] == ["a/b"]
    sinks.append_new(m.select(F.col("model").alias("id")), None, str(tmp_path / "log"))
    sinks.append_new(m.select(F.col("model").alias("id")), spark.read.parquet(str(tmp_path / "log")), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 1


def test_streaming(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "m", "clear", 0.2, 0.0, False), ("2024-01-01 00:20:00", "m", "clear", 0.8, 1.0, True), ("2024-01-01 05:00:00", "m", "clear", 0.5, 0.5, False)]
    schema = "ts string, model string, set_type string, confidence double, accuracy double, is_refusal boolean"
    spark.createDataFrame(rows, schema).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema("ts timestamp, " + schema[11:]).parquet(f"{tmp_path}/in")
    q = calibration_error(windowed(s)).writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("windows").where("n = 2").first()
    assert got["ece"] == pytest.approx(0.2) and got["brier"] == pytest.approx(0.04) and got["refusal_rate"] == 0.5


def test_features_of_nothing(spark):
    doc = "array<struct<url: string, domain: string, category: string>>"
    d = spark.createDataFrame([], f"model string, entry_id long, set_type string, confidence double, accuracy double, retrieved_docs {doc}, relevant_docs {doc}, prediction_text string, prediction_explanation string")
    assert metrics.all_metrics(features(d), ["model"]).count() == 0
    one = spark.createDataFrame([("m", 1, "clear", 0.5, 0.5, [], None, None, None)], d.schema)
    got = metrics.all_metrics(features(one), ["model"]).first()
    assert got["avg_recall"] == 1.0 and got["ece"] == 0.0


def test_categories(spark):
    sql = pages.category("h", "lower(c)", "0.5D", ["good.org"], ["bad.com"], {"reliable": ["peer review", "journal of"], "unreliable": ["miracle cure"]}, [])
    d = spark.createDataFrame([("good.org", "x"), ("bad.com", "x"), ("z.net", "Peer Review"), ("z.net", "miracle cure"), ("z.net", "")], "h string, c string")
    assert [r[0] for r in d.select(F.expr(sql)).collect()] == ["reliable", "unreliable", "reliable", "unreliable", "unreliable"]
