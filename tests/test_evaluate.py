"""A whole evaluation from files to files."""

import json

import pytest

from veridex import evaluate
from veridex.operators import evaluation
from veridex.sources import json_files


@pytest.fixture
def files(tmp_path):
    src = lambda i, c: {"url": f"http://s{i}.org/x", "domain": f"s{i}.org", "category": c, "title": f"t{i}", "text": f"The river {i} is 120 km long and clean.", "timestamp": "", "score": "N/A"}
    entries, said, judged, grades = [], [], [], []
    for i in range(8):
        e = f"a_{i:03d}"
        entries.append({"id": e, "topic": "a", "question": f"How long is river {i}? " + "x" * 120, "gold_answer": "120 km", "source_sets": {"clear": [src(i, "reliable"), src(i + 1, "reliable")], "ambiguous": [src(i, "reliable"), src(i + 2, "unreliable")]}})
        for k, model in enumerate(("gpt-4o", "Qwen/Qwen2")):
            for s in ("clear", "ambiguous"):
                if i == 7 and s == "ambiguous":
                    continue  # a call that failed
                answer = "I don't know" if i == 3 else "120 km" if (i + k) % 2 else "It is likely 12 km long."
                said.append({"model": model, "id": e, "set_type": s, "response": f"{answer}\nThe river {i} is 120 km long.", "tokens_used": 5})
                judged.append({"model": model, "id": e, "set_type": s, "letter": "A", "log_probs": [{"token": "A", "logprob": -0.1 * (i + 1), "top_logprobs": [{"token": "A", "logprob": -0.1 * (i + 1)}]}]})
                grades.append({"model": model, "id": e, "set_type": s, "grade": str(0.1 * i)})
    (tmp_path / "entries.json").write_text(json.dumps(entries))
    for name, rows in (("responses", said), ("judgements", judged), ("grades", grades)):
        (tmp_path / f"{name}.json").write_text("\n".join(map(json.dumps, rows)))
    return tmp_path


def config(files, *more, env=None):
    return evaluate.Config.of(["--dataset", f"{files}/entries.json", "--responses", f"{files}/responses.json", "--judgements", f"{files}/judgements.json", "--output", f"{files}/out", *more], env or {})


def test_run(spark, files):
    s = {r["model"]: r for r in evaluate.run(spark, config(files)).collect()}
    assert set(s) == {"gpt-4o", "Qwen/Qwen2"}
    r = s["gpt-4o"]
    assert (r["total_entries"], r["successful_evaluations"], r["confidence_method"]) == (8, 7, "p(true)")
    assert r["metrics"]["total_refusals"] == 2 and r["ptrue_diagnostics"]["n"] == 15 and 0 <= r["ptrue_diagnostics"]["p_value"] <= 1
    assert r["metrics"]["tp"] + r["metrics"]["fp"] + r["metrics"]["fn"] + r["metrics"]["tn"] == 13
    assert r["asi_metrics"]["pairs"] == 6 and r["utility_metrics"]["avg_recall"] == pytest.approx((8 * 1 + 7 * 0.5) / 15, abs=5e-4)
    report = spark.read.json(f"{files}/out/reports")
    assert {x["file"] for x in report.select("file").collect()} == {"gpt-4o_report.json", "Qwen_Qwen2_report.json"}
    assert {"h1_overconfidence_gap", "h2_hedging_behavior", "diagnostics"} <= set(report.columns)
    c = spark.read.json(f"{files}/out/model_comparison.json").first()
    assert c["models_evaluated"] == ["Qwen/Qwen2", "gpt-4o"] and c["comparison_metrics"]["gpt-4o"]["success_rate"] == 0.875


def test_grading(spark, files):
    graded = evaluate.results(spark, config(files, "--grades", f"{files}/grades.json", "--models", "gpt-4o")).collect()
    assert {r["model"] for r in graded} == {"gpt-4o"}
    assert all(r["accuracy"] == pytest.approx(0.4 if r["is_refusal"] else 0.1 * int(r["entry_id"][-1])) for r in graded)
    skipped = evaluate.results(spark, config(files, "--grades", f"{files}/grades.json", env={"SKIP_LLM_GRADING": "true"}))
    assert {r["accuracy"] for r in skipped.collect()} == {0.4, None}
    assert {r["pending"] for r in evaluation.pending(skipped).collect()} == {True}


def test_limits_and_rows(spark, files):
    r = evaluate.results(spark, config(files, "--max-entries", "2"))
    assert {x["entry_id"] for x in r.select("entry_id").collect()} == {"a_000", "a_001"}
    listed = evaluation.result_rows(r).first()
    assert listed["question"].endswith("...") and len(listed["question"]) == 103
    assert evaluation.examples(r).count() == 6


def test_config():
    assert evaluate.clients_with_keys({"OPENAI_API_KEY": "x", "MISTRAL_API_KEY": ""}) == ["openai"]
    assert [evaluate.shown(x) for x in (1, 0.12345, None, "x", True)] == ["1.000", "0.123", "N/A", "N/A", "N/A"]
    with pytest.raises(SystemExit):
        evaluate.Config.of([])


def test_prompts_of_a_batch(spark, files):
    entries = json_files.read_entries(spark, f"{files}/entries.json")
    asked = evaluation.requests(json_files.both_sets(entries), ["gpt-4o", "claude-x"])
    assert asked.count() == 32 and {r["client"] for r in asked.select("client").collect()} == {"openai", "anthropic"}
    d = evaluate.results(spark, config(files))
    assert "120 km" in evaluation.grading_requests(d).first()["grading_prompt"]
    assert evaluation.judgement_requests(d).first()["judge_prompt"].startswith("Sources:\n")
