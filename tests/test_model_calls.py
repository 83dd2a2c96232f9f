"""Replies kept in a table: asked once, found again, logged."""

import os

import pytest
from pyspark.sql import functions as F

from codeloom.operators.model_calls import KeptCompleter, Settings, answer_batch, read_calls
from codeloom.operators.reviews import call_stats


def counting(folder, fail=None):
    """A model that leaves a line for every prompt it is asked."""
    def ask(prompts, settings):
        with open(f"{folder}/asked-{os.getpid()}", "a") as f:
            f.writelines(p + "\n" for p in prompts)
        if fail and any(fail in p for p in prompts):
            raise RuntimeError("model gone")
        return [(f"{settings.system}{p.upper()}", 3) for p in prompts]
    return ask


def asked(folder):
    return sorted(ln for n in os.listdir(folder) if n.startswith("asked") for ln in open(f"{folder}/{n}").read().split("\n") if ln)


def test_asks_each_prompt_once_and_nothing_twice(spark, tmp_path):
    prompts = [(i, f"p{i % 7}", "x") for i in range(50)] + [(50, None, "x")]
    df = spark.createDataFrame(prompts, "id long, prompt string, reply string")
    calls = str(tmp_path / "calls")
    one = KeptCompleter(counting(tmp_path), calls, "one", batch=2, round_batches=2)
    got = {r.id: r.reply for r in one.complete(df.where("id < 3"), "describe").collect()}
    assert got == {0: "P0", 1: "P1", 2: "P2"} and asked(tmp_path) == ["p0", "p1", "p2"]
    two = KeptCompleter(counting(tmp_path), calls, "two", batch=2, round_batches=2)
    out = two.complete(df, "describe")
    assert out.columns == ["id", "prompt", "reply"]
    assert {r.id: r.reply for r in out.collect()} == {i: p and p.upper() for i, p, _ in prompts}
    assert asked(tmp_path) == [f"p{i}" for i in range(7)]
    stats = {r.run: (r.calls, r.output_tokens, r.swaps) for r in call_stats(read_calls(spark, calls)).collect()}
    assert stats == {"one": (3, 9, 0), "two": (4, 12, 0)}
    # another task or other settings are other calls
    other = KeptCompleter(counting(tmp_path), calls, "three", Settings("m", system="> "))
    assert other.complete(df.where("id = 1"), "describe").first().reply == "> P1"
    assert two.complete(df.where("id = 1"), "write").first().reply == "P1"
    assert len(asked(tmp_path)) == 9 and two.complete(df.limit(0), "write").count() == 0


def test_run_that_died_pays_for_no_finished_round_twice(spark, tmp_path):
    df = spark.range(40).select("id", F.concat(F.lit("q"), "id").alias("prompt"))
    calls = str(tmp_path / "calls")

    count = counting(tmp_path)

    def dies(prompts, settings):
        if os.path.isdir(calls) and any(n.endswith(".parquet") for n in os.listdir(calls)):
            os._exit(1)  # the worker goes after the first round was written
        return count(prompts, settings)

    with pytest.raises(Exception):  # noqa: B017
        KeptCompleter(dies, calls, "one", batch=4, round_batches=2).complete(df, "t")
    first = asked(tmp_path)
    assert 0 < len(first) < 40 and read_calls(spark, calls).count() == len(first)
    out = KeptCompleter(counting(tmp_path), calls, "two", batch=4, round_batches=2).complete(df, "t")
    assert out.where("reply = upper(prompt)").count() == 40
    assert asked(tmp_path) == sorted(f"q{i}" for i in range(40))


def test_failed_prompts_are_logged_and_asked_again(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("bad",), ("c",)], "prompt string")
    calls = str(tmp_path / "calls")
    out = KeptCompleter(counting(tmp_path, "bad"), calls, "one").complete(df, "t")
    assert {r.prompt: r.reply for r in out.collect()} == {"a": "A", "bad": None, "c": "C"}
    failed = read_calls(spark, calls).where("reply IS NULL").first()
    assert failed.error == "RuntimeError: model gone" and failed.attempts == 4
    out = KeptCompleter(counting(tmp_path), calls, "two").complete(df, "t")
    assert out.where("reply = upper(prompt)").count() == 3
    assert [r.calls for r in call_stats(read_calls(spark, calls)).orderBy("run").collect()] == [3, 1]


def test_replies_of_another_number_are_a_failed_attempt():
    def short(prompts, settings):
        return ["one"] if len(prompts) < 3 else ["one", "two"]

    rows = answer_batch(["a", "b", "c"], short, Settings(), 2)
    assert [(r[0], r[1], r[3], r[4]) for r in rows] == [("one", 2, 1, None)] * 3
    assert answer_batch(["a"], lambda p, s: [], Settings(), 2)[0][4] == "0 replies to 1 prompts"
