"""Model calls as rows: every reply is kept in a table, and only what no kept reply answers is asked.

The table is the log as well: one row per prompt asked, with the run, the model, the attempts, seconds and tokens.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import as_table

CALLS = ("task string, call string, run string, seq bigint, model string, reply string, attempts int, "
         "seconds double, output_tokens bigint, error string")
_LOGGED = "call string, seq bigint, reply string, attempts int, seconds double, output_tokens bigint, error string"

#: What a model is asked with. A reply is its text, or its text and the number of its tokens.
Ask = Callable[[list[str], "Settings"], list]


@dataclass(frozen=True)
class Settings:
    """Everything besides the prompt that a reply depends on; part of the key under which it is kept."""

    model: str = "function"
    system: str = ""
    schema: str = ""
    temperature: float = 0.0


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """The log; without rows where nothing was asked yet."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], CALLS)
    return spark.read.schema(CALLS).parquet(path)


def kept_replies(calls: DataFrame) -> DataFrame:
    """call, reply: the first reply of every call that has one."""
    return (calls.where("reply IS NOT NULL").groupBy("call")
            .agg(F.min_by("reply", F.struct("seq", "reply")).alias("reply")))


def answer_batch(prompts: list[str], ask: Ask, settings: Settings, attempts: int) -> list[tuple]:
    """(reply, attempts, seconds, tokens, error) of each prompt.

    All go in one call first. If it fails, or answers another number of prompts, each is asked by itself, up to
    attempts times. Tokens that the model does not count are the words of its reply.
    """
    def tried(some: list[str]) -> tuple[list | None, float, str | None]:
        start = time.monotonic()
        try:
            got = list(ask(some, settings))
            error = None if len(got) == len(some) else f"{len(got)} replies to {len(some)} prompts"
        except Exception as e:  # whatever a model client raises is one failed attempt
            got, error = [], f"{type(e).__name__}: {e}"
        return (got if error is None else None), time.monotonic() - start, error

    def row(reply, n: int, seconds: float, error: str | None) -> tuple:
        said, tokens = reply if isinstance(reply, tuple) else (reply, None)
        return said, n, seconds, len((said or "").split()) if tokens is None else tokens, error

    together, seconds, error = tried(prompts)
    share = seconds / max(1, len(prompts))
    if together is not None:
        return [row(r, 1, share, None) for r in together]
    out = []
    for p in prompts:
        alone, spent, n = None, share, 1
        while alone is None and n <= attempts:
            alone, seconds, error = tried([p])
            spent, n = spent + seconds, n + 1
        out.append(row(alone[0] if alone else None, n, spent, None if alone else error))
    return out


class KeptCompleter:
    """A completer over ask(prompts, settings) whose replies are kept in the table at path.

    Equal prompts of a task are asked once. What is missing goes out in rounds of round_batches tasks with one
    batch each: a task that is lost repeats its own batch only, and a run that dies repeats only the round it was
    in, as each round is written before the next begins. A prompt whose attempts all fail has a null reply, is
    logged with the error, and is asked again by the next run. A null prompt has a null reply and is not asked.
    """

    def __init__(self, ask: Ask, path: str, run: str, settings: Settings | None = None,
                 attempts: int = 3, batch: int = 32, round_batches: int = 256):
        self.ask, self.path, self.run, self.settings = ask, path, run, settings or Settings()
        self.attempts, self.batch, self.round_batches = attempts, batch, round_batches

    @property
    def name(self) -> str:
        return self.settings.model

    def _ask_missing(self, missing: DataFrame, task: str) -> None:
        ask, settings, attempts, batch = self.ask, self.settings, self.attempts, self.batch

        def answered(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for at in range(0, len(part), batch):
                    some = part.iloc[at:at + batch]
                    seq = time.time_ns()
                    rows = answer_batch(list(some["prompt"]), ask, settings, attempts)
                    yield pd.DataFrame([(c, seq + k, *r) for k, (c, r) in enumerate(zip(some["call"], rows, strict=True))],
                                       columns=["call", "seq", "reply", "attempts", "seconds", "output_tokens", "error"])

        left = missing.count()
        rounds = -(-left // (self.batch * self.round_batches))
        for turn in range(rounds):
            asked = missing.where(F.pmod(F.xxhash64("call"), F.lit(rounds)) == turn)
            tasks = max(1, -(-left // (rounds * self.batch)))
            (asked.repartition(tasks).mapInPandas(answered, _LOGGED)
             .select(F.lit(task).alias("task"), "call", F.lit(self.run).alias("run"), "seq",
                     F.lit(settings.model).alias("model"), "reply", "attempts", "seconds", "output_tokens", "error")
             .write.mode("append").parquet(self.path))

    def complete(self, df: DataFrame, task: str) -> DataFrame:
        fixed = json.dumps([task, asdict(self.settings)], sort_keys=True)
        rows = as_table(df.withColumn("__call", F.sha2(F.concat(F.lit(fixed + "\n"), "prompt"), 256)))
        spark = df.sparkSession
        wanted = (rows.where("__call IS NOT NULL").groupBy(F.col("__call").alias("call"))
                  .agg(F.first("prompt").alias("prompt")))
        self._ask_missing(as_table(wanted.join(kept_replies(read_calls(spark, self.path)), "call", "left_anti")), task)
        replies = kept_replies(read_calls(spark, self.path)).withColumnRenamed("call", "__call")
        return rows.drop("reply").join(replies, "__call", "left").drop("__call")
