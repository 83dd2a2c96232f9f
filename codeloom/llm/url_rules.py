"""Judge URLs by host and path rules with a sort-merge range join.

Hosts become keys with their labels reversed, so that a rule's host and all its subdomains are one interval
of keys and intervals of nested hosts nest. Rules and URLs are sorted together; a sweep keeps the rules of
the intervals it is inside on a stack.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.session import as_table

from .common import ascii_lower, batches

_END = "\x00"  # closes each label of a key: below every other character
CARRIED, RULE, URL = -1, 0, 1
_OUT = pa.schema([("id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()),
                  ("verdict", pa.string())])


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) after the first :// and the path after it; both empty without one."""
    rest = F.substr(url, F.locate("://", url) + 3)
    has = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(has, ascii_lower(host)).otherwise(""), F.when(has, path).otherwise("")


def host_key(host: Column) -> Column:
    """Labels from the top level down, each closed; the key of a host is a prefix of its subdomains' keys."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), _END), F.lit(_END))


def rules_from(spark: SparkSession, lines: list[str]) -> DataFrame:
    """Rules written as `allow host/path` or `block host/path`."""
    parts = [(line.split()[0], *line.split()[1].partition("/")) for line in lines]
    return spark.createDataFrame([(h, s + p, v) for v, h, s, p in parts], "host string, path string, verdict string")


class Stack:
    """The rules of all hosts whose interval the sweep is inside, outermost first."""

    def __init__(self) -> None:
        self.open: list[tuple[str, int, dict[int, dict[str, tuple[str, str]]]]] = []

    def move_to(self, key: str) -> None:
        while self.open and not key.startswith(self.open[-1][0]):
            self.open.pop()

    def add(self, key: str, host: str, path: str, verdict: str) -> None:
        self.move_to(key)
        if not self.open or self.open[-1][0] != key:
            self.open.append((key, len(host), {}))
        of_length = self.open[-1][2].setdefault(len(path), {})
        of_length[path] = max(of_length.get(path, ("", "")), (verdict, host + path))

    def find(self, key: str, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the longest rule that fits; of equally long ones that of the longer host."""
        self.move_to(key)
        best, longest = None, -1
        for _, wide, by_length in reversed(self.open):
            for n in sorted(by_length, reverse=True):
                if n > len(path):
                    continue
                if wide + n <= longest:
                    break
                hit = by_length[n].get(path[:n])
                of = hit and hit[1][:wide]
                if hit and (host == of or host.endswith("." + of)):
                    best, longest = hit, wide + n
                    break
        return best


def _sweep(otherwise: str):
    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            part, stack = None, Stack()
            for batch in incoming:
                for pid, key, kind, path, rid, host, verdict in zip(*(c.to_pylist() for c in batch.columns),
                                                                    strict=True):
                    if pid != part:
                        part, stack = pid, Stack()
                    if kind != URL:
                        stack.add(key, host, path, verdict)
                        continue
                    hit = stack.find(key, host, path)
                    yield (rid, host, path, hit and hit[1], hit[0] if hit else otherwise)
        yield from batches(_OUT, rows())
    return run


def judge_urls(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url",
               otherwise: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict: one row per input row.

    rules: host, path, verdict (allow or block). A rule fits its host and all subdomains if the path starts
    with the rule's; the longest rule wins, of equally long ones that with the longer host, and block wins
    over allow for one and the same rule. URLs that no rule fits get `otherwise` and a null rule; so do null
    URLs and those without ://, whose host and path are empty. Rules with a null part are not used. Repeated
    rows are judged each; a null page_id is carried along. Other columns are not read.

    Rows are dealt out by ranges of (key, path, page_id), so a host with a third of all pages fills as many
    tasks as it needs. What a task must know of rules that begin before its first key are the rules of that
    key's own ancestors: they are looked up by key, once per task, and sent ahead.
    """
    host, path = host_and_path(pages[f"`{url}`"])
    urls = (pages.select(pages[f"`{page_id}`"].cast("long").alias("rid"), host.alias("host"), path.alias("path"))
            .select(host_key(F.col("host")).alias("key"), F.lit(URL).alias("kind"), "path", "rid", "host",
                    F.lit(None).cast("string").alias("verdict")))
    known = (rules.select(ascii_lower(F.col("host")).alias("host"), "path", "verdict").dropna().where("host <> ''")
             .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
             .select(host_key(F.col("host")).alias("key"), F.lit(RULE).alias("kind"), "path",
                     F.lit(None).cast("long").alias("rid"), "host", "verdict"))
    order = ["key", "kind", "path", "rid"]
    dealt = as_table(urls.union(known).repartitionByRange(*order).withColumn("pid", F.spark_partition_id()))

    first = dealt.groupBy("pid").agg(F.min("key").alias("first"))
    labels = F.slice(F.split("first", _END, -1), F.lit(1), F.size(F.split("first", _END, -1)) - 1)
    ancestors = first.select("pid", F.explode(F.transform(labels, lambda _, i: F.concat(
        F.array_join(F.slice(labels, F.lit(1), i + 1), _END), F.lit(_END)))).alias("key"))
    carried = ancestors.join(known, "key").withColumn("kind", F.lit(CARRIED))
    columns = ["pid", "key", "kind", "path", "rid", "host", "verdict"]
    swept = (dealt.select(columns).union(carried.select(columns)).repartition("pid")
             .sortWithinPartitions("pid", *order)
             .mapInArrow(_sweep(otherwise), "id bigint, host string, path string, rule string, verdict string"))
    return swept.withColumnRenamed("id", page_id)
