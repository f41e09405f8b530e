"""Long chains of links take few rounds, and small tables few tasks, however many partitions a shuffle has."""

import random

from veridex.llm import near_dup
from veridex.scratch import cut


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    vertices = random.Random(3).sample(range(10**6), 300)
    wanted = {v: min(vertices[k - k % 150 : k - k % 150 + 150]) for k, v in enumerate(vertices)}
    links = [(a, b) for k, (a, b) in enumerate(zip(vertices[:-1], vertices[1:], strict=True)) if k != 149]
    rounds, real = [], near_dup.new_path

    def counted(session, tag):
        rounds.append(tag)
        return real(session, tag)

    monkeypatch.setattr(near_dup, "new_path", counted)
    got = near_dup.components(cut(spark.createDataFrame(links, "a long, b long"), "links"))
    assert {r["id"]: r["label"] for r in got.collect()} == wanted
    assert rounds.count("labels") <= 12


def test_small_tables_take_few_tasks(spark):
    empty = spark.range(1000).repartition(64)
    assert near_dup.dense(empty, 1000).rdd.getNumPartitions() == near_dup.LEAST_TASKS
    assert near_dup.dense(empty, 20 << 20).rdd.getNumPartitions() == 64
