import random
import time
import uuid

from strandmill.llm import components as module
from strandmill.llm.components import components


def brute(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root if find(x) != x}


def test_components(spark):
    rng = random.Random(1)
    cases = [[(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 80)], [(rng.randrange(200), rng.randrange(200)) for _ in range(150)], [(5, 5)], []]
    for edges in cases:
        frame = spark.createDataFrame(edges, "u bigint, v bigint")
        assert {r["u"]: r["root"] for r in components(frame).collect()} == brute(edges)


def tasks_of(spark, work):
    """The tasks that ran for work()."""
    context, group = spark.sparkContext, str(uuid.uuid4())
    context.setJobGroup(group, "")
    try:
        work()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    time.sleep(1)  # the tracker hears of the last stage late
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return sum(i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i)


def test_tasks_follow_the_edges_and_not_the_partitions(spark, monkeypatch):
    edges = [(i, i + 1) for i in range(0, 300, 2)] + [(i, i + 4) for i in range(0, 300, 4)]
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        frame, found = spark.createDataFrame(edges, "u bigint, v bigint"), []
        work = lambda: found.append({r["u"]: r["root"] for r in components(frame).collect()})
        assert tasks_of(spark, work) < 64 * 6
        monkeypatch.setattr(module, "TASK_EDGES", 20)
        work()
        assert found == [brute(edges)] * 2
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_edges_to_roots_need_no_round_more(spark, monkeypatch):
    rounds, star = [], module._large_star
    monkeypatch.setattr(module, "_large_star", lambda *a: rounds.append(1) or star(*a))
    edges = [(0, i) for i in range(1, 80)]
    assert {r["u"]: r["root"] for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()} == brute(edges)
    assert len(rounds) == 1
