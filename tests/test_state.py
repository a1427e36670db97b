"""Components, spend windows, transitions and file trees against plain loops, with hot keys, nulls, ties and no rows."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.operators import components, routing, transitions, trees

START = datetime(2024, 1, 1)


def slow_components(edges):
    """node -> smallest node of its cycle's component, by reachability."""
    out = defaultdict(set)
    for s, t in edges:
        out[s].add(t)
    reach = {}
    for n in out:
        seen, todo = set(), [n]
        while todo:
            for t in out.get(todo.pop(), ()):
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        reach[n] = seen
    return {n: min(m for m in reach[n] if n in reach.get(m, ())) for n in out if n in reach[n]}


def found(spark, edges):
    df = spark.createDataFrame(edges, "s long, t long")
    return {r.node: r.component for r in components.strong_components(df).collect()}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(430)]
    edges += [(k, k + 1) for k in range(1000, 1300)] + [(1300, 1000)]  # one long cycle
    edges += [(k, 2000) for k in range(2001, 2400)] + [(2000, 2001), (7, 7), (7, 7)]  # a hot node, a loop, a repeat
    expected = slow_components(edges)
    assert found(spark, edges + [(None, 1), (1, None)]) == expected and 1300 in expected
    assert found(spark, []) == {} and found(spark, [(1, 2), (2, 3)]) == {}


def test_components_by_colours_alone(spark, monkeypatch):
    monkeypatch.setattr(components, "FEW", 0)
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(90)] + [(k, k + 1) for k in range(100, 116)] + [(116, 100)]
    assert found(spark, edges) == slow_components(edges)


def test_rounds_hold_no_more_than_the_edges(spark, monkeypatch):
    most, before = [], components.settled
    monkeypatch.setattr(components, "settled", lambda df: (lambda out: most.append(out.count()) or out)(before(df)))
    n = 300
    edges = [(k, (k + 1) % n) for k in range(n)] + [(k, k // 2) for k in range(n)]
    assert set(found(spark, edges).values()) == {0} and max(most) <= len(edges)


def slow_windows(calls):
    """calls (key, ts, id): id -> start of its window."""
    start, out = {}, {}
    for key, ts, i in sorted((c for c in calls if c[1] is not None), key=lambda c: c[1]):
        if key not in start or ts - start[key] > timedelta(hours=1):
            start[key] = ts
        out[i] = start[key]
    return out


def test_windows_begin_with_calls(spark):
    rng = random.Random(3)
    calls, at = [], START
    for i in range(3000):  # one key's calls without a pause, so that starts are chained over days
        at += timedelta(seconds=rng.choice([1, 20, 90, 200, 400]))
        calls.append(("hot", at, i))
    at = START
    for i in range(3000, 3300):
        at += timedelta(seconds=rng.choice([600, 1800, 3600, 3601, 40000]))
        calls.append((rng.choice([None, "b", "c"]), at, i))
    calls += [("d", START, 5000), ("d", START + timedelta(hours=1), 5001), ("d", START + timedelta(hours=1, microseconds=1), 5002), ("d", START, 5003), ("e", None, 5004)]
    got = {r.id: r.window_start for r in routing.spend_windows(spark.createDataFrame(calls, "key string, ts timestamp, id long")).collect()}
    assert got.pop(5004) is None and got == slow_windows(calls)
    assert len({got[i] for i in range(3000)}) > 60
    assert routing.spend_windows(spark.createDataFrame([], "key string, ts timestamp, id long")).count() == 0


def test_a_key_with_a_hundred_thousand_calls(spark):
    rng = np.random.default_rng(1)
    seconds = np.cumsum(rng.integers(0, 120, 100_000))
    calls = spark.createDataFrame([(int(s), i) for i, s in enumerate(seconds)], "s long, id long").select(F.lit("one").alias("key"), F.timestamp_seconds("s").alias("ts"), "id", F.when(F.col("id") % 3 == 0, "critical").otherwise("moderate").alias("complexity"), (F.col("id") % 50 * 1000).alias("tokens"))
    got = routing.route(routing.spend_windows(calls)).select(F.unix_seconds("window_start").alias("w"), "id", "tier", F.round("spent", 6).alias("spent")).toPandas().sort_values("id")
    start, spent, want = None, 0.0, []
    for i, s in enumerate(seconds):
        if start is None or s - start > 3600:
            start, spent = s, 0.0
        want.append((start, "critical" if i % 3 == 0 else "balanced", round(spent, 6)))
        if spent + (1.0 if i % 3 == 0 else 0.1) > 5.0:
            want[-1] = (start, "fast", round(spent, 6))
        a, z = {"critical": (15.0, 75.0), "balanced": (3.0, 15.0), "fast": (0.25, 1.25)}[want[-1][1]]
        n = i % 50 * 1000
        spent += n / 1_000_000 * a + n * 2 / 1_000_000 * z
    assert list(zip(got.w, got.tier, got.spent)) == want and {w[1] for w in want} == {"critical", "balanced", "fast"}


def test_models_fall_back(spark):
    calls = spark.createDataFrame([(1, START, 1, "complex", 1000, START), (1, START, 2, "odd", None, START)], "key long, ts timestamp, id long, complexity string, tokens long, window_start timestamp")
    model = lambda *a: [r.model for r in routing.route(calls, available=a).orderBy("id").collect()]
    assert model("claude-sonnet-4-20250514", "gpt-4o") == ["claude-sonnet-4-20250514", "claude-sonnet-4-20250514"]
    assert model("other", "gpt-4o") == ["other", "gpt-4o"]
    with pytest.raises(ValueError):
        routing.route(calls, available=())


def slow_replay(events, machine):
    start, moves = machine
    state, out = {}, []
    for key, seq, op in sorted((e for e in events if e[1] is not None), key=lambda e: (e[1], e[2])):
        now = state.get(key, start)
        after = moves.get((now, op))
        out.append((key, seq, op, now, after or now, after is not None))
        state[key] = after or now
    return Counter(out)


@pytest.mark.parametrize("machine", [transitions.SLOT, transitions.POSTING, ("off", {("off", "start"): "on", ("on", "fail"): "off"})])
def test_transitions(spark, machine):
    rng = random.Random(5)
    ops = ["assign", "start", "complete", "fail", "post", "claim", "nonsense"]
    events = [(rng.choice([1, 1, 1, 2, 3, None]), k * 3, rng.choice(ops)) for k in range(3000)] + [(1, None, "post")]
    got = transitions.replay(spark.createDataFrame(events, "key long, seq long, op string").repartition(7), machine)
    assert Counter(tuple(r) for r in got.collect()) == slow_replay(events, machine)
    assert {r[0] for r in got.select("valid").distinct().collect()} == {True, False}


def test_a_hot_task_is_in_many_tasks(spark):
    events = spark.range(40_000).select(F.lit(1).alias("key"), F.col("id").alias("seq"), F.element_at(F.array(*map(F.lit, ["assign", "start", "fail", "complete", "start"])), (F.col("id") * 7 % 5 + 1).cast("int")).alias("op"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = transitions.replay(events, transitions.SLOT).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spread) > 1 and max(r["count"] for r in spread) < 30_000
    assert transitions.replay(events.limit(0), transitions.SLOT).count() == 0


def slow_tree(files, max_depth, hidden, ignored):
    """(path, is_dir) -> (n_files, n_dirs, bytes), and the listing in order with its branches."""
    leaves = Counter()
    for path, size in files:
        p = tuple(x for x in (path or "").split("/") if x)
        if p and not (not hidden and any(x.startswith(".") for x in p)) and not set(p[:-1]) & set(ignored):
            leaves[p] += size or 0
    dirs = {p[:k] for p in leaves for k in range(1, len(p))}
    totals = {(d, True): (sum(p[: len(d)] == d and len(p) > len(d) for p in leaves), sum(x[: len(d)] == d and len(x) > len(d) for x in dirs), sum(n for p, n in leaves.items() if p[: len(d)] == d and len(p) > len(d))) for d in dirs}
    totals |= {(p, False): (0, 0, n) for p, n in leaves.items()}
    lines = []

    def walk(at, prefix):
        entries = sorted((e for e in totals if e[0][:-1] == at), key=lambda e: (not e[1], e[0][-1].lower(), e[0][-1]))
        for k, (p, is_dir) in enumerate(entries):
            last = k == len(entries) - 1
            lines.append(("/".join(p), is_dir, prefix + ("└── " if last else "├── "), is_dir and len(p) - 1 == max_depth, *totals[p, is_dir]))
            if is_dir and len(p) - 1 < max_depth:
                walk(p, prefix + ("    " if last else "│   "))

    walk((), "")
    return lines


@pytest.mark.parametrize("max_depth, hidden, ignored", [(1, False, trees.IGNORED), (3, True, trees.IGNORED), (10, False, ())])
def test_trees(spark, max_depth, hidden, ignored):
    rng = random.Random(6)
    names = ["src", "Lib", "lib", ".git", "node_modules", "a.py", "B.py", "é", ".env", "docs"]
    files = [("/".join(rng.choice(names) for _ in range(rng.randrange(1, 6))), rng.randrange(5000)) for _ in range(300)] + [(None, 5), ("", 5), ("//", 1), ("src//a.py", None), ("src", 3), ("src", 4), *((f"big/f{k}", 1) for k in range(200))]
    df = spark.createDataFrame([(p, n, START) for p, n in files], "path string, size long, ts timestamp")
    got = trees.file_tree(df, F.lit(START + timedelta(hours=2)), max_depth, hidden, ignored).collect()
    assert [(r.path, r.is_dir, r.branch, r.more, r.n_files, r.n_dirs, r.bytes) for r in got] == slow_tree(files, max_depth, hidden, ignored)
    assert {r.age for r in got} == {None, "2h ago"} and {r.changed for r in got} == {None, "day"}


def test_tree_labels_and_patterns(spark):
    now = START + timedelta(days=30)
    ages = [timedelta(minutes=5), timedelta(hours=3, minutes=59), timedelta(days=6), timedelta(days=20)]
    files = [(f"d/f{k}", 1024**k * 3 // 2, now - a) for k, a in enumerate(ages)]
    tree = lambda **k: trees.file_tree(spark.createDataFrame(files, "path string, size long, ts timestamp"), F.lit(now), **k).collect()
    assert [(r.name, r["size"], r.age, r.changed) for r in tree()][1:] == [("f0", "1.0B", "5m ago", "hour"), ("f1", "1.5KB", "3h ago", "day"), ("f2", "1.5MB", "6d ago", "older"), ("f3", "1.5GB", "2024-01-11", "older")]
    assert [r.name for r in tree(pattern="f2")] == ["f2"] and trees.file_tree(spark.createDataFrame([], "path string, size long, ts timestamp"), F.lit(now)).count() == 0
    with pytest.raises(ValueError):
        tree(max_depth=11)


def test_sizes_between_two_tenths_go_to_the_even_one(spark):
    sizes = [0, 5, 1023, 1024, 1075, 2304, 4352, 15616, 133376, 1280, 1792, 1024**2 - 1, 1024**2 * 5 // 4, 1024**3 + 1024**3 // 4 * 3, 1024**4 * 9 // 4, 1024**5 * 7, *(1024**k * n // 20 for k in (1, 2, 3) for n in range(20, 60))]

    def label(n):
        k = next((k for k in range(4) if n < 1024 ** (k + 1)), 4)
        return f"{n / 1024**k:.1f}{('B', 'KB', 'MB', 'GB', 'TB')[k]}"

    df = spark.createDataFrame([(n,) for n in sizes], "n long")
    assert {r.n: r.s for r in df.select("n", trees.size_label(F.col("n")).alias("s")).collect()} == {n: label(n) for n in sizes}


def test_windows_are_dealt_to_many_tasks(spark):
    rows = [(k % 3, START + timedelta(minutes=k), k, "complex", 1000, START) for k in range(50)]
    calls = spark.createDataFrame(rows, "key int, ts timestamp, id long, complexity string, tokens long, window_start timestamp")
    assert routing.route(calls).rdd.getNumPartitions() >= routing.TASKS  # not joined into one by their bytes


def test_components_send_nothing_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(components, "FEW", 0)
    plans, before = [], components.settled
    monkeypatch.setattr(components, "settled", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or before(df))
    edges = [(k, (k + 1) % 40) for k in range(40)] + [(50, 51), (51, 50), (7, 50)]
    got = components.strong_components(spark.createDataFrame(edges, "s long, t long"))
    assert {r.node: r.component for r in got.collect()} == slow_components(edges)
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 5 and not any("Broadcast" in p for p in plans)


def test_small_colours_are_finished_in_tasks(spark, monkeypatch):
    import pyarrow as pa

    calls, before = [], components.coloured
    monkeypatch.setattr(components, "coloured", lambda e: calls.append(1) or before(e))
    monkeypatch.setattr(components, "FEW", 30)
    monkeypatch.setattr(components, "TASK_EDGES", 20)
    edges = [e for k in range(0, 90, 3) for e in ((k, k + 1), (k + 1, k + 2), (k + 2, k), (k + 2, k + 3))] + [(89, 95), (95, 96), (96, 95)]
    edges = edges[:-4] + edges[-3:]
    assert found(spark, [e for e in edges if e[0] // 9 == e[1] // 9]) == slow_components([e for e in edges if e[0] // 9 == e[1] // 9])
    assert len(calls) == 1  # forward only
    rows = [(s, t, 1000 + s // 6) for s, t in edges if s // 6 == t // 6]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[k : k + 5])], names=["s", "t", "colour"]) for k in range(0, len(rows), 5)]
    got = [b for b in components.finished(iter(batches))]
    marks = {}
    for b in got:
        for node, mark in zip(b.column("node").to_pylist(), b.column("mark").to_pylist()):
            marks.setdefault(mark, set()).add(node)
    assert len(got) > 1 and {n: min(m) for m in marks.values() for n in m} == slow_components([r[:2] for r in rows])
