"""Every query of the library against its SQL, and those without SQL against what they promise."""

import pytest

from gneiss.plans import catalog

QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(name, spark, sf_dir, rows_of, duck_rows):
    df = QUERIES[name](spark, sf_dir)
    names, expected = duck_rows(ORACLE[name])
    assert sorted(df.columns) == names
    assert rows_of(df) == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(name, spark, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() >= 0


def test_every_ready_task_returns(spark, tmp_path):
    rows = {k: (k, "F" if k < 300 else "O", f"{k % 5}-x") for k in range(1000)}
    spark.createDataFrame(list(rows.values()), "o_orderkey long, o_orderstatus string, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    ready = sorted((r[2], k) for k, r in rows.items() if r[1] != "F" and all(rows[d][1] == "F" for d in (k // 2, k // 3)))
    assert len(ready) == 300
    assert [(r.priority, r.id) for r in QUERIES["ready_frontier"](spark, str(tmp_path)).collect()] == ready


def test_every_call_is_scheduled(spark, sf_dir):
    from collections import Counter, defaultdict
    from itertools import combinations

    turns, ok = defaultdict(list), defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("event_id").collect():
        turns[r.event_id // 10].append((r.event_id, r.user_id, r.event_type != "error"))
        ok[r.user_id].append(r.event_type != "error")
    history = Counter(frozenset((a[1], b[1])) for calls in turns.values() for a, b in combinations([c for c in calls if not c[2]], 2))
    expected = set()
    for turn, calls in turns.items():
        calls = sorted(calls, key=lambda c: -sum(ok[c[1]]) / len(ok[c[1]]))
        chosen = []
        for c in calls:
            if len(calls) == 1 or (c[1] % 5 and not any(history[frozenset((c[1], o[1]))] >= 2 for o in chosen)):
                chosen.append(c)
        workers = min(len(chosen), 8, 4 if any(c[1] % 11 == 1 for c in chosen) else 8, 3 if any(c[1] % 13 == 1 for c in chosen) else 8)
        expected |= {(turn, c[0], c[1], at, c in chosen, max(1, workers)) for at, c in enumerate(calls, 1)}
    got = [(r.turn, r.call, r.tool, r.place, r.concurrent, r.workers) for r in QUERIES["tool_call_schedule"](spark, sf_dir).collect()]
    assert len(got) == len(expected) > 20 and set(got) == expected
    assert {x[4] for x in got} == {True, False} and len({x[5] for x in got}) > 2


def test_display_reads_the_whole_table(spark, sf_dir):
    keys = sorted(r.c_custkey for r in spark.read.parquet(f"{sf_dir}/customer.parquet").collect())
    assert [r.c_custkey for r in QUERIES["sql_display_table"](spark, sf_dir).collect()] == [str(k) for k in keys[:100]] and len(keys) > 100


def test_entry():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(ORACLE) <= set(e.oracle_sql())


def test_streams_read_a_folder_of_files(spark, sf_dir, tmp_path, rows_of):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "many/events.parquet"))
    events.limit(0).write.parquet(str(tmp_path / "none/events.parquet"))
    for name in ("stream_tool_stats", "stream_latest", "stream_dedup", "stream_hourly"):
        assert rows_of(QUERIES[name](spark, str(tmp_path / "many"))) == rows_of(QUERIES[name](spark, sf_dir))
        assert QUERIES[name](spark, str(tmp_path / "none")).count() == 0
