"""Session stores in files: deltas against a loop, and an index that grows with its folder."""

import json
import os
import random

from pyspark.sql import functions as F

from gneiss.sources import sessions as S


def write(folder, name, body, at):
    p = folder / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(body if isinstance(body, str) else json.dumps(body, indent=2, ensure_ascii=False), encoding="utf-8")
    os.utime(p, (at, at))


def base(sid, items, **more):
    return {"session_id": sid, "created_at": 1.5, "updated_at": 2.5, "workspace": "/w", "messages": items, "transcript_entries": [], "history": ["a", "b"]} | more


def say(i):
    return {"role": ("user", "assistant", "system")[i % 3], "content": f"é{i} " * 60}


def held(first, deltas):
    """The messages of a session by a plain loop."""
    got = list(first)
    for d in deltas:
        if isinstance(d, str):
            continue
        items, at = d.get("messages", []), d.get("msg_offset", len(got))
        got += items if at >= len(got) else items[len(got) - at:] if at + len(items) > len(got) else []
    return got


def test_deltas_equal_a_loop(spark, tmp_path):
    pick, expected = random.Random(5), {}
    for s in range(40):
        sid, n = f"s {s}+é", pick.randrange(5)
        first = [say(i) for i in range(n)]
        deltas = []
        for _ in range(pick.randrange(6)):
            kind = pick.randrange(6)
            d = {"messages": [say(pick.randrange(100)) for _ in range(pick.randrange(5))], "msg_offset": pick.randrange(12), "transcript_offset": 0, "transcripts": [{"k": len(deltas)}]}
            if kind == 0:
                del d["msg_offset"]
            if kind == 1:
                del d["messages"]
            deltas.append("{broken" if kind == 2 else d)
        write(tmp_path, f"{sid}.json", base(sid, first), 1000)
        for i, d in enumerate(deltas):
            write(tmp_path, f"deltas/{sid}/delta_{i:04d}.json", d, 1000)
        expected[sid] = held(first, deltas)
    write(tmp_path, "bad.json", "[1]", 1000)
    write(tmp_path, "empty.json", "", 1000)
    write(tmp_path, "short.json", {"session_id": "short", "messages": [say(0)]}, 1000)
    write(tmp_path, "deltas/orphan/delta_0000.json", {"messages": [say(0)]}, 1000)
    parts = S.parts(S.read_files(spark, str(tmp_path)))
    got = {sid: [] for sid in expected}
    for r in S.messages(parts).orderBy("session", "place").collect():
        assert r.place == len(got[r.session])
        got[r.session].append({"role": r.role, "content": r.content})
    assert got == expected
    rows = {r.session: r for r in S.index(parts).collect()}
    assert rows.keys() == expected.keys()
    for sid, items in expected.items():
        user = [m["content"][:100] for m in items if m["role"] == "user"]
        either = [m["content"][:100] for m in items if m["role"] != "system"]
        assert (rows[sid].message_count, rows[sid].first_message, rows[sid].last_message) == (len(items), user[0] if user else "", either[-1] if either else "")
    assert S.history(parts).where("session = 's 3+é'").orderBy("place").select("line").collect() == [("a",), ("b",)]
    assert S.transcripts(parts).select(F.get_json_object("entry", "$.k").isNotNull().alias("k")).distinct().collect() == [(True,)]


def test_index_reads_what_changed(spark, tmp_path):
    store, to = tmp_path / "store", [str(tmp_path / f"index{i}") for i in range(4)]
    for s in range(6):
        write(store, f"{s}.json", base(str(s), [say(0), say(1)]), 10_000 + s)
    assert {r.session: r.message_count for r in S.refresh_index(spark, str(store), to[0]).collect()} == dict.fromkeys("012345", 2)

    write(store, "deltas/1/delta_0001.json", {"msg_offset": 2, "messages": [say(3)]}, 20_000)
    write(store, "2.json", base("2", [say(0)], updated_at=9.0), 20_000)
    write(store, "old.json", base("old", []), 5)
    (store / "0.json").unlink()
    got = {r.session: r for r in S.refresh_index(spark, str(store), to[1], to[0]).collect()}
    assert {k: r.message_count for k, r in got.items()} == {"1": 3, "2": 1, "3": 2, "4": 2, "5": 2, "old": 0}
    assert got["1"].last_message == say(3)["content"][:100] and got["2"].updated_at == 9.0
    read = {(r.session, r.part): r.read for r in spark.read.parquet(to[1]).collect()}
    assert {k for k, n in read.items() if n == 2} == {("1", "delta_0001"), ("2", ""), ("old", "")}

    again = S.refresh_index(spark, str(store), to[2], to[1])
    assert spark.read.parquet(to[2]).where("read = 3").count() == 0
    assert {r.session: r for r in again.collect()} == got
    assert sorted(r.session for r in S.expired(again, 2).collect()) == ["3", "4", "5", "old"]

    for f in store.rglob("*.json"):
        f.unlink()
    assert S.refresh_index(spark, str(store), to[3], to[2]).count() == 0
