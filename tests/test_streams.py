"""The stream of attempts against one pass over the whole log: batches, late rows, restarts, closed cases."""

import random
from datetime import datetime, timedelta

from docforge.operators.evaluation import final_attempts
from docforge.streaming import attempts

SCHEMA = "case string, seq int, ok boolean, ts timestamp"
DAY = datetime(2024, 1, 1)


def final(rows):
    by = {}
    for case, seq, ok, _ in rows:
        by.setdefault(case, []).append((seq, ok))
    return {c: max((s for s, ok in own if ok), default=min(s for s, _ in own)) for c, own in by.items()}


def run(session, tmp_path, name, batches, **more):
    """Each batch is one start of the query on the same checkpoint."""
    log, table, check = (f"{tmp_path}/{name}-{x}" for x in ("log", "table", "check"))
    state = []
    for rows in batches:
        session.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(log)
        q = attempts.follow(session, log, SCHEMA, table, check, "case", "ok", ["seq"], **more)
        q.awaitTermination()
        state.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = {r.case: r.seq for r in attempts.finals(session, table, SCHEMA, "case", "ok", ["seq"]).collect()}
    return got, state, session.read.parquet(table).count()


def test_batches_restarts_and_late_rows(session, tmp_path):
    r = random.Random(4)
    rows = [(f"c{r.randrange(12)}", i, r.random() < 0.3, DAY) for i in range(120)] + [(None, 1, False, DAY), (None, 2, True, DAY)]
    r.shuffle(rows)  # attempts arrive in any order
    got, _, written = run(session, tmp_path, "any", [rows[:50], rows[50:51], rows[51:]])
    assert got == final(rows) and written < len(rows)
    batch = {x.case: x.seq for x in final_attempts(session.createDataFrame(rows, SCHEMA), "case", "ok", ["seq"]).collect()}
    assert got == batch


def test_order_by_time(session, tmp_path):
    rows = [("a", 3, True, DAY), ("a", 2, True, DAY + timedelta(hours=1)), ("a", 1, False, DAY + timedelta(hours=2)), ("b", 5, False, DAY), ("b", 4, False, None)]
    for k, row in enumerate(rows):
        session.createDataFrame([row], SCHEMA).write.mode("append").parquet(f"{tmp_path}/log")
        attempts.follow(session, f"{tmp_path}/log", SCHEMA, f"{tmp_path}/table", f"{tmp_path}/check", "case", "ok", ["ts", "seq"]).awaitTermination()
    assert {r.case: r.seq for r in attempts.finals(session, f"{tmp_path}/table", SCHEMA, "case", "ok", ["ts", "seq"]).collect()} == {"a": 2, "b": 4}


def test_state_holds_open_cases_only(session, tmp_path):
    batches = [[(f"d{day}-{c}", k, k == 1, DAY + timedelta(days=day, minutes=k)) for c in range(10) for k in range(2)] for day in range(5)]
    batches[4].append(("d0-0", 7, True, DAY + timedelta(days=4)))  # a closed case speaks again
    batches[4].append(("d4-1", -1, False, DAY + timedelta(days=4, minutes=-30)))  # late, but within the watermark
    got, state, _ = run(session, tmp_path, "quiet", batches, ts="ts", quiet_ms=3_600_000)
    assert got == final([x for b in batches for x in b])
    everything, all_state, _ = run(session, tmp_path, "all", batches)
    assert everything == got and state[-1] < all_state[-1] / 2, (state, all_state)


def test_one_state_for_each_case_and_batches_written_anew(session, tmp_path):
    r = random.Random(5)
    rows = [(f"c{r.randrange(30)}", i, r.random() < 0.3, None if i % 3 else DAY) for i in range(400)]
    got, state, _ = run(session, tmp_path, "one", [rows[:200], rows[200:]])
    assert got == final(rows) and state[-1] == len({x[0] for x in rows})
    folders = sorted(p.name for p in (tmp_path / "one-table").iterdir() if p.is_dir())
    assert len(folders) == 2, "a batch that is run again takes the place of its folder"
