"""Lanes of different shape, numbers of bad lines, aliased columns."""

import pytest

from docforge.sources import lanes


def test_numbers_of_lines(session, tmp_path):
    for name, n in (("a", 700), ("b", 3)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name} {i} {'x' * (i % 90)}\n" if i % 7 else "\n" for i in range(n)))
    size = session.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        session.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # files are read in many blocks
        rows = lanes.numbered(session, str(tmp_path)).collect()
    finally:
        session.conf.set("spark.sql.files.maxPartitionBytes", size)
    got = {(r.file[-5:], r.line): r.value for r in rows}
    assert len(got) == 703
    for name, n in (("a", 700), ("b", 3)):
        for i, line in enumerate((tmp_path / f"{name}.txt").read_text().split("\n")[:-1]):
            assert got[f"{name}.txt", i + 1] == line


def test_bad_lines_tell_their_number(session, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('﻿{"id": 1}\n\n{"id": "x", "b": [1]}\n')
    assert lanes.records(session, str(good)).count() == 2
    for text, line in (('{"a": 1}\n\n[1, 2]\n', 3), ('{"a": 1}\n{"a": \n', 2), ('{"a": 1}\nnull\n', 2), ('7\n', 1)):
        bad = tmp_path / "bad.jsonl"
        bad.write_text(text)
        with pytest.raises(lanes.BadLineError, match=f"bad.jsonl, line {line}:"):
            lanes.records(session, str(bad))


def test_lanes_and_aliases(session, tmp_path):
    (tmp_path / "one.jsonl").write_text('{"case_id": "1", "gold": {"decision": "Answer", "n": 3}, "docs": ["a ", "", "B"]}\n{"id": 2, "gold": null, "docs": "a;zz | a"}\n')
    (tmp_path / "two.csv").write_text('﻿id,Answer text,n\n3,"first\nsecond, ""quoted""",x\n4,,12\n')
    own = [
        lanes.Lane("one", f"{tmp_path}/one.jsonl", {"id": ("$.case_id", "$.id"), "decision": ("$.gold.decision",), "n": ("$.gold.n",), "labels": ("$.docs",)}, {"n": "int", "labels": "array<string>"}, {"kind": "json"}),
        lanes.Lane("two", f"{tmp_path}/two.csv", {"id": ("$.id",), "answer": ("$.text", "$['Answer text']"), "n": ("$.n",), "labels": ("$.docs",)}, {"n": "int", "labels": "array<string>"}),
    ]
    corpus = session.createDataFrame([("A",), ("b",), ("c",)], "doc_id string")
    rows = {r.id: r for r in lanes.resolved(lanes.union(session, own), corpus).collect()}
    assert rows["1"].expected == ["A", "b"] and rows["1"].n_unmatched == 0 and rows["1"].n == 3 and rows["1"].kind == "json"
    assert rows["2"].expected == ["A"] and rows["2"].n_unmatched == 1 and rows["2"].decision is None
    assert rows["3"].answer == 'first\nsecond, "quoted"' and rows["3"].n is None and rows["4"].n == 12 and rows["4"].answer is None and rows["4"].expected == []
    shapes = {r.lane: r["shape"] for r in lanes.shapes(session, own).collect()}
    assert "gold" in shapes["one"] and shapes["two"].startswith("OBJECT")
