"""Guards and the summary of a run."""

import pytest
from pyspark.sql import functions as F

from docforge.operators import summary as S

GOLD = [("a", "set", "q1"), ("b", "answer", "q2"), ("c", "answer", "q3")]
SAID = [("a", "answered", 1.0, None), (" b ", "abstained", 0.0, 0.5), ("x", "answered", 1.0, 1.0)]


def frames(session, gold=GOLD, said=SAID):
    return session.createDataFrame(gold, "id string, lane string, q string"), session.createDataFrame(said, "id string, response_status string, retrieval_recall double, list_f1 double")


def test_guards(session, tmp_path):
    details, unknown = S.joined(*frames(session), f"{tmp_path}/ok")
    assert [r.id for r in unknown.collect()] == ["x"]
    assert {r.id: (r.predicted, r.response_status) for r in details.collect()} == {"a": (True, "answered"), "b": (True, "abstained"), "c": (False, None)}
    for k, (gold, said, what) in enumerate([(GOLD + [("a", "set", "again")], SAID, "repeated_golden"), (GOLD, SAID + [("b", "answered", 0.0, 0.0)], "repeated_predictions"), (GOLD + [(None, "set", "q")], SAID, "blank_golden"), (GOLD, SAID + [("  ", "x", 0.0, 0.0)], "blank_predictions")]):
        with pytest.raises(S.GuardError, match=what):
            S.joined(*frames(session, gold, said), f"{tmp_path}/{k}")


def test_summary_and_reasons(session, tmp_path):
    details, _ = S.joined(*frames(session), f"{tmp_path}/s")
    details = details.withColumn("response_status", F.coalesce("response_status", F.lit("empty_response"))).withColumn("citation_status", F.lit("misplaced"))
    got = {r.lane: r for r in S.summary(details).collect()}
    assert (got["all"].cases, got["all"].answered, got["all"].empty_response) == (3, 1, 1) and got["answer"].retrieval_recall == 0 and got["all"].retrieval_recall == 0.5
    assert got["set"].list_f1 is None and got["answer"].list_f1 == 0.5 and abs(got["all"].generation_success - 2 / 3) < 1e-12
    own = {r.id: r.reasons for r in details.withColumn("reasons", S.reasons(details)).collect()}
    assert own == {"a": ["citation_misplaced"], "b": ["retrieval_failure", "set_mismatch", "citation_misplaced"], "c": ["empty_response"]}
    counted = {r.value: r.n for r in S.histogram(details.withColumn("reasons", S.reasons(details)), "reasons").collect()}
    assert counted == {"citation_misplaced": 2, "retrieval_failure": 1, "set_mismatch": 1, "empty_response": 1}
    assert S.summary(details.limit(0)).where("lane <> 'all'").count() == 0
