"""Retries, and runs that were cut off."""

import pytest

from delaylake.config import LakeConfig
from delaylake.plans import checks, flow
from delaylake.plans.ledger import Ledger, run_steps

SF = "/root/testdata/sf0.001"


class Killed(BaseException):
    """As when the process ends: nothing can be noted any more."""


def steps_that(log, **faults):
    def act(name):
        def run():
            log.append(name)
            fault = faults.get(name, [])
            if fault:
                raise fault.pop(0)
            return {1: len(log), "name": name}

        return run

    return {name: act(name) for name in ("one", "two", "three")}


def outcomes(ledger):
    rows = ledger.table().orderBy("at").collect()
    return [(r.run, r.step, r.attempt, r.outcome) for r in rows]


def test_a_step_that_fails_once_is_tried_again(spark, tmp_path):
    ledger, log, pauses = Ledger(spark, str(tmp_path / "ledger")), [], []
    work = steps_that(log, two=[OSError("gone")])
    found = run_steps(ledger, work, 1, 5.0, pauses.append)
    assert log == ["one", "two", "two", "three"] and pauses == [5.0]
    assert found["two"] == {1: 3, "name": "two"}
    assert outcomes(ledger) == [
        (1, "one", 1, "begun"), (1, "one", 1, "ended"), (1, "two", 1, "begun"),
        (1, "two", 1, "failed"), (1, "two", 2, "begun"), (1, "two", 2, "ended"),
        (1, "three", 1, "begun"), (1, "three", 1, "ended"),
    ]
    assert ledger.table().where("outcome = 'failed'").first().error == "OSError: gone"


def test_a_run_is_taken_up_where_it_was_cut_off(spark, tmp_path):
    ledger, log = Ledger(spark, str(tmp_path / "ledger")), []
    work = steps_that(log, two=[Killed()], three=[OSError("a"), OSError("b")])
    with pytest.raises(Killed):
        run_steps(ledger, work, 1, 0.0)
    with pytest.raises(OSError, match="b"):
        run_steps(ledger, work, 1, 0.0)
    found = run_steps(ledger, work, 1, 0.0)
    assert log == ["one", "two", "two", "three", "three", "three"]
    # The reports of the steps that had ended are those of then.
    assert found == {"one": {1: 1, "name": "one"}, "two": {1: 3, "name": "two"},
                     "three": {1: 6, "name": "three"}}
    assert {o[0] for o in outcomes(ledger)} == {1}
    assert (1, "three", 3, "ended") in outcomes(ledger)
    run_steps(ledger, work, 1, 0.0)
    assert log[6:] == ["one", "two", "three"] and (2, "one", 1, "ended") in outcomes(ledger)


def test_other_steps_are_another_run(spark, tmp_path):
    ledger, log = Ledger(spark, str(tmp_path / "ledger")), []
    work = steps_that(log, three=[Killed()])
    with pytest.raises(Killed):
        run_steps(ledger, work, 0, 0.0)
    run_steps(ledger, {"one": work["one"]}, 0, 0.0)
    assert log == ["one", "two", "three", "one"]


def test_the_flow_skips_what_has_ended(spark, tmp_path, monkeypatch):
    cfg = LakeConfig(root=str(tmp_path / "lake"), ledger=True, retries=0)
    records, steps = checks.records_of(spark, SF).limit(200), ("ingest", "bronze", "silver", "load")
    done = []

    def watched(name, act):
        def run(*args):
            done.append(name)
            if name == "load" and done.count("load") == 1:
                raise Killed()
            return act(*args)

        return run

    for name in ("ingest", "land", "refine", "load"):
        monkeypatch.setattr(flow, name, watched(name, getattr(flow, name)))
    with pytest.raises(Killed):
        flow.run_flow(spark, cfg, records, steps)
    found = flow.run_flow(spark, cfg, records, steps)
    assert done == ["ingest", "land", "refine", "load", "load"]
    assert sum(found["ingest"].values()) == found["bronze"] == found["silver"] == 200
    assert set(found["ingest"]) == set(range(1, 11))
    assert found["load"] == spark.read.parquet(cfg.fact).count()
