"""Publishing as one commit: of two publishers one wins; a failing step leaves what was there."""

import threading

import pytest
from memloom.operators.snapshots import RefusedError, SnapshotStore


def store(spark, tmp_path):
    made = lambda c: spark.createDataFrame([("n1", c), ("n2", c)], "node string, community_id string")
    return SnapshotStore(spark, f"file://{tmp_path}/snapshots"), made


def seen(s):
    return {r.community_id for r in s.members().collect()}


def test_of_two_publishers_one_wins(spark, tmp_path):
    s, made = store(spark, tmp_path)
    assert seen(s) == set() and s.pointer() is None
    old = s.begin("old")
    new = s.begin("new")
    assert new > old
    for run, fence in (("old", old), ("new", new)):
        s.stage(run, fence, made(run), f"snap-{run}")
    with pytest.raises(RefusedError):
        s.publish("old", old, "snap-old")
    s.publish("new", new, "snap-new")
    assert seen(s) == {"new"}
    same, won = s.begin("third"), []

    def race(name):
        try:
            s.publish("third", same, name)
            won.append(name)
        except RefusedError:
            pass

    threads = [threading.Thread(target=race, args=(f"snap-{n}",)) for n in ("old", "new")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and s.pointer() == won[0]


def test_numbers_are_taken_once(spark, tmp_path):
    s, _ = store(spark, tmp_path)
    got = []
    threads = [threading.Thread(target=lambda k=k: got.append(s.begin(f"r{k}"))) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(set(got)) == 4


def test_a_failing_step_restores(spark, tmp_path):
    s, made = store(spark, tmp_path)
    projected = []
    put = lambda df: projected.append({r.community_id for r in df.collect()})
    first = s.rebuild("one", lambda: made("c1"), put)
    assert seen(s) == {"c1"} and s.pointer() == first and projected == [{"c1"}]

    def broken():
        raise ValueError("no graph")

    with pytest.raises(ValueError, match="no graph"):
        s.rebuild("two", broken, put)

    def halfway(df):
        put(df)
        if projected[-1] == {"c3"}:
            raise OSError("half written")

    with pytest.raises(OSError, match="half written"):
        s.rebuild("three", lambda: made("c3"), halfway)
    assert seen(s) == {"c1"} and s.pointer() == first and projected[-1] == {"c1"}
    states = {r.run_id: r.state for r in s.states().collect()}
    assert (states["one"], states["two"], states["three"]) == ("published", "failed", "failed")
    assert s.rebuild("four", lambda: made("c4"), put) == s.pointer() and seen(s) == {"c4"}
