"""Changes told by the stream against comparing snapshots one by one; stops, kills and half-published epochs."""

import random
from collections import Counter
from pathlib import Path

import pytest

from codeseam.streaming.epochs import EpochOrder, Epochs

FORM = "id int, place string, v string, w int"


def plain(snapshots):
    """(id, place, epoch, change) of bags of rows by key."""
    out, before = [], {}
    for e, rows in enumerate(snapshots):
        now = {}
        for i, place, *rest in rows:
            now.setdefault((i, place), Counter())[tuple(rest)] += 1
        for k in before.keys() | now.keys():
            if before.get(k) != now.get(k):
                out.append((*k, e, "deleted" if k not in now else "added" if k not in before else "edited"))
        before = now
    return out


def told(spark, out):
    return [(r["key"]["id"], r["key"]["place"], r["epoch"], r["change"]) for r in spark.read.parquet(out).collect()]


def same(got, want):
    assert Counter(got) == Counter(want)


def drawn(rng, n):
    some = lambda: (rng.choice([None, 1, 2, 3, 4, 5]), rng.choice([None, "", "a"]), rng.choice([None, "", "x", "y"]), rng.choice([None, 0, 7]))
    return [some() for _ in range(n)]


def test_snapshots_over_stops_and_kills(spark, tmp_path):
    rng = random.Random(5)
    # nulls in keys and values, keys of several rows, an empty snapshot, a repeated one
    snapshots = [drawn(rng, 12), drawn(rng, 12), [], drawn(rng, 9)]
    snapshots.append(snapshots[-1][::-1])
    frame = lambda rows: spark.createDataFrame(rows, FORM).repartition(3)
    epochs = Epochs(spark, str(tmp_path / "s"), frame([]).select("id", "place").schema)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for e in range(2):
        epochs.publish(frame(snapshots[e]), e)
    epochs.follow(out, state, files=1).awaitTermination()  # an epoch spans batches
    same(told(spark, out), plain(snapshots[:2]))
    # killed after a batch was written and before it was noted: it is run again and told once
    last = max((p for p in Path(state, "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    last.unlink()
    Path(state, "commits", f".{last.name}.crc").unlink(missing_ok=True)
    for e in range(2, 5):
        epochs.publish(frame(snapshots[e]), e)
    epochs.follow(out, state).awaitTermination()  # three epochs in one batch
    same(told(spark, out), plain(snapshots))


def test_epochs_come_in_order_and_are_taken_up_again(spark, tmp_path, monkeypatch):
    one = spark.createDataFrame([(1, "a", "x", 1)], FORM)
    epochs = Epochs(spark, str(tmp_path / "s"), one.select("id", "place").schema)
    with pytest.raises(EpochOrder):
        epochs.publish(one, 1)
    place = epochs._place

    def lost(df, epoch, what):
        if what == "seal":
            raise RuntimeError("driver lost")
        place(df, epoch, what)

    monkeypatch.setattr(epochs, "_place", lost)
    with pytest.raises(RuntimeError, match="driver lost"):
        epochs.publish(one, 0)
    monkeypatch.undo()
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    epochs.follow(out, state).awaitTermination()
    assert told(spark, out) == []  # rows without a seal: what comes may still change them
    epochs.publish(one, 0)
    with pytest.raises(EpochOrder):
        epochs.publish(one, 0)
    epochs.follow(out, state).awaitTermination()
    assert told(spark, out) == [(1, "a", 0, "added")]


def test_no_python_in_the_stream(spark, tmp_path):
    one = spark.createDataFrame([(1, "a", "x", 1)], FORM)
    epochs = Epochs(spark, str(tmp_path / "s"), one.select("id", "place").schema)
    epochs.publish(one, 0)
    plan = epochs.changes()._jdf.queryExecution().analyzed().toString()
    assert "Python" not in plan and "FullOuter" in plan
