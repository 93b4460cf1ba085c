"""Sessions under a capacity against a plain replay."""

import datetime
import random

import pytest

from corvane.operators.sessions import lru_sessions

START = datetime.datetime(2024, 1, 1)


def replay(events, ttl, most):
    """One event after the other: a lookup, and for a new session first the stale ones, then the longest unused."""
    open_, done, counts = {}, [], {}
    events = sorted(e for e in events if e[0] is not None and e[1] is not None)
    events.sort(key=lambda e: (e[1], e[2]))

    def close(key, reason):
        number, started, ended, n = open_.pop(key)
        done.append((key, number, started, ended, n, reason))

    for key, t, _ in events:
        if key in open_ and t - open_[key][2] > ttl:
            close(key, "idle")
        if key in open_:
            number, started, _, n = open_.pop(key)
            open_[key] = (number, started, t, n + 1)
            continue
        for k in [k for k in open_ if t - open_[k][2] > ttl]:
            close(k, "idle")
        while len(open_) >= most:
            close(min(open_, key=lambda k: (open_[k][2], list(open_).index(k))), "over capacity")
        counts[key] = counts.get(key, 0) + 1
        open_[key] = (counts[key], t, t, 1)
    for k in list(open_):
        close(k, "idle" if events[-1][1] - open_[k][2] > ttl else "open")
    return sorted(done)


@pytest.mark.parametrize("most,ttl,block", [(1, 50, 40), (5, 30, 7), (5, 400, 60), (50, 100, 35), (8, 100, 10_000)])
def test_sessions_equal_a_plain_replay_whatever_the_blocks(spark, most, ttl, block):
    own, t, events = random.Random(most * ttl), 0, []
    for n in range(900):
        t += own.choice([0, 0, 1, 2, 5, 120 if own.random() < 0.02 else 1])
        events.append((own.choice([own.randint(0, 40), own.randint(0, 6), 1]), t, n))
    events += [(None, 5, 901), (3, None, 902)]
    rows = [(k, None if t is None else START + datetime.timedelta(seconds=t), n) for k, t, n in events]
    frame = spark.createDataFrame(rows, "key int, ts timestamp, n int").repartition(5)
    seconds = lambda x: int((x - START).total_seconds())
    got = [(r.key, r.session, seconds(r.started), seconds(r.ended), r.n, r.reason) for r in lru_sessions(frame, "key", "ts", "n", ttl, most, block).collect()]
    assert sorted(got) == replay(events, ttl, most)


def test_no_events_have_no_sessions(spark):
    assert lru_sessions(spark.createDataFrame([], "key string, ts timestamp, n int"), "key", "ts", "n").count() == 0
