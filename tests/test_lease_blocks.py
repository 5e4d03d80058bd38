"""Jobs that share a block of states, and the calls to it."""

import math

from auditlake.streaming import queue
from tests.test_queue_stream import MINUTE, job, result, steps, stream_of


def test_blocks_change_nothing(spark, tmp_path, monkeypatch):
    """Jobs beside each other, far apart, negative and in blocks of one give the same rows."""
    numbers = [-257, -1, 0, 1, 255, 256, 70_000]
    batches = [
        [job(i, k * MINUTE, attempts=k % 2) for k, i in enumerate(numbers)],
        [result(i, (k + 9) * MINUTE, 1 + k % 2, "TIMEOUT" if k % 3 else None) for k, i in enumerate(numbers)],
        [job(9, 900 * MINUTE)],
    ]
    got = []
    for size in (1, 3, queue.BLOCK):
        monkeypatch.setattr(queue, "BLOCK", size)
        got.append(steps(queue.replayed(queue.leases(stream_of(spark, batches, str(tmp_path / str(size))), "0 seconds"), "leases")))
    assert got[0] == got[1] == got[2] and len(got[0]) >= 2 * len(numbers) + 1


class Calls:
    """A handle and list state that count what is asked of them."""

    def __init__(self):
        self.n, self.rows, self.timers = 0, [], set()

    def __getattr__(self, name):
        def call(*args):
            self.n += 1
            if name == "getListState":
                return self
            if name == "get":
                return iter(self.rows)
            if name in ("put", "clear"):
                self.rows = list(args[0]) if args else []
            if name == "registerTimer":
                self.timers.add(args[0])
            if name == "deleteTimer":
                self.timers.remove(args[0])

        return call


class Message:
    def __init__(self, i):
        self.job_id, self.at, self.kind, self.state, self.attempts, self.lease_until, self.error = job(i, i)


def test_calls_do_not_grow_with_jobs():
    """A block of jobs is read, written and timed once, and its one timer is that of the earliest deadline."""
    handle, leases = Calls(), queue.Leases()
    leases.init(handle)
    out = list(leases.handleInputRows((0,), iter([Message(i) for i in range(200)]), None))
    assert len(out) == len(handle.rows) == 200 and handle.n <= 5
    assert handle.timers == {queue.HOLD // 1000 + 1} and math.isclose(min(r[3] for r in handle.rows), queue.HOLD)
