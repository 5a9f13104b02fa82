"""How often a session's debounce asks for its state: by batches and timers, not by clicks or buckets."""

from types import SimpleNamespace

from pyspark.sql import Row

from priceboard.streaming.jobs import Debounce


class Kept:
    """A list or a value of state that counts what is asked of it."""

    def __init__(self, calls):
        self.calls, self.own = calls, []

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            if name == "get":
                return iter(list(self.own)) if self.many else (self.own[0] if self.own else None)
            self.own = {"clear": lambda: [], "update": lambda x: [x], "put": lambda x: list(x), "appendList": lambda x: self.own + list(x)}[name](*args)

        return call


class Handle:
    def __init__(self):
        self.calls, self.timers = [], set()

    def _made(self, many):
        made = Kept(self.calls)
        made.many = many
        return made

    def getListState(self, name, schema):
        return self._made(True)

    def getValueState(self, name, schema):
        return self._made(False)

    def registerTimer(self, at):
        self.calls.append("registerTimer")
        self.timers.add(at)


def at(watermark):
    return SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark)


def test_calls_do_not_grow_with_buckets():
    clicks = [Row(session_id=1, label="ab"[i % 7 == 0], ms=370 * i, id=i) for i in range(1000)]
    want, last = [], None
    for c in clicks:
        if last is None or last["label"] != c["label"] or c["ms"] - last["ms"] >= 2000:
            want.append(c["id"])
            last = c
    handle, job = Handle(), Debounce(2000, 1000)
    job.init(handle)
    parts = [clicks[::2], clicks[1::2]]  # two batches, each with clicks of all 370 buckets
    for rows in parts:
        assert list(job.handleInputRows((1,), iter(rows), at(0))) == []
    assert len(handle.calls) <= 4 and handle.timers == {1000}
    got = []
    for watermark in (150_000, 400_000):
        handle.calls.clear()
        for t in sorted(x for x in handle.timers if x <= watermark):
            handle.timers.discard(t)
            got += [r["id"] for r in job.handleExpiredTimer((1,), at(watermark), None)]
        assert len(handle.calls) <= 12
        assert got == [i for i in want if clicks[i]["ms"] < watermark]
    assert not handle.timers and list(job.waiting.get()) == [] and job.last.get() is None
    # a click of a bucket that has been gone through is dropped
    handle.calls.clear()
    assert list(job.handleInputRows((1,), iter(clicks[:3]), at(400_000))) == [] and handle.calls == []
