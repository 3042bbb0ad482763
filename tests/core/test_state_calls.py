"""What a processor of frames asks of its state: each access is a call to the JVM, so there may not be one a row or a frame."""

import datetime

import pandas as pd

from courtflux.operators import ball
from courtflux.streaming.events import BallGate

AT = datetime.datetime(2024, 1, 1)


class _State:
    """List, value and map states, as far as they are used, in memory."""

    def __init__(self, calls):
        self.calls, self.now, self.rows, self.map = calls, None, [], {}

    def __getattribute__(self, name):
        if not name.startswith("_") and name not in ("calls", "now", "rows", "map"):
            object.__getattribute__(self, "calls").append(name)
        return object.__getattribute__(self, name)

    exists = lambda self: self.now is not None
    get = lambda self: iter(list(self.rows)) if self.now is None else self.now
    update = lambda self, x: setattr(self, "now", x)
    appendList = lambda self, x: self.rows.extend(x)  # noqa: E731, N815
    put = lambda self, x: setattr(self, "rows", list(x))
    updateValue = lambda self, k, x: self.map.update({k: x})  # noqa: E731, N815
    removeKey = lambda self, k: self.map.pop(k)  # noqa: E731, N815
    iterator = lambda self: iter(list(self.map.items()))

    def clear(self):
        self.now, self.rows, self.map = None, [], {}


class _Handle:
    def __init__(self):
        self.calls, self.timers = [], set()
        self.getListState = self.getMapState = self.getValueState = lambda *_: _State(self.calls)

    def registerTimer(self, t):  # noqa: N802
        self.calls.append("registerTimer")
        self.timers.add(t)


class _Time:
    def __init__(self, t):
        self.t = t

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.t

    def getExpiryTimeInMs(self):  # noqa: N802
        return self.t


def _run(frames):
    """Frames in three batches, the last two with rows of the batch before: what comes out, and the calls that it took."""
    gate, handle = BallGate(60_000, 300.0), _Handle()
    gate.init(handle)
    rows = pd.DataFrame([(f, d, AT + datetime.timedelta(milliseconds=40 * f), 100.0 + 5 * f + 60 * d, 50.0, 0.5 + (d == f % 2) / 4) for f in range(frames) for d in (0, 1)], columns=["frame_id", "det_idx", "ts", "x", "y", "score"])
    first, out = int(pd.Timestamp(AT).value // 1_000_000), []
    for k in range(3):
        part = rows[(rows.frame_id >= (k * frames // 3) - 2) & (rows.frame_id < (k + 1) * frames // 3)]
        list(gate.handleInputRows((7,), iter([part.sample(frac=1, random_state=k)]), None))
        watermark = first + 40 * ((k + 1) * frames // 3 - 4) if k < 2 else first + 40 * frames
        for t in sorted(t for t in handle.timers if t <= watermark):
            handle.timers.discard(t)
            expired = _Time(t)
            for got in gate.handleExpiredTimer((7,), _Time(watermark), expired):
                out += list(got.itertuples(index=False, name=None))
    return rows, out, len(handle.calls)


def test_calls_do_not_grow_with_frames():
    rows, out, few = _run(30)
    _, more, many = _run(300)
    last, want = None, []
    for f, g in rows.groupby("frame_id"):
        got = ball.gate(list(zip(g.x, g.y, g.score)), last, 300.0)
        last = got[:2] if got else last
        want += [(7, f, *got)] if got else []
    assert out == want and len(more) > len(out) and many == few
