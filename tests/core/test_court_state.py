"""The court tracker in a stream: its state is read and written once for all frames that are handed over, and rows wait in packed parts."""

import datetime

import numpy as np
import pandas as pd
from test_state_calls import AT, _Handle, _State, _Time

from courtflux.operators.tracking import CourtConfig, CourtTracker, seen_of
from courtflux.streaming import events


class _Map(_State):
    containsKey = lambda self, k: k in self.map  # noqa: E731, N815


def _run(frames):
    """Frames in three batches, the last two with rows of the batch before: the rows, what comes out, and the calls that it took."""
    court, handle = events.CourtPlayers(60_000, CourtConfig()), _Handle()
    handle.getMapState = lambda *_: _Map(handle.calls)
    court.init(handle)
    rows = []
    for f in range(frames):
        for d in (0, 1, 2):
            look, x = [float(d == i) + 0.01 * (f % 5) for i in range(3)], 300.0 + 300 * d + f % 40
            if d < 2 or 5 < f < 9:  # one leaves early
                rows.append((f, d, AT + datetime.timedelta(milliseconds=40 * f), x, 10.0, x + 30, 90.0, x / 100 - 6, d - 1.0, look, None if f % 7 == d else np.array(look[:2]), None))
    rows = pd.DataFrame(rows, columns=["frame_id", "det_idx", "ts", *court.columns])
    first, out = int(pd.Timestamp(AT).value // 1_000_000), []
    for k in range(3):
        part = rows[(rows.frame_id >= (k * frames // 3) - 2) & (rows.frame_id < (k + 1) * frames // 3)]
        list(court.handleInputRows((7,), iter([part.sample(frac=1, random_state=k)]), None))
        watermark = first + 40 * ((k + 1) * frames // 3 - 4) if k < 2 else first + 40 * frames
        for t in sorted(t for t in handle.timers if t <= watermark):
            handle.timers.discard(t)
            for got in court.handleExpiredTimer((7,), _Time(watermark), _Time(t)):
                out += list(got.itertuples(index=False, name=None))
    return rows, out, len(handle.calls)


def test_calls_do_not_grow_with_frames():
    rows, out, few = _run(90)
    _, more, many = _run(300)
    tracker, want = CourtTracker(), []
    for f, g in rows.groupby("frame_id"):
        g = g.astype(object).where(g.notna(), None)
        want += [(7, f, d, i) for d, i in zip(g.det_idx, tracker.step([seen_of(r) for r in g.to_dict("records")]))]
    assert out == want and {i for *_, i in out} >= {1, 2, 3} and len(more) > len(out) and many == few


def test_parts_give_their_rows_back(monkeypatch):
    monkeypatch.setattr(events, "PART", 2)
    rows = [(3, 0, 120, None, [0.5, float("inf")], True), (1, 2, 40, 1.25, None, None), (3, 0, 120, 2.0, [], False)]
    parts = events.packed(list(zip(*rows)), ["long", "long", "long", "double", "array<double>", "boolean"])
    assert len(parts) == 2 and list(events.unpacked(iter(parts))) == rows
    ((_, _, _, _, vector, _),) = events.unpacked(iter(events.packed([[1], [1], [1], [None], [np.array([np.nan, 1.0])], [None]], ["long", "long", "long", "double", "array<double>", "boolean"])))
    assert np.isnan(vector[0]) and vector[1] == 1.0  # a number of a vector stays as it is


def test_means_of_recent_vectors():
    tracker = CourtTracker()
    rng = np.random.default_rng(3)
    tracker.looks = [([rng.random(4) for _ in range(n)], []) for n in (3, 0, 5, 1)]
    own = rng.random(4)
    got = tracker._away(0, np.arange(4), [own, None])
    for r, (held, _) in enumerate(tracker.looks):
        mean = np.mean(held, 0) if held else None
        assert np.isnan(got[r, 1]) and (np.isnan(got[r, 0]) if mean is None else abs(got[r, 0] - (1 - mean @ own / np.linalg.norm(mean) / np.linalg.norm(own))) < 1e-12)
