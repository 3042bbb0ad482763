"""Identities over frames: min-cost flow over whole videos, and two frame-by-frame trackers.

A video is one group: identities are a global decision over it, and videos are solved side by side. Inputs are detections with optional
``reid`` and ``color`` vectors and court positions.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..runtime import ship
from .assign import Paths, assignment


#: The defaults of the configurations here are those of the published pipeline's settings.
@dataclass(frozen=True)
class FlowConfig:
    tracks: int = 10
    max_skip: int = 15
    box_scale: float = 20.0
    w_spatial: float = 0.2
    w_app: float = 0.6
    w_iou: float = 0.2
    w_color: float = 0.3
    w_extended: float = 1.5
    skip_penalty: float = 1.0
    reward: float = 1.0
    enter: float = 2.0
    leave: float = 2.0
    margin: float = 5.0
    first_frames: int = 10
    last_frames: int = 10
    passes: int = 5
    look_back: int = 5
    oof_entry: float = 0.5
    max_occlusion: int = 45
    occlusion_gate: float = 50.0
    occlusion_penalty: float = 0.1
    occlusion_from: int = 2


def unit_rows(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(n < 1e-8, 0.0, x / np.maximum(n, 1e-12))


class Video:
    """A video's detections as arrays, in frame order."""

    def __init__(self, pdf: pd.DataFrame):
        self.frame = pdf.frame_id.to_numpy(np.int64)
        self.box = pdf[["x1", "y1", "x2", "y2"]].to_numpy(float)
        self.foot = np.stack([(self.box[:, 0] + self.box[:, 2]) / 2, self.box[:, 3]], 1)
        self.color = self._vectors(pdf, "color")
        own = self._vectors(pdf, "reid")
        self.look = own if own is not None else self.color

    @staticmethod
    def _vectors(pdf: pd.DataFrame, name: str) -> np.ndarray | None:
        if name not in pdf or pdf[name].isna().any():
            return None
        return np.stack([np.asarray(v, float) for v in pdf[name]])

    def cosine(self, x: np.ndarray | None, i: np.ndarray, j: np.ndarray, default: float) -> np.ndarray:
        if x is None:
            return np.full(len(i), default)
        u = unit_rows(x)
        return 1 - np.einsum("ij,ij->i", u[i], u[j])


def ious(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of boxes row by row."""
    w = np.clip(np.minimum(a[..., 2], b[..., 2]) - np.maximum(a[..., 0], b[..., 0]), 0, None)
    h = np.clip(np.minimum(a[..., 3], b[..., 3]) - np.maximum(a[..., 1], b[..., 1]), 0, None)
    both = w * h
    area = lambda x: np.clip(x[..., 2] - x[..., 0], 0, None) * np.clip(x[..., 3] - x[..., 1], 0, None)
    union = area(a) + area(b) - both
    return np.where(union > 0, both / np.where(union > 0, union, 1), 0.0)


def band_pairs(frame: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows sorted by frame whose frames lie ``low`` to ``high`` apart."""
    a, z = np.searchsorted(frame, frame + low), np.searchsorted(frame, frame + high, side="right")
    n = np.maximum(z - a, 0)
    i = np.repeat(np.arange(len(frame)), n)
    return i, np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)


def link_costs(v: Video, i: np.ndarray, j: np.ndarray, fps: float, cfg: FlowConfig) -> np.ndarray:
    """Cost of linking detections over a gap: distance, appearance, IoU (fading over five frames), colour and skipped frames."""
    gap = (v.frame[j] - v.frame[i]).astype(float)
    px = np.hypot(*(v.foot[i] - v.foot[j]).T)
    spatial = np.expm1(np.minimum(px / (cfg.box_scale * 30 / fps * np.sqrt(np.maximum(gap, 1))), 15))
    fade = np.where(gap <= 5, np.maximum(0, 1 - (gap - 1) / 5), 0)
    w_iou = cfg.w_iou * fade
    lost = (cfg.w_iou - w_iou) / 2
    iou_cost = np.where(gap <= 5, 1 - ious(v.box[i], v.box[j]), 0)
    return (cfg.w_spatial + lost) * spatial + (cfg.w_app + lost) * v.cosine(v.look, i, j, 1.0) + w_iou * iou_cost + cfg.w_color * v.cosine(v.color, i, j, 0.0) + np.maximum(0, gap - 1) * cfg.skip_penalty


class Context:
    """Mean vectors of each tracked detection's past and future along its track, and the cost between them."""

    def __init__(self, v: Video, tracks: list[list[int]], look: int):
        self.ok = np.zeros(len(v.frame), bool)
        self.parts = []
        for x in (v.look, v.color):
            if x is None:
                self.parts.append(None)
                continue
            past, future = np.zeros_like(x), np.zeros_like(x)
            for t in tracks:
                self.ok[t] = True
                run = np.concatenate([np.zeros((1, x.shape[1])), x[t].cumsum(0)])
                at, n = np.arange(len(t)), len(t)
                a, z = np.maximum(at - look, 0), np.minimum(at + look + 1, n)
                past[t] = (run[at + 1] - run[a]) / (at + 1 - a)[:, None]
                future[t] = (run[z] - run[at]) / (z - at)[:, None]
            self.parts.append((unit_rows(past), unit_rows(future)))

    def cost(self, i: np.ndarray, j: np.ndarray, cfg: FlowConfig) -> np.ndarray:
        if self.parts[0] is None:
            return np.zeros(len(i))
        d = 1 - np.einsum("ij,ij->i", self.parts[0][0][i], self.parts[0][1][j])
        out = d * d
        if self.parts[1] is not None:
            out += cfg.w_color * (1 - np.einsum("ij,ij->i", self.parts[1][0][i], self.parts[1][1][j]))
        return np.where(self.ok[i] & self.ok[j], cfg.w_extended * out, 0)


def occlusion_links(v: Video, tracks: list[list[int]], fps: float, cfg: FlowConfig) -> tuple[np.ndarray, np.ndarray]:
    """Pairs over long gaps that both stand near one track of others: a player hidden behind it and seen again."""
    gate = cfg.occlusion_gate * 30 / fps
    own = np.full(len(v.frame), -1)
    for k, t in enumerate(tracks):
        own[t] = k
    out = []
    for k, t in enumerate(tracks):
        place = dict(zip(v.frame[t].tolist(), t))
        mate = np.array([place.get(f, -1) for f in v.frame.tolist()])
        near = np.flatnonzero((mate >= 0) & (own != k) & (np.hypot(*(v.foot - v.foot[np.maximum(mate, 0)]).T) <= gate))
        i, j = band_pairs(v.frame[near], cfg.max_skip + 1, cfg.max_occlusion)
        i, j = near[i], near[j]
        ok = (own[i] < 0) | (own[i] != own[j])
        out.append(np.stack([i[ok], j[ok]]))
    both = np.concatenate(out, 1) if out else np.empty((2, 0), int)
    return both[0], both[1]


def flow_tracks(v: Video, fps: float, cfg: FlowConfig = FlowConfig(), width: float | None = None) -> list[list[int]]:
    """Tracks as lists of rows, by the cheapest flow; later passes add the context of the tracks before."""
    n = len(v.frame)
    width = width if width is not None else float(v.box[:, 2].max())
    ids, cut = np.unique(v.frame, return_index=True)
    early = np.isin(v.frame, ids[: cfg.first_frames])
    left, right = (v.box[:, 0] <= cfg.margin) & (width > 0), (v.box[:, 2] >= width - cfg.margin) & (width > 0)
    edge = left | right
    # Each row of a frame may follow all rows of the ``max_skip`` frames before: a matrix a frame.
    low, cut = np.searchsorted(v.frame, ids - cfg.max_skip), np.append(cut, n)
    rows = np.diff(cut)
    many = np.repeat(cut[:-1] - low, rows)
    lj = np.repeat(np.arange(n), many)
    li = np.arange(len(lj)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(np.repeat(low, rows), many)
    at = np.cumsum(rows * (cut[:-1] - low))[:-1]
    links = link_costs(v, li, lj, fps, cfg)
    oof = []
    for side in (left, right):
        some = np.flatnonzero(side)
        i, j = band_pairs(v.frame[some], 1, int(ids[-1] - ids[0]) if len(ids) else 0)
        oof.append(np.stack([some[i], some[j]]))
    oi, oj = np.unique(np.concatenate(oof, 1), axis=1) if v.look is not None and n else np.empty((2, 0), int)
    away = v.cosine(v.look, oi, oj, 1.0) + cfg.w_color * v.cosine(v.color, oi, oj, 0.0) + cfg.oof_entry
    start = np.minimum(np.where(early, cfg.enter, np.inf), np.where(edge, cfg.enter + cfg.oof_entry, np.inf))
    flow = Paths(cut, low, start, np.where(edge, min(0.0, cfg.leave), cfg.leave), cfg.reward)
    tracks: list[list[int]] | None = None
    look = cfg.look_back
    for k in range(cfg.passes):
        more, far = np.zeros(len(li)), np.zeros(len(oi))
        hidden = (np.empty(0, int), np.empty(0, int), np.empty(0))
        if tracks is not None:
            context = Context(v, tracks, look)
            look *= 2
            more, far = context.cost(li, lj, cfg), context.cost(oi, oj, cfg)
            if k >= cfg.occlusion_from and v.look is not None:
                hi, hj = occlusion_links(v, tracks, fps, cfg)
                cost = v.cosine(v.look, hi, hj, 1.0) + cfg.w_color * v.cosine(v.color, hi, hj, 0.0) + (v.frame[hj] - v.frame[hi]) * cfg.occlusion_penalty
                hidden = (hi, hj, cost + context.cost(hi, hj, cfg))
        near = [c.reshape(m, -1) for m, c in zip(rows.tolist(), np.split(links + more, at))]
        flow.price(near, *(np.concatenate(x) for x in zip((oi, oj, away + far), hidden)))
        if tracks is None or len(tracks) < cfg.tracks or not flow.still_cheapest():
            flow.solve(cfg.tracks)
        tracks = flow.paths()
    return tracks or []


# -- frame by frame ------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class CourtConfig:
    w_spatial: float = 0.2
    w_app: float = 0.6
    w_color: float = 0.3
    max_age: int = 15
    gallery: int = 5
    confirm: int = 3
    still_after: int = 2
    update_gate: float = 13.82
    chi2: float = 5.9915
    bottom_jump: float = 0.15
    shrink: float = 0.30
    color_gate: float = 0.40
    color_least: int = 5
    half_length: float = 15.0
    half_width: float = 8.0
    gate_base: float = 1.0
    gate_step: float = 0.5
    gate_most: float = 5.0


@dataclass
class Seen:
    """A detection as the frame-by-frame trackers see it."""

    box: np.ndarray
    court: np.ndarray | None = None
    reid: np.ndarray | None = None
    color: np.ndarray | None = None
    masked: bool | None = None

    @property
    def height(self) -> float:
        return float(self.box[3] - self.box[1])


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return 1.0 if n < 1e-8 else float(1 - a @ b / n)


_MOVE = np.eye(4) + np.eye(4, k=2)
_DRIFT = np.diag([0.0625, 0.0625, 0.25, 0.25])
_NOISE = np.diag([0.09, 0.09])


class CourtTracker:
    """Players on the court as rows of arrays: constant-velocity filters in metres, last boxes, and recent vectors.

    A frame is one prediction of all rows and one cost matrix of all rows and detections; rows are then matched by age, freshest first. A
    detection gets the id of a confirmed row, else -1.
    """

    def __init__(self, cfg: CourtConfig = CourtConfig()):
        self.cfg, self.next = cfg, 1
        self.id, self.hits, self.age, self.sure = np.empty(0, int), np.empty(0, int), np.empty(0, int), np.empty(0, bool)
        self.mean, self.cov = np.empty((0, 4)), np.empty((0, 4, 4))
        self.bottom, self.height = np.empty(0), np.empty(0)
        self.looks: list[tuple[deque, deque]] = []  # of each row, the recent ReID and colour vectors

    def _predict(self) -> None:
        self.mean[self.age >= self.cfg.still_after, 2:] = 0
        self.mean = self.mean @ _MOVE.T
        self.cov = _MOVE @ self.cov @ _MOVE.T + _DRIFT
        self.age = self.age + 1

    def _spread(self, rows: np.ndarray) -> np.ndarray:
        return self.cov[rows, :2, :2] + _NOISE

    def _cropped(self, rows: np.ndarray, bottom: np.ndarray, height: np.ndarray) -> np.ndarray:
        """Whether boxes (broadcast against rows) end elsewhere than, or are much lower than, the rows' last ones."""
        h = np.maximum(height, 1.0)
        return (np.abs(bottom - self.bottom[rows]) > self.cfg.bottom_jump * h) | (h < (1 - self.cfg.shrink) * self.height[rows])

    def _away(self, kind: int, rows: np.ndarray, vectors: list) -> np.ndarray:
        """Cosine distances of the rows' mean vectors and the detections'; nan where either has none."""
        out = np.full((len(rows), len(vectors)), np.nan)
        have, there = [k for k, r in enumerate(rows) if self.looks[r][kind]], [k for k, v in enumerate(vectors) if v is not None]
        if have and there:
            held = [self.looks[rows[k]][kind] for k in have]
            n = np.array([len(x) for x in held])
            mean = np.add.reduceat([v for x in held for v in x], np.cumsum(n) - n, axis=0) / n[:, None]  # of all rows at once
            own = np.stack([vectors[k] for k in there])
            n = np.linalg.norm(mean, axis=1)[:, None] * np.linalg.norm(own, axis=1)
            out[np.ix_(have, there)] = np.where(n < 1e-8, 1.0, 1 - mean @ own.T / np.maximum(n, 1e-12))
        return out

    def _costs(self, at: np.ndarray, box: np.ndarray, height: np.ndarray, seen: list[Seen]) -> np.ndarray:
        """Weighted means of place, appearance and colour for all rows and detections; infinite beyond the gates."""
        c, rows = self.cfg, np.arange(len(self.id))
        d = at[None] - self.mean[:, None, :2]
        surprise = np.einsum("rdi,rij,rdj->rd", d, np.linalg.inv(self._spread(rows)), d)
        with np.errstate(invalid="ignore"):
            near = np.hypot(d[..., 0], d[..., 1]) <= np.minimum(c.gate_base + c.gate_step * self.age, c.gate_most)[:, None]
            odd = self._cropped(rows[:, None], box[None, :, 3], height[None]) | (surprise > c.update_gate)
        place = np.where(odd, 0.5, np.minimum(surprise / c.chi2, 1.0))
        total, weight = c.w_spatial * place, np.full(place.shape, c.w_spatial)
        for kind, w in ((0, c.w_app), (1, c.w_color)):
            x = self._away(kind, rows, [s.reid if kind == 0 else s.color for s in seen])
            known = ~np.isnan(x)
            total, weight = total + np.where(known, w * np.nan_to_num(x), 0), weight + np.where(known, w, 0)
            if kind == 1:
                full = np.array([len(look[1]) >= c.color_least for look in self.looks], bool)
                near &= ~(full[:, None] & known & (np.nan_to_num(x) > c.color_gate))
        return np.where(near, total / weight, np.inf)

    def _update(self, rows: np.ndarray, at: np.ndarray, box: np.ndarray, height: np.ndarray, seen: list[Seen]) -> None:
        c = self.cfg
        bad = self._cropped(rows, box[:, 3], height)
        self.bottom[rows], self.height[rows] = box[:, 3], np.maximum(height, 1.0)
        d = at - self.mean[rows, :2]
        inverse = np.linalg.inv(self._spread(rows))
        fits = ~bad & (np.einsum("ri,rij,rj->r", d, inverse, d) <= c.update_gate)
        gain = self.cov[rows][:, :, :2] @ inverse
        moved = self.mean[rows] + np.einsum("rij,rj->ri", gain, d)
        narrowed = self.cov[rows] - gain @ self.cov[rows][:, :2, :]
        self.mean[rows[fits]], self.cov[rows[fits]] = moved[fits], narrowed[fits]
        for r, x in zip(rows[~bad], (s for s, out in zip(seen, bad) if not out)):
            self._keep(r, x)
        self.hits[rows] += 1
        self.age[rows] = 0
        self.sure[rows] |= self.hits[rows] >= c.confirm

    def _keep(self, row: int, x: Seen) -> None:
        for held, v in zip(self.looks[row], (x.reid, x.color)):
            if v is not None:
                held.append(v)

    def _begin(self, some: np.ndarray, at: np.ndarray, box: np.ndarray, height: np.ndarray, seen: list[Seen]) -> None:
        k = len(some)
        grown = lambda x, new: np.concatenate([x, new])
        self.id, self.next = grown(self.id, self.next + np.arange(k)), self.next + k
        self.hits, self.age, self.sure = grown(self.hits, np.ones(k, int)), grown(self.age, np.zeros(k, int)), grown(self.sure, np.zeros(k, bool))
        self.mean = grown(self.mean, np.concatenate([at[some], np.zeros((k, 2))], 1))
        self.cov = grown(self.cov, np.broadcast_to(np.diag([1.0, 1.0, 5.0, 5.0]), (k, 4, 4)))
        self.bottom, self.height = grown(self.bottom, box[some, 3]), grown(self.height, height[some])
        for i in some:
            self.looks.append((deque(maxlen=self.cfg.gallery), deque(maxlen=self.cfg.gallery)))
            self._keep(len(self.looks) - 1, seen[i])

    def _leave(self, keep: np.ndarray) -> None:
        for name in ("id", "hits", "age", "sure", "mean", "cov", "bottom", "height"):
            setattr(self, name, getattr(self, name)[keep])
        self.looks = [x for x, k in zip(self.looks, keep) if k]

    def _whole(self, height: np.ndarray) -> np.ndarray:
        """Whether boxes are about as high as confirmed rows' usually are."""
        return height >= (1 - self.cfg.shrink) * np.median(self.height[self.sure]) if self.sure.any() else np.ones(len(height), bool)

    def step(self, seen: list[Seen]) -> list[int]:
        c, ids = self.cfg, np.full(len(seen), -1)
        box = np.array([d.box for d in seen]).reshape(-1, 4)
        at = np.array([(np.nan, np.nan) if d.court is None else d.court for d in seen]).reshape(-1, 2)
        height = box[:, 3] - box[:, 1]
        masked = np.array([bool(d.masked) for d in seen], bool)
        with np.errstate(invalid="ignore"):
            free = (np.abs(at[:, 0]) <= c.half_length) & (np.abs(at[:, 1]) <= c.half_width)
        free &= (masked | ~masked.any()) & self._whole(height)
        self._predict()
        hit = np.zeros(len(self.id), bool)
        if len(self.id) and free.any():
            cost = self._costs(at, box, height, seen)
            for age in np.unique(self.age):
                level, open_ = np.flatnonzero(self.age == age), np.flatnonzero(free)
                level = level[np.argsort(~self.sure[level], kind="stable")]
                if not len(open_):
                    break
                part = cost[np.ix_(level, open_)]
                r, k = (np.asarray(x, int) for x in assignment(np.where(np.isfinite(part), part, 1e6)))
                met = np.isfinite(part[r, k])
                rows, own = level[r[met]], open_[k[met]]
                if len(rows):
                    hit[rows], free[own] = True, False
                    self._update(rows, at[own], box[own], height[own], [seen[i] for i in own])
                    ids[own] = np.where(self.sure[rows], self.id[rows], -1)
        dead = ~hit & (~self.sure | (self.age > c.max_age))
        new = np.flatnonzero(free & self._whole(height))
        self._leave(~dead)
        self._begin(new, at, box, height, seen)
        return ids.tolist()


@dataclass(frozen=True)
class AppearanceConfig:
    tracks: int = 10
    max_age: int = 15
    reach: float = 300.0
    w_reid: float = 0.7
    w_spatial: float = 0.3
    blend: float = 0.3


class AppearanceTracker:
    """Tracks as last boxes and blended vectors; unmatched rows keep the ids they came with."""

    def __init__(self, cfg: AppearanceConfig = AppearanceConfig()):
        self.cfg, self.all, self.next = cfg, [], 1

    def step(self, seen: list[Seen], ids: list[int]) -> list[int]:
        c, out = self.cfg, list(ids)
        free = list(range(len(seen)))
        centre = lambda b: np.array([(b[0] + b[2]) / 2, (b[1] + b[3]) / 2])
        hit: set[int] = set()
        if self.all and seen:
            cost = np.full((len(self.all), len(seen)), 1e6)
            for a, t in enumerate(self.all):
                for i, d in enumerate(seen):
                    far = float(np.hypot(*(centre(t["box"]) - centre(d.box))))
                    if far <= c.reach:
                        look = d.reid if d.reid is not None else d.color
                        app = 0.5 if t["look"] is None or look is None else cosine(t["look"], look)
                        cost[a, i] = c.w_reid * app + c.w_spatial * min(far / c.reach, 1.0)
            for a, i in zip(*assignment(cost)):
                if cost[a, i] < 1e6:
                    t, d = self.all[a], seen[i]
                    look = d.reid if d.reid is not None else d.color
                    t["look"] = look if t["look"] is None or look is None else (1 - c.blend) * t["look"] + c.blend * look
                    t["box"], t["age"] = d.box, 0
                    out[i] = t["id"]
                    free.remove(i)
                    hit.add(a)
        for a, t in enumerate(self.all):
            if a not in hit:
                t["age"] += 1
        active = sum(t["age"] == 0 for t in self.all)
        for i in free:
            if active >= c.tracks:
                break
            d = seen[i]
            self.all.append({"id": self.next, "box": d.box, "look": d.reid if d.reid is not None else d.color, "age": 0})
            out[i] = self.next
            self.next, active = self.next + 1, active + 1
        self.all = [t for t in self.all if t["age"] <= c.max_age]
        return out


# -- on DataFrames -------------------------------------------------------------------------------------------------------------


def _per_video(rows: DataFrame, solve: Callable[[pd.DataFrame], np.ndarray]) -> DataFrame:
    """``rows`` with player_id from one video's rows in (frame_id, det_idx) order."""
    ship(rows.sparkSession)
    schema = rows.drop("player_id").schema.add("player_id", "long")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["frame_id", "det_idx"]).reset_index(drop=True)
        return pdf.assign(player_id=solve(pdf))[schema.names]

    return _spread(rows).groupBy("video_id").applyInPandas(run, schema)


def _spread(rows: DataFrame) -> DataFrame:
    """``rows`` by video in as many tasks as the session shuffles to: a video's rows are few, but take long, so small partitions aren't merged."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "video_id")


def track_flow(rows: DataFrame, fps: float = 30.0, cfg: FlowConfig = FlowConfig()) -> DataFrame:
    def solve(pdf: pd.DataFrame) -> np.ndarray:
        ids = np.full(len(pdf), -1)
        for k, path in enumerate(flow_tracks(Video(pdf), fps, cfg), 1):
            ids[path] = k
        return ids

    return _per_video(rows, solve)


def seen_of(row: dict) -> Seen:
    vec = lambda k: None if row.get(k) is None else np.asarray(row[k], float)
    court = None if row.get("court_x") is None or np.isnan(row["court_x"]) else np.array([row["court_x"], row["court_y"]], float)
    return Seen(np.array([row[c] for c in ("x1", "y1", "x2", "y2")], float), court, vec("reid"), vec("color"), row.get("has_mask"))


def _frames(pdf: pd.DataFrame) -> dict[int, list[tuple[int, dict]]]:
    by: dict[int, list[tuple[int, dict]]] = defaultdict(list)
    for i, row in enumerate(pdf.to_dict("records")):
        by[row["frame_id"]].append((i, row))
    return by


def track_court(rows: DataFrame, cfg: CourtConfig = CourtConfig()) -> DataFrame:
    def solve(pdf: pd.DataFrame) -> np.ndarray:
        tracker, ids = CourtTracker(cfg), np.full(len(pdf), -1)
        for _, some in sorted(_frames(pdf).items()):
            ids[[i for i, _ in some]] = tracker.step([seen_of(r) for _, r in some])
        return ids

    return _per_video(rows, solve)


def track_appearance(rows: DataFrame, cfg: AppearanceConfig = AppearanceConfig()) -> DataFrame:
    """Rows keep their player_id (e.g. a detector's rank) where no track takes them."""

    def solve(pdf: pd.DataFrame) -> np.ndarray:
        tracker = AppearanceTracker(cfg)
        ids = pdf.player_id.to_numpy().copy() if "player_id" in pdf else np.full(len(pdf), -1)
        for _, some in sorted(_frames(pdf).items()):
            at = [i for i, _ in some]
            ids[at] = tracker.step([seen_of(r) for _, r in some], ids[at].tolist())
        return ids

    ship(rows.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["frame_id", "det_idx"]).reset_index(drop=True)
        return pdf.assign(player_id=solve(pdf))

    return _spread(rows).groupBy("video_id").applyInPandas(run, rows.schema if "player_id" in rows.columns else rows.select("*").schema.add("player_id", "long"))
