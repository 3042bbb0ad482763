"""Evaluation: detections, tracks, segments, identities, text."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..functions.text import normalized_edit_similarity
from ..runtime import ship, written
from .assign import assignment
from .detect import FRAME
from .enrich import prefixed
from .relops import paired, top_k
from .tracking import ious

IOUS = [round(0.5 + 0.05 * i, 2) for i in range(10)]


def precision_recall(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1; 0 where a denominator is 0."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return p, r, ratio(2 * p * r, p + r)


# -- detections ----------------------------------------------------------------------------------------------------------------


_NEAR = "array<struct<o:double,i:bigint>>"
_TAKEN = "array<array<struct<det_idx:bigint,confidence:double,hit:bigint>>>"


def matched(gt: DataFrame, pred: DataFrame, least: list[float], by: list[str] = ()) -> DataFrame:
    """Predictions at each IoU limit (column iou): ``gt_idx`` is the box taken, ``hit`` whether there is one.

    By falling confidence each prediction takes the free ground-truth box of largest IoU, if it reaches the limit. One fold over an
    image's predictions serves all limits; its state is what each has taken, and boxes under the lowest limit are left out beforehand.
    ``by`` are keys besides the image within which boxes meet.
    """
    keys = [*FRAME, *by]
    g = gt.groupBy(*keys).agg(F.collect_list(F.struct("det_idx", "x1", "y1", "x2", "y2")).alias("gt"))
    order = F.struct((-F.col("confidence")).alias("o"), "det_idx", "x1", "y1", "x2", "y2")
    p = pred.groupBy(*keys).agg(F.array_sort(F.collect_list(order)).alias("pred")).join(g, keys, "left")

    def candidate(x: Column) -> Column:
        scored = F.transform("gt", lambda k: F.struct((-G.iou(G.box_of(x), G.box_of(k))).alias("o"), k["det_idx"].cast("long").alias("i")))
        near = F.array_sort(F.filter(scored, lambda n: -n["o"] >= min(least)))
        return F.struct(x["det_idx"].cast("long").alias("det_idx"), (-x["o"]).cast("double").alias("confidence"), F.coalesce(near.cast(_NEAR), F.array().cast(_NEAR)).alias("near"))

    limits = F.array(*(F.lit(float(t)) for t in least))

    def step(state: Column, x: Column) -> Column:
        def one(own: Column, limit: Column) -> Column:
            free = F.filter(x["near"], lambda n: ~F.exists(own, lambda s: s["hit"].eqNullSafe(n["i"])))
            best = F.get(free, F.lit(0))
            return F.concat(own, F.array(F.struct(x["det_idx"].alias("det_idx"), x["confidence"].alias("confidence"), F.when(-best["o"] >= limit, best["i"]).alias("hit"))))

        return F.zip_with(state, limits, one)

    begin = F.array_repeat(F.array().cast("array<struct<det_idx:bigint,confidence:double,hit:bigint>>"), len(least)).cast(_TAKEN)
    folded = p.withColumn("pred", F.transform("pred", candidate)).select(*keys, F.posexplode(F.aggregate("pred", begin, step)).alias("t", "own"))
    rows = folded.select(*keys, F.get(limits, F.col("t")).alias("iou"), F.explode("own").alias("m"))
    return rows.select(*keys, "iou", F.col("m.det_idx").alias("det_idx"), F.col("m.confidence").alias("confidence"), F.col("m.hit").alias("gt_idx"), F.col("m.hit").isNotNull().alias("hit"))


def greedy_matches(gt: DataFrame, pred: DataFrame, least: float) -> DataFrame:
    """``matched`` at one limit."""
    return matched(gt, pred, [least]).drop("iou")


def _beside(rows: DataFrame, one: DataFrame, by: list[str]) -> DataFrame:
    """Rows with a small table's columns, by keys or, without keys, from its one row."""
    if by:
        return rows.join(F.broadcast(one), by, "left")
    return rows.withColumn("__k", F.lit(1)).join(F.broadcast(one.withColumn("__k", F.lit(1))), "__k").drop("__k")


def detection_scores(gt: DataFrame, pred: DataFrame, least: float = 0.5, by: list[str] = ()) -> DataFrame:
    """TP, FP, FN and their ratios over all images, for each value of ``by`` that the ground truth has."""
    by = list(by)
    hits = matched(gt, pred, [least], by).groupBy(*by).agg(F.sum(F.col("hit").cast("int")).alias("tp"), F.count("*").alias("m"))
    one = _beside(gt.groupBy(*by).agg(F.count("*").alias("n")), hits, by)
    one = one.withColumn("tp", F.coalesce("tp", F.lit(0))).withColumn("m", F.coalesce("m", F.lit(0)))
    tp, fp, fn = F.col("tp"), F.col("m") - F.col("tp"), F.col("n") - F.col("tp")
    p, r, f = precision_recall(tp, fp, fn)
    return one.select(*by, "tp", fp.alias("fp"), fn.alias("fn"), p.alias("precision"), r.alias("recall"), f.alias("f1"))


def precision_curve(matches: DataFrame, total: int | DataFrame, by: list[str] = ()) -> DataFrame:
    """Cumulative precision and recall by falling confidence, within each value of ``by``.

    Rows are sorted into ranges of confidence and, where that is equal, of frames; running sums are taken within ranges and added to the sums of
    those before, so that no window holds all rows, whatever their confidences. ``total`` is the number of ground-truth boxes, or a table of
    it (column total, and those of ``by`` that it depends on).
    """
    by = list(by)
    ties = [F.col(c) for c in (*FRAME, "det_idx")]
    m = written(matches.repartitionByRange(*by, F.desc("confidence"), *ties).withColumn("part", F.spark_partition_id()))
    parts = m.groupBy(*by, "part").agg(F.sum(F.col("hit").cast("long")).alias("h"), F.count("*").alias("c"))
    over = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select(*by, "part", F.coalesce(F.sum("h").over(over), F.lit(0)).alias("h0"), F.coalesce(F.sum("c").over(over), F.lit(0)).alias("c0"))
    w = Window.partitionBy(*by, "part").orderBy(F.desc("confidence"), *ties).rowsBetween(Window.unboundedPreceding, 0)
    run = m.withColumn("h1", F.sum(F.col("hit").cast("long")).over(w)).withColumn("c1", F.count("*").over(w)).join(base, [*by, "part"])
    run = run.withColumn("total", F.lit(total)) if isinstance(total, int) else _beside(run, total, [c for c in by if c in total.columns])
    tp, n = F.col("h0") + F.col("h1"), F.col("c0") + F.col("c1")
    return run.select(*by, "confidence", *FRAME, "det_idx", (tp / n).alias("precision"), (tp / F.greatest("total", F.lit(1))).alias("recall"))


def average_precision(curve: DataFrame, points: int = 101, by: list[str] = (), groups: DataFrame | None = None) -> DataFrame:
    """Mean over evenly spaced recalls of the best precision at that recall or beyond, for each of ``groups`` (else of the curve's)."""
    # A row counts for all recalls up to its own, so the maximum by its highest one, then a running maximum, is enough.
    by = list(by)
    step = points - 1
    top = curve.groupBy(*by, F.floor(F.col("recall") * step + 1e-9).cast("long").alias("t")).agg(F.max("precision").alias("p"))
    grid = curve.sparkSession.range(points).withColumnRenamed("id", "t")
    if by:
        all_groups = curve.select(*by).distinct() if groups is None else groups
        grid = all_groups.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(step).cast("long"))))
    w = Window.partitionBy(*by).orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(top, [*by, "t"], "left").select(*by, F.coalesce(F.max("p").over(w), F.lit(0.0)).alias("p")).groupBy(*by).agg(F.avg("p").alias("ap"))


def _total(gt: DataFrame, by: list[str] = ()) -> DataFrame:
    return gt.groupBy(*by).agg(F.count("*").alias("total"))


def average_precisions(gt: DataFrame, pred: DataFrame, least: list[float], by: list[str] = ()) -> DataFrame:
    """ap at each IoU limit (column iou), for each value of ``by`` that the ground truth has; one matching serves all."""
    by = list(by)
    total = _total(gt, by)
    limits = F.array(*(F.lit(float(t)) for t in least))
    groups = total.select(*by, F.explode(limits).alias("iou"))
    return average_precision(precision_curve(matched(gt, pred, least, by), total, [*by, "iou"]), by=[*by, "iou"], groups=groups)


def average_precision_at(gt: DataFrame, pred: DataFrame, least: float) -> DataFrame:
    return average_precisions(gt, pred, [least]).select("ap")


def mean_average_precision(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """ap at each of ten IoUs, and their mean as the row without one."""
    each = average_precisions(gt, pred, IOUS)
    return each.unionByName(each.agg(F.lit(None).cast("double").alias("iou"), F.avg("ap").alias("ap")))


def best_f1(curve: DataFrame, by: list[str] = ()) -> DataFrame:
    """The operating point with the largest F1; of equals the one of highest confidence."""
    p, r = F.col("precision"), F.col("recall")
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    pick = curve.withColumn("f1", f).groupBy(*by).agg(F.max_by(F.struct("confidence", "precision", "recall", "f1"), F.struct("f1", "confidence")).alias("x"))
    return pick.select(*by, "x.*")


def detector_report(gt: DataFrame, pred: DataFrame, kinds: dict[str, tuple[int, int]]) -> DataFrame:
    """For each kind of object (a range of class ids): P, R and F1 at IoU 0.5, AP there, and the mean AP over ten IoUs."""
    kind = F.coalesce(*(F.when(F.col("class_id").between(a, b), F.lit(k)) for k, (a, b) in kinds.items()))
    g, p = (d.withColumn("kind", kind).where("kind is not null") for d in (gt, pred))
    ap = average_precisions(g, p, IOUS, ["kind"]).groupBy("kind").agg(F.max(F.when(F.col("iou") == 0.5, F.col("ap"))).alias("ap50"), F.avg("ap").alias("map"))
    return detection_scores(g, p, 0.5, ["kind"]).join(ap, "kind")


def coco_summary(gt: DataFrame, pred: DataFrame, most: int = 100) -> DataFrame:
    """AP (mean over ten IoUs), AP50, AP75, AR (mean over them of the recall), and the best F1 at IoU 0.5; of an image's predictions the ``most`` surest count."""
    some = top_k(pred, FRAME, [F.desc("confidence"), F.col("det_idx")], most)
    curve = precision_curve(matched(gt, some, IOUS), _total(gt), ["iou"])
    ap = average_precision(curve, by=["iou"], groups=gt.sparkSession.createDataFrame([(t,) for t in IOUS], "iou double"))
    recall = curve.groupBy("iou").agg(F.max("recall").alias("r"))
    means = ap.join(recall, "iou", "left").agg(F.avg("ap").alias("ap"), *(F.max(F.when(F.col("iou") == t, F.col("ap"))).alias(n) for n, t in (("ap50", 0.5), ("ap75", 0.75))), (F.sum(F.coalesce("r", F.lit(0.0))) / len(IOUS)).alias("ar"))
    return _beside(means, best_f1(curve.where("iou = 0.5")).select(F.col("f1").alias("max_f1"), F.col("confidence").alias("max_f1_confidence")), [])


def true_positives(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Predictions with ``hits``, a flag for each of ten IoUs: each prediction keeps its nearest box, each box its nearest prediction."""
    pairs = prefixed(gt, "g_").join(prefixed(pred, "p_"), FRAME).select(*FRAME, "g_det_idx", "p_det_idx", G.iou(G.box("g_"), G.box("p_")).alias("near")).where(F.col("near") >= IOUS[0])
    mine = top_k(pairs, [*FRAME, "p_det_idx"], [F.desc("near"), F.col("g_det_idx")], 1)
    both = top_k(mine, [*FRAME, "g_det_idx"], [F.desc("near"), F.col("p_det_idx")], 1).select(*FRAME, F.col("p_det_idx").alias("det_idx"), "near")
    flags = F.array(*(F.coalesce(F.col("near") >= t, F.lit(False)) for t in IOUS))
    return pred.select(*FRAME, "det_idx", "confidence").join(both, [*FRAME, "det_idx"], "left").withColumn("hits", flags).drop("near")


def coverage(detections: DataFrame) -> DataFrame:
    """Frames, classes and boxes of each video."""
    return detections.groupBy("video_id").agg(F.countDistinct("frame_id").alias("frames"), F.countDistinct("class_id").alias("classes"), F.count("*").alias("boxes"))


# -- segments ------------------------------------------------------------------------------------------------------------------


def segment_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Of inclusive frame ranges."""
    both = F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0) + 1)
    return both / ((a1 - a0 + 1) + (b1 - b0 + 1) - both)


def segment_f1(gt: DataFrame, pred: DataFrame, least: float, keys: tuple[str, ...] = ("clip", "cls")) -> DataFrame:
    """Per class F1 where predictions, in order, each take the free segment of largest IoU, if it reaches ``least``."""
    k = list(keys)
    g = gt.groupBy(*k).agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("gt"))
    p = pred.groupBy(*k).agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("pred"))
    joined = g.join(p, k, "full_outer")
    empty = F.array().cast("array<struct<s:bigint,e:bigint>>")
    taken = F.array().cast("array<bigint>")

    def step(state: Column, x: Column) -> Column:
        free = F.filter(F.transform("g", lambda s, i: F.struct(s["s"].alias("s"), s["e"].alias("e"), i.cast("bigint").alias("i"))), lambda s: ~F.array_contains(state, s["i"]))
        best = F.array_min(F.transform(free, lambda s: F.struct((-segment_iou(s["s"], s["e"], x["s"], x["e"])).alias("o"), s["i"].alias("i"))))
        return F.when(-best["o"] >= least, F.concat(state, F.array(best["i"]))).otherwise(state)

    per = joined.select(*k, F.coalesce("gt", empty).alias("g"), F.coalesce("pred", empty).alias("p"))
    tp = F.size(F.aggregate("p", taken, step))
    counts = per.select(*k, tp.alias("tp"), (F.size("p") - tp).alias("fp"), (F.size("g") - tp).alias("fn"))
    total = counts.groupBy(k[-1]).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    pr, rc, f1 = precision_recall(F.col("tp"), F.col("fp"), F.col("fn"))
    return total.select("*", pr.alias("precision"), rc.alias("recall"), f1.alias("f1"))


def class_accuracy(rows: DataFrame) -> DataFrame:
    """Share of right labels of each class, and over all (``overall``, where label is null too)."""
    return rows.rollup("label").agg((F.grouping("label") == 1).alias("overall"), F.count("*").alias("n"), F.avg((F.col("label") == F.col("pred")).cast("double")).alias("accuracy"))


# -- identities ----------------------------------------------------------------------------------------------------------------


def reid_ranks(queries: DataFrame, gallery: DataFrame, block: int = 64, held: int = 1 << 25) -> DataFrame:
    """For each query (id, pid, v) the 1-based ranks by distance (then id) of the gallery rows that share its pid, but not its id.

    Queries go in groups of some ``block``, fewer where the gallery is so large that a group would have more than ``held`` distances. All rows of
    the gallery stream past each group, a row a vector; only their distances are kept, until each query's are sorted. The job is a product of the
    queries and the gallery by nature; its memory is not.
    """
    spark = queries.sparkSession
    ship(spark)
    size = max(1, min(block, held // max(1, gallery.count())))
    groups = max(1, -(-queries.count() // size))
    asked = queries.select(F.pmod(F.xxhash64("id"), F.lit(groups)).alias("part"), F.lit(True).alias("asks"), "id", "pid", "v")
    rows = gallery.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("part"), F.lit(False).alias("asks"), "id", "pid", "v")
    # As many tasks as groups, to a bound: AQE would merge such small inputs, whose work is large.
    tasks = min(groups, 10 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    both = asked.unionByName(rows).repartition(tasks, "part").sortWithinPartitions("part", F.desc("asks"))

    def opened(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return batch.column("id").to_numpy(zero_copy_only=False), batch.column("pid").to_numpy(zero_copy_only=False), batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)

    def ranked(asks: list, seen: list):
        if not asks or not seen:
            return
        qi, qp = (np.concatenate([x[k] for x in asks]) for k in (0, 1))
        gi, gp = (np.concatenate([x[k] for x in seen]) for k in (0, 1))
        for k in range(len(qi)):
            d = np.concatenate([x[2][k] for x in seen])
            order = np.lexsort((gi, d))
            order = order[gi[order] != qi[k]]
            at = np.flatnonzero(gp[order] == qp[k])
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), qi[k]), pa.int64()), pa.array(gi[order[at]], pa.int64()), pa.array(at + 1, pa.int64())], names=["q", "g", "rank"])

    def run(batches):
        now, asks, seen, vectors = None, [], [], None
        for batch in batches:
            part = batch.column("part").to_numpy()
            code = 2 * part + ~batch.column("asks").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(part)]
            for a, z in zip(cuts, cuts[1:]):
                if a == z:
                    continue
                if part[a] != now:
                    yield from ranked(asks, seen)
                    now, asks, seen, vectors = part[a], [], [], None
                some = opened(batch.slice(a, z - a))
                if batch.column("asks")[a].as_py():
                    asks.append(some)
                elif asks:
                    vectors = np.concatenate([x[2] for x in asks]) if vectors is None else vectors
                    seen.append((*some[:2], np.stack([((some[2] - x) ** 2).sum(1) for x in vectors])))
        yield from ranked(asks, seen)

    return both.mapInArrow(run, "q long, g long, rank long")


def reid_scores(ranks: DataFrame, tops: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """mAP and CMC over the queries that have a match."""
    hits = ranks.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("rank")))
    each = hits.groupBy("q").agg(F.avg(F.col("n") / F.col("rank")).alias("ap"), F.min("rank").alias("first"))
    return each.agg(F.count("*").alias("queries"), F.avg("ap").alias("map"), *(F.avg((F.col("first") <= k).cast("double")).alias(f"rank{k}") for k in tops))


# -- text ----------------------------------------------------------------------------------------------------------------------


def text_scores(rows: DataFrame, key: str = "dataset") -> DataFrame:
    """Accuracy, mean 1 - normalised edit distance, confidence and length of each data set, and over all (``overall``)."""
    sim = normalized_edit_similarity(F.col("pred"), F.col("gt"))
    return rows.rollup(key).agg((F.grouping(key) == 1).alias("overall"), F.count("*").alias("n"), F.avg((F.col("pred") == F.col("gt")).cast("double")).alias("accuracy"), F.avg(sim).alias("ned"), F.avg("conf").alias("confidence"), F.avg(F.length("pred")).alias("length"))


# -- tracks --------------------------------------------------------------------------------------------------------------------


def frame_matches(gt: np.ndarray, pred: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Optimal pairs of a frame's boxes (rows) with at least that IoU."""
    if not len(gt) or not len(pred):
        return []
    s = ious(gt[:, None], pred[None])
    r, c = assignment(-np.where(s >= least, s, 0.0))
    return [(int(i), int(j)) for i, j in zip(r, c) if s[i, j] >= least]


class Sequence:
    """A video's ground truth and predictions by frame, with IoUs; ids numbered from 0."""

    def __init__(self, gt: pd.DataFrame, pred: pd.DataFrame):
        box = ["x1", "y1", "x2", "y2"]
        self.g_ids, self.p_ids = ({v: i for i, v in enumerate(sorted(x.id.unique()))} for x in (gt, pred))
        self.frames = []
        by_g, by_p = (dict(list(x.groupby("frame_id"))) for x in (gt, pred))
        for f in sorted(by_g.keys() | by_p.keys()):
            g, p = by_g.get(f), by_p.get(f)
            gi = np.array([self.g_ids[v] for v in g.id], int) if g is not None else np.empty(0, int)
            pi = np.array([self.p_ids[v] for v in p.id], int) if p is not None else np.empty(0, int)
            s = ious(g[box].to_numpy(float)[:, None], p[box].to_numpy(float)[None]) if len(gi) and len(pi) else np.zeros((len(gi), len(pi)))
            self.frames.append((gi, pi, s))
        self.n_gt, self.n_pred = len(gt), len(pred)


def clear(seq: Sequence, least: float = 0.5) -> dict[str, float]:
    """CLEAR: matches prefer last frame's pairs, then IoU; switches are matches to another id than the last one."""
    tp = fp = fn = switches = 0
    total = 0.0
    last: dict[int, int] = {}
    before: dict[int, int] = {}
    for gi, pi, s in seq.frames:
        score = np.where(s >= least, s, 0.0)
        keep = np.array([[before.get(g) == p for p in pi] for g in gi], bool).reshape(s.shape)
        r, c = assignment(-(1000.0 * keep * (score > 0) + score))
        pairs = [(i, j) for i, j in zip(r, c) if s[i, j] >= least]
        before = {}
        for i, j in pairs:
            g, p = int(gi[i]), int(pi[j])
            switches += g in last and last[g] != p
            last[g] = before[g] = p
            total += s[i, j]
        tp, fp, fn = tp + len(pairs), fp + len(pi) - len(pairs), fn + len(gi) - len(pairs)
    return {"tp": tp, "fp": fp, "fn": fn, "idsw": int(switches), "iou_sum": float(total), "mota": (tp - fp - switches) / max(1, tp + fn), "motp": total / max(1, tp)}


def identity(seq: Sequence, least: float = 0.5) -> dict[str, float]:
    """IDF1 by one assignment of ids over the whole video."""
    both = np.zeros((len(seq.g_ids), len(seq.p_ids)))
    for gi, pi, s in seq.frames:
        i, j = np.nonzero(s >= least)
        np.add.at(both, (gi[i], pi[j]), 1)
    r, c = assignment(-both)
    tp = float(both[r, c].sum())
    return {"idtp": tp, "idf1": 2 * tp / max(1.0, seq.n_gt + seq.n_pred), "idp": tp / max(1, seq.n_pred), "idr": tp / max(1, seq.n_gt)}


def hota(seq: Sequence) -> dict[str, float]:
    """HOTA, DetA and AssA over 19 thresholds; matches maximise the ids' overall alignment times IoU."""
    g_count, p_count = np.zeros(len(seq.g_ids)), np.zeros(len(seq.p_ids))
    soft = np.zeros((len(seq.g_ids), len(seq.p_ids)))
    for gi, pi, s in seq.frames:
        np.add.at(g_count, gi, 1)
        np.add.at(p_count, pi, 1)
        if s.size:
            den = s.sum(0, keepdims=True) + s.sum(1, keepdims=True) - s
            soft[np.ix_(gi, pi)] += np.where(den > 1e-12, s / np.maximum(den, 1e-12), 0)
    align = soft / np.maximum(1e-12, g_count[:, None] + p_count[None] - soft)
    # Thresholds come after the matching, so one matching of each frame serves all.
    pairs = []
    for gi, pi, s in seq.frames:
        if s.size:
            r, c = assignment(-align[np.ix_(gi, pi)] * s)
            pairs.append((gi[r], pi[c], s[r, c]))
    g, p, value = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.empty(0, int), np.empty(0, int), np.empty(0))
    found = []
    for a in np.arange(0.05, 0.99, 0.05):
        ok = value >= a - 1e-12
        tp, hits = int(ok.sum()), np.zeros_like(soft)
        np.add.at(hits, (g[ok], p[ok]), 1)
        det = tp / max(1, seq.n_gt + seq.n_pred - tp)
        ass = float((hits * hits / np.maximum(1, g_count[:, None] + p_count[None] - hits)).sum() / max(1, tp))
        found.append((np.sqrt(det * ass), det, ass))
    h, d, a = np.mean(found, 0)
    return {"hota": float(h), "deta": float(d), "assa": float(a)}


def track_scores(gt: DataFrame, pred: DataFrame, least: float = 0.5) -> DataFrame:
    """CLEAR, identity and HOTA scores of each video, from rows (video_id, frame_id, id, x1..y2); a video is one task's group."""
    ship(gt.sparkSession)
    names = ["tp", "fp", "fn", "idsw", "iou_sum", "mota", "motp", "idtp", "idf1", "idp", "idr", "hota", "deta", "assa"]

    def run(g: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        seq = Sequence(g, p[p.id >= 0])
        video = (g if len(g) else p).video_id.iloc[0]
        return pd.DataFrame([{"video_id": video} | clear(seq, least) | identity(seq, least) | hota(seq)])

    cols = ["video_id", "frame_id", "id", "x1", "y1", "x2", "y2"]
    schema = "video_id long, " + ", ".join(f"{n} double" for n in names)
    return paired(gt.select(*cols), pred.select(*cols), "video_id", run, schema)


def overall(scores: DataFrame) -> DataFrame:
    """CLEAR from summed counts; the others as plain means."""
    tp, fn, fp, sw = (F.sum(c) for c in ("tp", "fn", "fp", "idsw"))
    return scores.agg(((tp - fp - sw) / (tp + fn)).alias("mota"), (F.sum("iou_sum") / tp).alias("motp"), F.avg("idf1").alias("idf1"), F.avg("hota").alias("hota"), F.count("*").alias("videos"))


def remap_ids(gt: DataFrame, pred: DataFrame, least: float = 0.5) -> DataFrame:
    """Predictions under the ground-truth ids they meet most, one to one; others get fresh ids above all."""
    ship(gt.sparkSession)
    pairs = prefixed(gt, "g_").join(prefixed(pred, "p_"), FRAME).where(G.iou(G.box("g_"), G.box("p_")) >= least)
    met = pairs.groupBy("video_id", "g_id", "p_id").count()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot_table(index="g_id", columns="p_id", values="count", fill_value=0)
        r, c = assignment(-m.to_numpy(float))
        return pd.DataFrame({"video_id": pdf.video_id.iloc[0], "id": m.columns[c], "to": m.index[r], "n": m.to_numpy()[r, c]}).query("n > 0")[["video_id", "id", "to"]]

    to = met.groupBy("video_id").applyInPandas(run, "video_id long, id long, to long")
    top = gt.groupBy("video_id").agg(F.max("id").alias("top"))
    ids = pred.select("video_id", "id").distinct().join(to, ["video_id", "id"], "left")
    fresh = F.row_number().over(Window.partitionBy("video_id", F.col("to").isNull()).orderBy("id"))
    mapped = ids.withColumn("k", fresh).join(top, "video_id", "left").select("video_id", "id", F.coalesce("to", F.coalesce("top", F.lit(0)) + F.col("k")).alias("new_id"))
    return pred.join(mapped, ["video_id", "id"])


def optimal_frame_pairs(gt: DataFrame, pred: DataFrame, least: float = 0.5) -> DataFrame:
    """Optimal IoU pairs of every frame."""
    ship(gt.sparkSession)
    box = ["x1", "y1", "x2", "y2"]

    def run(g: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        out = []
        by_p = dict(list(p.groupby("frame_id")))
        for f, own in g.groupby("frame_id"):
            q = by_p.get(f)
            if q is not None:
                own, q = own.sort_values("id"), q.sort_values("id")
                out += [(own.video_id.iloc[0], f, own.id.iloc[i], q.id.iloc[j]) for i, j in frame_matches(own[box].to_numpy(float), q[box].to_numpy(float), least)]
        return pd.DataFrame(out, columns=["video_id", "frame_id", "gt_id", "pred_id"])

    cols = ["video_id", "frame_id", "id", *box]
    return paired(gt.select(*cols), pred.select(*cols), "video_id", run, "video_id long, frame_id long, gt_id long, pred_id long")

