"""Corpora of words to read against literal versions of their rules."""

import json
import math

import numpy as np

from courtflux.sources import corpora, readers


def _write(path, name, text):
    (path / name).write_text(text, encoding="utf-8")
    return str(path)


def _turn(points, corner):
    """The turn of a word, point by point."""
    p = np.array(points, float).reshape(-1, 2)
    mid = (p[0] + p[-1]) / 2
    d = ((p - mid) ** 2).sum(1)
    far = sorted(range(len(p)), key=lambda i: (d[i], i))[-2:]
    to = np.abs(p[far].mean(0) - mid)
    away = ((p - np.array(corner)) ** 2).sum(1)
    if away[0] + away[-1] <= away[far].sum():
        return 0 if to[0] >= to[1] else 90
    return 180 if to[0] >= to[1] else -90


def test_textocr(spark, tmp_path):
    """Any polygons, boxes that begin outside the picture, lists whose ids are out of order or have no annotation."""
    rng = np.random.default_rng(3)
    anns, lists, imgs = {}, {}, {}
    for i in range(12):
        imgs[f"p{11 - i}"] = {"id": f"p{11 - i}", "file_name": f"{i}.jpg"}
        own = [f"{i}_{k}" for k in rng.permutation(4)]
        lists[f"p{11 - i}"] = own + ["none"]
        for a in own:
            pts = [float(x) for x in rng.integers(0, 50, 2 * int(rng.integers(4, 8)))]
            anns[a] = {"utf8_string": str(rng.choice([".", "word", "."])), "bbox": [float(x) for x in rng.normal(5, 10, 2)] + [9.2, 3.0], "points": pts}
    doc = {"imgs": imgs, "imgToAnns": lists, "anns": anns | {"free": anns["0_0"]}}
    got = corpora.textocr(spark, _write(tmp_path, "a.json", json.dumps(doc)))
    want = []
    for image, (key, info) in enumerate(imgs.items()):
        for place, a in enumerate(lists[key]):
            if a in anns and anns[a]["utf8_string"] != ".":
                x, y, w, h = anns[a]["bbox"]
                x, y = max(0, math.floor(x)), max(0, math.floor(y))
                want.append((image, place, info["file_name"], "word", x, y, x + math.ceil(w), y + math.ceil(h), _turn(anns[a]["points"], (x, y))))
    assert sorted(tuple(r)[1:] for r in got.collect()) == sorted(want)
    assert got.select(corpora.crop_name().alias("n")).first().n.startswith("img_")


def test_coco_text_labels(spark, tmp_path):
    """Entities are read before the rules; null labels, other scripts and endings with a star go."""
    texts = ["a&lt;b", " x ", "&#35;1", "#", "*a", "a*", "a*b", "", " ", None, "&amp;amp;", "a#b"]
    ann = {"class": "machine printed", "language": "english", "legibility": "legible", "bbox": [1.5, 0.5, 3.2, 4.0]}
    doc = {
        "imgs": {"7": {"id": 7, "file_name": "7.jpg", "set": "train", "width": 6, "height": 100}, "8": {"id": 8, "file_name": "8.jpg", "set": "val", "width": 6, "height": 9}},
        "imgToAnns": {"7": list(range(len(texts))), "8": [0]},
        "anns": {str(i): ann | {"utf8_string": t} for i, t in enumerate(texts)},
    }
    got = corpora.coco_text(spark, _write(tmp_path, "c.json", json.dumps(doc)), "train")
    assert sorted((r.place, r.label) for r in got.collect()) == [(0, "a<b"), (1, "x"), (3, "#"), (6, "a*b"), (10, "&amp;")]
    assert {(r.x1, r.y1, r.x2, r.y2) for r in got.collect()} == {(0, 0, 6, 8)}
    assert corpora.coco_text(spark, _write(tmp_path, "c.json", json.dumps(doc)), "test").count() == 0


def test_faulty_documents(spark, tmp_path):
    """A file that is no JSON gives nothing and takes no other with it; an image without annotations has no word."""
    _write(tmp_path, "bad.json", "{")
    path = _write(tmp_path, "good.json", json.dumps({"a": [], "b": [{"transcription": " LocaL#3 ", "language": "LATIN", "illegibility": False, "points": [[1, 2], [0, 5]]}, {"transcription": None, "illegibility": False}]}))
    assert [tuple(r)[1:] for r in corpora.art(spark, path).collect()] == [(1, "b.jpg", "LocaL#3")]
    assert corpora.lsvt(spark, path).count() == 0
    assert corpora.open_images(spark, path).count() == 0 and corpora.textocr(spark, path).count() == 0


def test_label_files(spark, tmp_path):
    for n, text in (("1.txt", " One \nrest"), ("20.txt", "Two"), ("3.txt", ""), ("note.md", "no")):
        _write(tmp_path, n, text)
    got = {(r.file_name, r.label) for r in corpora.label_files(spark, str(tmp_path)).collect()}
    assert {x for x in got if x[1]} == {("IMG/1.jpg", "One"), ("IMG/20.jpg", "Two")}


def test_class_names(spark, tmp_path):
    for n, text in (("a", "nc: 2\nnames: ['x y', \"b\"]\n"), ("b", "names:\n\n  - x\n- 'y'\npath: p\n- z\n"), ("c", "names:\n  3: x\n  0: 'y: z'\n"), ("d", "path: names\n")):
        _write(tmp_path, f"{n}.yaml", text)
    got = sorted((r.path[-6], r.id, r.name) for r in readers.class_names(spark, str(tmp_path)).collect())
    assert got == [("a", 0, "x y"), ("a", 1, "b"), ("b", 0, "x"), ("b", 1, "y"), ("c", 0, "y: z"), ("c", 3, "x")]
