"""License scans: exact phrases of words, and fuzzy search for short notices.

Each notice with at most k edits is split into k + 1 pieces; by the pigeonhole principle one piece stands unchanged in any match. One
Aho-Corasick automaton finds all pieces, a piece's place bounds the window in which its notice can lie, and the ``regex`` library's
bounded-error matching verifies the edits there and gives the span. Words that tell one license from another (``exact``: "mit", "nc", a
version's numbers) must stand as whole words without an edit; a pattern takes them literally and allows edits only between them.

The text is searched as its lower-cased words joined by single spaces, so spans are in words. Defined results: null and empty texts have
no words, no labels and score 0. Of overlapping spans the one with the fewest edits stays, then the longest notice, then the earliest; the
bare names of licenses, which match whole words only, give way to the other notices. Repeated rows get equal results, an empty table
gives an empty one. Texts of any length are searched whole, a window at a time; other columns of the input are not read.
"""

from __future__ import annotations

from functools import cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Phrases of the base and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


class Notice(NamedTuple):
    label: str
    text: str
    edits: int
    exact: tuple[str, ...] = ()  # words that bear no edit
    bare: bool = False  # a license's bare name: whole words only


#: Short notices, lower-cased words, with the edits allowed and the words that must stand as they are.
NOTICES = (
    Notice("apache-2.0", "licensed under the apache license version 2 0", 4, ("2", "0")),
    Notice("gpl-3.0", "gnu general public license version 3", 3, ("3",)),
    Notice("gpl-2.0", "gnu general public license version 2", 3, ("2",)),
    Notice("lgpl", "gnu lesser general public license", 3),
    Notice("lgpl", "gnu library general public license", 3),
    Notice("agpl", "gnu affero general public license", 3),
    Notice("mit", "released under the mit license", 3, ("mit",)),
    Notice("mit", "permission is hereby granted free of charge to any person", 5),
    Notice("bsd", "redistribution and use in source and binary forms", 4),
    Notice("bsd", "released under the bsd license", 3, ("bsd",)),
    Notice("isc", "released under the isc license", 3, ("isc",)),
    Notice("mpl-2.0", "mozilla public license version 2 0", 3, ("2", "0")),
    Notice("mpl", "mozilla public license", 2),
    Notice("cc-by-nc", "licensed under cc by nc 4 0", 2, ("nc",)),
    Notice("cc-by-sa", "licensed under cc by sa 4 0", 2, ("sa",)),
    Notice("cc-by-nd", "licensed under cc by nd 4 0", 2, ("nd",)),
    Notice("cc-by-nc-sa", "licensed under cc by nc sa 4 0", 2, ("nc", "sa")),
    Notice("cc-by-nc-nd", "licensed under cc by nc nd 4 0", 2, ("nc", "nd")),
    Notice("cc-by-nc", "creative commons attribution noncommercial", 3),
    Notice("cc-by-nc-sa", "creative commons attribution noncommercial sharealike", 4),
    Notice("cc-by-nc-nd", "creative commons attribution noncommercial noderivatives", 4),
    Notice("cc-by-sa", "creative commons attribution sharealike", 3),
    Notice("cc-by-nd", "creative commons attribution noderivatives", 3),
    Notice("cc-by", "creative commons attribution", 2),
    Notice("cc0", "creative commons zero", 2),
    Notice("unlicense", "released into the public domain", 3),
    Notice("mit", "mit license", 2, ("mit",), True),
    Notice("apache", "apache license", 2, ("apache",), True),
    Notice("gpl", "gnu general public license", 3, (), True),
    Notice("apache-2.0", "apache 2 0 license", 1, ("apache", "2", "0"), True),
    Notice("apache-2.0", "apache license 2 0", 1, ("apache", "2", "0"), True),
    Notice("isc", "isc license", 0, ("isc",), True),
    Notice("cc-by-nc-sa", "cc by nc sa", 0, (), True),
    Notice("cc-by-nc-nd", "cc by nc nd", 0, (), True),
    Notice("cc-by-nc", "cc by nc", 0, (), True),
    Notice("cc-by-sa", "cc by sa", 0, (), True),
    Notice("cc-by-nd", "cc by nd", 0, (), True),
    Notice("cc-by", "cc by", 0, (), True),
    Notice("mit", "spdx license identifier mit", 2, ("mit",)),
    Notice("isc", "spdx license identifier isc", 2, ("isc",)),
    Notice("unlicense", "spdx license identifier unlicense", 2, ("unlicense",)),
    Notice("apache-2.0", "spdx license identifier apache 2 0", 2, ("apache", "2", "0")),
    Notice("mpl-2.0", "spdx license identifier mpl 2 0", 2, ("mpl", "2", "0")),
    Notice("gpl-2.0", "spdx license identifier gpl 2 0", 2, ("gpl", "2", "0")),
    Notice("gpl-3.0", "spdx license identifier gpl 3 0", 2, ("gpl", "3", "0")),
    Notice("lgpl", "spdx license identifier lgpl 2 1", 2, ("lgpl", "2", "1")),
    Notice("lgpl", "spdx license identifier lgpl 3 0", 2, ("lgpl", "3", "0")),
    Notice("agpl", "spdx license identifier agpl 3 0", 2, ("agpl", "3", "0")),
    Notice("bsd", "spdx license identifier bsd 2 clause", 2, ("bsd", "2")),
    Notice("bsd", "spdx license identifier bsd 3 clause", 2, ("bsd", "3")),
    Notice("cc0", "spdx license identifier cc0 1 0", 2, ("cc0", "1", "0")),
)

#: Maps bytes to lower case and what is no part of a word to spaces: words are [0-9a-z] and all beyond ASCII.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


class Span(NamedTuple):
    label: str
    first_word: int
    last_word: int
    edits: int
    length: int


def pieces(text: str, edits: int) -> list[tuple[int, str]]:
    """``edits + 1`` pieces of nearly equal lengths, with their places."""
    cuts = [len(text) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:])]


def pattern(x: Notice) -> regex.Pattern:
    """The notice with at most ``edits`` edits in each part between its exact words; the sum is tested on what is found."""
    parts, at = [], 0
    for m in regex.finditer("|".join(rf"(?<![^ ]){regex.escape(w)}(?![^ ])" for w in x.exact) or r"(?!)", x.text):
        parts += [(x.text[at : m.start()], False), (m.group(), True)]
        at = m.end()
    parts.append((x.text[at:], False))
    body = "".join(rf"(?<![^ ]){regex.escape(t)}(?![^ ])" if exact else rf"(?:{regex.escape(t, literal_spaces=True)}){{e<={x.edits}}}" for t, exact in parts if t)
    edge = " " if x.bare else ""
    return regex.compile(rf"(?b){edge}({body}){edge}")


@cache
def searcher(notices: tuple[Notice, ...] = NOTICES):
    """The automaton of all pieces, with (notice, place in it) of each, and the notices' patterns."""
    owners: dict[str, list[tuple[int, int]]] = {}
    for i, x in enumerate(notices):
        for at, piece in pieces(x.text, x.edits):
            owners.setdefault(piece, []).append((i, at))
    automaton = ahocorasick.Automaton()
    for piece, own in owners.items():
        automaton.add_word(piece, (len(piece), own))
    automaton.make_automaton()
    return automaton, [pattern(x) for x in notices], [[f" {w} " for w in x.exact] for x in notices]


def fuzzy(joined: str, notices: tuple[Notice, ...] = NOTICES) -> list[tuple[int, int, int, int]]:
    """(notice, start, end, edits) of the verified spans in a text of joined words; spans don't overlap."""
    automaton, patterns, needed = searcher(notices)
    spaced = f" {joined} "
    windows: dict[int, list[list[int]]] = {}
    for end, (size, own) in automaton.iter(joined):
        for i, at in own:
            k, n = notices[i].edits, len(notices[i].text)
            a, b = max(0, end + 1 - size - at - k), min(len(joined), end + 1 - size - at + n + k)
            mine = windows.setdefault(i, [])
            if mine and a <= mine[-1][1]:
                mine[-1][1] = max(mine[-1][1], b)
            else:
                mine.append([a, b])
    found = []
    for i, mine in sorted(windows.items()):
        mine.sort()
        merged: list[list[int]] = []
        for a, b in mine:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        edge = int(notices[i].bare)  # a bare name's pattern has the spaces around it, which two matches may share
        todo = [(a, b + 2 * edge) for a, b in merged]
        while todo:
            a, b = todo.pop()
            if a >= b or not all(w in spaced[a : b + 2] for w in needed[i]):
                continue
            # The best match of a window: if it has too many edits, all have. Others may stand on both of its sides.
            if (m := patterns[i].search(spaced if edge else joined, a, b)) and sum(m.fuzzy_counts) <= notices[i].edits:
                found.append((i, m.start(1) - edge, m.end(1) - edge, sum(m.fuzzy_counts)))
                todo += [(a, m.start() + edge), (max(m.end() - edge, m.start() + 1), b)]
    kept: list[tuple[int, int, int, int]] = []
    for x in sorted(found, key=lambda x: (notices[x[0]].bare, x[3], -len(notices[x[0]].text), x[1], x[0])):
        if all(x[2] <= y[1] or y[2] <= x[1] for y in kept):
            kept.append(x)
    return sorted(kept, key=lambda x: (x[1], x[0]))


def scan(text: bytes, notices: tuple[Notice, ...] = NOTICES) -> tuple[int, list[tuple[str, int]], list[Span]]:
    """The number of words, the exact phrases' (label, first word), and the fuzzy spans."""
    words = text.translate(WORD_BYTES).split()
    joined = b" " + b" ".join(words) + b" "
    places = []
    for phrase, label in PHRASES.items():
        want = b" " + phrase.encode() + b" "
        at = joined.find(want)
        while at >= 0:
            places.append((label, joined.count(b" ", 0, at)))
            at = joined.find(want, at + 1)
    spans = []
    body = joined[1:-1].decode()
    for i, a, b, edits in fuzzy(body, notices):
        while a < b and body[a] == " ":
            a += 1
        spans.append(Span(notices[i].label, body.count(" ", 0, a), body.count(" ", 0, b - 1), edits, len(notices[i].text)))
    return len(words), places, spans


def licenses(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """Per row the exact places, all labels, a score and the spans (label, first and last word, edits)."""

    def f(part: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
        for text in C.utf8_list(part.column("text")):
            n, places, spans = scan(text, notices)
            base = {x for x, _ in places}
            out["n_words"].append(n)
            out["n_base"].append(len(places))
            out["first_word"].append(min((p for _, p in places), default=None))
            out["last_word"].append(max((p for _, p in places), default=None))
            out["base_labels"].append(",".join(sorted(base)))
            out["labels"].append(",".join(sorted(base | {s.label for s in spans})))
            out["score"].append(max([1.0 if places else 0.0, *(1 - s.edits / s.length for s in spans)]))
            out["spans"].append([{"label": s.label, "first_word": s.first_word, "last_word": s.last_word, "edits": s.edits} for s in spans])
        return out | {"doc_id": part.column("doc_id")}

    return C.map_text(docs, ["doc_id", "text"], "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,last_word:long,edits:int>>", f)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses(C.table(spark, sf_dir, "documents"))
    text = F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["first_word"], s["last_word"], s["edits"]))
    return found.withColumn("spans", F.array_join(text, ","))
