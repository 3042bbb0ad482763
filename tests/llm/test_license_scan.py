"""Fuzzy spans against a scan of all substrings, and words that bear no edit."""

import math

import numpy as np
import pytest
import regex

from courtflux.llm import licenses


def parts_of(notice):
    """(text, exact) in order; a bare name stands between spaces."""
    out, at = [], 0
    for m in regex.finditer("|".join(rf"(?<![^ ]){regex.escape(w)}(?![^ ])" for w in notice.exact) or r"(?!)", notice.text):
        out += [(notice.text[at : m.start()], False), (m.group(), True)]
        at = m.end()
    out.append((notice.text[at:], False))
    return [p for p in out if p[0]]


def least_edits(notice, text):
    """The fewest edits of any substring from the notice, where exact words stand whole and unchanged; by dynamic programming."""
    spaced = f" {text} "
    if notice.bare:
        text = spaced
    n = len(text)
    cost = [0.0] * (n + 1) if not notice.bare else [0.0 if i and text[i - 1] == " " else math.inf for i in range(n + 1)]
    for part, exact in parts_of(notice):
        if exact:
            whole = lambda i, p=part: text.startswith(p, i) and (i == 0 or text[i - 1] == " ") and (i + len(p) == n or text[i + len(p)] == " ")
            new = [math.inf] * (n + 1)
            for i in range(n - len(part) + 1):
                if whole(i):
                    new[i + len(part)] = cost[i]
            cost = new
            continue
        for j in range(1, n + 1):
            cost[j] = min(cost[j], cost[j - 1] + 1)
        for c in part:
            new = [cost[0] + 1]
            for j in range(1, n + 1):
                new.append(min(cost[j] + 1, new[j - 1] + 1, cost[j - 1] + (text[j - 1] != c)))
            cost = new
    return min((x for i, x in enumerate(cost) if not notice.bare or (i < n and text[i] == " ")), default=math.inf)


def mutated(rng, notice):
    t = list(notice.text)
    for _ in range(int(rng.integers(0, notice.edits + 3))):
        at = int(rng.integers(0, len(t)))
        t[at : at + 1] = [[], ["q"], [t[at], "z"]][int(rng.integers(0, 3))]
    return " ".join("".join(t).split())


@pytest.mark.parametrize("notice", licenses.NOTICES, ids=lambda x: f"{x.label}-{x.text[:20]}")
def test_every_match_is_found(notice):
    rng = np.random.default_rng(len(notice.text))
    words = [*notice.text.split(), "the", "bsd", "1", "license", "permit", "cc"]
    for _ in range(12):
        pieces = [mutated(rng, notice) if rng.random() < 0.5 else " ".join(words[int(i)] for i in rng.integers(0, len(words), 4)) for _ in range(3)]
        text = " ".join(" ".join(pieces).split())
        spans = licenses.fuzzy(text, (notice,))
        best = least_edits(notice, text)
        assert bool(spans) == (best <= notice.edits), text
        if spans:
            assert min(s[3] for s in spans) == best, text
            assert all(least_edits(notice, text[a:b]) <= e <= notice.edits for _, a, b, e in spans)
            rest, at = [], 0
            for _, a, b, _ in spans:
                rest.append(text[at:a])
                at = b
            if not notice.bare:  # nothing is left over that matches
                assert all(least_edits(notice, r) > notice.edits for r in [*rest, text[at:]]), text


@pytest.mark.parametrize(
    "text, labels",
    [
        ("released under the BSD license", {"bsd"}),
        ("released under the ISC license", {"isc"}),
        ("ISC license", {"isc"}),
        ("a discus license", set()),
        ("CC BY-NC-SA 4.0", {"cc-by", "cc-by-nc-sa"}),
        ("CC-BY-NC-ND 4.0", {"cc-by", "cc-by-nc-nd"}),
        ("licensed under CC BY-NC-SA 4.0", {"cc-by", "cc-by-nc-sa"}),
        ("CC BY-SA 3.0 and CC BY 4.0", {"cc-by", "cc-by-sa"}),
        ("creative commons attribution noncommercial sharealike", {"cc-by-nc-sa"}),
        ("Creative Commons Attribution-NonCommercial-NoDerivatives", {"cc-by-nc-nd"}),
        ("Apache 2.0 license", {"apache-2.0"}),
        ("the Apache License 2.0", {"apache", "apache-2.0"}),
        ("GNU Library General Public License", {"lgpl"}),
        ("SPDX-License-Identifier: MIT", {"mit"}),
        ("SPDX-License-Identifer: Apache-2.0", {"apache-2.0"}),
        ("SPDX-License-Identifier: GPL-3.0-or-later", {"gpl-3.0"}),
        ("SPDX-License-Identifier: BSD-3-Clause", {"bsd"}),
        ("licensed under CC BY-ND 4.0", {"cc-by", "cc-by-nd"}),
        ("Mozilla Public License Version 1.1", {"mpl"}),
        ("Mozilla Public License Version 2.0", {"mpl-2.0"}),
        ("Licensed under the Apache License, Version 1.1", {"apache"}),
        ("GNU General Public License version 1", {"gpl"}),
        ("GNU General Public License version 2", {"gpl", "gpl-2.0"}),
        ("Creative Commons Attribution-NonCommercial", {"cc-by-nc"}),
        ("a permit license, a limit license", set()),
        ("released under the mip license released under the mit license", {"mit"}),
    ],
)
def test_labels(text, labels):
    _, places, spans = licenses.scan(text.encode())
    assert {x for x, _ in places} | {s.label for s in spans} == labels
