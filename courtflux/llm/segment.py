"""SentencePiece encoding and decoding: sampled segmentations without replacement (Gumbel top-k).

A text's lattice has an edge for each piece of the vocabulary at each place; a segmentation is a path and its probability the product of its
pieces' weights, normalised. The vocabulary's scores are merge ranks, so a piece weighs ``(1 + rank) ** -THETA``; characters beyond the
vocabulary fall back to their bytes. No piece joins two units (a word with the spaces before it, or a line break), which is checked when a
vocabulary is opened, so backward masses are found for each distinct unit of some texts at once; units that recur keep theirs.

The k paths of largest Gumbel-perturbed log probability are a sample without replacement. A best-first search finds them: the agenda holds
sets of paths (a shared beginning, a place, and the edges excluded there) under the exact perturbed maximum of each; the set with the
largest is opened, its best path emitted, and the rest of it split by where paths leave that one. The (k+1)-th maximum is the threshold
of the inclusion scores, 1 - exp(-exp(log_prob - threshold)).

Random numbers depend on the row's key, the round and the place only. Defined results: null and empty texts have one segmentation, without
pieces; a text with fewer than k segmentations gives them all, and inclusion 1 each. A null key counts as 0. A U+2581 in a text is taken
as a space, as the vocabulary does. Repeated rows get equal samples. An empty table gives none. Texts of any length are segmented whole;
the work of a text grows with its length. Paths of equal perturbed value (which random numbers don't give) keep the order they were found
in. Columns besides the key and the text are not read, so their names don't clash.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter, defaultdict
from functools import lru_cache
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common as C

K, THETA = 2, 1.0
SLICE_BYTES = 1 << 20
SPACE = "▁"
UNIT = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x2545F4914F6CDD1D)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)


def uniform(seed: np.ndarray, counter: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from seeds and counters, by the SplitMix64 finaliser."""
    x = seed + (counter.astype(np.uint64) + np.uint64(1)) * _GOLD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def row_seed(key: int | None, stream: int) -> np.uint64:
    mask = (1 << 64) - 1
    x = ((key or 0) * 0xD6E8FEB86659FD93 + (stream + 1) * 0xA0761D6478BD642F) & mask
    return np.uint64((x ^ x >> 32) * 0xD6E8FEB86659FD93 & mask)


class Vocabulary:
    """Pieces, their log weights, and their hashes for looking up many substrings at once."""

    def __init__(self, path: str, theta: float = THETA):
        from sentencepiece import SentencePieceProcessor

        p = SentencePieceProcessor(model_file=path)
        size = p.get_piece_size()
        names = [p.id_to_piece(i) for i in range(size)]
        self.byte_id = {int(x[3:5], 16): i for i, x in enumerate(names) if p.is_byte(i)}
        self.raw = [bytes([int(x[3:5], 16)]) if p.is_byte(i) else x.replace(SPACE, " ").encode() for i, x in enumerate(names)]
        self.log_weight: dict[str, tuple[float, int]] = {}
        for i, x in enumerate(names):
            if p.is_control(i) or p.is_unknown(i) or p.is_byte(i):
                continue
            if "\n" in x or SPACE in x.lstrip(SPACE):
                raise ValueError(f"piece {x!r} joins two units")
            self.log_weight[x] = (-theta * math.log(1 + min(-p.get_score(i), size)), i)
        self.longest = max(map(len, self.log_weight))
        self.log_byte = -theta * math.log(1.0 + size)
        self.fallback: list[tuple[int, ...]] = []
        self.fallback_of: dict[str, int] = {}
        pieces = list(self.log_weight)
        hashes = np.concatenate([self.hashes(np.array([list(map(ord, x)) for x in pieces if len(x) == n], np.uint64)) for n in range(1, self.longest + 1) if any(len(x) == n for x in pieces)])
        order = [x for n in range(1, self.longest + 1) for x in pieces if len(x) == n]
        by = np.argsort(hashes)
        self.hash = np.append(hashes[by], np.uint64(2**64 - 1))  # the end stops a search
        if (self.hash[1:-1] == self.hash[:-2]).any():
            raise ValueError("two pieces have one hash")
        # By a piece's place in the order of hashes plus one; 0 is no piece, and behind the pieces come 1 to 4 bytes of a character.
        logs = np.concatenate([[-np.inf], np.array([self.log_weight[x][0] for x in order])[by], self.log_byte * np.arange(1, 5)])
        self.weight = np.exp(logs)
        self.piece_id = np.concatenate([[0], np.array([self.log_weight[x][1] for x in order])[by], [0] * 4])
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.hash[:-1] >> np.uint64(44)] = True
        self.near = np.searchsorted(self.hash[:-1], np.arange(1 << 18, dtype=np.uint64) << np.uint64(46)).astype(np.int32)
        self.raw_size = np.fromiter(map(len, self.raw), np.int64, size)
        self.raw_start, self.raw_bytes = np.cumsum(self.raw_size) - self.raw_size, np.frombuffer(b"".join(self.raw), np.uint8)
        self.common = Common(self)

    def find(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are pieces', and their numbers in ``weight``."""
        may = np.flatnonzero(self.seen[m >> np.uint64(44)])
        m = m[may]
        at = self.near[m >> np.uint64(46)]
        late = np.flatnonzero(self.hash[at] < m)
        while len(late):
            at[late] += 1
            late = late[self.hash[at[late]] < m[late]]
        hit = np.flatnonzero(self.hash[at] == m)
        return may[hit], at[hit] + 1

    @staticmethod
    def hashes(rows: np.ndarray) -> np.ndarray:
        h = np.zeros(len(rows), np.uint64)
        for c in rows.T:
            h = h * _BASE + c
        return mixed(h)

    def bytes_of(self, char: str) -> int:
        """The id of a character's byte, or a negative number for its bytes as one edge."""
        own = char.encode()
        if len(own) == 1:
            return self.byte_id[own[0]]
        if char not in self.fallback_of:
            self.fallback.append(tuple(self.byte_id[b] for b in own))
            self.fallback_of[char] = -len(self.fallback)
        return self.fallback_of[char]

    def split(self, text: str) -> list[str]:
        return UNIT.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def decode(self, ids) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    def decoded(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of the pieces of each of many segmentations, the space that stands before a text included."""
        flat = np.concatenate(ids) if ids else np.empty(0, np.int64)
        size = self.raw_size[flat]
        ends = np.cumsum(size)
        every = self.raw_bytes[np.repeat(self.raw_start[flat] - (ends - size), size) + np.arange(int(size.sum()))].tobytes()
        cut = np.concatenate([[0], ends])[np.cumsum([0, *map(len, ids)])].tolist()
        return [every[a:z] for a, z in zip(cut, cut[1:])]

    def expand(self, ids: np.ndarray) -> np.ndarray:
        if len(ids) and ids.min() < 0:
            ids = np.array([j for i in ids.tolist() for j in ((i,) if i >= 0 else self.fallback[-i - 1])], np.int64)
        return ids


class Lattices:
    """Lattices of distinct units laid end to end: a node for each character, edges by node, the longest first, with running sums of their probabilities.

    They are made level by level from the units' ends. Units stand in order of falling length there, so a level, and where its edges of
    one size lead, are slices.
    """

    def __init__(self, v: Vocabulary, units: list[str]):
        self.length = np.fromiter(map(len, units), np.int64, len(units))
        stop = np.cumsum(self.length)
        self.first = stop - self.length
        joined = "".join(units)
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
        n, top = len(cp), int(self.length.max()) if len(units) else 0
        by = np.argsort(-self.length, kind="stable")
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        width = len(units) - np.concatenate([[0], np.cumsum(np.bincount(self.length, minlength=top + 1))[:-1]])  # units of a length or more
        level = np.concatenate([[0, 0], np.cumsum(width[1:])])  # where each level begins
        left = np.repeat(stop, self.length) - np.arange(n)  # characters from a node to its unit's end
        place = level[left] + np.repeat(rank, self.length)
        chars = np.empty(n, np.uint64)
        chars[place] = cp
        before = np.repeat(np.concatenate([[0], width[1:-1]]), width[1:]) if top else place  # from a node back to the next character's
        size = min(v.longest, top)
        piece = np.zeros((size, n), np.uint16 if len(v.weight) <= 1 << 16 else np.int32)
        h, at = np.zeros(n, np.uint64), np.arange(n)
        for k in range(size):
            h = h * _BASE + chars[at]
            hit, number = v.find(mixed(h))
            piece[k, hit + level[k + 1]] = number
            if k + 1 < size:
                beyond = level[k + 2] - level[k + 1]  # these end here
                h, at = h[beyond:], (at - before[at])[beyond:]
        bare = np.flatnonzero(piece[0] == 0) if n else place
        own = np.array([v.bytes_of(chr(int(c))) for c in chars[bare]], np.int64)
        if len(bare):
            piece[0, bare] = len(v.weight) - 5 + np.array([len(chr(int(c)).encode()) for c in chars[bare]])
        # Backward masses: of a level and the sizes before it; all of a unit's are scaled up before they vanish.
        mass = np.zeros((size + 1, len(units)))
        mass[0] = 1.0
        share = np.zeros((size, n))
        for k in range(1, top + 1):
            a, z, m = level[k], level[k + 1], min(k, size)
            rows = np.arange(k - 1, k - 1 - m, -1) % (size + 1)
            q = v.weight[piece[:m, a:z]] * mass[rows, : z - a]
            total = q.sum(0)
            if total.min() < 1e-200:
                small = np.flatnonzero(total < 1e-200)
                mass[:, small] *= 1e200
                total_up = total.copy()
                total_up[small] *= 1e200
                mass[k % (size + 1), : z - a] = total_up
            else:
                mass[k % (size + 1), : z - a] = total
            q /= total
            share[:m, a:z] = q
        # Edges by node in the units' order, from the longest.
        count = (piece > 0).sum(0)
        self.edge_start = np.concatenate([[0], np.cumsum(count[place])])
        free = np.empty(n, np.int64)
        free[place] = self.edge_start[:-1]
        m = int(self.edge_start[-1])
        self.step, self.id, self.cum, q = np.empty(m, np.int32), np.empty(m, np.int32), np.empty(m), np.empty(m)
        run, ids = np.zeros(n), v.piece_id
        for k in range(size - 1, -1, -1):
            at = np.flatnonzero(piece[k])
            to, p = free[at], share[k, at]
            run[at] += p
            self.step[to], self.id[to], self.cum[to], q[to] = k + 1, ids[piece[k, at]], run[at], p
            if k == 0 and len(bare):
                self.id[free[bare]] = own
            free[at] += 1
        if n:
            self.cum[self.edge_start[1:] - 1] = 1.0
        with np.errstate(divide="ignore"):
            self.log_q = np.log(q)
        self.q = q


class Common:
    """Lattices of units that recur: those of at least two of ``LOOK`` slices in a row, looked at anew every ``EVERY`` slices.

    They only save work: a unit's lattice is the same wherever it is made. They stand at the beginning of buffers, behind which each
    slice puts the lattices of its other units, so what one slice got is overwritten by the next.
    """

    LOOK, EVERY = 4, 256
    EDGES = ("step", "id", "cum", "q", "log_q")

    def __init__(self, v: Vocabulary):
        self.v, self.turn, self.seen = v, 0, Counter()
        self._keep([])

    def _keep(self, units: list[str]) -> None:
        self.index = {u: i for i, u in enumerate(units)}
        self.buffers = dict(vars(Lattices(self.v, units)))
        self.nodes, self.edges = len(self.buffers["edge_start"]) - 1, int(self.buffers["edge_start"][-1])

    def _behind(self, name: str, kept: int, new: np.ndarray) -> np.ndarray:
        have = self.buffers[name]
        if kept + len(new) > len(have):
            self.buffers[name] = np.empty(2 * (kept + len(new)), have.dtype)
            self.buffers[name][:kept] = have[:kept]
            have = self.buffers[name]
        have[kept : kept + len(new)] = new
        return have[: kept + len(new)]

    def lattices_of(self, index: dict[str, int]) -> Lattices:
        """Of the units in ``index``, which begins with ``self.index``."""
        own, out = Lattices(self.v, list(islice(index, len(self.index), None))), object.__new__(Lattices)
        out.length = self._behind("length", len(self.index), own.length)
        out.first = self._behind("first", len(self.index), own.first + self.nodes)
        out.edge_start = self._behind("edge_start", self.nodes + 1, own.edge_start[1:] + self.edges)
        for name in self.EDGES:
            setattr(out, name, self._behind(name, self.edges, getattr(own, name)))
        return out

    def note(self, index: dict[str, int]) -> None:
        """Told of each slice's units, when it is done with."""
        if self.turn < self.LOOK:
            self.seen.update(index.keys())
        self.turn += 1
        if self.turn == self.LOOK:
            self._keep([u for u, n in self.seen.items() if n > 1])
            self.seen = Counter()
        elif self.turn == self.EVERY:
            self.turn = 0


class Texts:
    """The lattices of some texts, by their units."""

    def __init__(self, v: Vocabulary, texts: list[str], keys: list[int | None]):
        self.v, self.keys = v, keys
        index: defaultdict[str, int] = defaultdict(None, v.common.index)
        index.default_factory = index.__len__
        units: list[int] = []
        count = []
        for t in texts:
            own = v.split(t)
            units += map(index.__getitem__, own)
            count.append(len(own))
        x = v.common.lattices_of(index)
        self.index = index
        self.unit = np.array(units, np.int64)
        self.start = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
        self.first, self.len = x.first[self.unit], x.length[self.unit]
        self.edge_start, self.cum, self.q, self.log_q, self.step, self.id = x.edge_start, x.cum, x.q, x.log_q, x.step, x.id
        total = np.concatenate([[0], np.cumsum(self.len)])
        self.place = total[:-1] - np.repeat(total[self.start[:-1]], count) if len(units) else total[:0]

    def walk(self, tokens: np.ndarray, seed: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sampled edges of the tokens (from character ``at`` on) in order, each one's number among ``tokens``, and its place in the text."""
        pos = np.zeros(len(tokens), np.int64) if at is None else at.copy()
        live, found = np.flatnonzero(pos < self.len[tokens]), []
        while len(live):
            t = tokens[live]
            place = self.place[t] + pos[live]
            node = self.first[t] + pos[live]
            edge, u = self.edge_start[node], uniform(seed[live], place)
            late = np.flatnonzero(self.cum[edge] <= u)
            while len(late):
                edge[late] += 1
                late = late[self.cum[edge[late]] <= u[late]]
            found.append((live, edge, place))
            pos[live] += self.step[edge]
            live = live[pos[live] < self.len[t]]
        counts = np.zeros(len(tokens), np.int64)
        for x, _, _ in found:
            counts[x] += 1
        offset = np.cumsum(counts) - counts
        edges, of, places = (np.empty(int(counts.sum()), np.int64) for _ in range(3))
        for x, edge, place in found:
            edges[offset[x]], of[offset[x]], places[offset[x]] = edge, x, place
            offset[x] += 1
        return edges, of, places


class Path:
    __slots__ = ("edges", "of", "places", "before")

    def __init__(self, edges: np.ndarray, of: np.ndarray, places: np.ndarray, log_q: np.ndarray):
        self.edges, self.of, self.places = edges, of, places
        self.before = np.concatenate([[0.0], np.cumsum(log_q[edges])])


class Row:
    """The search of one text."""

    __slots__ = ("found", "agenda", "order", "left", "excluded", "value", "path", "least")

    def __init__(self, path: Path, value: float):
        self.found, self.agenda, self.order, self.left, self.excluded, self.value, self.path, self.least = [], [], 0, 0, [], value, path, -math.inf


def top_k(x: Texts, k: int) -> list[tuple[list[tuple[float, Path]], float]]:
    """For each text up to k (perturbed value, path), best first, and the threshold (-inf if there are no more paths)."""
    docs = len(x.keys)
    if not docs:
        return []
    seeds = np.array([row_seed(i, 0) for i in x.keys], np.uint64)
    edges, of, places = x.walk(np.arange(len(x.unit)), np.repeat(seeds, np.diff(x.start)))
    ends = np.searchsorted(of, x.start)
    first = -np.log(-np.log(uniform(seeds, np.full(docs, 1 << 41))))
    rows = [Row(Path(edges[a:b], of[a:b], places[a:b], x.log_q), float(g)) for a, b, g in zip(ends, ends[1:], first)]
    live = list(range(docs))
    for r in range(1, k + 1):
        for d in live:
            rows[d].found.append((rows[d].value, rows[d].path))
        _open(x, rows, live, r, k + 1 - r)
        nxt = []
        for d in live:
            row = rows[d]
            if row.agenda:
                value, _, row.path, row.left, row.excluded = heapq.heappop(row.agenda)
                row.value = -value
                if r == k:
                    row.least = row.value
                else:
                    nxt.append(d)
        live = nxt
        if live:
            _sample(x, rows, live, r)
    return [(row.found, row.least) for row in rows]


def _open(x: Texts, rows: list[Row], live: list[int], r: int, most: int) -> None:
    """Puts on the agendas the best ``most`` of the sets of paths that leave each text's path at or after its ``left``."""
    some = [d for d in live if len(rows[d].path.edges) > rows[d].left]
    if not some:
        return
    size = np.array([len(rows[d].path.edges) - rows[d].left for d in some])
    start = np.cumsum(size) - size
    edges = np.concatenate([rows[d].path.edges[rows[d].left :] for d in some])
    places = np.concatenate([rows[d].path.places[rows[d].left :] for d in some])
    mass = np.concatenate([rows[d].path.before[rows[d].left : -1] for d in some])
    rest = 1.0 - x.q[edges]
    for a, d in zip(start.tolist(), some):
        if rows[d].excluded:
            rest[a] -= x.q[rows[d].excluded].sum()
    seed = np.repeat(np.array([row_seed(x.keys[d], r) for d in some], np.uint64), size)
    noise = -np.log(-np.log(uniform(seed, places + (1 << 40))))
    value = np.repeat(np.array([rows[d].value for d in some]), size)
    with np.errstate(divide="ignore", invalid="ignore"):
        top = -np.logaddexp(-value, -(mass + np.log(np.maximum(rest, 0)) + noise))
    top[rest <= 1e-12] = -np.inf
    which = np.repeat(np.arange(len(some)), size)
    for _ in range(most):
        best = np.maximum.reduceat(top, start)
        hit = np.flatnonzero((top == best[which]) & (top > -np.inf))
        own, at = np.unique(which[hit], return_index=True)
        if not len(own):
            break
        for j, i in zip(own.tolist(), hit[at].tolist()):
            row = rows[some[j]]
            off = i - int(start[j])
            row.order += 1
            heapq.heappush(row.agenda, (-float(top[i]), row.order, row.path, row.left + off, [*(row.excluded if off == 0 else ()), int(edges[i])]))
        top[hit[at]] = -np.inf


def _sample(x: Texts, rows: list[Row], live: list[int], r: int) -> None:
    """The best path of each popped set: its beginning, another edge at its place, and all that follows sampled anew."""
    seeds = np.array([row_seed(x.keys[d], 1000 + r) for d in live], np.uint64)
    token = np.array([rows[d].path.of[rows[d].left] for d in live])
    place = np.array([rows[d].path.places[rows[d].left] for d in live])
    node = x.first[token] + place - x.place[token]
    u = uniform(seeds, place)
    chosen = []
    for d, at, y in zip(live, node.tolist(), u.tolist()):
        choices = [e for e in range(x.edge_start[at], x.edge_start[at + 1]) if e not in rows[d].excluded]
        y *= float(x.q[choices].sum())
        for e in choices:
            y -= x.q[e]
            if y < 0:
                break
        chosen.append(e)
    size = x.start[np.array(live) + 1] - token
    begin = np.cumsum(size) - size
    tokens = np.repeat(token - begin, size) + np.arange(int(size.sum()))
    pos = np.zeros(len(tokens), np.int64)
    pos[begin] = place - x.place[token] + x.step[chosen]
    edges, of, places = x.walk(tokens, np.repeat(seeds, size), pos)
    ends = np.searchsorted(of, np.concatenate([begin, [len(tokens)]]))
    for d, e, t, p, a, z in zip(live, chosen, token, place, ends, ends[1:]):
        row, left = rows[d], rows[d].left
        old = row.path
        row.path = Path(np.concatenate([old.edges[:left], [e], edges[a:z]]), np.concatenate([old.of[:left], [t], tokens[of[a:z]]]), np.concatenate([old.places[:left], [p], places[a:z]]), x.log_q)


@lru_cache(2)
def vocabulary(path: str | None, theta: float) -> Vocabulary:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return Vocabulary(path, theta)


def segmentations(docs: DataFrame, k: int = K, theta: float = THETA, model: str | None = None, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """k sampled segmentations of every row's whole text; ``decoded_ok`` says that decoding gives the text back."""

    def f(part: pa.RecordBatch) -> dict:
        v = vocabulary(model, theta)
        texts, keys = C.text_list(part.column("text")), part.column(key).to_pylist()
        x = Texts(v, texts, keys)
        cols: dict[str, list] = {c: [] for c in ("doc_id", "rank", "n_pieces", "ids_crc32", "log_prob", "perturbed", "inclusion")}
        every, plain = [], []
        for text, row_key, (found, least) in zip(texts, keys, top_k(x, k)):
            own = (" " + text.replace(SPACE, " ")).encode() if text else b""
            for rank, (value, path) in enumerate(found, 1):
                ids = v.expand(x.id[path.edges])
                log_prob = float(path.before[-1])
                inclusion = 1.0 if least == -math.inf else -math.expm1(-math.exp(min(700.0, log_prob - least)))
                for c, y in zip(cols, (row_key, rank, len(ids), crc32(ids.astype("<u4").tobytes()), log_prob, value, inclusion)):
                    cols[c].append(y)
                every.append(ids)
                plain.append(own)
        v.common.note(x.index)
        return cols | {"decoded_ok": [a == b for a, b in zip(v.decoded(every), plain)], "ids": [ids.tolist() for ids in every] if with_ids else None}

    schema = "doc_id long, rank int, n_pieces long, ids_crc32 long, log_prob double, perturbed double, inclusion double, decoded_ok boolean"
    return C.map_text(docs, [key, "text"], schema + ", ids array<int>" * with_ids, f, SLICE_BYTES)


def op9_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentations(C.table(spark, sf_dir, "documents"))
