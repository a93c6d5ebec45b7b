"""SentencePiece encoding and decoding by a max-plus scan over the lattice of pieces.

A text, with spaces as U+2581 and one in front, is a path of pieces. A path weighs the sum of its pieces' scores; for a BPE model two
neighbouring pieces weigh minus infinity unless merging their joined text gives just these two. That holds for all neighbours of the BPE
result and of no other path of pieces that are their own BPE result: in a text, merges inside pieces run as they do alone, and the first merge across
a border would also run in the two pieces alone. So the heaviest path is exactly the library's encoding, for BPE and for unigram models. A
character without a piece is an unknown step and becomes its bytes.

No piece has a space after another character, so a path always breaks before a space that follows a non-space: such units are independent. All
new units of a batch of texts are scanned side by side in numpy: for each place in them the best weight over the edges that end there, with the
edge that gives it (``scan``); then all are traced back at once.

Every text is dealt in chunks of ``CHUNK`` characters wherever they fall. The state at a border is the piece that crosses it or ends there (its
end, its text); a chunk gives the matrix of best weights from each state at its left border to each at its right one, looking as far as the longest
piece beyond both. Matrices of a document are multiplied in (max, +) up a tree of ``ARITY`` children a node, which works as the product is
associative; then the best states are read off down the tree, and each chunk is traced back alone between its two states. The only chunk of a text has
no border inside the text, so it needs no matrix and is traced at once, by the same function.

Scale: one pass in Arrow batches, without a shuffle, for texts of one chunk. The chunks of longer ones are spread over the cluster and cut by a
checkpoint, so all passes see the same rows; a group of a tree's level holds at most ARITY matrices. Only the ids of one document come together, in its own
row. Caches of units and pairs are bounded and only save time.

Defined results: null and empty texts have no ids; U+2581 in a text is a space, as in the library; equal rows get equal ids; an empty table gives no rows;
extra columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 32_768
#: Children of a node in the tree of matrix products.
ARITY = 16
#: Units kept between batches.
MOST_UNITS = 150_000
#: Characters that are turned into ids at once.
CHARS_AT_ONCE = 600_000
SPACE = "▁"
UNKNOWN_PENALTY = 10.0

State = tuple[int, str]
#: The state of a text's two ends, and of a border that every path breaks at.
EDGE: State = (0, "")


def _mixed(h: np.ndarray, length: int) -> np.ndarray:
    h = (h + np.uint64(length)) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class _Edges:
    """Tables that find all edges of many lattices at once: hashes of the usable pieces and of their beginnings, and what may follow what."""

    BITS, MIX, STEP = 21, np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x100000001B3)

    def __init__(self, v: Pieces):
        self.v = v
        self.names = [p for p in v.ids if v.usable(p)]
        self.unknown = len(self.names)
        self.ids = np.array([*[v.ids[p] for p in self.names], -1], np.int32)
        self.scores = np.array([*[v.scores[p] for p in self.names], v.floor])
        by_length: dict[int, list[int]] = {}
        for i, p in enumerate(self.names):
            by_length.setdefault(len(p), []).append(i)
        self.longest = max(by_length)
        begins: dict[int, set[str]] = {}
        for p in self.names:
            for n in range(1, len(p) + 1):
                begins.setdefault(n, set()).add(p[:n])
        self.starts = np.zeros(1 << self.BITS, bool)
        for n, names in begins.items():
            self.starts[self._slot(self._hash(sorted(names), n))] = True
        self.exact = {n: self._sorted(self._hash([self.names[i] for i in own], n), np.array(own)) for n, own in by_length.items()}
        self.keys, self.good = np.full(1 << self.BITS, -1), np.zeros(1 << self.BITS, bool)

    @classmethod
    def _hash(cls, names: list[str], n: int) -> np.ndarray:
        c = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n).astype(np.uint64)
        h = np.zeros(len(c), np.uint64)
        for k in range(n):
            h = h * cls.STEP + c[:, k] + np.uint64(1)
        return _mixed(h, n)

    @classmethod
    def _slot(cls, h: np.ndarray) -> np.ndarray:
        return (h * cls.MIX >> np.uint64(64 - cls.BITS)).astype(np.int64)

    @staticmethod
    def _sorted(h: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(h)
        return h[order], own[order]

    def find(self, text: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """start, size and piece of all edges; ``room`` is how many characters are left in the unit. A character without a piece is an unknown step."""
        at = np.arange(len(text))
        h = np.zeros(len(text), np.uint64)
        starts, sizes, pieces = [], [], []
        for n in range(1, self.longest + 1):
            live = np.flatnonzero(room[at] >= n)
            at = at[live]
            if not len(at):
                break
            h = h[live] * self.STEP + text[at + n - 1] + np.uint64(1)
            key = _mixed(h, n)
            may = self.starts[self._slot(key)]
            if n == 1:  # a character that begins no piece is an unknown step; so is one that is no piece
                starts.append(at[~may])
            at, h, key = at[may], h[may], key[may]
            if n in self.exact:
                known, own = self.exact[n]
                where = np.minimum(np.searchsorted(known, key), len(known) - 1)
                hit = known[where] == key
                if n == 1:
                    starts[0] = np.concatenate([starts[0], at[~hit]])
                    sizes.append(np.ones(len(starts[0]), np.int64))
                    pieces.append(np.full(len(starts[0]), self.unknown))
                found = at[hit]
                starts.append(found)
                pieces.append(own[where[hit]])
                sizes.append(np.full(len(found), n))
        empty = np.empty(0, np.int64)
        return np.concatenate([*starts, empty]), np.concatenate([*sizes, empty]), np.concatenate([*pieces, empty])

    def allowed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether piece b may follow piece a; a character without a piece takes part in no merge. Known pairs stay in a table of fixed size."""
        key = a * (self.unknown + 1) + b
        slot = self._slot(key.astype(np.uint64))
        out = self.good[slot]
        free = (a == self.unknown) | (b == self.unknown)
        new = np.flatnonzero((self.keys[slot] != key) & ~free)
        if len(new):
            fresh, back = np.unique(key[new], return_inverse=True)
            names, n = self.names, self.unknown + 1
            ok = np.array([self.v.allowed(names[k // n], names[k % n]) for k in fresh.tolist()])
            out[new] = ok[back]
            at = self._slot(fresh.astype(np.uint64))
            self.keys[at], self.good[at] = fresh, ok
            # two new pairs of one slot: the later key stays, so its own answer must
            self.good[at] = ok[np.searchsorted(fresh, self.keys[at])]
        return out | free


@dataclass
class Pieces:
    """A vocabulary with its kind, and bounded caches."""

    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: list[int]
    raw: list[bytes]
    bpe: bool
    dummy_prefix: bool
    longest: int
    breaks: bool
    line_breaks: bool
    units: dict[str, bytes] = field(default_factory=dict)
    growth: dict[str, tuple] = field(default_factory=dict)
    floor: float = 0.0
    edges: _Edges | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"units": {}, "edges": None}

    # -- weights ---------------------------------------------------------------------------------------------

    def grown(self, piece: str) -> tuple[list[tuple[str, float]], list[tuple[str, float]]] | None:
        """The first and the last part of a piece while its characters merge, each with the score of the merge that ends it; None if they do not
        become the piece, or if a merge has a better score than the one before."""
        parts, score, none = list(piece), self.scores.get, -np.inf
        left, right, worst = [], [], np.inf
        while len(parts) > 1:
            ranks = [score(x + y, none) for x, y in zip(parts, parts[1:], strict=False)]
            best = max(ranks)
            if best == none or best > worst:
                return None
            i, worst = ranks.index(best), best
            if i == 0:
                left.append((parts[0], best))
            if i == len(parts) - 2:
                right.append((parts[-1], best))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [*left, (piece, none)], [*right, (piece, none)]

    def usable(self, piece: str) -> bool:
        return len(piece) == 1 or (piece in self.scores if not self.bpe else piece in self.growth)

    def allowed(self, a: str, b: str) -> bool:
        """Whether piece b may follow piece a; anything may follow a border.

        Two pieces stay apart if, as both grow in order of their merges' scores, no merge across their border ever comes first. Of equal
        scores the leftmost merge comes first.
        """
        if not self.bpe or not a or a not in self.growth or b not in self.growth:
            return True  # a character without a piece takes part in no merge
        xs, ys, score, i, j = self.growth[a][1], self.growth[b][0], self.scores.get, 0, 0
        while True:
            (x, end_x), (y, end_y) = xs[i], ys[j]
            across = score(x + y)
            if across is not None and across > end_x and across >= end_y:
                return False
            if end_x >= end_y:
                if end_x == -np.inf:
                    return True
                i += 1
            else:
                j += 1

    def score(self, piece: str) -> float:
        return self.scores.get(piece, self.floor)

    # -- lattice ---------------------------------------------------------------------------------------------

    def forward(self, text: str, start: int, last: str, stop: int) -> dict[int, dict[str, tuple[float, int, str]]]:
        """Best weight, and the state before, of each (end, last piece) with end <= stop, from ``start`` after piece ``last``.

        A unigram path needs no last piece to go on, so only the best piece of each end is kept.
        """
        best: dict[int, dict[str, tuple[float, int, str]]] = {start: {last: (0.0, -1, "")}}
        scores, longest = self.scores, self.longest
        for end in range(start + 1, stop + 1):
            here: dict[str, tuple[float, int, str]] = {}
            for s in range(max(start, end - longest), end):
                before = best.get(s)
                if not before:
                    continue
                piece = text[s:end]
                if (piece in scores or end - s == 1) and self.usable(piece):
                    for prev, (w, _, _) in before.items():
                        if (not prev and s == start) or self.allowed(prev, piece):
                            total = w + self.score(piece)
                            if self.bpe:
                                if piece not in here or total > here[piece][0]:
                                    here[piece] = (total, s, prev)
                            elif not here or total > next(iter(here.values()))[0]:
                                here = {piece: (total, s, prev)}
            best[end] = here
        return best

    @staticmethod
    def trace(best: dict, start: int, end: int, last: str) -> list[str]:
        out = []
        while end > start:
            out.append(last)
            _, end, last = best[end][last]
        return out[::-1]

    def to_ids(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            i = self.ids.get(p)
            if i is None:
                out.extend(self.byte_ids[b] for b in p.encode("utf-8", "surrogatepass"))
            else:
                out.append(i)
        return out

    def scan(self, units: list[str]) -> list[bytes]:
        """Ids, as 32-bit numbers, of the heaviest paths of texts between two borders.

        Step t takes all edges that end t characters into their unit: the weight of a path is that of the path before, plus the piece's
        score, plus (BPE) 0 or minus infinity for the pair of pieces; the greatest of each end stays. Of the paths of a BPE prefix only its
        BPE result is not minus infinity, so one last piece for each end carries all that the pairs need.
        """
        if self.edges is None:
            self.edges = _Edges(self)
        e = self.edges
        lens = np.fromiter(map(len, units), np.int64, len(units))
        text = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.cumsum(lens) - lens
        offset = np.arange(len(text)) - np.repeat(first, lens)
        start, size, piece = e.find(text, np.repeat(lens, lens) - offset)
        end = start + size  # ends and starts count within ``text``; a unit's own first place stands for "before it"
        depth = offset[start] + size
        order = np.argsort((depth * (len(text) + 1) + end) * (e.longest + 1) - size)  # by depth, then end, then longest first
        start, end, piece, depth = start[order], end[order], piece[order], depth[order]
        weight = np.full(len(text) + 1, -np.inf)  # by the last character's place
        last, back = np.full(len(text) + 1, -1), np.zeros(len(text) + 1, np.int64)
        bounds = np.searchsorted(depth, np.arange(1, int(lens.max(initial=0)) + 2))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            s, t, p = start[a:b], end[a:b] - 1, piece[a:b]
            inner = offset[s] > 0
            total = np.where(inner, weight[s - 1], 0.0)
            live = np.flatnonzero(total > -np.inf)
            s, t, p, inner, total = s[live], t[live], p[live], inner[live], total[live] + e.scores[p[live]]
            if self.bpe:
                bad = inner.copy()
                bad[inner] = ~e.allowed(last[s[inner] - 1], p[inner])
                keep = np.flatnonzero(~bad)
                s, t, p, total = s[keep], t[keep], p[keep], total[keep]
            if not len(t):
                continue
            heads = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            best = np.maximum.reduceat(total, heads)
            win = np.flatnonzero(total == np.repeat(best, np.diff(np.append(heads, len(t)))))[::-1]  # of equals the first, that is the longest, is written last
            weight[t[win]], last[t[win]], back[t[win]] = total[win], p[win], s[win]
        who = np.arange(len(units))[lens > 0]
        at = (first + lens - 1)[lens > 0]
        found = []
        while len(who):
            found.append((who, last[at]))
            s = back[at]
            more = offset[s] > 0
            who, at = who[more], s[more] - 1
        owner = np.concatenate([w for w, _ in found] or [np.empty(0, np.int64)])
        pieces = np.concatenate([p for _, p in found] or [np.empty(0, np.int64)])
        order = np.argsort(owner[::-1], kind="stable")
        owner, pieces = owner[::-1][order], pieces[::-1][order]
        data = e.ids[pieces].tobytes()
        ends = (4 * np.cumsum(np.bincount(owner, minlength=len(units)))).tolist()
        out = [data[a:b] for a, b in zip([0, *ends][:-1], ends, strict=True)]
        for u in np.unique(owner[pieces == e.unknown]).tolist():  # characters without a piece become bytes
            own, place = [], 0
            for p in pieces[owner == u].tolist():
                name = units[u][place] if p == e.unknown else e.names[p]
                own.append(name)
                place += len(name)
            out[u] = np.array(self.to_ids(own), np.int32).tobytes()
        return out

    def _split(self, text: str) -> list[str]:
        """The independent units of a text."""
        if not self.breaks:
            return [text] if text else []
        if not self.line_breaks or SPACE * 2 in text:
            return (_UNIT_LINE if self.line_breaks else _UNIT).findall(text)
        out: list[str] = []
        for n, line in enumerate(text.split("\n")):
            if n:
                out.append("\n")
            if line == SPACE:
                out.append(SPACE)
            elif line:
                first, *rest = line.split(SPACE)  # as the pattern does where no two spaces meet
                if first:
                    out.append(first)
                out += [SPACE + w for w in rest]
        return out

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts that begin and end at borders (spaces already replaced)."""
        parts = list(map(self._split, texts))
        need = set(chain.from_iterable(parts))
        new = list(need - self.units.keys())
        if len(self.units) + len(new) > MOST_UNITS:
            self.units = {u: self.units[u] for u in need if u in self.units}
        self.units.update(zip(new, self.scan(new), strict=True))
        return [np.frombuffer(b"".join(map(self.units.__getitem__, p)), np.int32) for p in parts]

    def cuts(self, text: str) -> list[int]:
        """Places where every path breaks."""
        return [m.end() for m in re.finditer(f"[^{SPACE}](?={SPACE})", text)] if self.breaks else []

    def prepared(self, text: str) -> str:
        return (SPACE if self.dummy_prefix and text else "") + text.replace(" ", SPACE)

    # -- chunks ----------------------------------------------------------------------------------------------

    def _breaks_at(self, text: str, border: int) -> bool:
        """Whether every path breaks at a border: an end of the text, or before a space after another character."""
        return border <= 0 or border >= len(text) or (self.breaks and text[border] == SPACE and text[border - 1] != SPACE)

    def states(self, text: str, border: int) -> list[State]:
        """Pieces that cross or end at a border inside ``text``, by their end relative to it."""
        if self._breaks_at(text, border):
            return [EDGE]
        found = []
        for s in range(max(0, border - self.longest), border):
            for e in range(border, min(len(text), s + self.longest) + 1):
                piece = text[s:e]
                if (piece in self.scores or e - s == 1) and self.usable(piece):
                    found.append((e - border, piece))
        return found if self.bpe else sorted({(e, "") for e, _ in found})

    def _arrivals(self, text: str, lo: int, best: dict, hi: int) -> dict[State, tuple[float, int, str]]:
        """States at border ``hi`` reached from the lattice ``best`` over text up to it: weight, and the end and piece before."""
        out: dict[State, tuple[float, int, str]] = {}
        if self._breaks_at(text, hi):
            for p, (w, _, _) in best.get(hi, {}).items():
                if EDGE not in out or w > out[EDGE][0]:
                    out[EDGE] = (w, hi, p)
            return out
        for s in range(max(lo, hi - self.longest), hi):
            for prev, (w, _, _) in best.get(s, {}).items():
                for e in range(hi, min(len(text), s + self.longest) + 1):
                    piece = text[s:e]
                    if (piece in self.scores or e - s == 1) and self.usable(piece) and ((not prev and s == lo) or self.allowed(prev, piece)):
                        key, total = (e - hi, piece if self.bpe else ""), w + self.score(piece)
                        if key not in out or total > out[key][0]:
                            out[key] = (total, s, prev) if s < hi else out.get(key, (total, s, prev))
        return out

    def matrix(self, text: str, lo: int, hi: int) -> list[tuple[State, State, float]]:
        """Best weights from each state at border lo to each state at border hi of ``text`` (which also has what surrounds them)."""
        out = []
        inner = [c for c in self.cuts(text) if lo < c < hi]
        for state in self.states(text, lo):
            at, last = lo + state[0], state[1]
            if at > hi:  # the crossing piece spans the whole chunk
                out.append((state, (at - hi, last), 0.0))
                continue
            if inner and at <= inner[0]:
                head = self.forward(text, at, last, inner[0])[inner[0]] if at < inner[0] else {last: (0.0, -1, "")}
                if not head:
                    continue
                w = max(x[0] for x in head.values())
                tail = self.forward(text, inner[-1], "", hi)
                out.extend((state, j, w + x[0]) for j, x in self._arrivals(text, inner[-1], tail, hi).items())
            elif at == hi:
                out.append((state, (0, last if self.bpe else "") if self.states(text, hi) != [EDGE] else EDGE, 0.0))
            else:
                best = self.forward(text, at, last, hi)
                out.extend((state, j, x[0]) for j, x in self._arrivals(text, at, best, hi).items())
        return out

    def between(self, chunks: list[tuple[str, int, int, State, State]]) -> list[np.ndarray]:
        """Ids of the pieces that start in the chunks (text, lo, hi), entered and left in the given states.

        What lies between a chunk's first and last certain break goes to one scan for all chunks.
        """
        heads, middles, tails = [], [], []
        for text, lo, hi, enter, leave in chunks:
            at, last = lo + enter[0], enter[1]
            head, middle, tail = [], "", []
            ends_sure = leave == EDGE and self._breaks_at(text, hi)
            if at < hi:
                if at == lo and enter == EDGE and ends_sure and self._breaks_at(text, lo):
                    middle = text[lo:hi]
                else:
                    inner = [c for c in self.cuts(text) if lo < c < hi]
                    if inner and at <= inner[0]:
                        if at < inner[0]:
                            best = self.forward(text, at, last, inner[0])
                            end = max(best[inner[0]].items(), key=lambda x: x[1][0])[0]
                            head = self.to_ids(self.trace(best, at, inner[0], end))
                        middle = text[inner[0] : inner[-1]]
                        at, last = inner[-1], ""
                    best = self.forward(text, at, last, hi)
                    _, s, prev = self._arrivals(text, at, best, hi)[leave]
                    pieces = self.trace(best, at, s, prev)
                    if s < hi:
                        pieces.append(leave[1] if self.bpe else text[s : hi + leave[0]])
                    tail = self.to_ids(pieces)
            heads.append(head)
            middles.append(middle)
            tails.append(tail)
        whole = self.whole(middles)
        return [np.concatenate([np.array(h, np.int32), m, np.array(t, np.int32)]) if h or t else m for h, m, t in zip(heads, whole, tails, strict=True)]

    # -- decoding --------------------------------------------------------------------------------------------

    def decode(self, ids: list[int]) -> str:
        return decoded(ids, self.raw, self.dummy_prefix)


_UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Where no piece has a line feed, every path also breaks on both of its sides.
_UNIT_LINE = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


def load(model: str = MODEL) -> Pieces:
    """The vocabulary of a model file, read on the driver."""
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(model, "rb") as f:
        proto.ParseFromString(f.read())
    normal = proto.normalizer_spec
    if normal.name != "identity" or normal.remove_extra_whitespaces or not normal.escape_whitespaces:
        raise ValueError("only models without text normalisation are supported")
    kinds = proto.SentencePiece
    if proto.trainer_spec.model_type not in (1, 2):
        raise ValueError("only unigram and BPE models are supported")
    SentencePieceProcessor(model_file=model)  # checks the file
    ids, scores, byte_ids, raw = {}, {}, [0] * 256, []
    for i, p in enumerate(proto.pieces):
        if p.type == kinds.BYTE:
            byte_ids[int(p.piece[1:-1], 16)] = i
            raw.append(bytes([int(p.piece[1:-1], 16)]))
        elif p.type == kinds.NORMAL:
            ids[p.piece], scores[p.piece] = i, p.score
            raw.append(p.piece.encode())
        else:
            raw.append(b"")
    if not all(byte_ids):
        raise ValueError("the model must have byte pieces")
    if not set("".join(ids)) <= ids.keys():
        raise ValueError("each character of a piece must be a piece")
    breaks = not any(SPACE in p.lstrip(SPACE) for p in ids)
    v = Pieces(ids, scores, byte_ids, raw, proto.trainer_spec.model_type == 2, normal.add_dummy_prefix, max(map(len, ids)), breaks, not any("\n" in p for p in ids), floor=min(scores.values()) - UNKNOWN_PENALTY)
    if v.bpe:
        name = {p: p for p in ids}  # parts of pieces are pieces: the same strings serve for both
        v.growth = {p: tuple(tuple((name[x], w) for x, w in side) for side in g) for p in ids if (g := v.grown(p)) is not None}
    return v


def decoded(ids: list[int], raw: list[bytes], dummy_prefix: bool) -> str:
    text = b"".join(map(raw.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
    return text[1:] if dummy_prefix and text.startswith(" ") else text


def product(a: list[tuple[State, State, float]], b: list[tuple[State, State, float]]) -> list[tuple[State, State, float]]:
    """(max, +) product of two transfer matrices."""
    by: dict[State, list[tuple[State, float]]] = {}
    for i, j, w in b:
        by.setdefault(i, []).append((j, w))
    out: dict[tuple[State, State], float] = {}
    for i, j, w in a:
        for k, x in by.get(j, ()):
            if w + x > out.get((i, k), -np.inf):
                out[i, k] = w + x
    return [(i, k, w) for (i, k), w in out.items()]


def best_states(matrices: list[list[tuple[State, State, float]]], enter: State = EDGE, leave: State = EDGE) -> list[State]:
    """The states at the borders of neighbouring chunks on the heaviest path from ``enter`` to ``leave``, both included."""
    before: list[dict[State, tuple[float, State]]] = [{enter: (0.0, enter)}]
    for m in matrices:
        now: dict[State, tuple[float, State]] = {}
        for i, j, w in m:
            if i in before[-1] and (j not in now or before[-1][i][0] + w > now[j][0]):
                now[j] = (before[-1][i][0] + w, i)
        before.append(now)
    out = [leave]
    for step in before[:0:-1]:
        out.append(step[out[-1]][1])
    return out[::-1]


_STATE = "struct<end:int,piece:string>"
_MATRIX = f"array<struct<i:{_STATE},j:{_STATE},w:double>>"


def _plain(m) -> list[tuple[State, State, float]]:
    return [((x["i"]["end"], x["i"]["piece"]), (x["j"]["end"], x["j"]["piece"]), x["w"]) for x in m]


def _rows(m: list[tuple[State, State, float]]) -> list[dict]:
    return [{"i": {"end": i[0], "piece": i[1]}, "j": {"end": j[0], "piece": j[1]}, "w": w} for i, j, w in m]


def _ids_column(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.empty(0, np.int32)])))


def _traced(sent, check: bool = False):
    """ids of chunks with the columns t, lo, hi, enter, leave in place of these; the others stay. ``check`` is for whole texts: it adds whether the
    ids give the text back."""
    own = ("t", "lo", "hi", "enter", "leave")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        for b in batches:
            keep = [c for c in b.schema.names if c not in own]
            size = np.cumsum(pa.compute.utf8_length(b.column("t")).to_numpy(zero_copy_only=False))
            at = 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHARS_AT_ONCE, "right")))
                part = b.slice(at, to - at)
                at = to
                t, lo, hi, enter, leave = (part.column(c).to_pylist() for c in own)
                ids = v.between([(x.replace(" ", SPACE), a, z, (i["end"], i["piece"]), (j["end"], j["piece"])) for x, a, z, i, j in zip(t, lo, hi, enter, leave, strict=True)])
                out, names = [*[part.column(c) for c in keep], _ids_column(ids)], [*keep, "ids"]
                if check:
                    same = [v.decode(i.tolist()) == x[v.dummy_prefix and x != "" :] for i, x in zip(ids, t, strict=True)]
                    out, names = [*out, pa.array(same, pa.bool_())], [*names, "round_trip"]
                yield pa.RecordBatch.from_arrays(out, names)

    return run


def _states_of(chunks: DataFrame, sent) -> DataFrame:
    """row, part, enter and leave of the chunks of texts that have several: products up a tree, states down it."""

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = sent.value
        for b in batches:
            yield pd.DataFrame({"row": b["row"], "part": b["part"], "m": [_rows(p.matrix(t.replace(" ", SPACE), lo, hi)) for t, lo, hi in zip(b["t"], b["lo"], b["hi"], strict=True)]})

    def up(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        total = _plain(pdf["m"].iloc[0])
        for m in pdf["m"].iloc[1:]:
            total = product(total, _plain(m))
        return pd.DataFrame({"row": pdf["row"].iloc[:1].to_list(), "part": [int(pdf["part"].iloc[0]) // ARITY], "m": [_rows(total)]})

    def down(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        i, j = pdf["enter"].iloc[0], pdf["leave"].iloc[0]
        found = best_states([_plain(m) for m in pdf["m"]], (i["end"], i["piece"]), (j["end"], j["piece"]))
        s = [{"end": e, "piece": p} for e, p in found]
        return pd.DataFrame({"row": pdf["row"], "part": pdf["part"], "enter": s[:-1], "leave": s[1:]})

    level = cut(chunks.select("row", "part", "t", "lo", "hi").mapInPandas(matrices, f"row long, part int, m {_MATRIX}"))
    levels, top = [level], level.agg(F.max("part")).first()[0]
    while top:
        node = F.floor(F.col("part") / ARITY)
        level = cut(level.groupBy("row", node.alias("node")).applyInPandas(up, f"row long, part int, m {_MATRIX}"))
        levels.append(level)
        top //= ARITY
    edge = F.struct(F.lit(0).alias("end"), F.lit("").alias("piece"))
    found = levels[-1].select("row", "part", edge.alias("enter"), edge.alias("leave"))
    for level in levels[-2::-1]:
        above = found.select("row", F.col("part").alias("node"), "enter", "leave")
        child = level.withColumn("node", F.floor(F.col("part") / ARITY).cast("int")).join(above, ["row", "node"])
        found = child.groupBy("row", "node").applyInPandas(down, f"row long, part int, enter {_STATE}, leave {_STATE}")
    return found


def encode(docs: DataFrame, model: str = MODEL, chunk: int = CHUNK, check: bool = False) -> DataFrame:
    """doc_id and ids of every document; with ``check`` also round_trip, whether decoding gives the text back."""
    sent = docs.sparkSession.sparkContext.broadcast(load(model))
    v = sent.value
    margin = v.longest
    if chunk <= 2 * margin:
        raise ValueError("chunks must be longer than two of the longest piece")
    text = F.coalesce("text", F.lit(""))
    ready = F.when(text == "", "").otherwise(F.concat(F.lit(SPACE if v.dummy_prefix else ""), text))
    rows = docs.select("doc_id", text.alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    edge = F.struct(F.lit(0).alias("end"), F.lit("").alias("piece"))
    one = rows.filter(F.length("text") < chunk).select("doc_id", ready.alias("t")).select("doc_id", "t", F.lit(0).alias("lo"), F.length("t").alias("hi"), edge.alias("enter"), edge.alias("leave"))
    whole = one.mapInArrow(_traced(sent, check), f"doc_id {kind}, ids array<int>{', round_trip boolean' if check else ''}")
    # one pass over a long text cuts it; each chunk also has the ends of its neighbours
    several = rows.filter(F.length("text") >= chunk).select("doc_id", F.sha2("text", 256).alias("sha"), F.monotonically_increasing_id().alias("row"), F.regexp_extract_all(ready, F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0)).alias("cells"))
    cell = lambda i: F.coalesce(F.get("cells", i), F.lit(""))
    dealt = F.transform("cells", lambda c, i: F.struct(i.alias("part"), F.right(cell(i - 1), F.lit(margin)).alias("left"), c.alias("own"), F.left(cell(i + 1), F.lit(margin)).alias("right")))
    several = several.select("doc_id", "sha", "row", F.inline(dealt)).select(
        "doc_id", "sha", "row", "part", F.concat("left", "own", "right").alias("t"), F.length("left").alias("lo"), (F.length("left") + F.length("own")).alias("hi"))
    chunks = cut(several.repartition("row", "part"))
    if chunks.isEmpty():
        return whole
    parts = chunks.join(_states_of(chunks, sent), ["row", "part"]).mapInArrow(_traced(sent), f"row long, part int, doc_id {kind}, sha string, ids array<int>")
    joined = parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("sha").alias("sha"), F.array_sort(F.collect_list(F.struct("part", "ids"))).alias("parts"))
    joined = joined.select("doc_id", "sha", F.flatten(F.transform("parts", lambda x: x["ids"])).alias("ids"))
    if check:
        joined = decode(joined, model, "_back").withColumn("round_trip", F.sha2("_back", 256) == F.col("sha"))
    return whole.unionByName(joined.select(*whole.columns))


def decode(rows: DataFrame, model: str = MODEL, to: str = "text") -> DataFrame:
    """Add the text of ``ids``."""
    v = load(model)
    sent = rows.sparkSession.sparkContext.broadcast((v.raw, v.dummy_prefix))

    def run(ids: pd.Series) -> pd.Series:
        return pd.Series([decoded(x.tolist(), *sent.value) for x in ids])

    return rows.withColumn(to, F.pandas_udf(run, "string")("ids"))


def round_trip(docs: DataFrame, model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_tokens, ids and whether decoding them gives the text back (U+2581 counts as a space)."""
    found = encode(docs, model, chunk, check=True)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")
