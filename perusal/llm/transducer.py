"""A byte-level BPE tokenizer compiled to finite-state transducers.

Two deterministic transducers run in cascade:

1. The splitter reads character classes and cuts a text into pieces. It has ten states, so a
   chunk of text is a map from states to states. The maps of all chunks of a batch are made
   in step (one vector operation per position within a chunk), composed by a parallel prefix
   scan, and the scan's results give each chunk its true starting state.
2. The merger reads the bytes of one piece; each transition carries the change in the number
   of tokens. Its states are built when first reached: a state holds the longest suffix read
   so far that can still begin a vocabulary entry, and for every cut within that suffix the
   last token before the cut with its token count, relative to the present one. That is all
   that later input can depend on, so pieces of any length take one step per byte.

The number of compiled states and remembered pieces is bounded: at the bound both are
dropped and compiled anew, which costs time and changes no result.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np

# states of the splitter, after a character
(CUT, LETTER, NUMBER, OTHER, BLANK, SPACE, QUOTE, QR, QV, QL) = range(10)
#: characters the splitter tells apart: letters by their part in contractions, numbers, quote, other, space, blank
(C_LETTER, C_STMD, C_R, C_V, C_L, C_E, C_NUMBER, C_QUOTE, C_OTHER, C_SPACE, C_BLANK, C_RESET) = range(12)
LETTERS = (C_LETTER, C_STMD, C_R, C_V, C_L, C_E)
CHUNK = 256


def _classes() -> np.ndarray:
    """Class of each code point, by Unicode category (L*, N*, white space)."""
    out = np.full(0x110000, C_OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = C_LETTER
        elif kind == "N":
            out[c] = C_NUMBER
    for c in (*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        out[c] = C_BLANK
    for chars, k in (("stmd", C_STMD), ("r", C_R), ("v", C_V), ("l", C_L), ("e", C_E), ("'", C_QUOTE), (" ", C_SPACE)):
        for c in chars:
            out[ord(c)] = k
    return out


def _table() -> np.ndarray:
    """Next state by (class, state)."""
    t = np.zeros((12, 10), np.uint8)
    for c in LETTERS:
        t[c] = LETTER
    t[C_NUMBER], t[C_OTHER], t[C_SPACE], t[C_BLANK], t[C_RESET] = NUMBER, OTHER, SPACE, BLANK, CUT
    t[C_QUOTE] = QUOTE  # begins a piece of its own, unless a run of others or a space goes before it
    t[C_QUOTE, [OTHER, QUOTE, SPACE]] = OTHER
    t[C_STMD, QUOTE] = CUT
    t[C_R, QUOTE], t[C_V, QUOTE], t[C_L, QUOTE] = QR, QV, QL
    t[C_E, [QR, QV]] = CUT
    t[C_L, QL] = CUT
    return t


CLASSES, TABLE = _classes(), _table()


def scan(classes: np.ndarray) -> np.ndarray:
    """State after each character, by composing the state maps of chunks."""
    n = len(classes)
    rows = -(-n // CHUNK)
    cells = np.full(rows * CHUNK, C_RESET, np.uint8)
    cells[:n] = classes
    steps = np.ascontiguousarray(cells.reshape(rows, CHUNK).T).astype(np.intp) * 10
    flat = TABLE.ravel()
    maps = np.tile(np.arange(10, dtype=np.uint8), (rows, 1))
    for step in steps:
        maps = flat[step[:, None] + maps]
    # inclusive prefix scan under composition: after it, maps[i] takes the state before chunk 0 past chunk i
    k = 1
    while k < rows:
        maps[k:] = np.take_along_axis(maps[k:], maps[:-k].astype(np.intp), 1)
        k *= 2
    state = np.empty(rows, np.uint8)
    state[0], state[1:] = CUT, maps[:-1, CUT]
    out = np.empty((CHUNK, rows), np.uint8)
    for i, step in enumerate(steps):
        out[i] = state = flat[step + state]
    return out.T.ravel()[:n]


def starts(classes: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each character. Reset characters stand alone."""
    n = len(classes)
    if not n:
        return np.zeros(0, bool)
    s = scan(classes)
    before = np.empty(n, np.uint8)
    before[0], before[1:] = CUT, s[:-1]
    letter, reset = classes <= C_E, classes == C_RESET
    blank = (classes == C_SPACE) | (classes == C_BLANK)
    # by default a piece begins where the kind of run changes
    run = np.select([letter, classes == C_NUMBER, blank, reset], [0, 1, 3, 4], 2).astype(np.uint8)
    begin = np.ones(n, bool)
    begin[1:] = run[1:] != run[:-1]
    # a space goes with what follows it
    begin &= ~((before == SPACE) & ~blank & ~reset)
    # of several blanks before other text the last begins a piece
    last = np.zeros(n, bool)
    last[:-1] = blank[:-1] & ~blank[1:] & ~reset[1:]
    begin |= last
    # contractions: quote + letter, quote + two letters
    done = (s == CUT) & ~reset
    begin[done] = False
    pair = np.flatnonzero(done & np.isin(before, (QR, QV, QL)))
    begin[pair - 1] = False
    # what follows a contraction begins a piece; so does each reset
    begin |= (before == CUT) | reset
    begin[0] = True
    return begin


class Merger:
    """Counts the tokens of a piece by running the compiled merger over its bytes."""

    def __init__(self, merges: list[tuple[bytes, bytes]], alphabet: list[bytes], most_states: int = 200_000):
        """merges in rank order; alphabet: the single bytes. Token numbers follow rank."""
        self.most = most_states
        self.ids = {b: i for i, b in enumerate(alphabet)}
        self.halves: list[tuple[int, int] | None] = [None] * len(alphabet)
        self.rank: dict[tuple[int, int], int] = {}
        for a, b in merges:
            if a + b not in self.ids:
                self.rank[self.ids[a], self.ids[b]] = self.ids[a + b] = len(self.halves)
                self.halves.append((self.ids[a], self.ids[b]))
        # trie of the vocabulary: children by byte, the token that ends at a node, and the node's longest proper suffix
        self.child: list[dict[int, int]] = [{}]
        self.token, self.depth = [-1], [0]
        for word, i in self.ids.items():
            at = 0
            for c in word:
                nxt = self.child[at].get(c)
                if nxt is None:
                    nxt = self.child[at][c] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                    self.depth.append(self.depth[at] + 1)
                at = nxt
            self.token[at] = i
        self.suffix = [0] * len(self.child)
        todo = list(self.child[0].values())
        for at in todo:  # breadth first
            for c, nxt in self.child[at].items():
                f = self.suffix[at]
                while f and c not in self.child[f]:
                    f = self.suffix[f]
                self.suffix[nxt] = self.child[f].get(c, 0)
                todo.append(nxt)
        self.fits: dict[tuple[int, int], bool] = {}
        self.clear()

    def clear(self) -> None:
        #: state: (trie node, for each cut where an entry may begin: bytes back, last token, relative count)
        self.number: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.cuts: list[dict[int, tuple[int, int]]] = []
        self.moves: list[dict[int, tuple[int, int]]] = []
        self._state((0, ((0, -1, 0),)))

    def _state(self, key: tuple) -> int:
        n = self.number.get(key)
        if n is None:
            n = self.number[key] = len(self.states)
            self.states.append(key)
            self.cuts.append({k: (x, m) for k, x, m in key[1]})
            self.moves.append({})
        return n

    def adjacent(self, a: int, b: int) -> bool:
        """Whether token b can stand right after token a, that is, no merge that comes before
        one of their own joins a suffix part of a with a prefix part of b."""
        if a < 0:
            return True
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            known = self.fits[a, b] = self._adjacent(a, b)
        return known

    def _adjacent(self, a: int, b: int) -> bool:
        # Undo the later merge of the two sides step by step. Between two undoings both parts lie
        # side by side while all merges of lower rank happen, so a rank for them that is lower
        # than that of the merge undone last (with the left side first in a tie) joins them.
        limit, left = len(self.halves) + 1, False
        while True:
            r = self.rank.get((a, b))
            if r is not None and (r < limit or left and r == limit):
                return False
            ha, hb = self.halves[a], self.halves[b]
            if ha is None and hb is None:
                return True
            if a > b:
                limit, left, a = a, False, ha[1]
            else:
                limit, left, b = b, True, hb[0]

    def _compile(self, at: int, c: int) -> tuple[int, int]:
        node, cuts = self.states[at][0], self.cuts[at]
        # cuts[k] = (last token before the cut k bytes back, tokens up to there minus tokens up to here)
        nxt = node
        while nxt and c not in self.child[nxt]:
            nxt = self.suffix[nxt]
        nxt = self.child[nxt].get(c, 0)
        f = nxt
        while f:
            t, k = self.token[f], self.depth[f]
            if t >= 0 and self.adjacent(cuts[k - 1][0], t):
                break
            f = self.suffix[f]
        assert f, "the alphabet covers every byte"
        emitted = cuts[k - 1][1] + 1
        keep, f = [(0, t, 0)], nxt
        while f:  # only where a vocabulary entry may still begin
            x, n = cuts[self.depth[f] - 1]
            keep.append((self.depth[f], x, n - emitted))
            f = self.suffix[f]
        return self._state((nxt, tuple(keep))), emitted

    def count(self, piece: bytes) -> int:
        if len(self.states) > self.most:
            self.clear()
        at = total = 0
        moves = self.moves
        for c in piece:
            got = moves[at].get(c)
            if got is None:
                got = moves[at][c] = self._compile(at, c)
            at, n = got
            total += n
        return total


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 stands for
    itself, the other bytes take code points from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Known(dict):
    """Tokens of the pieces met so far."""

    def __init__(self, merger: Merger):
        super().__init__()
        self.merger = merger

    def __missing__(self, piece: str) -> int:
        n = self[piece] = self.merger.count(piece.encode("utf-8"))
        return n


class Compiled:
    """A tokenizer file compiled for counting."""

    def __init__(self, path: str, most_pieces: int = 500_000):
        spec = json.load(open(path, encoding="utf-8"))
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("only byte-level BPE without normalizer or prefix space is compiled")
        of = _byte_of_char()
        raw = lambda s: bytes(of[c] for c in s)
        self.merger = Merger([(raw(a), raw(b)) for a, b in (m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"])], [bytes([b]) for b in range(256)])
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.known = _Known(self.merger)
        self.most = most_pieces

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text. Texts are joined with one reset character between them; each
        special string becomes a reset character too, and one token."""
        extra = [0] * len(texts)
        parts, ends, at = [], [], 0
        for i, t in enumerate(texts):
            for s in self.special:
                if s in t:
                    extra[i] += t.count(s)
                    t = t.replace(s, "\udffe")
            parts.append(t)
            at += len(t) + 1
            ends.append(at)
        whole = "\udfff".join(parts) + "\udfff" if parts else ""
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        classes = CLASSES[codes]
        classes[(codes == 0xDFFE) | (codes == 0xDFFF)] = C_RESET
        stops = np.flatnonzero(starts(classes))  # resets stand alone, so a piece ends where the next one or a reset begins
        piece = classes[stops] != C_RESET
        begin, after = stops[piece], stops[1:][piece[:-1]]
        known = self.known
        pieces = map(whole.__getitem__, map(slice, begin.tolist(), after.tolist()))
        sums = np.zeros(len(begin) + 1, np.int64)
        np.cumsum(np.fromiter(map(known.__getitem__, pieces), np.int64, len(begin)), out=sums[1:])
        upto = sums[np.searchsorted(begin, np.array(ends, np.int64))]
        if len(known) > self.most:
            known.clear()
        return [int(b - a) + x for a, b, x in zip([0, *upto[:-1].tolist()], upto.tolist(), extra)]

