"""Exact BPE segmentation of a SentencePiece model, one position at a time.

SentencePiece's BPE merges the adjacent pair with the best-scoring piece,
leftmost first, until nothing merges. Merges inside a region do not depend on
text outside it while no merge crosses its border. Hence a sequence of pieces is
the segmentation of its text exactly when every two neighbours are the
segmentation of their own concatenation ("compatible"), and each prefix of a text
has one last piece, found from the last pieces of shorter prefixes. That makes
segmentation a left-to-right automaton whose registers are the last pieces of the
latest positions; two characters that stand together in no piece always have a
border between them (a synchronising position).
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable

import sentencepiece

SPACE = "▁"
#: In place of a piece's id: nothing before, and a character outside the vocabulary.
START, RAW = -1, -2
#: Bounds of the per-process memo tables (entries); a full table is emptied, results stay the same.
UNIT_LIMIT, PAIR_LIMIT = 300_000, 600_000
#: Longer units and words are not kept in a memo.
LONG = 64
NEVER = float("-inf")


class PieceModel:
    """Pieces, their automaton and memo tables of one model file."""

    def __init__(self, path: str):
        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = lib.get_piece_size()
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.texts = [""] * self.size
        self.byte_ids = [0] * 256
        self.out_bytes: list[bytes] = []
        for i in range(self.size):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                byte = int(piece[3:5], 16)
                self.byte_ids[byte] = i
                self.out_bytes.append(bytes([byte]))
            elif lib.is_control(i):
                self.out_bytes.append(b"")
            elif lib.is_unknown(i):
                self.out_bytes.append(" ⁇ ".encode())
            else:
                self.ids[piece] = i
                self.texts[i] = piece
                self.scores[piece] = lib.get_score(i)
                self.out_bytes.append(piece.replace(SPACE, " ").encode())
        self.max_len = max(map(len, self.ids))
        self.inside = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        if any(x[1] == SPACE and x[0] != SPACE or "\n" in x for x in self.inside) or "\n" in self.ids:
            raise ValueError("pieces that cross a word start or hold a line feed are not supported")
        if lib.normalize("a  b ") != f"{SPACE}a{SPACE}{SPACE}b{SPACE}":
            raise ValueError("only models that keep white space and add a dummy prefix are supported")
        self.follows: list[dict[int, bool]] = [{} for _ in range(self.size)]  # by second piece, then first
        self.n_pairs = 0
        self.histories: dict[int, tuple | None] = {}
        self.units = self._unit_pattern()
        self._compile()

    def _unit_pattern(self) -> re.Pattern:
        """Units start at synchronising positions that a pattern sees cheaply: word starts, line
        feeds, and marks after Latin letters (those marks that no piece holds after one)."""
        letter = "A-Za-zÀ-ÖØ-öø-ÿ"
        known = re.compile(f"[{letter}]")
        marks = {chr(c) for c in range(33, 127) if not chr(c).isalnum()} - {x[1] for x in self.inside if known.match(x[0])}
        other = f"[^{letter}{SPACE}\n]"
        stop = f"(?![{re.escape(''.join(sorted(marks)))}])" if marks else ""
        return re.compile(f"(?=[^\n]){SPACE}*{other}*(?:[{letter}]+{stop}{other}+)*[{letter}]*|\n")

    def sync(self, left: str, right: str) -> bool:
        """Whether a border always lies between these two characters."""
        return (left + right) not in self.inside

    def starts_unit(self, left: str, char: str) -> bool:
        """Whether the pattern starts a unit between these neighbours."""
        return len(self.units.findall(left + char)) == 2

    def _compile(self) -> None:
        """The automaton that knows, after each character, all pieces that end there, longest first."""
        self.moves: list[dict[str, int]] = [{}]
        own: list[int | None] = [None]
        for piece, i in self.ids.items():
            at = 0
            for char in piece:
                at = self.moves[at].setdefault(char, len(self.moves))
                if at == len(own):
                    self.moves.append({})
                    own.append(None)
            own[at] = i
        self.fail = [0] * len(own)
        self.ends: list[tuple[tuple[int, int, dict[int, bool]], ...]] = [()] * len(own)
        level = [0]
        while level:
            below = []
            for at in level:
                for char, to in self.moves[at].items():
                    if at:
                        back = self.fail[at]
                        while back and char not in self.moves[back]:
                            back = self.fail[back]
                        self.fail[to] = self.moves[back].get(char, 0)
                    here = ((len(self.texts[own[to]]), own[to], self.follows[own[to]]),) if own[to] is not None else ()
                    self.ends[to] = here + self.ends[self.fail[to]]
                    below.append(to)
            level = below
        self.trie_moves = [dict(x) for x in self.moves]

    def move(self, at: int, char: str) -> int:
        """The next node; found moves are kept in the table."""
        back = at
        while back and char not in self.trie_moves[back]:
            back = self.fail[back]
        to = self.trie_moves[back].get(char, 0)
        if char in self.trie_moves[0]:
            self.moves[at][char] = to
        return to

    def merge(self, text: str) -> tuple[list[str], list[tuple[str, float]], list[tuple[str, float]]]:
        """The pieces of a short text by plain merging; and which symbols stood first and last,
        each with the level (lowest score merged so far) at which it was merged away."""
        parts, scores, level = list(text), self.scores, float("inf")
        first, last = [], []
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                break
            level = min(level, best)
            if at == 0:
                first.append((parts[0], level))
            if at == len(parts) - 2:
                last.append((parts[-1], level))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts, [*first, (parts[0], NEVER)], [*last, (parts[-1], NEVER)]

    def history(self, i: int) -> tuple | None:
        """First and last symbols of piece i over its merging; None if it never arises."""
        if i not in self.histories:
            parts, first, last = self.merge(self.texts[i])
            self.histories[i] = (first, last) if len(parts) == 1 else None
        return self.histories[i]

    def compatible(self, a: int, b: int) -> bool:
        """Whether piece b can stand right after a (START and RAW: after a border)."""
        known = self.follows[b].get(a)
        if known is None:
            if self.n_pairs >= PAIR_LIMIT:
                self.n_pairs = 0
                for x in self.follows:
                    x.clear()
            self.n_pairs += 1
            known = self.follows[b][a] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        right = self.history(b)
        if right is None or a < 0:
            return right is not None
        left = self.history(a)
        if left is None:
            return False
        x, y = self.texts[a], self.texts[b]
        if (x[-1] + y[0]) not in self.inside:
            return True
        if SPACE * 2 in x + y:  # pieces of equal score
            return self.merge(x + y)[0] == [x, y]
        ends, starts, i, j = left[1], right[0], 0, 0
        while True:
            (end, end_goes), (start, start_goes) = ends[i], starts[j]
            across = self.scores.get(end + start, NEVER)
            if across > end_goes and across >= start_goes:
                return False
            if end_goes == start_goes == NEVER:
                return True
            if end_goes >= start_goes:
                i += 1
            else:
                j += 1

    def forward(self, unit: str, before: int = START) -> tuple[list[int], list[int]]:
        """For each prefix of a unit its last piece and its number of ids. `before` stands left of it."""
        at, moves, ends = 0, self.moves, self.ends
        lasts, counts = [before], [0]
        for char in unit:
            to = moves[at].get(char)
            at = self.move(at, char) if to is None else to
            for length, piece, known in ends[at]:
                ok = known.get(lasts[-length])
                if ok or ok is None and self.compatible(lasts[-length], piece):
                    lasts.append(piece)
                    counts.append(counts[-length] + 1)
                    break
            else:
                lasts.append(RAW)
                counts.append(counts[-1] + len(char.encode()))
        return lasts, counts

    def segmented(self, unit: str) -> list[int]:
        """The ids of a whole unit."""
        at, moves, ends = 0, self.moves, self.ends
        lasts = [START]
        put = lasts.append
        for char in unit:
            to = moves[at].get(char)
            at = self.move(at, char) if to is None else to
            for length, piece, known in ends[at]:
                ok = known.get(lasts[-length])
                if ok or ok is None and self.compatible(lasts[-length], piece):
                    put(piece)
                    break
            else:
                put(RAW)
        return self.backward(unit, lasts)

    def backward(self, unit: str, lasts: list[int]) -> list[int]:
        """The ids of a unit, from its last pieces."""
        out, i = [], len(unit)
        while i > 0:
            piece = lasts[i]
            if piece == RAW:
                out.extend(self.byte_ids[b] for b in reversed(unit[i - 1].encode()))
                i -= 1
            else:
                out.append(piece)
                i -= len(self.texts[piece])
        out.reverse()
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the dummy prefix goes, invalid bytes become U+FFFD."""
        raw = b"".join(map(self.out_bytes.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def escaped(text: str) -> str:
    """The model's normal form of a whole text (empty stays empty)."""
    return SPACE + text.replace(" ", SPACE) if text else ""


class Memo(dict):
    """Values by text, bounded: what is not asked for while `most` others come is forgotten."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.old, self.most = make, {}, most

    def __missing__(self, key: str):  # noqa: ANN204
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONG:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Words:
    """What a text's units add up to: `value` of each unit, added by `join` (numbers, or bytes). Words between single
    spaces are looked up whole, since most come again; a word that is not known is cut into its units."""

    def __init__(self, m: PieceModel, value: Callable, join: Callable[[Iterable], object], most: int = UNIT_LIMIT):
        self.model, self.join, self.units = m, join, Memo(value, most)
        self.words = Memo(lambda word: self.of_units(SPACE + word), most)
        self.starts = Memo(self.of_units, most)

    def of_units(self, normal: str):  # noqa: ANN201
        """The value of a text in normal form that starts and ends at borders."""
        return self.join(map(self.units.__getitem__, self.model.units.findall(normal)))

    def of(self, text: str):  # noqa: ANN201
        """The value of a whole text."""
        if not text or text[0] == " " or "  " in text or SPACE in text:
            return self.of_units(escaped(text))
        first, *lines = text.split("\n")
        parts = [*map(self.words.__getitem__, first.split(" "))]
        for line in lines:
            own = line.split(" ")
            parts += (self.units["\n"], self.starts[own[0]])
            parts += map(self.words.__getitem__, own[1:])
        return self.join(parts)
