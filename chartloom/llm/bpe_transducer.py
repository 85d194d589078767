"""Byte-pair merges as a finite-state transducer that is made deterministic while it runs.

Merging takes the pair of neighbours with the lowest rank, the leftmost of equal ones, until no pair has
a rank. Two facts turn that into an automaton. A sequence of tokens is what merging makes of its bytes
exactly if each token is what merging makes of its own bytes and no two neighbours merge across their
border (``MergeRules.may_follow``): until a first merge across a border, each token's bytes merge as they
would alone. So every prefix of the input has one token sequence, and one last token.

The nondeterministic transducer guesses where tokens start: each of its paths has the last token before its
start and a node in the trie of tokens. A deterministic state is the set of paths that the bytes so far allow;
with each byte it tells the last token of the prefix. Tokens follow backwards from any place on, and all that
lies before the last place that every path has passed through is emitted: no path starts further
back than the longest token, which bounds the number of paths. States are made when bytes first ask
for them and are thrown away together when there are too many.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable

import numpy as np

#: A state takes about 250 bytes with its moves, a pair 100.
MOST_STATES = 250_000
MOST_PAIRS = 200_000
NEVER = 1 << 62
ROOT = 0
#: A path is the number of the token before it plus one (0: none) and 24 bits of its node; a move is the next
#: state and 24 bits of the last token.
BITS = 24
LOW = (1 << BITS) - 1
#: Bytes between two looks for what a stream can emit.
STRIDE = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a ``.tiktoken`` file."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class MergeRules:
    """What merging does inside a token and at the border of two."""

    def __init__(self, ranks: dict[bytes, int]):
        missing = [byte for byte in range(256) if bytes([byte]) not in ranks]
        if missing:
            raise ValueError(f"bytes without a token: {missing[:5]}")
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self._histories: dict[int, tuple[bool, list[tuple[int, bytes, bytes]]]] = {}

    def merges(self, token: bytes) -> tuple[bool, list[tuple[int, bytes, bytes]]]:
        """Whether the bytes become one part, and each merge's rank with the outer parts after it."""
        parts, steps = [token[i : i + 1] for i in range(len(token))], []
        while len(parts) > 1:
            ranks = [self.ranks.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
            lowest = min(ranks)
            if lowest == NEVER:
                break
            at = ranks.index(lowest)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            steps.append((lowest, parts[0], parts[-1]))
        return len(parts) == 1, steps

    def history(self, token: int) -> tuple[bool, list[tuple[int, bytes, bytes]]]:
        if token not in self._histories:
            self._histories[token] = self.merges(self.bytes_of[token])
        return self._histories[token]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether ``right`` is what merging makes of its bytes and no part of ``left`` ever merges with one
        of its parts; -1 for ``left`` at the start."""
        return self.history(right)[0] and (left < 0 or self._apart(left, right))

    def _apart(self, left: int, right: int) -> bool:
        ours, theirs = self.history(left)[1], self.history(right)[1]
        end, start = self.bytes_of[left][-1:], self.bytes_of[right][:1]
        i = j = 0
        while True:
            across = self.ranks.get(end + start, NEVER)
            inside = ours[i][0] if i < len(ours) else NEVER
            beyond = theirs[j][0] if j < len(theirs) else NEVER
            if across < inside and across <= beyond:  # of equal ranks the leftmost pair goes first
                return False
            if inside == beyond == NEVER:
                return True
            if inside <= beyond:
                end = ours[i][2]
                i += 1
            else:
                start = theirs[j][1]
                j += 1


class _Moves:
    """Moves by state and byte, looked up for many at once: open addressing in two arrays."""

    def __init__(self, size: int = 1 << 16):
        self.keys, self.values = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        self.held = 0

    def _slots(self, keys):
        return (keys * 0x9E3779B97F4A7C1 >> 20) & (len(self.keys) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The move of each key, -1 where there is none yet."""
        slots = self._slots(keys)
        held = self.keys[slots]
        found = np.where(held == keys, self.values[slots], -1)
        left = np.flatnonzero((held != keys) & (held >= 0))
        while len(left):
            slots[left] = (slots[left] + 1) & (len(self.keys) - 1)
            held = self.keys[slots[left]]
            hit = held == keys[left]
            found[left[hit]] = self.values[slots[left[hit]]]
            left = left[~hit & (held >= 0)]
        return found

    def add(self, key: int, value: int) -> None:
        if 2 * self.held > len(self.keys):
            old = self.keys >= 0
            pairs = zip(self.keys[old].tolist(), self.values[old].tolist())
            self.__init__(4 * len(self.keys))
            for pair in pairs:
                self.add(*pair)
        mask = len(self.keys) - 1
        slot = (key * 0x9E3779B97F4A7C1 + (1 << 63) & (1 << 64) - 1) - (1 << 63) >> 20 & mask  # as in 64 bits
        while self.keys[slot] >= 0:
            slot = slot + 1 & mask
        self.keys[slot], self.values[slot] = key, value
        self.held += 1


class Transducer:
    """Token ids of byte strings, each string merged separately. Paths, states and moves are numbers."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = MOST_STATES):
        self.rules = MergeRules(ranks)
        self.most_states = most_states
        self.edges: dict[int, int] = {}  # node and byte to node
        self.whole = [-1]  # node to token
        self.depth = [0]
        self.follows: dict[int, bool] = {}  # token before plus one and token, as in a path
        for token, rank in ranks.items():
            node = ROOT
            for byte in token:
                key = node << 8 | byte
                following = self.edges.get(key)
                if following is None:
                    following = self.edges[key] = len(self.depth)
                    self.depth.append(self.depth[node] + 1)
                    self.whole.append(-1)
                node = following
            self.whole[node] = rank
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.sizes[list(ranks.values())] = list(map(len, ranks))
        self.size_of = self.sizes.tolist()
        self._forget()

    def _forget(self) -> None:
        self.states: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.paths: dict[int, int] = {}  # one object for equal paths
        self.moves = _Moves()
        self.single: dict[int, int] = {}  # those that were asked for one by one
        self._number((ROOT,))

    def _number(self, paths: tuple[int, ...]) -> int:
        number = self.numbers.get(paths)
        if number is None:
            paths = tuple(self.paths.setdefault(path, path) for path in paths)
            number = self.numbers[paths] = len(self.states)
            self.states.append(paths)
        return number

    def _move(self, state: int, byte: int) -> int:
        """Makes a move. Paths stay in order of their starts; exactly one of them can end here."""
        found, last, follows = [], -1, self.follows
        for path in self.states[state]:
            node = path & LOW
            here = self.edges.get(node << 8 | byte)
            if here is None:
                continue
            path -= node
            found.append(path | here)
            if last < 0 and (token := self.whole[here]) >= 0:
                fits = follows.get(path | token)
                if fits is None:
                    if len(follows) > MOST_PAIRS:
                        follows.clear()
                    fits = follows[path | token] = self.rules.may_follow((path >> BITS) - 1, token)
                if fits:
                    last = token
        found.append(last + 1 << BITS | ROOT)
        move = self._number(tuple(found)) << BITS | last
        self.moves.add(state << 8 | byte, move)
        return move

    def _step(self, state: int, byte: int) -> int:
        key = state << 8 | byte
        found = self.single.get(key)
        if found is None:
            found = int(self.moves.find(np.array([key]))[0])
            found = self.single[key] = found if found >= 0 else self._move(state, byte)
        return found

    def _alone(self, state: int) -> int:
        """The token that the whole string is, also one that merging would not reach; -1 if it is none."""
        path = self.states[state][0]
        return self.whole[path] if path <= LOW else -1

    def _tokens(self, lasts: list[int], end: int) -> list[int]:
        """The tokens before a place, from the last token of each prefix."""
        ids = []
        while end > 0:
            token = lasts[end - 1]
            ids.append(token)
            end -= self.size_of[token]
        ids.reverse()
        return ids

    def _agreed(self, lasts: list[int], state: int) -> int:
        """The last place that the tokens before all paths' starts have in common."""
        ends = {len(lasts) - self.depth[path & LOW] for path in self.states[state]}
        while len(ends) > 1:
            latest = max(ends)
            ends.remove(latest)
            ends.add(latest - self.size_of[lasts[latest - 1]])
        return ends.pop()

    def stream(self, chunks: Iterable[bytes]) -> Iterable[int]:
        """Ids of one string that comes in parts, as soon as its paths agree on them. Another string may
        not be begun before this one ends."""
        state, lasts, emitted = 0, [], False
        for chunk in chunks:
            for byte in chunk:
                if len(self.states) > self.most_states:
                    paths = self.states[state]
                    self._forget()
                    state = self._number(paths)
                move = self._step(state, byte)
                state = move >> BITS
                lasts.append(move & LOW)
                if len(lasts) % STRIDE == 0 and (agreed := self._agreed(lasts, state)) > 0:
                    yield from self._tokens(lasts, agreed)
                    # A token that starts before the place it left is no longer asked for.
                    lasts, emitted = lasts[agreed:], True
        alone = -1 if emitted or not lasts else self._alone(state)
        yield from self._tokens(lasts, len(lasts)) if alone < 0 else [alone]

    def encode(self, string: bytes) -> list[int]:
        return list(self.stream([string]))

    def encode_many(self, data: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of strings that stand in a row in ``data``, and where each string's end: all take a step at
        a time."""
        if len(self.states) > self.most_states:
            self._forget()
        sizes, many = np.asarray(sizes, np.int64), len(sizes)
        order = np.argsort(-sizes, kind="stable")
        longest = int(sizes.max(initial=0))
        flat, starts = np.frombuffer(data, np.uint8), (np.cumsum(sizes) - sizes)[order]
        active = np.searchsorted(-sizes[order], -np.arange(longest), side="left")
        states = np.zeros(many, np.int64)
        lasts = np.zeros((longest, many), np.int32)
        for at in range(longest):
            n = active[at]
            keys = states[:n] << 8 | flat[starts[:n] + at]
            moves = self.moves.find(keys)
            open_ = np.flatnonzero(moves < 0)
            for key in np.unique(keys[open_]).tolist():
                self._move(key >> 8, key & 255)
            moves[open_] = self.moves.find(keys[open_])
            states[:n], lasts[at, :n] = moves >> BITS, moves & LOW
        ends, rows, tokens, counts = sizes[order], [], [], np.zeros(many, np.int64)
        left = np.flatnonzero(ends)
        final, at = np.unique(states, return_inverse=True)
        whole = np.array([self._alone(state) for state in final.tolist()], np.int64)[at]
        while len(left):
            last = np.where(whole[left] >= 0, whole[left], lasts[ends[left] - 1, left])
            rows.append(left)
            tokens.append(last)
            counts[left] += 1
            ends[left] -= self.sizes[last]
            left = left[ends[left] > 0]
        by_string = np.zeros(many, np.int64)
        by_string[order] = counts
        bounds = np.cumsum(by_string)
        ids, stops = np.zeros(int(counts.sum()), np.int32), bounds[order]
        for back, (own, last) in enumerate(zip(rows, tokens)):
            ids[stops[own] - 1 - back] = last
        return ids, bounds


#: Well-formed UTF-8 by lead byte: bytes that follow, and the bounds of the first of them (Unicode, table 3-7).
_LEADS = [
    (range(0xC2, 0xE0), 1, 0x80, 0xBF),
    (range(0xE0, 0xE1), 2, 0xA0, 0xBF),
    (range(0xE1, 0xED), 2, 0x80, 0xBF),
    (range(0xED, 0xEE), 2, 0x80, 0x9F),
    (range(0xEE, 0xF0), 2, 0x80, 0xBF),
    (range(0xF0, 0xF1), 3, 0x90, 0xBF),
    (range(0xF1, 0xF4), 3, 0x80, 0xBF),
    (range(0xF4, 0xF5), 3, 0x80, 0x8F),
]
_FOLLOW = {lead: (many, low, high) for leads, many, low, high in _LEADS for lead in leads}
COMPLETE, ILL_FORMED = (0, 0x80, 0xBF), (-1, 0, 0)


class Utf8Stream:
    """Characters of bytes that come in parts, which may end inside a character.

    The state is how many bytes the character still needs and the bounds of the next one. Ill-formed bytes
    become U+FFFD, one for each longest part that could have started a character.
    """

    def __init__(self):
        self.held = b""

    @staticmethod
    def step(state: tuple[int, int, int], byte: int) -> tuple[int, int, int]:
        many, low, high = state
        if many == 0:
            return COMPLETE if byte < 0x80 else _FOLLOW.get(byte, ILL_FORMED)
        return (many - 1, 0x80, 0xBF) if low <= byte <= high else ILL_FORMED

    def feed(self, part: bytes) -> str:
        """The characters that are complete."""
        data = self.held + part
        cut = len(data)
        for start in range(len(data) - 1, max(len(data) - 4, -1), -1):
            if data[start] & 0xC0 == 0x80:
                continue
            state = COMPLETE
            for byte in data[start:]:
                state = self.step(state, byte)
                if state[0] <= 0:
                    break
            if state[0] > 0:
                cut = start
            break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")
