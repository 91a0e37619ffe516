"""Byte-level BPE by dynamic programming over prefixes, for many pieces at a time.

The BPE encoding of a prefix ends with one token, and without that token it is the encoding of a shorter prefix.
So for every prefix the only thing to store is its last token: of the vocabulary's tokens that end there, the one
that is compatible with the last token of the prefix before it. Back-pointers give the ids. Two tokens are
compatible if no merge across their border comes before the merges that made them.

All pieces advance by one byte per step: an Aho-Corasick automaton of the vocabulary (its states' suffix links fail over) gives each piece's longest token
that ends at the byte, suffix links the shorter ones, and compatibility is tested for all pieces together.
"""

import json

import numpy as np

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_HALF = 16


def byte_symbols() -> dict[str, int]:
    """The printable symbols that stand for bytes in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _PairTable:
    """A hash table from pairs of tokens to the token they merge to, looked up for arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> None:
        size = 1 << (4 * len(merged)).bit_length()
        self.shift, self.mask = np.uint64(64 - size.bit_length() + 1), size - 1
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        keys = left.astype(np.int64) << 32 | right
        at, rest = self._slot(keys), np.arange(len(keys))
        while len(rest):
            free = self.keys[at[rest]] < 0
            slots, first = np.unique(at[rest[free]], return_index=True)
            put = rest[free][first]
            self.keys[slots], self.values[slots] = keys[put], merged[put]
            rest = np.setdiff1d(rest, put, assume_unique=True)
            at[rest] = (at[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _GOLDEN) >> self.shift).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged tokens, -1 for pairs that do not merge."""
        keys = left.astype(np.int64) << 32 | right
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        rest = np.flatnonzero((found != keys) & (found >= 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & self.mask
            found = self.keys[at[rest]]
            hit = found == keys[rest]
            out[rest[hit]] = self.values[at[rest[hit]]]
            rest = rest[~hit & (found >= 0)]
        return out


class PrefixBpe:
    """The model of a byte-level BPE tokenizer file whose ids rise in the order of the merges."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols, model = byte_symbols(), spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*model["vocab"].values(), *self.special.values()])
        self.token_bytes = [b""] * self.size
        for token, i in model["vocab"].items():
            self.token_bytes[i] = bytes(symbols[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = np.array([[model["vocab"][a], model["vocab"][b], model["vocab"][a + b]] for a, b in pairs], np.int64)
        left, right, merged = ids.reshape(-1, 3).T
        if np.any(np.diff(merged) <= 0):
            raise ValueError("ids must rise in the order of the merges")
        #: of each token, the two it was merged from; itself for single bytes
        self.left, self.right = np.arange(self.size), np.arange(self.size)
        self.left[merged], self.right[merged] = left, right
        self.pairs = _PairTable(left, right, merged)
        self.lengths = np.array([len(t) for t in self.token_bytes], np.int64)
        self._automaton([i for i in model["vocab"].values()])

    def _automaton(self, tokens: list[int]) -> None:
        """Tables: next state by byte, longest token that ends in a state, next shorter token of a token."""
        parent, byte, ends, depth_of = [0], [0], [-1], [0]
        at: dict[tuple[int, int], int] = {}
        for i in sorted(tokens, key=lambda i: len(self.token_bytes[i])):
            state = 0
            for b in self.token_bytes[i]:
                following = at.get((state, b))
                if following is None:
                    following = at[state, b] = len(parent)
                    parent.append(state)
                    byte.append(b)
                    ends.append(-1)
                    depth_of.append(depth_of[state] + 1)
                state = following
            ends[state] = i
        parents, bytes_, depths, own = (np.array(x, np.int64) for x in (parent, byte, depth_of, ends))
        # states by byte are looked up in two steps, by half a byte each; a state shares the blocks of 16 next states
        # that it does not change with the state it falls back to
        self.block = np.zeros((len(parents), _HALF), np.int32)
        self.next = np.zeros((1, _HALF), np.int32)
        fail = np.zeros(len(parents), np.int64)
        self.longest = np.full(len(parents), -1, np.int64)
        self.shorter = np.full(self.size, -1, np.int64)
        by_depth = np.argsort(depths, kind="stable")
        bounds = np.searchsorted(depths[by_depth], np.arange(int(depths.max()) + 2))
        self._add_children(np.zeros(bounds[2] - bounds[1], np.int64), bytes_, by_depth[bounds[1]:bounds[2]])
        for depth in range(1, int(depths.max()) + 1):
            states = by_depth[bounds[depth]:bounds[depth + 1]]
            if depth > 1:
                fail[states] = self.following(fail[parents[states]], bytes_[states])
            self.block[states] = self.block[fail[states]]
            inherited = self.longest[fail[states]]
            named = own[states] >= 0
            self.shorter[own[states[named]]] = inherited[named]
            self.longest[states] = np.where(named, own[states], inherited)
            if depth + 2 < len(bounds):
                # a child's entry replaces the one its parent inherits, so parents come first
                below = by_depth[bounds[depth + 1]:bounds[depth + 2]]
                self._add_children(parents[below], bytes_, below)

    def _add_children(self, parents: np.ndarray, bytes_: np.ndarray, states: np.ndarray) -> None:
        """Blocks of their own for the parents' entries of these states."""
        high, low = bytes_[states] // _HALF, bytes_[states] % _HALF
        changed, of = np.unique(parents * _HALF + high, return_inverse=True)
        blocks = self.next[self.block[changed // _HALF, changed % _HALF]]
        blocks[of, low] = states
        self.block[changed // _HALF, changed % _HALF] = len(self.next) + np.arange(len(changed))
        self.next = np.concatenate([self.next, blocks])

    def following(self, states: np.ndarray, bytes_: np.ndarray) -> np.ndarray:
        """The next state of each state by a byte."""
        block = self.block.ravel().take(states * _HALF + (bytes_ >> 4))
        return self.next.ravel().take(block * _HALF + (bytes_ & 15))

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether BPE encodes the bytes of each pair as that pair.

        Undo the later of the two tokens' merges again and again; the pair is broken if the tokens at the
        border merge at a time when both were there: before the merge that was undone last on either side.
        """
        good = np.ones(len(left), bool)
        l, r, rows = left.copy(), right.copy(), np.arange(len(left))
        l_end, r_end = (np.full(len(left), np.iinfo(np.int64).max) for _ in range(2))
        while len(rows):
            merged = self.pairs.look_up(l, r)
            # at equal times the merge further left goes first: the left token's own merge, then the border's
            broken = (merged >= 0) & (merged < l_end) & (merged <= r_end)
            good[rows[broken]] = False
            l_made, r_made = self.left[l] != l, self.left[r] != r
            go = ~broken & (l_made | r_made)
            rows, l, r, l_end, r_end, l_made, r_made = (
                x[go] for x in (rows, l, r, l_end, r_end, l_made, r_made))
            undo_left = l_made & (~r_made | (l > r))
            l_end, r_end = np.where(undo_left, l, l_end), np.where(undo_left, r_end, r)
            l, r = np.where(undo_left, self.right[l], l), np.where(undo_left, r, self.left[r])
        return good

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in one array, and ids per piece."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        order = np.argsort(-sizes, kind="stable")
        data = np.frombuffer(b"".join(pieces), np.uint8)
        starts = np.cumsum(sizes) - sizes
        last = np.full(len(data), -1, np.int32)
        state = np.zeros(len(pieces), np.int64)
        longest = int(sizes.max()) if len(sizes) else 0
        active = np.searchsorted(-sizes[order], -np.arange(longest), side="left")
        for p in range(longest):
            rows = order[:active[p]]
            at = starts[rows] + p
            state[rows] = self.following(state[rows], data[at])
            token = self.longest[state[rows]]
            while len(rows):
                before = p - self.lengths[token]
                inner = np.flatnonzero(before >= 0)
                good = before == -1
                previous = last[starts[rows[inner]] + before[inner]].astype(np.int64)
                known = previous >= 0
                good[inner[known]] = self.compatible(previous[known], token[inner[known]])
                last[starts[rows[good]] + p] = token[good]
                rows, token = rows[~good], self.shorter[token[~good]]
                rows, token = rows[token >= 0], token[token >= 0]
        return self._back(data, starts, sizes, last)

    def _back(self, data, starts, sizes, last) -> tuple[np.ndarray, np.ndarray]:
        """Follow the last tokens back from each piece's end."""
        ends_token = np.zeros(len(data), bool)
        at, first = starts + sizes - 1, starts
        alive = sizes > 0
        at, first = at[alive], first[alive]
        while len(at):
            if np.any(last[at] < 0):
                raise ValueError("a byte that no token of the vocabulary holds")
            ends_token[at] = True
            at = at - self.lengths[last[at]]
            go = at >= first
            at, first = at[go], first[go]
        before = np.concatenate([[0], np.cumsum(ends_token)])
        return last[ends_token], before[starts + sizes] - before[starts]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")
