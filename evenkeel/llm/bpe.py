"""Byte-pair merging, and its compilation into a transducer that emits token counts."""

from __future__ import annotations

import base64
import functools
import json


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@functools.cache
def byte_letters() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies: printable Latin-1
    stands for itself, the rest is numbered on from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_bytes(token: str) -> bytes:
    return bytes(map(byte_letters().__getitem__, token))


def read_merges(path: str) -> tuple[list[bytes], dict[tuple[bytes, bytes], int], list[str]]:
    """Tokens, rank of each merged pair, and the special strings of a byte-level tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = [t["content"] for t in spec["added_tokens"]]
    tokens = [token_bytes(t) for t in spec["model"]["vocab"] if t not in set(special)]
    pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
    return tokens, {(token_bytes(a), token_bytes(b)): i for i, (a, b) in enumerate(pairs)}, special


def merge(word: bytes, ranks: dict[tuple[bytes, bytes], int]) -> list[bytes]:
    """Tokens of a pre-token: the pair of least rank, leftmost first, is joined until none is left."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best, at = min((ranks.get((parts[i], parts[i + 1]), len(ranks)), i) for i in range(len(parts) - 1))
        if best == len(ranks):
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class CountTransducer:
    """Token counts by a deterministic transducer over bytes, compiled as it is used.

    For each prefix of a word the merges end in one last token, and two tokens may stand side by
    side exactly if merging their bytes gives the two back. So the last token of a longer prefix
    follows from those of earlier prefixes that some vocabulary entry still reaches from: a state
    holds, for each such prefix, the place in the vocabulary's prefix tree since then, its last
    token and its token count relative to the whole; a transition emits the change of the count.
    """

    def __init__(self, tokens: list[bytes], ranks: dict[tuple[bytes, bytes], int], most: int = 1_500_000):
        self.ranks, self.most = ranks, most
        self.kids: list[dict[int, int]] = [{}]
        self.token: list[bytes | None] = [None]
        for t in tokens:
            at = 0
            for b in t:
                nxt = self.kids[at].get(b)
                if nxt is None:
                    nxt = self.kids[at][b] = len(self.kids)
                    self.kids.append({})
                    self.token.append(None)
                at = nxt
            self.token[at] = t
        self.none = len(ranks)
        self.made: dict[bytes, tuple[int, tuple[bytes, bytes]]] = {}
        for pair, rank in sorted(ranks.items(), key=lambda x: -x[1]):
            self.made[pair[0] + pair[1]] = (rank, pair)  # the least rank that makes a token stays
        self.beside: dict[tuple[bytes, bytes], bool] = {}
        self.spine: dict[tuple[bytes, bool], list[tuple[bytes, int]]] = {}
        self.forget()

    def forget(self) -> None:
        self.states: list[tuple] = [((0, b"", 0),)]
        self.number = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, int]] = {}

    def edges(self, token: bytes, right: bool) -> list[tuple[bytes, int]]:
        """The parts that hold the token's last (right) or first byte while it is merged, largest
        first, each with the rank at which it is used up; the whole is never used up."""
        out, used = [(token, self.none)], self.none
        while len(token) > 1:
            rank, pair = self.made[token]
            token, used = pair[right], rank
            out.append((token, used))
        return out

    def fits(self, a: bytes, b: bytes) -> bool:
        """Whether merging a + b gives [a, b]: no part at a's end joins a part at b's start while both are there.

        Equal ranks go leftmost first: a part of a is used up before it can join across, a part of b after.
        """
        known = self.beside.get((a, b))
        if known is None:
            if len(self.beside) > self.most:
                self.beside.clear()
                self.spine.clear()
            ends = self.spine.get((a, True)) or self.spine.setdefault((a, True), self.edges(a, True))
            starts = self.spine.get((b, False)) or self.spine.setdefault((b, False), self.edges(b, False))
            ranks, none = self.ranks, self.none
            known = self.beside[a, b] = not any((r := ranks.get((x, y), none)) < ux and r <= uy and r < none for x, ux in ends for y, uy in starts)
        return known

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        reach, last, count = [], None, 0
        for node, before, c in self.states[state]:
            nxt = self.kids[node].get(byte)
            if nxt is None:
                continue
            reach.append((nxt, before, c))
            t = self.token[nxt]
            if last is None and t is not None and (not before or self.fits(before, t)):
                last, count = t, c + 1
        new = (*((n, t, c - count) for n, t, c in reach if self.kids[n]), (0, last, 0))
        at = self.number.get(new)
        if at is None:
            at = self.number[new] = len(self.states)
            self.states.append(new)
        out = self.moves[state << 8 | byte] = (at, count)
        return out

    def count(self, word: bytes) -> int:
        if len(self.moves) > self.most:
            self.forget()
        state = total = 0
        moves = self.moves
        for b in word:
            move = moves.get(state << 8 | b)
            if move is None:
                move = self.compile(state, b)
            state, emitted = move
            total += emitted
        return total
