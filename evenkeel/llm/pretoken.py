"""The byte-level pre-token pattern as a finite-state machine, run over blocks in parallel.

The pattern is
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
Its machine reads one character class at a time and says where pre-tokens start: at the
character just read, at the one before (white space and contractions look one ahead), or both.
A stream is cut into equal blocks; each block's map from every entry state to its exit state is
found for all blocks at once, the maps are composed by a parallel prefix scan, and a last sweep
from the now known entry states marks the starts. Any cut of a text gives the same starts.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np

# Character classes.
OTHER, LETTER, NUMBER, SPACE, BLANK, QUOTE, ONE, R, V, E, LL, RESET = range(12)
CLASSES = 12
# States: ready for a new pre-token; inside runs; white space of one or more, by its last; a quote that may open a contraction.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, SPACE1, BLANK1, SPACES, BLANKS, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L = range(12)
STATES = 12
HERE, BEFORE = 1, 2
#: Unicode's White_Space (fixed values).
WHITE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Letters and numbers of Unicode 16 that Python's own tables may not have yet (fixed values, first and last).
NEW_LETTERS = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]


@functools.cache
def class_table() -> np.ndarray:
    """Class of each code point."""
    kinds = np.array([{"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)], np.uint8)
    for ranges, kind in ((NEW_LETTERS, LETTER), (NEW_NUMBERS, NUMBER)):
        for a, b in ranges:
            kinds[a : b + 1] = kind
    kinds[WHITE] = BLANK
    kinds[0x20] = SPACE
    kinds[ord("'")] = QUOTE
    for c in "stmd":
        kinds[ord(c)] = ONE
    for c, k in (("r", R), ("v", V), ("e", E), ("l", LL)):
        kinds[ord(c)] = k
    return kinds


def _step(state: int, kind: int) -> tuple[int, int]:
    """(next state, starts) on reading one character."""
    letters, white = kind in (LETTER, ONE, R, V, E, LL), kind in (SPACE, BLANK)
    if state in (QUOTED_R, QUOTED_V, QUOTED_L):
        if kind == (LL if state == QUOTED_L else E):
            return FRESH, 0
        nxt, starts = _step(IN_LETTERS, kind)
        return nxt, starts | BEFORE
    if kind == RESET:
        return FRESH, HERE
    if state == QUOTED:
        if kind == ONE:
            return FRESH, 0
        if kind in (R, V, LL):
            return {R: QUOTED_R, V: QUOTED_V, LL: QUOTED_L}[kind], 0
        return _step(IN_OTHERS, kind)
    if white:
        if state in (SPACE1, BLANK1, SPACES, BLANKS):
            return (SPACES if kind == SPACE else BLANKS), 0
        return (SPACE1 if kind == SPACE else BLANK1), HERE
    run = IN_LETTERS if letters else IN_NUMBERS if kind == NUMBER else IN_OTHERS
    if state in (SPACE1, SPACES):  # the last space joins what follows
        return run, BEFORE if state == SPACES else 0
    if state == run:
        return run, 0
    starts = HERE | (BEFORE if state == BLANKS else 0)
    return (QUOTED if kind == QUOTE else run), starts


@functools.cache
def machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and starts, by state * CLASSES + class."""
    both = [_step(s, k) for s in range(STATES) for k in range(CLASSES)]
    return np.array([b[0] for b in both], np.uint8), np.array([b[1] for b in both], np.uint8)


def compose_scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps (rows), in log2(rows) rounds."""
    done, width = maps.copy(), 1
    while width < len(done):
        later = done[width:]
        done[width:] = np.take_along_axis(later, done[:-width].astype(np.intp), axis=1)
        width *= 2
    return done


#: Characters after which nearly all blocks have forgotten the state that they began in.
SETTLE = 24


def starts_of(kinds: np.ndarray, block: int = 512) -> np.ndarray:
    """Whether a pre-token starts at each character; resets are one character each.

    Most blocks reach one state from whatever state they began in within a few characters; from
    there one state is enough, and only the first characters wait for the scan.
    """
    n = len(kinds)
    if not n:
        return np.zeros(0, bool)
    table, starts = machine()
    ahead = (table * CLASSES).astype(np.uint8)  # states are kept multiplied: 11 * 12 + 11 < 256
    block = max(1, min(block, n))
    settle = min(SETTLE, block)
    rows = -(-n // block)
    grid = np.full(rows * block, RESET, np.uint8)
    grid[:n] = kinds
    columns = np.ascontiguousarray(grid.reshape(rows, block).T)
    said = np.empty((block, rows), np.uint8)
    maps = np.broadcast_to(np.arange(STATES, dtype=np.uint8) * CLASSES, (rows, STATES)).copy()
    for column in columns[:settle]:
        maps = ahead.take(maps + column[:, None])
    late = np.flatnonzero((maps != maps[:, :1]).any(axis=1))
    own = maps[late]
    state = maps[:, 0].copy()
    for i in range(settle, block):
        at = state + columns[i]
        starts.take(at, out=said[i])
        state = ahead.take(at)
    for column in columns[settle:, late]:
        own = ahead.take(own + column[:, None])
    exits = np.broadcast_to(state[:, None], (rows, STATES)).copy()
    exits[late] = own
    entry = np.full(rows, FRESH * CLASSES, np.uint8)
    if rows > 1:
        entry[1:] = compose_scan(exits // CLASSES)[:-1, FRESH] * CLASSES
    state = entry
    for i in range(settle):
        at = state + columns[i]
        starts.take(at, out=said[i])
        state = ahead.take(at)
    again = state[late]
    for i in range(settle, block if len(late) else settle):
        at = again + columns[i, late]
        said[i, late] = starts.take(at)
        again = ahead.take(at)
    flat = np.ascontiguousarray(said.T).reshape(-1)
    out = (flat & HERE).astype(bool)[:n]
    before = np.flatnonzero(flat & BEFORE) - 1
    out[before[(before >= 0) & (before < n)]] = True
    if n == rows * block and exits[-1, entry[-1] // CLASSES] // CLASSES in (QUOTED_R, QUOTED_V, QUOTED_L):
        out[n - 1] = True  # the text ends where a contraction did not
    return out


#: A space between two characters that are not white: a pre-token starts at it whatever came before.
SEAM = re.compile(r"(?<=\S) (?=\S)")


def slices(text: str, most: int) -> Iterator[str]:
    """The text in slices of `most` characters or a little more, whose pre-tokens are those of the text; one pre-token is never cut."""
    at = 0
    while len(text) - at > most and (seam := SEAM.search(text, at + most)):
        yield text[at : seam.start()]
        at = seam.start()
    yield text[at:]


def pretokens(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """All pre-tokens in order, and how many of them come before each text and in all (len + 1)."""
    if not texts:
        return [], np.zeros(1, np.int64)
    joined = "\x00".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = class_table()[codes]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    gaps = np.cumsum(lengths[:-1] + 1) - 1
    kinds[gaps] = RESET
    begin = starts_of(kinds)
    begin[gaps] = False  # the separators are no pre-tokens; what follows one starts anyway
    upto = np.cumsum(begin, dtype=np.int32)
    edges = np.concatenate([[0], gaps + 1, [len(codes)]])
    counts = np.where(edges > 0, upto[np.maximum(edges, 1) - 1] if len(codes) else 0, 0).astype(np.int64)
    # A mark that no text has goes before each pre-token, or takes the place of the separator there.
    mark = next(c for c in chain(range(1, 9), range(0xE000, 0x110000)) if not (codes == c).any())
    begin[gaps[gaps + 1 < len(codes)] + 1] = False
    place = np.cumsum(begin, dtype=np.int32)
    total = len(codes) + (int(place[-1]) if len(codes) else 0)
    place += np.arange(len(codes), dtype=np.int32)
    marked = np.full(total, mark, np.uint32)
    marked[place] = codes
    marked[place[gaps]] = mark
    return list(filter(None, marked.tobytes().decode("utf-32-le", "surrogatepass").split(chr(mark)))), counts
