"""Pre-tokenisation without regex: class arrays and a scan of transition functions over whole batches of text.

It cuts text where public_tokenizers.PATTERN does: contractions, letters, numbers or other signs with a space before
them, and white space, whose last sign stays with what follows.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

#: Classes of code points with what follows them: letter, number, other sign, apostrophe before a contraction of one or
#: of two letters, white space, and the last of white space before a sign: any, or a space.
LETTER, NUMBER, SIGN, SHORT, LONG, WHITE, LAST, LAST_SPACE = range(8)
#: States: at a fresh start; within letters, numbers, signs, white space; after a space that goes with what follows;
#: with two or one letters of a contraction to come.
FRESH, LETTERS, NUMBERS, SIGNS, WHITES, SPACED, TWO, ONE = range(8)
_FIRST, _CUT, _SPAN = 8, 8, 64
#: White space of Unicode.
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    found = (kinds.get(unicodedata.category(chr(c))[0], SIGN) if unicodedata.category(chr(c)) != "Cn" else 255 for c in range(0x110000))
    out = np.fromiter(found, np.uint8, 0x110000)
    out[_WHITE] = WHITE
    return out


@functools.cache
def _splitter():
    from tokenizers import pre_tokenizers

    return pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str


def classes_of(codes: np.ndarray) -> np.ndarray:
    """Code points newer than Python's tables are looked up in the tokenizer library's own, once each."""
    table = _classes()
    got = table[codes]
    for c in np.unique(codes[got == 255]).tolist():
        table[c] = next((k for k, probe in ((LETTER, "a"), (NUMBER, "1")) if len(_splitter()(probe + chr(c))) == 1), SIGN)
    return table[codes] if (got == 255).any() else got


@functools.cache
def _steps() -> np.ndarray:
    """Next state, plus _CUT where a piece begins, by class (plus _FIRST for the first of a text) and state."""
    step = np.zeros((16, 8), np.uint8)
    opened = {LETTER: LETTERS, NUMBER: NUMBERS, SIGN: SIGNS, SHORT: ONE, LONG: TWO, WHITE: WHITES, LAST: FRESH, LAST_SPACE: SPACED}
    for kind, state in opened.items():
        step[kind] = step[kind + _FIRST] = state + _CUT
    step[LETTER, [LETTERS, SPACED]] = LETTERS
    step[NUMBER, [NUMBERS, SPACED]] = NUMBERS
    for kind in (SIGN, SHORT, LONG):
        step[kind, [SIGNS, SPACED]] = SIGNS
    step[WHITE, WHITES] = WHITES
    step[:8, TWO] = ONE
    step[:8, ONE] = FRESH
    return step


def cuts(codes: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Where pieces begin in `codes`, texts laid end to end of which each begins at one of `heads`."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes_of(codes)
    first = np.zeros(n + 3, bool)
    first[heads[heads < n]] = True
    first[n:] = True
    white = kind == WHITE
    follows = np.append(~white[1:], False) & ~first[1 : n + 1]
    kind = kind.copy()
    kind[white & follows] = LAST
    kind[white & follows & (codes == 32)] = LAST_SPACE
    marks = np.flatnonzero(codes == 39)
    if len(marks):
        after = np.append(codes, [0, 0])
        one, two = after[marks + 1], after[marks + 2]
        joined = ~first[marks + 1]
        short = joined & np.isin(one, [ord(c) for c in "stmd"])
        pair = joined & ~first[marks + 2] & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        kind[marks[short]] = SHORT
        kind[marks[pair & ~short]] = LONG
    kind[first[:n]] += _FIRST
    step = _steps()
    ahead = (step & 7).ravel()
    rows = -(-n // _SPAN)
    grid = np.full(rows * _SPAN, _FIRST, np.uint8)
    grid[:n] = kind
    grid = np.ascontiguousarray(grid.reshape(rows, _SPAN).T).astype(np.uint16) << 3
    maps = np.broadcast_to(np.arange(8, dtype=np.uint8), (rows, 8))
    for column in grid:
        maps = ahead[column[:, None] + maps]
    width = 1
    while width < rows:  # maps[i] becomes the composition of all rows up to i
        joined = maps.copy()
        joined[width:] = np.take_along_axis(maps[width:], maps[:-width].astype(np.intp), 1)
        maps, width = joined, 2 * width
    state = np.zeros(rows, np.uint8)
    state[1:] = maps[:-1, FRESH]
    begins = np.zeros((_SPAN, rows), bool)
    flat = step.ravel()
    for k, column in enumerate(grid):
        got = flat[column + state]
        begins[k] = got >= _CUT
        state = got & 7
    return np.flatnonzero(begins.T.ravel()[:n])


def pieces(text: str, heads: np.ndarray, whole: list[tuple[int, int]] = ()) -> tuple[list[str], np.ndarray]:
    """The pieces of texts laid end to end, and where each begins; spans of `whole` (start, end) are pieces of their own."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if whole:
        heads = np.concatenate([heads, *[np.array(span) for span in whole]])
    at = cuts(codes, heads)
    for a, b in whole:
        at = at[(at <= a) | (at >= b)]
    ends = np.append(at[1:], len(codes))
    return [text[a:b] for a, b in zip(at.tolist(), ends.tolist(), strict=True)], at


def text_heads(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte offsets as code point offsets."""
    count = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=count[1:])
    return count[offsets]


#: Bytes of text that become lists of pieces at a time.
STEP_BYTES = 1 << 19


class Cache(dict):
    """What `make` gives for a piece, kept until there are too many: at `most`, some 300 bytes each, about 45 MB."""

    def __init__(self, make, most: int = 150_000, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, piece: str):
        got = self.make(piece)
        if len(piece) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[piece] = got
        return got
