"""Finite automata over arrays of symbols, by associative scans of transition functions.

The effect of a symbol on an automaton with S states is a function on states, an array of S entries. Composition of
such functions is associative, so the states along a long text follow from a parallel prefix scan: the text is cut into
blocks that are composed side by side (one array step per position within a block), the blocks' functions are composed
in log2(blocks) doubling steps, and a last sweep fills in the states.
"""

from __future__ import annotations

import numpy as np


def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Row-wise composition of state functions given as [row][state]: ``first``, then ``then``."""
    return np.take_along_axis(then, first.astype(np.intp), axis=1)


def prefix_functions(funcs: np.ndarray) -> np.ndarray:
    """Inclusive prefix compositions over rows, in doubling steps."""
    out, step = funcs.copy(), 1
    while step < len(out):
        out[step:] = compose(out[:-step], out[step:])
        step *= 2
    return out


def states_after(symbols: np.ndarray, table: np.ndarray, start: int = 0, block: int = 256) -> np.ndarray:
    """The state after each symbol; ``table`` is [symbol][state] -> state (uint8)."""
    n, (n_symbols, n_states) = len(symbols), table.shape
    if not n:
        return np.zeros(0, np.uint8)
    blocks = -(-n // block)
    # one extra symbol that changes nothing fills the last block
    flat = np.concatenate([table, np.arange(n_states, dtype=np.uint8)[None]]).ravel()
    at = np.full(blocks * block, n_symbols * n_states, np.int16)
    at[:n] = symbols.astype(np.int16) * n_states
    at = np.ascontiguousarray(at.reshape(blocks, block).T)
    funcs = np.tile(np.arange(n_states, dtype=np.uint8), (blocks, 1))
    for row in at:
        funcs = flat[row[:, None] + funcs]
    entry = np.empty(blocks, np.uint8)
    entry[0] = start
    entry[1:] = prefix_functions(funcs)[:-1, start]
    out = np.empty((block, blocks), np.uint8)
    state = entry
    for i, row in enumerate(at):
        state = flat[row + state]
        out[i] = state
    return np.ascontiguousarray(out.T).ravel()[:n]


#: Code points with the Unicode property White_Space.
WHITE_SPACE = (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
LETTER, NUMBER, SPACE, OTHER, BREAK = range(5)
#: The code point put between the texts of a batch; no valid text holds it.
BREAK_CHAR = "\ud800"


def codepoint_classes() -> np.ndarray:
    """LETTER, NUMBER, SPACE, OTHER by code point; BREAK for the separator."""
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x110000)))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            out[a:b + 1] = kind
    out[list(WHITE_SPACE)] = SPACE
    out[0xD800:0xE000] = OTHER
    out[ord(BREAK_CHAR)] = BREAK
    return out


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
