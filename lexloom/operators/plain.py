"""Plain statements of TypeScript and JavaScript, many texts at a time.

Texts of words, whole numbers, calls, blocks and named functions alone need no
scanner: every rule of ``tsjs`` that such texts can meet is a comparison of
neighbouring lexemes or of a bracket with its partner, so whole arrays of lexemes
are decided at once.  A text that holds anything else is left to the scanner.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..schema import MOST_DEPTH, TEXT_CAP
from .tsjs import CONTEXTUAL, KEYWORDS, MODIFIERS, TYPES, VALUES

#: Keywords that plain texts may hold, and words that may mean something else where they stand.
_PLAIN_WORDS = ("function", "debugger", "if", "while", "else", "return")
_OTHER_WORDS = tuple(sorted((KEYWORDS | CONTEXTUAL | MODIFIERS | TYPES | VALUES.keys()) - set(_PLAIN_WORDS)))
_WORDS = pa.array([*_PLAIN_WORDS, *_OTHER_WORDS])
_FUNCTION, _ELSE = _PLAIN_WORDS.index("function"), _PLAIN_WORDS.index("else")
_SYMBOLS = "{}();,"
_KINDS = pa.array(["identifier", "number", *_SYMBOLS, *_PLAIN_WORDS])
_CLASSES = pa.array(["ident", "num", "symbol"])
#: What a byte is.
_OTHER, _BLANK, _DIGIT, _LETTER, _SYMBOL = range(5)
_BYTES = np.zeros(256, np.uint8)
_BYTES[list(b" \t\n\r\v\f")] = _BLANK
_BYTES[list(b"0123456789")] = _DIGIT
_BYTES[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_$")] = _LETTER
_BYTES[list(_SYMBOLS.encode())] = _SYMBOL
_SYMBOL_KIND = np.zeros(256, np.int8)
_SYMBOL_KIND[list(_SYMBOLS.encode())] = np.arange(2, 2 + len(_SYMBOLS))
_OPEN, _CLOSE, _ROUND, _ROUND_CLOSE, _STOP, _COMMA = range(2, 8)
#: Blocks inside one another at most.
_NESTED = 32


def is_plain(text: bytes) -> bool:
    """Whether a text is made of bytes that plain statements have."""
    return bool(_BYTES[np.frombuffer(text, np.uint8)].all()) if text else False


def plain_tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, dict[str, pa.Array]]:
    """(indexes of texts that are plain statements, text of each token, columns of the tokens).

    The columns are those of the tokens relation but file and language.
    """
    own = np.array([i for i, t in enumerate(texts) if is_plain(t)], np.int64)
    while len(own):
        odd, of, columns = _tokens([texts[i] for i in own])
        if not len(odd):
            return own, own[of], columns
        own = np.delete(own, odd)
    return own, own, {}


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, dict[str, pa.Array]]:
    """(indexes of texts that are not plain, text of each token, columns); columns count only if all texts are plain."""
    raw = np.frombuffer(b"\n".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    what = _BYTES[raw]
    wordy, symbol = (what == _DIGIT) | (what == _LETTER), what == _SYMBOL
    edge = np.diff(wordy.astype(np.int8), prepend=0, append=0)
    start = np.flatnonzero((edge[:-1] == 1) | symbol)
    end = np.flatnonzero((edge[1:] == -1) | symbol) + 1
    firsts = np.searchsorted(start, begins)
    counts = np.diff(np.append(firsts, len(start)))
    of = np.repeat(np.arange(len(texts)), counts)
    odd = [np.flatnonzero(counts == 0)]
    if not len(start):
        return odd[0], of, {}

    length, kind = end - start, _SYMBOL_KIND[raw[start]].copy()
    letters = np.cumsum(what == _LETTER, dtype=np.int32)
    number = what[start] == _DIGIT
    odd.append(of[(length > TEXT_CAP) | number & (letters[end - 1] != letters[start])])
    kind[number] = 1
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    text = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(raw[wordy | symbol]))
    word = pc.fill_null(pc.index_in(text, value_set=_WORDS), -1).to_numpy()
    odd.append(of[word >= len(_PLAIN_WORDS)])
    special = (word >= 0) & (word < len(_PLAIN_WORDS))
    kind[special] = word[special] + len(_SYMBOLS) + 2

    # Neighbours within the text; -1 where it begins or ends.
    before, after = np.full(len(kind), -1, np.int8), np.full(len(kind), -1, np.int8)
    inner = of[1:] == of[:-1]
    before[1:][inner], after[:-1][inner] = kind[:-1][inner], kind[1:][inner]

    # Brackets pair up with the next one on their level.
    opens, closes = (kind == _OPEN) | (kind == _ROUND), (kind == _CLOSE) | (kind == _ROUND_CLOSE)
    bracket = np.flatnonzero(opens | closes)
    opening, file = opens[bracket], of[bracket]
    height = np.cumsum(np.where(opening, 1, -1))
    at_first = np.searchsorted(bracket, firsts)
    base = np.concatenate([[0], height])[at_first]
    odd.append(np.flatnonzero(np.diff(np.append(base, height[-1] if len(height) else 0)) != 0))
    level = height - opening - base[file]
    odd.append(file[level < 0])
    order = np.lexsort((level, file))
    one, two = order[:-1], order[1:]
    pairs = opening[one] & ~opening[two] & (level[one] == level[two]) & (file[one] == file[two]) & (kind[bracket[two]] == kind[bracket[one]] + 1)
    one, two = bracket[one[pairs]], bracket[two[pairs]]
    partner = np.full(len(kind), -1, np.int64)
    partner[one], partner[two] = two, one
    odd.append(of[bracket[partner[bracket] < 0]])

    # Blocks follow statements or heads; anything else may be an object.
    block = np.isin(before, (-1, _OPEN, _CLOSE, _ROUND_CLOSE, _STOP, _ELSE + len(_SYMBOLS) + 2))
    odd.append(of[(kind == _OPEN) & ~block])
    # Functions have a name, parameters and a body, and begin a statement.
    first = np.flatnonzero(word == _FUNCTION)
    inside = first + 2 < len(kind)
    odd.append(of[first[~inside]])
    first = first[inside]
    body = np.minimum(partner[first + 2] + 1, len(kind) - 1)
    fits = np.isin(before[first], (-1, _OPEN, _CLOSE, _ROUND_CLOSE, _STOP)) & (kind[first + 1] == 0) & (kind[first + 2] == _ROUND)
    fits &= (of[first + 2] == of[first]) & (partner[first + 2] >= 0) & (kind[body] == _OPEN) & (of[body] == of[first]) & (partner[body] >= 0)
    odd.append(of[first[~fits]])
    # A name, parameters and a body behind a brace or comma are a method.
    call = np.flatnonzero((kind < 2) & (after == _ROUND) & ((before == _OPEN) | (before == _COMMA)))
    behind = np.minimum(partner[np.minimum(call + 1, len(kind) - 1)] + 1, len(kind) - 1)
    odd.append(of[call[(kind[behind] == _OPEN) & (of[behind] == of[call])]])

    curly = np.cumsum((kind == _OPEN).astype(np.int32) - (kind == _CLOSE))
    curly -= np.concatenate([[0], curly])[firsts[of]]
    odd.append(of[curly > _NESTED])
    odd = np.unique(np.concatenate(odd))
    if len(odd):
        return odd, of, {}
    round_ = np.cumsum((kind == _ROUND).astype(np.int32) - (kind == _ROUND_CLOSE))
    round_ -= np.concatenate([[0], round_])[firsts[of]]

    named = np.zeros(len(kind), np.int32)  # inner functions come later and stand
    for i, (a, b) in enumerate(zip(first.tolist(), (partner[body] + 1).tolist())):
        named[a:b] = i + 1
    names = pa.concat_arrays([pa.array([""]), text.take(pa.array(first + 1))])

    place = np.arange(len(kind))
    around = curly - (kind == _OPEN)
    starts = np.concatenate([[0], np.cumsum(around + 1)]).astype(np.int32)
    path = np.full(starts[-1], -1, np.int32)
    for depth in range(1, int(around.max()) + 1):
        last = np.maximum.accumulate(np.where((kind == _OPEN) & (curly == depth), place, 0))
        deep = np.flatnonzero(around >= depth)
        path[starts[deep] + depth] = last[deep] - firsts[of[deep]]

    breaks = raw == 10
    lines = np.cumsum(breaks)
    line = lines[start] - np.concatenate([[0], lines])[begins][of] + 1
    line_start = np.maximum.accumulate(np.where(breaks, np.arange(1, len(raw) + 1), 0))[start]
    offset = begins[of]
    return odd, of, {
        "pos": pa.array((place - firsts[of]).astype(np.int32)),
        "node_kind": _KINDS.take(pa.array(kind)),
        "class": _CLASSES.take(pa.array(np.minimum(kind, 2))),
        "text": text,
        "function": names.take(pa.array(named)),
        "named": pa.array(kind < 2),
        "start_byte": pa.array(start - offset),
        "end_byte": pa.array(end - offset),
        "start_line": pa.array(line),
        "start_col": pa.array(start - line_start + 1),
        "end_line": pa.array(line),
        "end_col": pa.array(end - line_start + 1),
        "curly_depth": pa.array(np.minimum(curly + (kind == _CLOSE), MOST_DEPTH).astype(np.int32)),
        "round_depth": pa.array(np.minimum(round_ + (kind == _ROUND_CLOSE), MOST_DEPTH).astype(np.int32)),
        "bracket_depth": pa.array(np.zeros(len(kind), np.int32)),
        "jmp": pa.array((partner - firsts[of]).astype(np.int32), mask=partner < 0),
        "block_path": pa.ListArray.from_arrays(pa.array(starts), pa.array(path)),
    }
