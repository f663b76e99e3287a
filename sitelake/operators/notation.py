"""A structural index of nested texts: every bracket, string, scalar and key of a whole batch, from its bytes.

The texts of a batch lie behind one another in one byte buffer. Array operations
over that buffer find escapes, then the quotes that open strings, then what stands
outside them; depths are running sums and the container of each member is the last
head before it among the members of its depth. No text is read by itself. JSON and
Python notation (either quote, True, False, None, tuples, a comma at the end) share
one grammar, which two neighbours and their container decide.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_OTHER, _WHITE, _QUOTE, _BACKSLASH, _OBJECT, _ARRAY, _TUPLE, _END_OBJECT, _END_ARRAY, _END_TUPLE, _COLON, _COMMA = range(12)
_KIND = np.zeros(256, np.uint8)
for _chars, _code in ((b" \t\r\n", _WHITE), (b"\"'", _QUOTE), (b"\\", _BACKSLASH), (b"{", _OBJECT), (b"[", _ARRAY), (b"(", _TUPLE), (b"}", _END_OBJECT), (b"]", _END_ARRAY), (b")", _END_TUPLE), (b":", _COLON), (b",", _COMMA)):
    _KIND[list(_chars)] = _code
#: What a backslash and the character stand for; others stay as they are written.
_SIMPLE = np.zeros(256, np.uint8)
for _from, _to in zip(b"nrtbfav/\\\"'", b"\n\r\t\b\f\a\v/\\\"'"):
    _SIMPLE[_from] = _to
_HEX = np.full(256, 255, np.uint8)
for _i, _c in enumerate("0123456789abcdef"):
    _HEX[[ord(_c), ord(_c.upper())]] = _i
_SCALAR = r"^(?:[+-]?(?:0|[1-9][0-9]*)|[+-]?(?:[0-9]+\.[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[+-]?[0-9]+[eE][+-]?[0-9]+|true|false|null|True|False|None|NaN|[+-]?Infinity)$"
_NULLS = pa.array(["null", "None"])


@dataclass
class Members:
    """The members of all containers of a batch of complete values, by depth, then in the order of the texts.

    row: number of the text. level: 1 for members of the outermost value. parent:
    number of the container among all members, -1 for the outermost. container:
    whether it is an object or an array; in_array: whether its parent is an array.
    position: place in its parent. key, value: spans of bytes in data, key only
    in objects, value only of scalars; quoted: whether the span stood in quotes.
    """

    data: np.ndarray
    row: np.ndarray
    level: np.ndarray
    parent: np.ndarray
    container: np.ndarray
    is_array: np.ndarray
    in_array: np.ndarray
    position: np.ndarray
    key_start: np.ndarray
    key_end: np.ndarray
    value_start: np.ndarray
    value_end: np.ndarray
    quoted: np.ndarray

    def keys(self, at: np.ndarray) -> pa.Array:
        """Key of each of the members `at`: as stored, without quotes and escapes; positions in arrays as text."""
        named = np.flatnonzero(~self.in_array[at])
        if not len(named):
            return pa.array(self.position[at]).cast(pa.string())
        names = text_of(self.data, self.key_start[at[named]], self.key_end[at[named]])
        if len(named) == len(at):
            return names
        order = np.full(len(at), 0, np.int64)
        order[named] = np.arange(len(named))
        others = np.flatnonzero(self.in_array[at])
        order[others] = len(named) + np.arange(len(others))
        return pa.concat_arrays([names, pa.array(self.position[at[others]]).cast(pa.string())]).take(pa.array(order))

    def values(self, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """Scalar of each of the members `at` as text, null for containers and nulls, and which are nulls."""
        scalar = ~self.container[at]
        start, end = np.where(scalar, self.value_start[at], 0), np.where(scalar, self.value_end[at], 0)
        bare = scalar & ~self.quoted[at]
        texts = text_of(self.data, start, end)
        null = pc.is_in(texts, _NULLS).to_numpy(zero_copy_only=False) & bare
        for written, plain in (("True", "true"), ("False", "false")):
            hit = pc.equal(texts, written).to_numpy(zero_copy_only=False) & bare
            if hit.any():
                texts = pc.if_else(pa.array(hit), plain, texts)
        return pc.if_else(pa.array(scalar & ~null), texts, pa.scalar(None, pa.string())), null


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts, each ended by a newline; null and text without a bracket are empty."""
    ended = pc.binary_join_element_wise(pc.fill_null(texts, ""), "\n", "").cast(pa.large_string())
    offsets = np.frombuffer(ended.buffers()[1], np.int64)[ended.offset : ended.offset + len(ended) + 1]
    return np.frombuffer(ended.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the spans behind one another, and their offsets."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return data[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)], offsets


def _escapes(data: np.ndarray) -> np.ndarray:
    """Places of the backslashes that escape the next byte."""
    at = np.flatnonzero(data == 92)
    if not len(at):
        return at
    first = np.ones(len(at), bool)
    first[1:] = np.diff(at) != 1
    i = np.arange(len(at))
    return at[(i - np.maximum.accumulate(np.where(first, i, 0))) % 2 == 0]


def _unescaped(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with escapes resolved; half a surrogate pair becomes '?'."""
    at = _escapes(data)
    if not len(at):
        return data, offsets
    out, kept = np.concatenate([data, np.zeros(10, np.uint8)]), np.ones(len(data) + 10, bool)
    following = out[at + 1]
    simple = _SIMPLE[following] > 0
    out[at[simple] + 1] = _SIMPLE[following[simple]]
    kept[at[simple]] = False
    for letter, digits in ((b"u", 4), (b"x", 2), (b"U", 8)):
        here = at[following == letter[0]]
        if not len(here):
            continue
        hexes = _HEX[out[here[:, None] + 2 + np.arange(digits)]].astype(np.int64)
        whole = (hexes < 255).all(axis=1)
        here, hexes = here[whole], hexes[whole]
        code = (hexes << (4 * np.arange(digits - 1, -1, -1))).sum(axis=1)
        kept[here[:, None] + np.arange(2 + digits)] = False
        high = (code >= 0xD800) & (code < 0xDC00)
        low = (code >= 0xDC00) & (code < 0xE000)
        paired = np.zeros(len(here), bool)
        paired[:-1] = high[:-1] & low[1:] & (np.diff(here) == 2 + digits)
        code[paired] = 0x10000 + ((code[paired] - 0xD800) << 10) + (code[np.flatnonzero(paired) + 1] - 0xDC00)
        second = np.zeros(len(here), bool)
        second[1:] = paired[:-1]
        code = np.where((code >= 0xD800) & (code < 0xE000) | (code > 0x10FFFF), 63, code)
        for least, most, lead, size in ((0, 0x80, 0, 1), (0x80, 0x800, 0xC0, 2), (0x800, 0x10000, 0xE0, 3), (0x10000, 0x110000, 0xF0, 4)):
            hit = (code >= least) & (code < most) & ~second
            for k in range(size):
                part = code[hit] >> (6 * (size - 1 - k))
                out[here[hit] + k] = lead | part if k == 0 else 0x80 | (part & 63)
                kept[here[hit] + k] = True
    kept = kept[: len(data)]
    return out[: len(data)][kept], np.concatenate([[0], np.cumsum(kept)])[offsets]


def text_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as strings, escapes resolved."""
    found, offsets = _unescaped(*_spans(data, starts, ends))
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(found))).cast(pa.string())


def _strings(data: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the quotes that open and close strings, and the numbers of the texts in which one stays open.

    From a quote that opens a string the next one of its kind closes it and the
    quote after that opens the next. Following these leaps from each text's first
    quote, twice as far each turn, reaches all that open one.
    """
    escaped = np.zeros(len(data) + 1, bool)
    escaped[_escapes(data) + 1] = True
    quotes = np.flatnonzero((kind == _QUOTE) & ~escaped[: len(data)])
    n = len(quotes)
    if not n:
        return quotes, quotes, quotes
    row = np.searchsorted(offsets, quotes, side="right") - 1
    close = np.full(n, n)
    for q in (34, 39):
        own = np.flatnonzero(data[quotes] == q)
        same = row[own[1:]] == row[own[:-1]]
        close[own[:-1][same]] = own[1:][same]
    leap = np.full(n + 1, n)
    after = close + 1
    inside = np.flatnonzero(after < n)
    inside = inside[row[after[inside]] == row[inside]]
    leap[inside] = after[inside]
    opens = np.zeros(n + 1, bool)
    opens[np.flatnonzero(np.diff(row, prepend=-1))] = True
    while True:
        opens[leap[:n][opens[:n]]] = True
        if (leap == n).all():
            break
        leap = leap[leap]
    found = np.flatnonzero(opens[:n])
    unclosed = close[found] == n
    whole = found[~unclosed]
    return quotes[whole], quotes[close[whole]], row[found[unclosed]]


def read(data: np.ndarray, offsets: np.ndarray) -> tuple[Members, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The members of the complete values among the texts, and (bytes, offsets, rows) of the texts that were quoted as a whole, without that quoting."""
    kind = _KIND[data]
    opened, closed, unclosed = _strings(data, kind, offsets)
    rows = len(offsets) - 1
    bad = np.zeros(rows, bool)
    bad[unclosed] = True
    step = np.zeros(len(data) + 1, np.int8)
    step[opened] = 1
    step[closed] -= 1
    outside = np.cumsum(step[:-1], dtype=np.int8) == 0
    bare = outside & (kind != _QUOTE)
    other = bare & ((kind == _OTHER) | (kind == _BACKSLASH))
    edge = np.diff(other.astype(np.int8), prepend=0, append=0)
    scalar_start, scalar_end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    token = bare & (kind >= _OBJECT)
    token[opened] = True
    token[scalar_start] = True
    pos = np.flatnonzero(token)
    what = kind[pos]
    what[what == _BACKSLASH] = _OTHER
    row = np.searchsorted(offsets, pos, side="right") - 1
    end = pos + 1
    end[what == _QUOTE] = closed
    end[what == _OTHER] = scalar_end
    if len(scalar_start):
        words = text_words(data, scalar_start, scalar_end)
        wrong = ~pc.match_substring_regex(words.dictionary, _SCALAR).to_numpy(zero_copy_only=False)
        bad[row[what == _OTHER][wrong[words.indices.to_numpy()]]] = True

    # texts quoted as a whole: one token, a string
    tokens_of = np.bincount(row, minlength=rows)
    alone = tokens_of[row] == 1
    quoted = np.flatnonzero(alone & (what == _QUOTE) & ~bad[row])
    inner, inner_offsets = _spans(data, pos[quoted] + 1, end[quoted] + 1)
    inner = inner.copy()
    inner[inner_offsets[1:] - 1] = 10  # the quote that closes becomes the line end
    inner_rows = row[quoted]
    within = (*_unescaped(inner, inner_offsets), inner_rows)

    # depths
    is_open, is_close = (what >= _OBJECT) & (what <= _TUPLE), (what >= _END_OBJECT) & (what <= _END_TUPLE)
    depth = np.cumsum(is_open.astype(np.int64) - is_close)
    first = np.flatnonzero(np.diff(row, prepend=-1))
    before = np.zeros(rows, np.int64)
    before[row[first]] = depth[first] - is_open[first] + is_close[first]
    depth -= before[row]
    last = np.append(first[1:], len(pos)) - 1
    if len(pos):
        bad[row[first]] |= depth[last] != 0
    bad[row[depth < 0]] = True
    bad[row[first][~is_open[first]]] = True  # scalars at the top, and members without a container
    whole = np.flatnonzero(~bad[row])
    pos, end, what, row, depth, is_open, is_close = (x[whole] for x in (pos, end, what, row, depth, is_open, is_close))

    # the members of each container, side by side: an opening bracket is a member of its container and the head of its own
    twice = np.repeat(np.arange(len(pos)), 1 + is_open)
    head = np.zeros(len(twice), bool)
    head[1:] = twice[1:] == twice[:-1]
    level = depth[twice] - (is_open[twice] & ~head) + is_close[twice]
    most = int(level.max(initial=0))
    order = np.argsort(level.astype(np.uint8 if most < 256 else np.uint16 if most < 65536 else np.int64), kind="stable")
    twice, head, level = twice[order], head[order], level[order]
    at = np.arange(len(twice))
    heads = np.maximum.accumulate(np.where(head, at, 0))
    kinds, owner = what[twice], what[twice[heads]] if len(twice) else what
    top = level == 0
    new = np.ones(len(twice), bool)
    new[1:] = row[twice[1:]] != row[twice[:-1]]
    member_bad = top & ~new  # a second value behind the first
    prev = np.empty(len(twice), np.uint8)
    prev[:1], prev[1:] = 0, kinds[:-1]
    after_head = np.zeros(len(twice), bool)
    after_head[1:] = head[:-1]
    value = (kinds <= _TUPLE) & (kinds != _WHITE)
    in_object = owner == _OBJECT
    after_value = (prev <= _TUPLE) & ~after_head
    after_value |= (prev >= _END_OBJECT) & (prev <= _END_TUPLE)
    # a closed container's bracket stands at its own level, so the member before is its opening one
    start = after_head | (prev == _COMMA)
    key = in_object & value & start
    was_key = np.zeros(len(twice), bool)
    was_key[1:] = key[:-1]
    fine = np.where(
        value,
        np.where(in_object, start & ~is_open[twice] | (prev == _COLON), start),
        np.where(kinds == _COLON, in_object & was_key, np.where(kinds == _COMMA, after_value & ~was_key, after_head | after_value & ~was_key | (prev == _COMMA))),
    )
    closing = is_close[twice]
    fine &= ~closing | (kinds == owner + 3)
    single = np.zeros(len(twice), bool)  # (x) is x in brackets, no tuple
    single[2:] = closing[2:] & head[:-2] & (owner[2:] == _TUPLE) & ~head[1:-1]
    member_bad |= ~top & ~head & (~fine | single)
    bad[row[twice[member_bad]]] = True

    use = np.flatnonzero(value & ~head & ~key & ~bad[row[twice]])
    tok = twice[use]
    number = np.full(len(pos), -1)
    number[tok] = np.arange(len(tok))
    parent = np.where(top[use], -1, number[twice[heads[use]]])
    in_array = ~in_object[use] & ~top[use]
    commas = np.cumsum(kinds == _COMMA)
    position = commas[use] - commas[heads[use]]
    named = np.where(in_object[use] & ~top[use], twice[np.maximum(use - 2, 0)], 0)
    strings, key_strings = what[tok] == _QUOTE, what[named] == _QUOTE
    members = Members(
        data, row[tok], level[use], parent, is_open[tok], is_open[tok] & (what[tok] != _OBJECT), in_array, position,
        pos[named] + key_strings, end[named], pos[tok] + strings, end[tok], strings,
    )
    return members, within


def text_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.DictionaryArray:
    """The spans as a dictionary of their different texts; bytes are taken one by one, so that any are valid."""
    found, offsets = _spans(data, starts, ends)
    wide = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(found))])
    return wide.cast(pa.binary()).dictionary_encode()
