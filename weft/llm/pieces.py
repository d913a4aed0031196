"""Texts as sequences of few distinct pieces, so that costly work is done once a piece and batch.

A text is cut before every space, except where the space touches other white space; the patterns of
the byte-level tokenizers never match across such a cut, so a piece can be split on its own.
"""

from __future__ import annotations

import numpy as np
import regex

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ALL = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))


class Codes(dict):
    """Numbers distinct keys in the order in which they come."""

    def __missing__(self, key):
        value = self[key] = len(self)
        return value


def _ranges(chars: list[str]) -> str:
    out, k = [], 0
    while k < len(chars):
        end = k
        while end + 1 < len(chars) and ord(chars[end + 1]) == ord(chars[end]) + 1:
            end += 1
        out.append(f"\\U{ord(chars[k]):08x}-\\U{ord(chars[end]):08x}")
        k = end + 1
    return "[" + "".join(out) + "]"


class Splitter:
    """PATTERN as another library reads it.

    matched(pattern) gives the characters of which the library says that they match; where this
    module's tables differ from its tables, texts with such characters are split by the library's.
    """

    def __init__(self, matched):
        self.usual = regex.compile(PATTERN)
        letters, numbers, spaces = ("".join(matched(x)) for x in (r"\p{L}", r"\p{N}", r"\s"))
        exact = PATTERN
        doubt: set[str] = set()
        for name, chars in ((r"\p{L}", letters), (r"\p{N}", numbers), (r"\s", spaces)):
            doubt |= set(chars) ^ set("".join(regex.findall(name, _ALL)))
        inner = {name: _ranges(sorted(chars))[1:-1] for name, chars in (("L", letters), ("N", numbers), ("s", spaces))}
        exact = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{inner['L']}]+| ?[{inner['N']}]+| ?[^{inner['s']}{inner['L']}{inner['N']}]+|[{inner['s']}]+(?![^{inner['s']}])|[{inner['s']}]+"
        self.exact = regex.compile(exact)
        self.doubtful = doubt

    def pattern(self, texts: list[str]) -> regex.Pattern:
        return self.exact if any(not x.isascii() and not self.doubtful.isdisjoint(set(x)) for x in texts) else self.usual


def vocabulary(texts: list[str], pattern: regex.Pattern) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct pieces, the pieces of all texts as numbers, and where each text starts (n + 1).

    Every piece is a text that ``pattern`` can split without its neighbours.
    """
    spaced, other = Codes(), Codes()  # pieces after a space, without it; first pieces and matches as they are
    number, take = spaced.__getitem__, other.__getitem__
    parts, heads = [], []
    for text in texts:
        head, *rest = text.split(" ")
        heads.append(head)
        parts.append(np.array(list(map(number, rest)), np.int64))
    # a space that touches white space (or an end) shows in an empty piece, or in a piece that starts or ends in white space
    touching = np.array([not x or x[0].isspace() or x[-1].isspace() for x in spaced], bool)
    out, count = [], []
    for text, head, own in zip(texts, heads, parts):
        if head[-1:].isspace() or (len(own) and (not head or touching[own].any())):
            own = np.array([~x for x in map(take, pattern.findall(text))], np.int64)
        elif head:
            own = np.append(~take(head), own)
        out.append(own)
        count.append(len(own))
    codes = np.concatenate(out) if out else np.zeros(0, np.int64)
    low = codes < 0
    codes[low] = len(spaced) + ~codes[low]
    return [" " + x for x in spaced] + list(other), codes, np.append(0, np.cumsum(count)).astype(np.int64)


def split(parts: list[str], pattern: regex.Pattern) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct matches, the matches of all pieces as numbers, and where each piece starts (n + 1)."""
    known = Codes()
    number, find = known.__getitem__, pattern.findall
    plain = pattern.pattern == PATTERN
    flat: list[int] = []
    count = []
    for x in parts:
        if plain and x[1:].isalpha() and (x[0] == " " or x[0].isalpha()):
            flat.append(number(x))
            count.append(1)
        else:
            own = find(x)
            flat += map(number, own)
            count.append(len(own))
    return list(known), np.array(flat, np.int64), np.append(0, np.cumsum(count)).astype(np.int64)


def spread(codes: np.ndarray, starts: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of the rows named by codes, one after the other, and where each begins (n + 1); rows: starts and values."""
    size = np.diff(starts)[codes]
    ends = np.append(0, np.cumsum(size))
    kind = np.int32 if max(ends[-1], len(values)) < 2**31 else np.int64
    at = np.repeat((starts[codes] - ends[:-1]).astype(kind), size)
    at += np.arange(ends[-1], dtype=kind)
    return values[at], ends


def text_steps(texts: list[str | None], most: int = 12 << 20):
    """(first, texts) of bounded length; null counts as empty."""
    own, room, first = [], 0, 0
    for k, text in enumerate(texts):
        own.append(text or "")
        room += len(own[-1])
        if room > most:
            yield first, own
            own, room, first = [], 0, k + 1
    if own:
        yield first, own
