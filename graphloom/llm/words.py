"""Words of texts as arrays of hashes, many texts at a time."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np

#: Characters that a block of texts holds; bounds the memory of a task whatever the batch.
BLOCK_CHARS = 400_000

# fixed values: HTML elements that begin a new line or cell
_BREAKING = frozenset("p div br hr li ul ol dl dt dd td th tr table thead tbody tfoot caption h1 h2 h3 h4 h5 h6 pre blockquote section article aside header footer main nav address figure figcaption form fieldset legend option title body html head".split())
# fixed values: HTML elements that stand inside running text or have none
_INLINE = frozenset("a abbr acronym audio b base basefont bdi bdo big button canvas center cite code col colgroup data datalist del details dfn dialog dir em embed font frame frameset hgroup i iframe img input ins kbd label link map mark menu meta meter noframes noscript object optgroup output param picture progress q rp rt ruby s samp script search select slot small source span strike strong style sub summary sup svg math template textarea time track tt u var video wbr".split())
# fixed values: attributes that have no value
_BARE = "allowfullscreen|async|autofocus|autoplay|checked|compact|controls|default|defer|disabled|download|formnovalidate|hidden|inert|ismap|itemscope|loop|multiple|muted|nomodule|noshade|novalidate|nowrap|open|playsinline|readonly|required|reversed|selected"
_NAME = r"[A-Za-z][A-Za-z0-9:._-]*+"
_VALUE = r"""(?:"[^"<]*+"|'[^'<]*+'|[^\s"'=<>`]++)"""
_ATTRIBUTES = rf"""(?:\s++(?:[^\s"'<>/=]++\s*+=\s*+{_VALUE}|(?:{_BARE})(?![^\s/>])))*+"""
_TAG = re.compile(rf"<(?:(/)({_NAME})\s*+|({_NAME}){_ATTRIBUTES}\s*+/?+)>|<!--.*?-->|<!doctype\b[^<>]*+>", re.IGNORECASE | re.DOTALL)
_CLOSING = re.compile(rf"</({_NAME})\s*+>")

_LETTER = np.uint64(0x9E3779B97F4A7C15)
_WORD = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F))


@cache
def _invisible() -> frozenset[str]:
    """Format characters such as soft hyphens, joiners and zero-width spaces."""
    return frozenset(chr(c) for c in range(0xE0080) if unicodedata.category(chr(c)) == "Cf")


def _without_tags(text: str) -> str:
    """Text without tags of any length; those of blocks and cells become line feeds.

    A tag is one by its grammar: a name, then attributes that have a value or
    are known to need none. Its name is that of an HTML element, or is closed
    somewhere in the text. Any other ``<`` is a character like others, so
    ``if x <y and z> 1`` stays whole.
    """
    closed: set[str] | None = None

    def instead(tag: re.Match) -> str:
        nonlocal closed
        name = (tag[2] or tag[3] or "").lower()
        if name in _BREAKING:
            return "\n"
        if not name or name in _INLINE or tag[1]:
            return ""
        if closed is None:
            closed = {found.lower() for found in _CLOSING.findall(text)}
        return "" if name in closed else tag[0]

    return _TAG.sub(instead, text)


def plain(text: str) -> str:
    """Text without markup, entities, invisible characters and differing encodings of one character; lines stay.

    Letter case stays too. Texts of ASCII characters without markup come back as they are.
    """
    if "<" in text:
        text = _without_tags(text)
    if "&" in text:
        escaped = "&lt;" in text or "&#" in text
        text = html.unescape(text)
        if escaped and "<" in text:
            text = _without_tags(text)
    if not text.isascii():
        for character in _invisible().intersection(text):
            text = text.replace(character, "")
        text = unicodedata.normalize("NFKC", text)
    return text


def fold(text: str) -> str:
    """Without regard to letter case."""
    return text.lower() if text.isascii() else text.casefold()


@cache
def _kinds() -> np.ndarray:
    """For each code point: 0 between words, 1 in a word, 2 a word by itself (scripts without spaces)."""
    kinds = np.fromiter((chr(c).isalnum() for c in range(0x32000)), np.uint8, 0x32000)
    for low, high in ((0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x31FFF)):
        kinds[low : high + 1] *= 2
    return kinds


@cache
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers, so that any part of them serves as a hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(texts: Iterable[tuple[int, str]], limit: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """Group numbered texts into blocks of about ``limit`` characters; a longer text is a block by itself, whole."""
    block, size = [], 0
    for item in texts:
        block.append(item)
        size += len(item[1]) + 1
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def code_points(texts: list[str]) -> np.ndarray:
    """The code points of the texts, each text followed by a line feed."""
    return np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "replace"), "<u4")


def spans(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and last place of each word.

    A word is a run of letters and digits; each character of a script written
    without spaces is a word.
    """
    kinds = _kinds()[np.minimum(codes, 0x31FFF)]
    inside = kinds > 0
    alone = kinds == 2
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | alone[1:] | alone[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | alone[1:] | alone[:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends)


def words(texts: list[str], codes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of folded texts without line feeds, in order, and the number of each word's text."""
    codes = code_points(texts) if codes is None else codes
    first, last = spans(codes)
    size = 1 << max(12, int(len(codes) - 1).bit_length())
    with np.errstate(over="ignore"):
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes.astype(np.uint64) * _powers(int(_LETTER), size)[: len(codes)], out=sums[1:])
        inverse = pow(int(_LETTER), -1, 1 << 64)
        hashes = mixed((sums[last + 1] - sums[first]) * _powers(inverse, size)[first] + (last - first).astype(np.uint64))
    line = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(codes == 10, out=line[1:])
    return hashes, line[first]


def shingles(hashes: np.ndarray, width: int, kind: int = 0) -> np.ndarray:
    """Hashes of ``width`` consecutive words, from each position where so many follow."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = hashes[:n].copy()
        for i in range(1, width):
            out = out * _WORD[kind] + hashes[i : n + i]
        return mixed(out + np.uint64(width))


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` consecutive values, from each position."""
    reach = 1
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values
