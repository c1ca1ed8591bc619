"""Cutting texts into the pieces that byte-level merges never cross, and the places of the vocabulary files."""

from __future__ import annotations

import re

import regex

#: Letters, numbers and white space below U+0250; their classes are the same in every version of Unicode.
_L = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_N = r"0-9\xb2\xb3\xb9\xbc-\xbe"
_S = r"\t-\r \x85\xa0"
#: All white space of Unicode.
SPACE = _S + r"  -     　"
_SHAPE = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{l}]+| ?[{n}]+| ?[^{s}{l}{n}]+|[{s}]+(?![^{s}])|[{s}]+"

#: Text of these characters only is cut by the narrow expression, any other by the one that knows all of Unicode.
_PLAIN = re.compile(r"[\x00-ɏ‐-‧‰-⁞€]*")
_NARROW = re.compile(_SHAPE.format(l=_L, n=_N, s=_S))
_WIDE = regex.compile(_SHAPE.format(l=r"\p{L}", n=r"\p{N}", s=SPACE))


def pieces(text: str) -> list[str]:
    return (_NARROW if _PLAIN.fullmatch(text) else _WIDE).findall(text)


def vocabulary(name: str) -> str:
    """The place of one of the public vocabulary files."""
    import public_tokenizers

    return public_tokenizers.path(name)
