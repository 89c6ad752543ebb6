"""Splits texts the way a byte-level BPE tokenizer does before its merges."""

from __future__ import annotations

import re
import unicodedata

import regex

#: Fixed value: the published split pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_EXACT = regex.compile(PATTERN)
#: Below this code point the classes are spelled out for the faster ``re``.
_PLAIN = 0x530
_BEYOND = re.compile(f"[^\\0-{chr(_PLAIN - 1)}]")


def _class(kind: str) -> str:
    member, out, i = regex.compile(kind), [], 0
    while i < _PLAIN:
        j = i
        while j < _PLAIN and member.fullmatch(chr(j)):
            j += 1
        if j > i:
            out.append(f"\\u{i:04x}-\\u{j - 1:04x}")
        i = j + 1
    return "".join(out)


_L, _N, _S = _class(r"\p{L}"), _class(r"\p{N}"), _class(r"\s")
_FAST = re.compile(rf" ?[{_L}]+| ?[{_N}]+|'(?:[stmd]|re|ve|ll)| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def split_words(text: str, library_split=None) -> list[str]:
    """The pieces of ``text`` that merges do not cross.

    Code points that this Python does not know as assigned may belong to a
    class in the library's newer tables; texts with such go to
    ``library_split`` (text -> pieces), where one is given.
    """
    if not _BEYOND.search(text):
        return _FAST.findall(text)
    if library_split is not None and any(unicodedata.category(c) == "Cn" for c in set(text)):
        return library_split(text)
    return _EXACT.findall(text)


def library_splitter(tokenizer):
    def split(text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    return split
