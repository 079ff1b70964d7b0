"""Pre-tokens of the two public byte-pair vocabularies, as their own settings define them."""

from __future__ import annotations

import re

import regex

#: White space of the vocabularies' patterns (the Unicode property, which leaves out U+001C to U+001F).
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Texts of these characters only take the faster module; the classes below are the same for them.
_LATIN = re.compile(r"[\x00-\x7fÀ-ÖØ-öø-ÿ]*")


def _byte_level(letters: str, digits: str) -> str:
    return (rf"'(?:s|t|re|ve|m|ll|d)| ?[{letters}]+| ?[{digits}]+| ?[^{_SPACE}{letters}{digits}]+"
            rf"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def _word_level(letters: str, digits: str) -> str:
    return rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{_SPACE}{letters}{digits}]+"


_BYTE_LATIN = re.compile(_byte_level("a-zA-ZÀ-ÖØ-öø-ÿ", "0-9"))
_BYTE_ANY = regex.compile(_byte_level(r"\p{L}", r"\p{N}"))
_WORD_LATIN = re.compile(_word_level("a-zß-öø-ÿ", "0-9"))


def byte_level(text: str) -> list[str]:
    """Pre-tokens of the byte-level vocabulary; joined they give the text."""
    return (_BYTE_LATIN if _LATIN.fullmatch(text) else _BYTE_ANY).findall(text)


def word_level(text: str) -> list[str] | None:
    """Lower-case pre-tokens of the word-end vocabulary; None for texts beyond plain Latin letters."""
    return _WORD_LATIN.findall(text.lower()) if _LATIN.fullmatch(text) else None
