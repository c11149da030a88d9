"""Plain words and own text of forum posts."""

from __future__ import annotations

import html
import re
import unicodedata

_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
_IMAGE = re.compile(r"\[img\][^\[\]]*\[/img\]", re.I)
_INLINE = re.compile(r"</?(?:b|i|u|s|em|strong|span|font|a|code|small|big)\b[^<>]*>|\[/?(?:b|i|u|s|size|color|font|url|code)(?:=[^\[\]]*)?\]", re.I)
_BLOCK = re.compile(r"</?[a-z][a-z0-9]*\b[^<>]*>|\[/?(?:quote|list|\*|img|center|spoiler)(?:=[^\[\]]*)?\]", re.I)
_WORD = re.compile(r"[^\W_]+")


def plain(text: str) -> str:
    """Text without markup, entities and invisible characters."""
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    if "[" in text or "<" in text:
        text = _BLOCK.sub(" ", _INLINE.sub("", _IMAGE.sub(" ", text)))
    return text


def words(text: str | None) -> list[str]:
    """Words without case, punctuation, markup, quote marks and line layout; none of a null."""
    return _WORD.findall(plain(text).casefold()) if text else []
