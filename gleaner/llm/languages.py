"""Which of the five languages a text is mostly written in, by script and function words."""

from __future__ import annotations

import re
from collections import Counter

from gleaner.llm.prose import COMMON

_WORD = re.compile(r"[^\W\d_]+")
_HAN = re.compile("[㐀-鿿]")
#: Words of one language only count whole, shared ones for each of theirs.
_OF: dict[str, tuple[str, ...]] = {}
for _lang in ("en", "de", "fr", "es"):
    for _word in (w for w in COMMON[_lang] if len(w) > 1 or w in "aeoyàiu"):
        _OF[_word] = (*_OF.get(_word, ()), _lang)


def _bytes_of_words(encoding: str) -> bytes:
    """For every byte of an encoding without Chinese the letter it is in lower case, or a blank."""
    shown = (bytes([b]).decode(encoding, "replace").lower() for b in range(256))
    return b"".join(c.encode(encoding) if _WORD.fullmatch(c) else b" " for c in shown)


#: Most texts fit a byte a character, whose words come from one table; the others take the expressions.
_BYTES = {encoding: _bytes_of_words(encoding) for encoding in ("latin-1", "cp1252")}


def _words(text: str) -> tuple[list[str], int]:
    """Words of a text in lower case, between Chinese characters, and how many of these it has."""
    for encoding, table in _BYTES.items():
        try:
            return text.encode(encoding).translate(table).decode(encoding).split(), 0
        except UnicodeEncodeError:
            continue
    left, han = _HAN.subn(" ", text)
    return _WORD.findall(left.lower()), han


def scores(text: str | None) -> dict[str, float]:
    """Share of the text that speaks for each language (han: of its letters, the others: of its words)."""
    if not text:
        return {}
    words, han = _words(text)
    out = {"zh": 2 * han / (2 * han + sum(map(len, words))) if han else 0.0, "en": 0.0, "de": 0.0, "fr": 0.0, "es": 0.0}
    uses = Counter(filter(_OF.__contains__, words))
    for w in sorted(uses):
        langs = _OF[w]
        for lang in langs:
            out[lang] += uses[w] / len(langs)
    for lang in ("en", "de", "fr", "es"):
        out[lang] = out[lang] / max(1, len(words)) * (1 - out["zh"])
    return out


def best_of(s: dict[str, float]) -> str:
    """The language with the best score; "?" without any sign."""
    if not s or max(s.values()) == 0:
        return "?"
    if s["zh"] >= 0.3:
        return "zh"
    return max(("en", "de", "fr", "es"), key=lambda lang: (s[lang], lang))


def language(text: str | None) -> str:
    """The language a text is mostly written in."""
    return best_of(scores(text))
