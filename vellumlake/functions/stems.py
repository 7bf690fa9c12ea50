"""Stems of English words by Porter's published rules, and Latin letters without their marks."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

#: Fixed values of the algorithm: endings and what they become, if what stands before them has a measure over 0 (second and third step) or over 1 (fourth step).
SECOND = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
LONGEST = 64


def shape(word: str) -> str:
    """c for each consonant and v for each vowel; y is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in "aeiou" or (c == "y" and i and out[-1] == "c") else "c"
    return out


def measure(word: str) -> int:
    return shape(word).count("vc")


def _short(word: str) -> bool:
    """Consonant, vowel, consonant other than w, x and y at the end."""
    return shape(word).endswith("cvc") and word[-1] not in "wxy"


def _ending(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _plural(w: str) -> str:
    if len(w) > 4 and w.endswith("sses") or len(w) > 3 and w.endswith("ies"):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _past(w: str) -> str:
    if len(w) > 3 and w.endswith("eed"):
        return w[:-1] if measure(w[:-3]) else w
    for e in ("ed", "ing"):
        if w.endswith(e) and "v" in shape(w[: -len(e)]):
            w = w[: -len(e)]
            if w.endswith(("at", "bl", "iz")):
                return w + "e"
            if len(w) > 1 and w[-1] == w[-2] and shape(w)[-1] == "c" and w[-1] not in "lsz":
                return w[:-1]
            return w + "e" if measure(w) == 1 and _short(w) else w
    return w


def _suffixes(w: str) -> str:
    for table in (SECOND, THIRD):
        if (e := _ending(w, table)) and measure(w[: -len(e)]):
            w = w[: -len(e)] + table[e]
    if (e := _ending(w, FOURTH)) and measure(w[: -len(e)]) > 1 and (e != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(e)]
    if w.endswith("e") and (measure(w[:-1]) > 1 or measure(w[:-1]) == 1 and not _short(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w[:-1]) > 1 else w


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of fewer than three letters or of over LONGEST bytes stay."""
    if not 2 < len(word.encode()) <= LONGEST:
        return word
    w = _past(_plural(word))
    if w.endswith("y") and "v" in shape(w[:-1]):
        w = w[:-1] + "i"
    return _suffixes(w)


@lru_cache(maxsize=1)
def marks() -> tuple[str, str]:
    """Latin letters with marks, and the plain lower-case letters that they stand for: what translate() takes."""
    plain = {}
    for i in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(i))
        if len(base) > 1 and base[0].isascii() and base[0].isalpha() and all(unicodedata.combining(c) for c in base[1:]):
            plain[chr(i)] = base[0].lower()
    return "".join(plain), "".join(plain.values())
