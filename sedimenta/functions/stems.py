"""Porter's stemming algorithm (M. F. Porter, An algorithm for suffix stripping, 1980)."""

from __future__ import annotations

import re

# The endings of the published steps 2 to 4, each with what takes its place.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(word: str) -> str:
    """c for consonants and v for vowels; y after a consonant is a vowel."""
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in "aeiou" or c == "y" and i > 0 and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short(word: str) -> bool:
    """Ends consonant, vowel, consonant, the last none of w, x and y."""
    return len(word) > 2 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replaced(word: str, endings: dict[str, str]) -> str:
    """The longest ending that fits decides, whether its stem is long enough or not."""
    found = max((e for e in endings if word.endswith(e)), key=len, default=None)
    if found is None or _measure(word[: -len(found)]) < 1:
        return word
    return word[: -len(found)] + endings[found]


def porter(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters, and those with others than a-z, stay."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    for end, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(end):
            word = word[: -len(end)] + to
            break
    cut = next((e for e in ("eed", "ed", "ing") if word.endswith(e)), None)
    if cut == "eed":
        word = word[:-1] if _measure(word[:-3]) else word
    elif cut and "v" in _shape(word[: -len(cut)]):
        word = word[: -len(cut)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _short(word):
            word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, STEP2), STEP3)
    found = max((e for e in STEP4 if word.endswith(e)), key=len, default=None)
    if found and _measure(word[: -len(found)]) > 1 and (found != "ion" or word[-4] in "st"):
        word = word[: -len(found)]
    if word.endswith("e") and (_measure(word[:-1]) > 1 or _measure(word[:-1]) == 1 and not _short(word[:-1])):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word
