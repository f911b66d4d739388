"""The English Snowball stemmer (Porter2), from its public description."""

from __future__ import annotations

import re

#: Words with stems of their own.
_OWN = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_SAME = frozenset("sky news howe atlas cosmos bias andes".split())
_AFTER_PLURAL = frozenset("inning outing canning herring earring proceed exceed succeed".split())
#: Endings of the second and third steps and what they become.
_SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
_THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_FOURTH = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()

_VOWEL = re.compile("[aeiouy]")
_REGION = re.compile("[aeiouy][^aeiouy]")
_SHORT = re.compile("(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")


def _after(word: str, start: int) -> int:
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2 or word in _SAME:
        return word
    if word in _OWN:
        return _OWN[word]
    word = word.removeprefix("'")
    word = re.sub(r"^y|(?<=[aeiouy])y", "Y", word)
    prefix = next((p for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    r1 = len(prefix) if prefix else _after(word, 0)
    r2 = _after(word, r1)
    word = re.sub("'s'$|'s$|'$", "", word)
    # plurals
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and _VOWEL.search(word[:-2]):
        word = word[:-1]
    if word in _AFTER_PLURAL:
        return word
    # -eed, -ed, -ing
    ending = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if ending in ("eed", "eedly"):
        if len(word) - len(ending) >= r1:
            word = word[: len(word) - len(ending)] + "ee"
    elif ending and _VOWEL.search(word[: -len(ending)]):
        word = word[: -len(ending)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", word):
            word = word[:-1]
        elif len(word) <= r1 and _SHORT.search(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    # longer endings
    ending = _longest(word, _SECOND)
    if ending and len(word) - len(ending) >= r1:
        before = word[: -len(ending)]
        if ending == "ogi":
            word = word[:-1] if before.endswith("l") else word
        elif ending != "li" or before[-1:] in tuple("cdeghkmnrt"):
            word = before + _SECOND[ending]
    ending = _longest(word, _THIRD)
    if ending and len(word) - len(ending) >= r1 and (ending != "ative" or len(word) - 5 >= r2):
        word = word[: -len(ending)] + _THIRD[ending]
    ending = _longest(word, _FOURTH)
    if ending and len(word) - len(ending) >= r2 and (ending != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(ending)]
    if word.endswith("e") and (len(word) > r2 or (len(word) > r1 and not _SHORT.search(word[:-1]))):
        word = word[:-1]
    elif word.endswith("ll") and len(word) > r2:
        word = word[:-1]
    return word.replace("Y", "y")
