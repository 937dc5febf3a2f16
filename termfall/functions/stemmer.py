"""The English (Porter2) stemmer, after its published description."""

from __future__ import annotations

import re

_VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI = "cdeghkmnrt"

WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    **{w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")},
}
AFTER_1A = frozenset(("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"))

STEP2 = sorted(
    {
        "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize",
        "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
        "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
        "ogi": None, "li": None,
    }.items(),
    key=lambda x: -len(x[0]),
)
STEP3 = sorted(
    {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": None}.items(),
    key=lambda x: -len(x[0]),
)
STEP4 = sorted(("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion"), key=len, reverse=True)

_REGION = re.compile(r"[aeiouy][^aeiouy]")


def _region(word: str, start: int) -> int:
    m = _REGION.search(word, start)
    return m.end() if m else len(word)


def _short_syllable(word: str) -> bool:
    """Whether the word ends in a short syllable."""
    if len(word) == 2:
        return word[0] in _VOWELS and word[1] not in _VOWELS
    return len(word) > 2 and word[-1] not in _VOWELS + "wxY" and word[-2] in _VOWELS and word[-3] not in _VOWELS


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in WHOLE:
        return WHOLE[word]
    w = word[1:] if word[0] == "'" else word
    # y is a consonant, written Y, at the start and after a vowel.
    if "y" in w:
        letters = list(w)
        for i, c in enumerate(letters):
            if c == "y" and (i == 0 or letters[i - 1] in _VOWELS):
                letters[i] = "Y"
        w = "".join(letters)
    for head in ("gener", "commun", "arsen"):
        if w.startswith(head):
            r1 = len(head)
            break
    else:
        r1 = _region(w, 0)
    r2 = _region(w, r1)

    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in AFTER_1A:
        return w
    # 1b
    if w.endswith(("eedly", "eed")):
        end = 5 if w.endswith("eedly") else 3
        if len(w) - end >= r1:
            w = w[:-end] + "ee"
    else:
        for end in ("ingly", "edly", "ing", "ed"):
            if w.endswith(end):
                if any(c in _VOWELS for c in w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif w.endswith(DOUBLES):
                        w = w[:-1]
                    elif len(w) <= r1 and _short_syllable(w):
                        w += "e"
                break
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    # 2
    for end, new in STEP2:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r1:
                if end == "ogi":
                    w = w[:-1] if w[at - 1 : at] == "l" else w
                elif end == "li":
                    w = w[:-2] if w[at - 1 : at] and w[at - 1] in LI else w
                else:
                    w = w[:at] + new
            break
    # 3
    for end, new in STEP3:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r1:
                if new is not None:
                    w = w[:at] + new
                elif at >= r2:
                    w = w[:at]
            break
    # 4
    for end in STEP4:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r2 and (end != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    # 5
    if w.endswith("e"):
        at = len(w) - 1
        if at >= r2 or (at >= r1 and not _short_syllable(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")
