"""Porter's suffix-stripping stemmer (M. F. Porter, 1980, with the usual later refinements)."""

from __future__ import annotations

from collections.abc import Callable

# Whole words with a stem of their own.
_WHOLE = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed",
}
# The published suffix tables.
_STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
    ("fulli", "ful"),
)
_STEP3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""),
)
_STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism",
    "ate", "iti", "ous", "ive", "ize",
)


def _shape(word: str) -> str:
    """One letter per character: c for consonant, v for vowel (y after a consonant is a vowel)."""
    out = ""
    for letter in word:
        vowel = letter in "aeiou" or (letter == "y" and out.endswith("c"))
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    """How many vowel-to-consonant changes the stem has."""
    return _shape(stem).count("vc")


def _short_end(stem: str) -> bool:
    """Ends consonant-vowel-consonant (not w, x, y), or is vowel-consonant."""
    shape = _shape(stem)
    return shape == "vc" or (shape.endswith("cvc") and stem[-1] not in "wxy")


def _swap(word: str, table, allowed: Callable[[str], bool]) -> str:
    """Apply the first suffix of the table the word ends in, if its stem allows it."""
    for suffix, ending in table:
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            return stem + ending if allowed(stem) else word
    return word


def _plural(word: str) -> str:
    if word.endswith("ies"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("sses"):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        stem = word[: len(word) - len(suffix)]
        if word.endswith(suffix) and "v" in _shape(stem):
            break
    else:
        return word
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c":
        return stem if stem[-1] in "lsz" else stem[:-1]
    return stem + "e" if _measure(stem) == 1 and _short_end(stem) else stem


def _second(word: str) -> str:
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        return _second(word[:-2])
    if word.endswith("logi") and not word.endswith(tuple(s for s, _ in _STEP2)):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    return _swap(word, _STEP2, lambda stem: _measure(stem) > 0)


def _fourth(word: str) -> str:
    for suffix in _STEP4:
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            fits = _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t")))
            return stem if fits else word
    return word


def stem(word: str) -> str:
    """The stem of one word, in lower case."""
    lower = word.lower()
    if word in _WHOLE:
        return _WHOLE[word]
    if len(word) <= 2:
        return lower
    out = _past(_plural(lower))
    if out.endswith("y") and len(out) > 2 and _shape(out[:-1])[-1] == "c":
        out = out[:-1] + "i"
    out = _swap(_second(out), _STEP3, lambda s: _measure(s) > 0)
    out = _fourth(out)
    if out.endswith("e"):
        base = out[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _short_end(base)):
            out = base
    return out[:-1] if out.endswith("ll") and _measure(out[:-1]) > 1 else out
