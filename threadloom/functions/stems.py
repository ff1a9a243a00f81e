"""Word stems by the published algorithm of Porter (1980), and the length of a longest common subsequence."""

from __future__ import annotations

import re

# The suffix tables of the algorithm's second, third and fourth step.
SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = dict.fromkeys("al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split(), "")


def _shape(word: str) -> str:
    """c for each consonant and v for each vowel; y is a vowel after a consonant."""
    out = ""
    for x in word:
        out += "v" if x in "aeiou" or (x == "y" and out[-1:] == "c") else "c"
    return out


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _short_end(word: str) -> bool:
    """Consonant, vowel, consonant at the end, the last not w, x or y."""
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _replaced(word: str, table: dict[str, str], least: int) -> str:
    """word with its longest suffix of table replaced if what is before it measures least or more."""
    for n in range(min(7, len(word)), 1, -1):
        if word[-n:] in table:
            rest = word[:-n]
            kept = word[-n:] == "ion" and rest[-1:] not in ("s", "t")
            return word if kept or _measure(rest) < least else rest + table[word[-n:]]
    return word


def stem(word: str) -> str:
    """The stem of a lower-case word; words of up to three letters are their own, as the summary measure has it."""
    if len(word) <= 3:
        return word
    word = re.sub("(?:(?<=ss)es|(?<=i)es|(?<!s)s)$", "", word)
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    elif (found := re.fullmatch("(.*?)(?:ed|ing)", word)) and "v" in _shape(found[1]):
        word = found[1]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word[-1:] == word[-2:-1] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _short_end(word):
            word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(_replaced(word, SECOND, 1), THIRD, 1), FOURTH, 2)
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short_end(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def common_length(a: list[str], b: list[str]) -> int:
    """The length of a longest common subsequence, by one integer of a bit for each word of a (Crochemore and others, 2001)."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    whole = (1 << len(a)) - 1
    row = whole
    for y in b:
        hit = row & at.get(y, 0)
        row = ((row + hit) | (row - hit)) & whole
    return len(a) - row.bit_count()
