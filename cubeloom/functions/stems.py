"""English stems: the published Porter2 rules, for single lower-case words."""

from __future__ import annotations

import functools
import re

# Fixed values of the published algorithm.
VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_BEFORE = "cdeghkmnrt"
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_PLURAL = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
STEP_2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"),
    ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
STEP_3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
#: The usual short list of English words that carry no topic.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was",
    "will", "with",
)


def _region(word: str) -> int:
    """Where the part after the first non-vowel that follows a vowel begins."""
    m = re.search("[aeiouy][^aeiouy]", word)
    return m.end() if m else len(word)


def _short_end(word: str) -> bool:
    return bool(re.search("(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$", word))


@functools.lru_cache(maxsize=1 << 20)
def stem(word: str) -> str:
    if len(word) < 3:
        return word
    if word in WHOLE:
        return WHOLE[word]
    word = re.sub("(^|(?<=[aeiouy]))y", "Y", word.lstrip("'"))
    start = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    r1 = start if start is not None else _region(word)
    r2 = r1 + _region(word[r1:])

    word = re.sub("('s'|'s|')$", "", word)
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search("[aeiouy]", word[:-2]):
        word = word[:-1]
    if word in AFTER_PLURAL:
        return word

    m = re.search("(eedly|eed|ingly|edly|ing|ed)$", word)
    if m and m[1].startswith("eed"):
        if m.start() >= r1:
            word = word[: m.start()] + "ee"
    elif m and re.search("[aeiouy]", word[: m.start()]):
        word = word[: m.start()]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(DOUBLES):
            word = word[:-1]
        elif r1 >= len(word) and _short_end(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"

    for suffix, to in STEP_2:
        if word.endswith(suffix):
            fits = {"ogi": word[-4:-3] == "l", "li": word[-3:-2] in tuple(LI_BEFORE)}.get(suffix, True)
            if len(word) - len(suffix) >= r1 and fits:
                word = word[: -len(suffix)] + to
            break
    for suffix, to in STEP_3:
        if word.endswith(suffix):
            at = len(word) - len(suffix)
            if at >= r1 and (suffix != "ative" or at >= r2):
                word = word[:at] + to
            break
    for suffix in STEP_4:
        if word.endswith(suffix):
            at = len(word) - len(suffix)
            if at >= r2 and (suffix != "ion" or word[at - 1 : at] in ("s", "t")):
                word = word[:at]
            break
    if word.endswith("e"):
        at = len(word) - 1
        if at >= r2 or (at >= r1 and not _short_end(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()
