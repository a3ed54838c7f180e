"""English stems by the published Snowball algorithm, and lexemes with their places."""

from __future__ import annotations

import re
from functools import lru_cache

# The stop words of English text search, the algorithm's endings and its exceptions.
STOPS = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
KEPT = frozenset("sky news howe atlas cosmos bias andes".split())
KEPT_LATER = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less", "ogi": "og", "li": ""}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
REGION = re.compile("[aeiouy][^aeiouy]")
WORD = re.compile("[a-z0-9]+")


def _region(w: str, start: int) -> int:
    m = REGION.search(w, start)
    return m.end() if m else len(w)


def _ending(w: str, endings) -> str | None:
    found = [e for e in endings if w.endswith(e)]
    return max(found, key=len) if found else None


def _short_syllable(w: str) -> bool:
    """Whether the word ends in a short syllable."""
    return bool(re.search("[^aeiouy][aeiouy][^aeiouywxY]$", w)) or bool(re.fullmatch("[aeiouy][^aeiouy]", w))


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    if len(word) <= 2 or word in KEPT:
        return word
    if word in WHOLE:
        return WHOLE[word]
    w = re.sub("(^|[aeiouy])y", r"\1Y", word)
    head = re.match("gener|commun|arsen", w)
    r1 = head.end() if head else _region(w, 0)
    r2 = _region(w, r1)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in KEPT_LATER:
        return w
    # past and progressive
    e = _ending(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if e in ("eed", "eedly"):
        w = w[: -len(e)] + "ee" if len(w) - len(e) >= r1 else w
    elif e and re.search("[aeiouy]", w[: -len(e)]):
        w = w[: -len(e)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif len(w) <= r1 and _short_syllable(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    e = _ending(w, STEP2)
    if e and len(w) - len(e) >= r1 and (e != "ogi" or w[-4:-3] == "l") and (e != "li" or w[-3:-2] in "cdeghkmnrt"):
        w = w[: -len(e)] + STEP2[e]
    e = _ending(w, STEP3)
    if e and len(w) - len(e) >= (r2 if e == "ative" else r1):
        w = w[: -len(e)] + STEP3[e]
    e = _ending(w, STEP4)
    if e and len(w) - len(e) >= r2 and (e != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(e)]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_syllable(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def lexemes(text: str | None) -> dict[str, list[int]]:
    """Stems with the places of their words, counted over all words; stop words have places but no lexeme."""
    out: dict[str, list[int]] = {}
    for place, w in enumerate(WORD.findall((text or "").lower()), 1):
        if w not in STOPS:
            out.setdefault(stem(w), []).append(place)
    return out
