"""English stemming, after the published Porter2 (Snowball English) description."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_V = "aeiouy"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
#: Words with stems of their own.
_SPECIAL = {
    "skis": "ski", "skies": "sky", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_KEPT_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"),
    ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"),
    ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"),
]
_STEP3 = [
    ("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", ""),
]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic"]


def _regions(w: str) -> tuple[int, int]:
    def after(at: int) -> int:
        m = re.search(rf"[{_V}][^{_V}]", w[at:])
        return at + m.end() if m else len(w)

    for lead in ("gener", "commun", "arsen"):
        if w.startswith(lead):
            return len(lead), after(len(lead))
    r1 = after(0)
    return r1, after(r1)


def _short(w: str) -> bool:
    return bool(re.search(rf"(?:^[{_V}][^{_V}]|[^{_V}][{_V}][^{_V}wxY])$", w))


def stem(word: str) -> str:
    w = word.lower().replace("’", "'")
    if len(w) <= 2:
        return w
    if w in _SPECIAL:
        return _SPECIAL[w]
    w = w.lstrip("'")
    w = re.sub(rf"^y|(?<=[{_V}])y", "Y", w)
    r1, r2 = _regions(w)
    w = re.sub(r"('s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif re.search(r"(ied|ies)$", w):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not re.search(r"(us|ss)$", w) and re.search(rf"[{_V}]", w[:-2]):
        w = w[:-1]
    if w in _KEPT_AFTER_1A:
        return w
    if m := re.search(r"(eedly|eed)$", w):
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    elif (m := re.search(r"(ingly|edly|ing|ed)$", w)) and re.search(rf"[{_V}]", w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLE):
            w = w[:-1]
        elif _short(w) and r1 >= len(w):
            w += "e"
    w = re.sub(rf"(?<=[^{_V}])(?<!^.)[yY]$", "i", w) if len(w) > 2 else w
    for suffix, to in _STEP2:
        if w.endswith(suffix):
            if len(w) - len(suffix) >= r1:
                w = w[: -len(suffix)] + to
            break
    else:
        if w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
            w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in tuple("cdeghkmnrt"):
            w = w[:-2]
    for suffix, to in _STEP3:
        if w.endswith(suffix):
            if len(w) - len(suffix) >= r1:
                w = w[: -len(suffix)] + to
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    for suffix in _STEP4:
        if w.endswith(suffix):
            if len(w) - len(suffix) >= r2:
                w = w[: -len(suffix)]
            break
    else:
        if w.endswith(("sion", "tion")) and len(w) - 3 >= r2:
            w = w[:-3]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short(w[:-1]))):
        w = w[:-1]
    elif w.endswith("l") and len(w) - 1 >= r2 and w[-2:-1] == "l":
        w = w[:-1]
    return w.replace("Y", "y")


@F.pandas_udf(StringType())
def stemmed(terms: pd.Series) -> pd.Series:
    known: dict[str, str] = {}
    return terms.map(lambda t: None if t is None else known[t] if t in known else known.setdefault(t, stem(t)))
