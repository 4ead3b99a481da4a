"""English stemming by the published Porter2 rules, one word at a time, and as
a column function that stems each different word of a batch once.

The rules see lower-case words of letters and digits (:mod:`.text` splits at
anything else, so no word has an apostrophe). ``y`` counts as a consonant at
the start of a word and after a vowel; such ones are written ``Y`` inside.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published rules: whole words, words that end after the
# first step, prefixes with a region of their own, and suffixes with their
# replacements.
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
         "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
         "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
AFTER_PLURAL = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
PREFIXES = ("gener", "commun", "arsen")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = "cdeghkmnrt"
STEP_2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize",
          "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
          "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og",
          "fulli": "ful", "lessli": "less", "li": ""}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
          "ative": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive",
          "ize", "ion")

V, C = "[aeiouy]", "[^aeiouy]"
REGION = re.compile(f"{V}{C}")
SHORT_END = re.compile(f"({C}{V}[^aeiouywxY]|^{V}{C})$")
VOWEL = re.compile(V)


def longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def region(word: str, start: int) -> int:
    """Where the part after the first consonant behind a vowel begins."""
    m = REGION.search(word, start)
    return m.end() if m else len(word)


@lru_cache(maxsize=1 << 16)
def porter2(word: str) -> str:
    """Stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in WHOLE:
        return WHOLE[word]
    w = re.sub(f"({V})y", r"\1Y", re.sub("^y", "Y", word))
    own = next((p for p in PREFIXES if w.startswith(p)), None)
    r1 = len(own) if own else region(w, 0)
    r2 = region(w, r1)
    # plurals
    s = longest(w, ("sses", "ied", "ies", "us", "ss", "s"))
    if s == "sses":
        w = w[:-2]
    elif s in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif s == "s" and VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in AFTER_PLURAL:
        return w
    # past and progressive forms
    s = longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if s in ("eed", "eedly"):
        if len(w) - len(s) >= r1:
            w = w[:len(w) - len(s)] + "ee"
    elif s and VOWEL.search(w[:-len(s)]):
        w = w[:-len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif r1 >= len(w) and SHORT_END.search(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and not VOWEL.match(w[-2]):
        w = w[:-1] + "i"
    # derivational endings, in the region after the first syllable
    s = longest(w, STEP_2)
    if s and len(w) - len(s) >= r1:
        before = w[:-len(s)]
        if not (s == "ogi" and not before.endswith("l") or s == "li" and before[-1:] not in tuple(LI_ENDINGS)):
            w = before + STEP_2[s]
    s = longest(w, STEP_3)
    if s and len(w) - len(s) >= (r2 if s == "ative" else r1):
        w = w[:-len(s)] + STEP_3[s]
    s = longest(w, STEP_4)
    if s and len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = w[:-len(s)]
    # a final e or double l
    at = len(w) - 1
    if w.endswith("e") and (at >= r2 or at >= r1 and not SHORT_END.search(w[:-1])) or w.endswith("ll") and at >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def stems(words: Column) -> Column:
    """Stems of an array of lower-case words (without nulls)."""
    @F.arrow_udf("array<string>")
    def stem(arrays: pa.Array) -> pa.Array:
        coded = arrays.flatten().cast(pa.string()).dictionary_encode()
        known = pa.array([porter2(w) for w in coded.dictionary.to_pylist()], pa.string())
        ends = pc.cumulative_sum(arrays.value_lengths().cast(pa.int32()).fill_null(0))
        offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends.cast(pa.int32())])
        return pa.ListArray.from_arrays(offsets, known.take(coded.indices))
    return stem(words)
