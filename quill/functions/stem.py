"""The Porter2 (Snowball English) stemmer, over the distinct words of an Arrow batch."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quill.sources.shared import tune

_V = "aeiouy"
# Fixed values of the algorithm.
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_INVARIANT = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")


def _regions(word: str) -> tuple[int, int]:
    head = re.match(r"gener|commun|arsen", word)
    found = re.compile(f"[{_V}][^{_V}]")
    first = head.end() if head else (m.end() if (m := found.search(word)) else len(word))
    second = m.end() if (m := found.search(word, first)) else len(word)
    return first, second


def _short(word: str) -> bool:
    """Whether the word ends in a short syllable."""
    return bool(re.search(f"[^{_V}][{_V}][^{_V}wxY]$", word) or re.fullmatch(f"[{_V}][^{_V}]", word))


def _longest(word: str, suffixes) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


#: Words whose stems a worker keeps, at most, and characters of each: junk runs longer than that would fill its memory.
KEPT, LONGEST = 100_000, 64


def stem(word: str) -> str:
    return _kept(word) if len(word) <= LONGEST else _stem(word)


def _stem(word: str) -> str:
    if len(word) <= 2 or not word.isascii():
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    if word in _INVARIANT:
        return word
    word = re.sub(f"(?<=[{_V}])y", "Y", re.sub("^y", "Y", word.removeprefix("'")))
    r1, r2 = _regions(word)
    word = word[: -len(s)] if (s := _longest(word, ("'s'", "'s", "'"))) else word
    # Plurals.
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(f"[{_V}].", word[:-1]) and re.search(f"[{_V}]", word[:-2]):
        word = word[:-1]
    if word in _AFTER_1A:
        return word
    # Past tenses, participles, adverbs of them.
    suffix = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if suffix in ("eed", "eedly"):
        if len(word) - len(suffix) >= r1:
            word = word[: -len(suffix)] + "ee"
    elif suffix and re.search(f"[{_V}]", word[: -len(suffix)]):
        word = word[: -len(suffix)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(_DOUBLE):
            word = word[:-1]
        elif _short(word) and r1 >= len(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _V:
        word = word[:-1] + "i"
    # Derivations.
    suffix = _longest(word, (*_STEP2, "ogi", "li"))
    if suffix and len(word) - len(suffix) >= r1:
        if suffix == "ogi":
            word = word[:-1] if word[-4:-3] == "l" else word
        elif suffix == "li":
            word = word[:-2] if word[-3:-2] in tuple("cdeghkmnrt") else word
        else:
            word = word[: -len(suffix)] + _STEP2[suffix]
    suffix = _longest(word, (*_STEP3, "ative"))
    if suffix and len(word) - len(suffix) >= r1:
        if suffix != "ative":
            word = word[: -len(suffix)] + _STEP3[suffix]
        elif len(word) - len(suffix) >= r2:
            word = word[:-5]
    suffix = _longest(word, (*_STEP4, "ion"))
    if suffix and len(word) - len(suffix) >= r2 and (suffix != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(suffix)]
    if word.endswith("e"):
        if len(word) - 1 >= r2 or len(word) - 1 >= r1 and not _short(word[:-1]):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


_kept = lru_cache(maxsize=KEPT)(_stem)


def stem_all(words: Column) -> Column:
    """Stems of an array of words; each distinct word of a batch is stemmed once."""
    tune(SparkSession.active())

    @F.arrow_udf("array<string>")
    def run(column: pa.Array) -> pa.Array:
        flat = column.flatten().dictionary_encode()
        stems = pa.array([stem(w) if w is not None else None for w in flat.dictionary.to_pylist()], pa.string())
        sizes = np.diff(column.offsets.to_numpy())
        if column.null_count:
            sizes[column.is_null().to_numpy(zero_copy_only=False)] = 0
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, stems.take(flat.indices), mask=column.is_null() if column.null_count else None)

    return run(words)
