"""Porter stems of words, for full-text search (M. F. Porter, An algorithm for suffix stripping, 1980)."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The suffixes of the published algorithm, by step.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble",
    "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate",
    "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "sion", "tion", "ou", "ism", "ate", "iti",
    "ous", "ive", "ize",
)
WORD = re.compile(r"[^\W_]+")
#: Texts whose stems a worker holds as Python objects at a time.
SLICE = 64


def _shape(stem: str) -> str:
    """c and v for consonants and vowels; y is a vowel after a consonant."""
    out = ""
    for letter in stem:
        vowel = letter in "aeiou" or (letter == "y" and out.endswith("c"))
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(stem: str) -> bool:
    """Consonant, vowel, consonant other than w, x or y."""
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


@functools.lru_cache(maxsize=100_000)
def porter(word: str) -> str:
    """The stem of a lower-case word; words of two letters or of other alphabets stay as they are."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            stem = word.removesuffix(suffix)
            if stem != word and "v" in _shape(stem):
                word = stem
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short_end(word):
                    word += "e"
                break
            if stem != word:
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP_2, STEP_3):
        suffix = _longest(word, table)
        if suffix and _measure(word.removesuffix(suffix)) > 0:
            word = word.removesuffix(suffix) + table[suffix]
    suffix = _longest(word, STEP_4)
    if suffix:
        cut = word.removesuffix("ion" if suffix in ("sion", "tion") else suffix)
        if _measure(cut) > 1:
            word = cut
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _short_end(stem)):
            word = stem
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def stems(text: Column) -> Column:
    """The stems of a text's words in order, without diacritics; null gives none."""

    @F.arrow_udf("array<string>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            made = [pa.array([_stems(x.as_py()) for x in batch.slice(at, SLICE)], pa.list_(pa.string())) for at in range(0, len(batch), SLICE)]
            yield pa.concat_arrays(made) if made else pa.array([], pa.list_(pa.string()))

    return of(text)


def _stems(said: str | None) -> list[str]:
    plain = "".join(c for c in unicodedata.normalize("NFD", (said or "").lower()) if not unicodedata.combining(c))
    return [porter(w) for w in WORD.findall(plain)]
