"""English stems by the Snowball rules (the second Porter stemmer), for the distinct terms of a corpus.

A word's stem depends on two regions: R1 begins after the first consonant that follows a vowel, R2 after the next such.
Steps try suffixes, the longest that fits first; a suffix that fits but isn't in its region ends the step.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# The rules' letters, words and suffixes.
VOWELS, DOUBLES, LI = "aeiouy", {"bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"}, "cdeghkmnrt"
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
PREFIXES = ("gener", "commun", "arsen")
#: Suffixes in R1, then in R1 again, then in R2, and what comes in their place.
SECOND = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": ""}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = dict.fromkeys(("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion"), "")

_REGION = re.compile("[aeiouy][^aeiouy]")
_VOWEL = re.compile("[aeiouy]")
#: A short syllable at the end: consonant, vowel, consonant but w, x, Y; or a vowel that begins the word and a consonant.
_SHORT = re.compile("([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")


def _longest(word: str, suffixes: dict[str, str] | tuple[str, ...]) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _regions(word: str) -> tuple[int, int]:
    head = next((p for p in PREFIXES if word.startswith(p)), None)
    found = _REGION.search(word)
    first = len(head) if head else found.end() if found else len(word)
    found = _REGION.search(word, first)
    return first, found.end() if found else len(word)


def _plain(word: str, r1: int) -> str:
    """Without past and continuous endings."""
    end = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end is None:
        return word
    rest = word[: -len(end)]
    if end.startswith("ee"):
        return rest + "ee" if len(rest) >= r1 else word
    if not _VOWEL.search(rest):
        return word
    if rest.endswith(("at", "bl", "iz")):
        return rest + "e"
    if rest[-2:] in DOUBLES:
        return rest[:-1]
    return rest + "e" if _SHORT.search(rest) and len(rest) <= r1 else rest


def _replaced(word: str, suffixes: dict[str, str], region: int, r2: int) -> str:
    end = _longest(word, suffixes)
    if end is None or len(word) - len(end) < region:
        return word
    rest = word[: -len(end)]
    fits = {"ogi": rest.endswith("l"), "li": rest[-1:] in tuple(LI), "ative": len(rest) >= r2, "ion": rest.endswith(("s", "t"))}
    return rest + suffixes[end] if fits.get(end, True) else word


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in WHOLE:
        return WHOLE[word]
    word = word.removeprefix("'")
    word = re.sub("(^|[aeiouy])y", r"\1Y", word)
    r1, r2 = _regions(word)
    for end in ("'s'", "'s", "'"):
        if word.endswith(end):
            word = word[: -len(end)]
            break
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and _VOWEL.search(word[:-2]):
        word = word[:-1]
    if word in KEPT:
        return word
    word = _plain(word, r1)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"
    word = _replaced(word, SECOND, r1, r2)
    word = _replaced(word, THIRD, r1, r2)
    word = _replaced(word, FOURTH, r2, r2)
    if word.endswith("e") and (len(word) > r2 or (len(word) > r1 and not _SHORT.search(word[:-1]))):
        word = word[:-1]
    elif word.endswith("ll") and len(word) > r2:
        word = word[:-1]
    return word.replace("Y", "y")


def with_stems(terms: DataFrame, term: str = "term") -> DataFrame:
    """(term, stem) of distinct terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if t is None else stem(t) for t in batch.column(0).to_pylist()], pa.string())], [term, "stem"])

    return terms.select(term).mapInArrow(run, f"{term} string, stem string")
