"""English stems by the published Porter2 rules, and the words that an index leaves out. Stems are taken of a batch's distinct words, in Arrow tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Words that are too frequent to be searched for.
STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she", "her", "hers",
    "herself", "it", "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "these", "those", "am", "is",
    "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because",
    "as", "until", "while", "of", "at", "by", "for", "with", "about", "against", "between", "into", "through", "during", "before", "after", "above", "below", "to",
    "from", "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all", "any",
    "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will",
    "just", "don", "should", "now",
]

_VOWELS = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
#: Words with stems of their own.
_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_KEPT_AFTER_PLURALS = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
#: Suffixes and what takes their place, if they stand in the first region.
_STEP2 = {
    "ization": "ize", "ational": "ate", "ousness": "ous", "iveness": "ive", "fulness": "ful", "tional": "tion", "lessli": "less", "biliti": "ble", "entli": "ent", "ation": "ate", "alism": "al",
    "aliti": "al", "fulli": "ful", "ousli": "ous", "iviti": "ive", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
_REGION = re.compile("[aeiouy][^aeiouy]")
#: A task's memo of stems is emptied when it has so many words.
HELD_STEMS = 200_000


def _ends_short(w: str) -> bool:
    """Whether it ends in a short syllable: a vowel between consonants, the last not w, x or Y, or a vowel at the start and a consonant."""
    if len(w) == 2:
        return w[0] in _VOWELS and w[1] not in _VOWELS
    return len(w) > 2 and w[-1] not in _VOWELS + "wxY" and w[-2] in _VOWELS and w[-3] not in _VOWELS


def stem(word: str) -> str:
    """The stem of a word in lower case. Words of two letters and words with other letters than a to z are their own."""
    if len(word) < 3 or not (word.isascii() and word.replace("'", "").isalpha()):
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    w = word.removeprefix("'")
    w = re.sub("(^|[aeiouy])y", r"\1Y", w)
    first = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    if first is None:
        m = _REGION.search(w)
        first = m.end() if m else len(w)
    m = _REGION.search(w, first)
    second = m.end() if m else len(w)
    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in _KEPT_AFTER_PLURALS:
        return w.lower()
    # past tenses and gerunds
    for end in ("eedly", "eed", "ingly", "edly", "ing", "ed"):
        if w.endswith(end):
            base = w[: -len(end)]
            if end.startswith("ee"):
                if len(base) >= first:
                    w = base + "ee"
            elif any(c in _VOWELS for c in base):
                w = base
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w.endswith(_DOUBLES):
                    w = w[:-1]
                elif first >= len(w) and _ends_short(w):
                    w += "e"
            break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    # longer suffixes become shorter ones
    for end in sorted([*_STEP2, "ogi", "li"], key=len, reverse=True):
        if w.endswith(end):
            base = w[: -len(end)]
            if len(base) >= first:
                if end == "ogi":
                    w = base + "og" if base.endswith("l") else w
                elif end == "li":
                    w = base if base[-1:] in tuple("cdeghkmnrt") else w
                else:
                    w = base + _STEP2[end]
            break
    for end in sorted([*_STEP3, "ative"], key=len, reverse=True):
        if w.endswith(end):
            base = w[: -len(end)]
            if end == "ative":
                w = base if len(base) >= second else w
            elif len(base) >= first:
                w = base + _STEP3[end]
            break
    for end in sorted([*_STEP4, "ion"], key=len, reverse=True):
        if w.endswith(end):
            base = w[: -len(end)]
            if len(base) >= second and (end != "ion" or base[-1:] in ("s", "t")):
                w = base
            break
    if w.endswith("e") and (len(w) - 1 >= second or (len(w) - 1 >= first and not _ends_short(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= second:
        w = w[:-1]
    return w.lower()


def stemmed(rows: DataFrame, word: str, term: str = "term") -> DataFrame:
    """The rows with the stem of their word as a further column, null of null. Nothing is moved: a batch stems its distinct words, and a task keeps the stems of ``HELD_STEMS`` words."""
    names = [*rows.columns, term]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, str] = {}
        for batch in batches:
            coded = batch.column(names.index(word)).dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            if len(held) > HELD_STEMS:
                held.clear()
            own = pa.array([held[w] if w in held else held.setdefault(w, stem(w)) for w in distinct], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, own.take(coded.indices)], names=names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, `{term}` string")


def stems(words: DataFrame) -> DataFrame:
    """word, term: the stem of each row's word. Null words are left out."""
    return stemmed(words.filter("word IS NOT NULL").select("word"), "word")
