"""Suffix stripping of English words (the published five-step rules of 1980) as DataFrame steps.

A stem depends on the word alone, so the rules run over the distinct vocabulary and the
result, a table ``(term, stem)``, is joined back: an index is stemmed by one join of its
postings, not by a function per token. Words that are not made of three or more of the
letters a-z stay as they are.

Inside, a ``y`` that is a consonant (at the start, or behind a vowel) is written ``Y``. The measure
m of a stem, its number of vowel-consonant sequences, and the other conditions are
regular expressions. Of a step's suffixes the longest that the word ends in decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The conditions on what stands before a suffix, and the rules of the steps as
# (suffix, replacement). V: vowel, C: consonant.
V, C = "[aeiouy]", "[^aeiouy]"
MEASURED = f"^{C}*{V}+{C}"  # m > 0
MEASURED_TWICE = f"^{C}*{V}+{C}+{V}+{C}"  # m > 1
SHORT_END = f"{C}{V}[^aeiouywxY]$"  # consonant, vowel, consonant other than w, x, y
PLURALS = [("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")]
STEP_2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"),
          ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
          ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"),
          ("biliti", "ble")]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "sion", "tion", "ou", "ism", "ate", "iti",
          "ous", "ive", "ize"]
DOUBLED = "bcdfghjkmnpqrtvwxY"  # doubled consonants that lose one; l, s and z do not


def _before(word: Column, suffix: str) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - len(suffix))


def _by_suffix(word: Column, rules: list[tuple[str, str]], holds) -> Column:
    """The rule of the longest suffix that ``word`` ends in, if ``holds`` of what is before it."""
    out = None
    for suffix, new in sorted(rules, key=lambda r: -len(r[0])):
        stem = _before(word, suffix)
        done = F.when(holds(stem, suffix), F.concat(stem, F.lit(new))).otherwise(word)
        out = F.when(word.endswith(suffix), done) if out is None else out.when(word.endswith(suffix), done)
    return out.otherwise(word)


def _of(value: Column, rule) -> Column:
    """``rule(value)`` with the value computed once, however often the rule names it."""
    return F.transform(F.array(value), rule)[0]


def _measured(stem: Column, _: str = "") -> Column:
    return stem.rlike(MEASURED)


def _less(w: Column) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - 1)


def _mended(w: Column) -> Column:
    """What is left after -ed or -ing."""
    last = F.substring(w, -1, 1)
    doubled = (last == F.substring(w, -2, 1)) & (F.length(w) > 1) & F.lit(DOUBLED).contains(last)
    once = w.rlike(MEASURED) & ~w.rlike(MEASURED_TWICE)
    return (F.when(w.rlike("(at|bl|iz)$"), F.concat(w, F.lit("e"))).when(doubled, _less(w))
            .when(once & w.rlike(SHORT_END), F.concat(w, F.lit("e"))).otherwise(w))


def _past(w: Column) -> Column:
    cut = F.when(w.endswith("ed"), _before(w, "ed")).when(w.endswith("ing"), _before(w, "ing"))
    cut = _of(cut, lambda c: F.when(c.rlike(V), c))
    return F.when(w.endswith("eed"), _by_suffix(w, [("eed", "ee")], _measured)).otherwise(F.coalesce(_of(cut, _mended), w))


def _final_y(w: Column) -> Column:
    return F.when(w.rlike("[yY]$") & _less(w).rlike(V), F.concat(_less(w), F.lit("i"))).otherwise(w)


def _fourth(w: Column) -> Column:
    rules = sorted({("ion", "") if s in ("sion", "tion") else (s, "") for s in STEP_4})
    return _by_suffix(w, rules, lambda stem, suffix: stem.rlike(MEASURED_TWICE) & (stem.rlike("[st]$") if suffix == "ion" else F.lit(True)))


def _final_e(w: Column) -> Column:
    short = _less(w)
    gone = w.endswith("e") & (short.rlike(MEASURED_TWICE) | (short.rlike(MEASURED) & ~short.rlike(SHORT_END)))
    return F.when(gone, short).otherwise(w)


def _final_l(w: Column) -> Column:
    return F.when(w.endswith("ll") & w.rlike(MEASURED_TWICE), _less(w)).otherwise(w)


def stem(word: Column) -> Column:
    """The stem of a word."""
    w = F.regexp_replace(F.regexp_replace(F.regexp_replace(word, "^y", "Y"), "([aeiou])y", "$1Y"), "yy", "yY")
    steps = [lambda x: _by_suffix(x, PLURALS, lambda *_: F.lit(True)), _past, _final_y, lambda x: _by_suffix(x, STEP_2, _measured),
             lambda x: _by_suffix(x, STEP_3, _measured), _fourth, _final_e, _final_l]
    for step in steps:
        w = _of(w, step)
    return F.when(word.rlike("^[a-z]{3,}$"), F.lower(w)).otherwise(word)


def stems(vocabulary: DataFrame, column: str = "term") -> DataFrame:
    """(term, stem) of the distinct words of ``vocabulary``."""
    words = vocabulary.select(F.col(column).alias("term")).distinct()
    return words.select("term", stem(F.col("term")).alias("stem"))
