"""Text normalisation as JVM-side column expressions: tokens, stop words, Porter stems, comma lists.

Everything here is a narrow expression, so normalising a column adds no shuffle and no Python worker.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The English stop list of the analyzer whose output must be matched.
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then "
    "there these they this to was will with"
).split()

# A token is a run of letters, marks, digits or underscores; an apostrophe or full stop inside joins.
TOKEN = r"[\p{L}\p{M}\p{N}_]+(?:['’.][\p{L}\p{M}\p{N}_]+)*"

# Porter's published suffix rules (fixed values), longest suffixes win.
STEP2_SUFFIXES = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize",
    "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive",
    "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
    "logi": "log",
}
STEP3_SUFFIXES = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
}
STEP4_SUFFIXES = (
    "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize"
).split()

# Porter's word shape [C](VC)^m[V]; an initial y is held as Y so that it counts as a consonant.
CONSONANTS = "[^aeiou][^aeiouy]*"
VOWELS = "[aeiouy][aeiou]*"
MEASURE_GT0 = f"^(?:{CONSONANTS})?{VOWELS}{CONSONANTS}"
MEASURE_EQ1 = f"^(?:{CONSONANTS})?{VOWELS}{CONSONANTS}(?:{VOWELS})?$"
MEASURE_GT1 = f"^(?:{CONSONANTS})?{VOWELS}{CONSONANTS}{VOWELS}{CONSONANTS}"
HAS_VOWEL = f"^(?:{CONSONANTS})?[aeiouy]"
SHORT_SYLLABLE = f"^{CONSONANTS}[aeiouy][^aeiouwxy]$"


def _chop(word: Column, n: int) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - n)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _may_end_in(word: Column, suffixes) -> Column:
    """Cheap test of the last two letters, so that most words never reach a regular expression."""
    return F.substring(word, -2, 2).isin(*sorted({s[-2:] for s in suffixes}))


def _plural(w: Column) -> Column:
    return (
        F.when(~F.endswith(w, F.lit("s")) | F.endswith(w, F.lit("ss")), w)
        .when(w.rlike("^.+(?:ss|i)es$"), _chop(w, 2))
        .when(w.rlike("^.+[^s]s$"), _chop(w, 1))
        .otherwise(w)
    )


def _restore_e(stem: Column) -> Column:
    doubled = (F.right(stem, F.lit(1)) == F.substring(stem, F.length(stem) - 1, F.lit(1))) & (
        ~stem.rlike("[aeiouylsz]$")
    )
    return (
        F.when(stem.rlike("(?:at|bl|iz)$"), F.concat(stem, F.lit("e")))
        .when((F.length(stem) >= 2) & doubled, _chop(stem, 1))
        .when(stem.rlike(SHORT_SYLLABLE), F.concat(stem, F.lit("e")))
        .otherwise(stem)
    )


def _past_and_gerund(w: Column) -> Column:
    def cut(n: int) -> Column:
        return F.when(_chop(w, n).rlike(HAS_VOWEL), bind(_chop(w, n), _restore_e)).otherwise(w)

    return (
        F.when(~_may_end_in(w, ("ed", "ing")), w)
        .when(F.endswith(w, F.lit("eed")), F.when(_chop(w, 3).rlike(MEASURE_GT0), _chop(w, 1)).otherwise(w))
        .when(F.endswith(w, F.lit("ed")), cut(2))
        .when(F.endswith(w, F.lit("ing")), cut(3))
        .otherwise(w)
    )


def _final_y(w: Column) -> Column:
    return F.when(
        F.endswith(w, F.lit("y")) & _chop(w, 1).rlike(HAS_VOWEL), F.concat(_chop(w, 1), F.lit("i"))
    ).otherwise(w)


def _swap_suffix(rules: dict[str, str]) -> Callable[[Column], Column]:
    pattern = f"^(.+?)({'|'.join(sorted(rules, key=len, reverse=True))})$"
    table = F.create_map(*[F.lit(part) for pair in rules.items() for part in pair])

    def step(w: Column) -> Column:
        stem = F.regexp_extract(w, pattern, 1)
        return F.when(
            _may_end_in(w, rules) & w.rlike(pattern) & stem.rlike(MEASURE_GT0),
            F.concat(stem, F.try_element_at(table, F.regexp_extract(w, pattern, 2))),
        ).otherwise(w)

    return step


def _drop_suffix(w: Column) -> Column:
    plain = f"^(.+?)({'|'.join(sorted(STEP4_SUFFIXES, key=len, reverse=True))})$"
    ion = "^(.+?[st])ion$"
    stem, ion_stem = F.regexp_extract(w, plain, 1), F.regexp_extract(w, ion, 1)
    return (
        F.when(~_may_end_in(w, (*STEP4_SUFFIXES, "ion")), w)
        .when(w.rlike(plain), F.when(stem.rlike(MEASURE_GT1), stem).otherwise(w))
        .when(w.rlike(ion) & ion_stem.rlike(MEASURE_GT1), ion_stem)
        .otherwise(w)
    )


def _final_e(w: Column) -> Column:
    stem = _chop(w, 1)
    drop = stem.rlike(MEASURE_GT1) | (stem.rlike(MEASURE_EQ1) & ~stem.rlike(SHORT_SYLLABLE))
    return F.when(F.endswith(w, F.lit("e")) & drop, stem).otherwise(w)


def _final_ll(w: Column) -> Column:
    return F.when(F.endswith(w, F.lit("ll")) & w.rlike(MEASURE_GT1), _chop(w, 1)).otherwise(w)


def _longer_than_two(step: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda w: F.when(F.length(w) > 2, step(w)).otherwise(w)


def stem_all(tokens: Column) -> Column:
    """Porter stems of an array of lower-case tokens; tokens of one or two letters stay as they are."""
    words = F.transform(tokens, lambda w: F.regexp_replace(w, "^y", "Y"))
    for step in (
        _plural, _past_and_gerund, _final_y, _swap_suffix(STEP2_SUFFIXES),
        _swap_suffix(STEP3_SUFFIXES), _drop_suffix, _final_e, _final_ll,
    ):
        words = F.transform(words, _longer_than_two(step))
    return F.transform(words, lambda w: F.regexp_replace(w, "^Y", "y"))


def stem(token: Column) -> Column:
    return F.get(stem_all(F.array(token)), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-case tokens of a text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def content_tokens(text: Column) -> Column:
    """Tokens without stop words."""
    return F.filter(tokens(text), lambda t: ~t.isin(*STOP_WORDS))


def normalise_phrase(text: Column) -> Column:
    """Stemmed content tokens joined by a space."""
    return F.array_join(stem_all(content_tokens(text)), " ")


def normalise_list(items: Column) -> Column:
    """Normalise each element of a string array; elements that become empty are dropped."""
    return F.filter(F.transform(items, normalise_phrase), lambda x: x != "")


def normalise(text: Column) -> Column:
    """Normalise every comma part of a string and join the parts by comma; null becomes ''."""
    parts = F.split(F.coalesce(text, F.lit("")), ",")
    return F.array_join(F.transform(parts, normalise_phrase), ",")


def split_comma_list(text: Column) -> Column:
    """Comma list to array: outer quotes cut, each part trimmed and freed of one quote or comma per end."""
    inner = F.trim(F.regexp_replace(F.regexp_replace(text, '^"', ""), '"$', ""))
    parts = F.transform(
        F.split(inner, ","),
        lambda p: F.regexp_replace(F.regexp_replace(F.trim(p), '^[,"]', ""), '[,"]$', ""),
    )
    return F.filter(parts, lambda p: p != "")


def underscore_tokens(items: Column) -> Column:
    """Join a list of names by space after turning the spaces inside each name into underscores."""
    return F.array_join(F.transform(items, lambda x: F.replace(x, F.lit(" "), F.lit("_"))), " ")
