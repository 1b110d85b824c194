"""Porter stemming as Catalyst expressions.

Suffix rules of M. F. Porter, "An algorithm for suffix stripping" (1980), with the
usual later extensions: a small table of irregular words, words of one or two
letters left alone, ``ied``/``ies`` after a single letter, ``y`` kept after a
vowel, ``bli``, ``alli``, ``fulli`` and ``logi`` in step 2.

A step reads its input several times. Each runs inside a lambda that binds the
input, so the whole stem is one expression whose size is the sum of its steps and
stays so when Catalyst substitutes it into a pushed-down predicate.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words with their own stem.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "news": "news", "innings": "inning", "inning": "inning", "outings": "outing",
    "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
# Suffix -> replacement when the rest has measure > 0.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize",
    "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive",
    "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
    "fulli": "ful", "logi": "log",
}
STEP3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
}
# Suffixes removed when the rest has measure > 1.
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
         "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

# Last letters of the words that any step can change.
CHANGING_ENDS = sorted({suffix[-1] for suffix in (*STEP2, *STEP3, *STEP4, "s", "ed", "ing", "y", "e", "ll")})

# A ``y`` is a vowel after a consonant and a consonant elsewhere.
_CONSONANTS = "[^aeiou][^aeiouy]*"
_FIRST_VOWELS = f"^(?:{_CONSONANTS}[aeiouy]|[aeiou])[aeiou]*"
HAS_VOWEL = f"^(?:{_CONSONANTS}[aeiouy]|[aeiou])"
MEASURE_1_UP = f"{_FIRST_VOWELS}[^aeiou]"
MEASURE_2_UP = f"{_FIRST_VOWELS}{_CONSONANTS}[aeiouy][aeiou]*[^aeiou]"
MEASURE_1 = f"{_FIRST_VOWELS}{_CONSONANTS}(?:[aeiouy][aeiou]*)?$"
# consonant-vowel-consonant end, last not w, x, y; or a two-letter vowel-consonant word
SHORT_END = r"(?:(?:[^aeiouy][aeiouy]|(?:^|[aeiou])y[aeiou])[^aeiouwxy]|^[aeiou][^aeiou])$"


def ends_with_any(suffixes) -> str:
    """Pattern whose group is the longest of ``suffixes`` a word ends with."""
    return "(" + "|".join(suffixes) + ")$"


def _suffix_of(word: Column, suffixes) -> Column:
    """The longest of ``suffixes`` that ``word`` ends with, else null; plain comparisons, no regex."""
    longest_first = sorted(suffixes, key=len, reverse=True)
    return F.coalesce(*[F.when(word.endswith(s), F.lit(s)) for s in longest_first])


def _cut(word: Column, letters: int | Column) -> Column:
    return F.left(word, F.length(word) - letters)


def _plural(w: Column) -> Column:
    return (
        F.when(w.endswith("ies"), F.when(F.length(w) == 4, _cut(w, F.lit(1))).otherwise(_cut(w, F.lit(2))))
        .when(w.endswith("sses"), _cut(w, F.lit(2)))
        .when(w.endswith("s") & ~w.endswith("ss"), _cut(w, F.lit(1)))
        .otherwise(w)
    )


def _past_cut(w: Column) -> Column:
    """``ied``/``eed`` done; ``ed`` and ``ing`` removed and marked by a trailing ``+``."""
    cut_ed, cut_ing = _cut(w, F.lit(2)), _cut(w, F.lit(3))
    return (
        F.when(w.endswith("ied"), F.when(F.length(w) == 4, _cut(w, F.lit(1))).otherwise(_cut(w, F.lit(2))))
        .when(w.endswith("eed"), F.when(cut_ing.rlike(MEASURE_1_UP), _cut(w, F.lit(1))).otherwise(w))
        .when(w.endswith("ed"), F.when(cut_ed.rlike(HAS_VOWEL), F.concat(cut_ed, F.lit("+"))).otherwise(w))
        .when(w.endswith("ing"), F.when(cut_ing.rlike(HAS_VOWEL), F.concat(cut_ing, F.lit("+"))).otherwise(w))
        .otherwise(w)
    )


def _past_mend(w: Column) -> Column:
    """Mend a word that lost ``ed`` or ``ing``: hopp -> hop, fil -> file, conflat -> conflate."""
    bare = _cut(w, F.lit(1))
    doubled = (F.right(bare, F.lit(1)) == F.substring(bare, -2, 1)) & bare.rlike(".[^aeiou]$")
    return (
        F.when(~w.endswith("+"), w)
        .when(bare.rlike("(?:at|bl|iz)$"), F.concat(bare, F.lit("e")))
        .when(doubled, F.when(bare.rlike("[lsz]$"), bare).otherwise(_cut(bare, F.lit(1))))
        .when(bare.rlike(MEASURE_1) & bare.rlike(SHORT_END), F.concat(bare, F.lit("e")))
        .otherwise(bare)
    )


def _final_y(w: Column) -> Column:
    """``y`` becomes ``i`` behind a consonant that is not the first letter; a ``y`` behind a vowel is a consonant."""
    rest = _cut(w, F.lit(1))
    behind = rest.rlike("(?:[^aeiouy]|(?:^|[aeiou])y(?:yy)*|[^aeiouy](?:yy)+)$")
    return F.when(w.endswith("y") & (F.length(w) > 2) & behind, F.concat(rest, F.lit("i"))).otherwise(w)


def _double_al(w: Column) -> Column:
    """``alli`` becomes ``al`` first, and step 2 then looks at the new ending."""
    return F.when(w.endswith("alli") & _cut(w, F.lit(4)).rlike(MEASURE_1_UP), _cut(w, F.lit(2))).otherwise(w)


def _on_suffix(word: Column, suffixes, change) -> Column:
    """``change(suffix)`` where ``word`` ends with one of ``suffixes``, else ``word``."""
    held = F.transform(F.array(_suffix_of(word, suffixes)),
                       lambda suffix: F.when(suffix.isNull(), word).otherwise(change(suffix)))
    # most words already differ from every suffix in their last two letters
    return F.when(F.right(word, F.lit(2)).isin(sorted({s[-2:] for s in suffixes})), held[0]).otherwise(word)


def _suffix_map(rules: dict[str, str]):
    replacements = F.create_map(*[F.lit(part) for rule in rules.items() for part in rule])

    def step(w: Column) -> Column:
        def replaced(suffix: Column) -> Column:
            rest = _cut(w, F.length(suffix))
            # "logi" counts its own l as part of the rest
            measured = F.when(suffix == "logi", F.concat(rest, F.lit("l"))).otherwise(rest)
            return F.when(measured.rlike(MEASURE_1_UP),
                          F.concat(rest, F.try_element_at(replacements, suffix))).otherwise(w)

        return _on_suffix(w, rules, replaced)

    return step


def _strip_step4(w: Column) -> Column:
    def stripped(suffix: Column) -> Column:
        rest = _cut(w, F.length(suffix))
        fits = ((suffix != "ion") | rest.rlike("[st]$")) & rest.rlike(MEASURE_2_UP)
        return F.when(fits, rest).otherwise(w)

    return _on_suffix(w, STEP4, stripped)


def _final_e(w: Column) -> Column:
    rest = _cut(w, F.lit(1))
    drop = w.endswith("e") & (rest.rlike(MEASURE_2_UP) | (rest.rlike(MEASURE_1) & ~rest.rlike(SHORT_END)))
    return F.when(drop, rest).otherwise(w)


def _final_ll(w: Column) -> Column:
    rest = _cut(w, F.lit(1))
    return F.when(w.endswith("ll") & rest.rlike(MEASURE_2_UP), rest).otherwise(w)


def stem(word: Column) -> Column:
    """The Porter stem of a lower-case word."""
    steps = (_plural, _past_cut, _past_mend, _final_y, _double_al, _suffix_map(STEP2), _suffix_map(STEP3),
             _strip_step4, _final_e, _final_ll)
    held = F.array(word)
    for step in steps:
        held = F.transform(held, step)
    irregular = F.create_map(*[F.lit(part) for pair in IRREGULAR.items() for part in pair])
    return F.coalesce(F.when((F.length(word) <= 2) | ~F.right(word, F.lit(1)).isin(*CHANGING_ENDS), word), F.try_element_at(irregular, word), held[0])
