"""Text columns: white space, ASCII folding, last-occurrence replacement, slugs.

Every function maps a Column to a Column and stays inside Catalyst.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII white space that Python's strip() and \s take.
STRIP_SET = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f "
SPACE_CLASS = r"\x09-\x0d\x1c-\x20"

# ASCII spellings of characters that do not decompose into
# base letter + accent. Everything else comes from the rule in fold_tables().
SPECIAL_FOLDS = {
    "\u00a0": " ", "¡": "!", "¢": "C/", "£": "PS", "¤": "$?", "¥": "Y=", "¦": "|",
    "§": "SS", "¨": '"', "©": "(c)", "ª": "a", "«": "<<", "¬": "!", "\u00ad": "",
    "®": "(r)", "¯": "-", "°": "deg", "±": "+-", "²": "2", "³": "3", "´": "'",
    "µ": "u", "¶": "P", "·": "*", "¸": ",", "¹": "1", "º": "o", "»": ">>",
    "¼": "1/4", "½": "1/2", "¾": "3/4", "¿": "?", "×": "x", "÷": "/",
    "Æ": "AE", "Ð": "D", "Ø": "O", "Þ": "Th", "ß": "ss", "æ": "ae", "ð": "d",
    "ø": "o", "þ": "th", "Đ": "D", "đ": "d", "Ħ": "H", "ħ": "h", "ı": "i",
    "Ĳ": "IJ", "ĳ": "ij", "ĸ": "k", "Ŀ": "L", "ŀ": "l", "Ł": "L", "ł": "l",
    "ŉ": "'n", "Ŋ": "NG", "ŋ": "ng", "Œ": "OE", "œ": "oe", "Ŧ": "T", "ŧ": "t",
    "ſ": "s", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "--",
    "‘": "'", "’": "'", "‚": ",", "“": '"', "”": '"', "„": '"', "†": "+",
    "•": "*", "…": "...", "‹": "<", "›": ">", "€": "EUR", "™": "(tm)",
}
# ASCII spellings of Greek and Cyrillic small letters; capitals take the same with a capital first letter.
SCRIPT_FOLDS = {
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m",
    "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "ς": "s", "σ": "s", "τ": "t", "υ": "u", "φ": "ph", "χ": "kh", "ψ": "ps", "ω": "o",
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "й": "i", "к": "k", "л": "l", "м": "m",
    "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh",
    "щ": "shch", "ъ": '"', "ы": "y", "ь": "'", "э": "e", "ю": "iu", "я": "ia", "ђ": "dj", "є": "ie", "ѕ": "dz", "і": "i", "ј": "j",
    "љ": "lj", "њ": "nj", "ћ": "tsh", "џ": "dzh", "ґ": "g",
}
# Kana rows by consonant, vowels in order, and the syllables that the Hepburn system spells otherwise.
KANA_ROWS = {
    "": "あいうえお", "k": "かきくけこ", "g": "がぎぐげご", "s": "さしすせそ", "z": "ざじずぜぞ", "t": "たちつてと", "d": "だぢづでど",
    "n": "なにぬねの", "h": "はひふへほ", "b": "ばびぶべぼ", "p": "ぱぴぷぺぽ", "m": "まみむめも", "r": "らりるれろ",
}
KANA_SPECIAL = {
    "し": "shi", "じ": "ji", "ち": "chi", "つ": "tsu", "づ": "zu", "ふ": "fu", "や": "ya", "ゆ": "yu", "よ": "yo", "わ": "wa", "を": "wo", "ん": "n",
    "ぁ": "a", "ぃ": "i", "ぅ": "u", "ぇ": "e", "ぉ": "o", "っ": "tsu", "ゃ": "ya", "ゅ": "yu", "ょ": "yo", "ー": "-",
}
OTHER_SCRIPTS = "[\u0370-\u04ff\u1f00-\u1fff\u3041-\u30ff]"
# Latin-1 Supplement to Latin Extended-B, Latin Extended Additional.
LATIN_BLOCKS = ((0x00A0, 0x024F), (0x1E00, 0x1EFF))


def fold_tables() -> tuple[str, str, dict[str, str]]:
    """(from, to) strings for ``translate`` and the replacements of other lengths.

    Rule: decompose a Latin letter and drop its combining marks; keep the result
    when it is plain ASCII.
    """
    folds = dict(SPECIAL_FOLDS)
    for first, last in LATIN_BLOCKS:
        for char in map(chr, range(first, last + 1)):
            parts = unicodedata.normalize("NFKD", char)
            base = "".join(p for p in parts if not unicodedata.combining(p))
            if char not in folds and base and base.isascii():
                folds[char] = base
    single = {c: f for c, f in folds.items() if len(f) == 1}
    longer = {c: f for c, f in folds.items() if len(f) != 1}
    return "".join(single), "".join(single.values()), longer


FOLD_FROM, FOLD_TO, FOLD_LONGER = fold_tables()


def script_table() -> dict[str, str]:
    """ASCII spelling of Greek and Cyrillic letters, accented ones too, and of kana."""
    folds = dict(SCRIPT_FOLDS)
    for consonant, row in KANA_ROWS.items():
        folds.update({kana: consonant + vowel for kana, vowel in zip(row, "aiueo")})
    folds.update(KANA_SPECIAL)
    # katakana stand in the order of hiragana
    folds.update({chr(ord(k) + 0x60): v for k, v in folds.items() if "\u3041" <= k <= "\u3096"})
    folds.update({k.upper(): v.capitalize() for k, v in folds.items() if len(k.upper()) == 1 and k.upper() != k})
    for code in (*range(0x370, 0x500), *range(0x1F00, 0x2000)):
        parts = unicodedata.normalize("NFKD", chr(code))
        base = "".join(p for p in parts if not unicodedata.combining(p))
        if chr(code) not in folds and base in folds:
            folds[chr(code)] = folds[base]
    return folds


def fold_scripts(c: Column) -> Column:
    """Greek, Cyrillic and kana letters in ASCII, one by one; other characters stay."""
    table = F.create_map(*[F.lit(x) for pair in script_table().items() for x in pair])
    spelled = F.transform(F.split(c, ""), lambda x: F.when(x.rlike(OTHER_SCRIPTS), F.coalesce(F.try_element_at(table, x), x)).otherwise(x))
    return F.when(c.rlike(OTHER_SCRIPTS), F.array_join(spelled, "")).otherwise(c)


def fold_ascii(c: Column) -> Column:
    """ASCII spelling of Latin, Greek, Cyrillic and kana text; characters without one are dropped.

    Pure ASCII values, the bulk of most corpora, skip the replacement chain, and texts
    without letters of other scripts skip the table of those.
    """
    folded = fold_scripts(c)
    for char, spelling in FOLD_LONGER.items():
        folded = F.replace(folded, F.lit(char), F.lit(spelling))
    folded = F.translate(folded, FOLD_FROM, FOLD_TO)
    folded = F.regexp_replace(folded, r"[^\x00-\x7F]", "")
    return F.when(c.rlike(r"[^\x00-\x7F]"), folded).otherwise(c)


def inline(c: Column, lower: bool = False) -> Column:
    """One line: line breaks, tabs and runs of blanks become one blank, ends trimmed."""
    line = F.btrim(F.regexp_replace(c, "[\n\r\t ]+", " "), F.lit(STRIP_SET))
    return F.lower(line) if lower else line


def clean_text(c: Column) -> Column:
    """The stored form of an extracted body: folded, on one line, lower case."""
    return inline(fold_ascii(c), lower=True)


def utf8_text(c: Column) -> Column:
    """Text of a binary column read as UTF-8, malformed bytes replaced."""
    return F.make_valid_utf8(c.cast("string"))


def replace_last(c: Column, old: str, new: str, occurrences: int = 1) -> Column:
    """Replace the last ``occurrences`` of ``old``, counted from the right."""
    backwards = F.split(F.reverse(c), re.escape(old[::-1]), occurrences + 1)
    return F.reverse(F.array_join(backwards, new[::-1]))


def strip_suffix(c: Column, suffix: str = " Lyrics", compat: bool = False) -> Column:
    """Drop the last ``suffix`` and trim.

    ``compat`` trims line breaks, tabs, backslashes and the letter ``s`` but no
    blanks, as an older byte-set definition did.
    """
    trim_set = "\n\r\\s\t" if compat else STRIP_SET
    return F.btrim(replace_last(c, suffix, ""), F.lit(trim_set))


def slug_dash(c: Column) -> Column:
    """``No One`` -> ``no-one``; dashes already present stay."""
    kept = F.regexp_replace(fold_ascii(c), f"[^a-zA-Z0-9{SPACE_CLASS}-]", "")
    return F.lower(F.btrim(F.regexp_replace(kept, " +", "-"), F.lit("-")))


def slug_underscore(c: Column) -> Column:
    """``T.N.T.`` -> ``t_n_t``; dots and slashes separate, dashes vanish."""
    marked = F.regexp_replace(fold_ascii(c), "[./]", "_")
    kept = F.regexp_replace(marked, f"[^a-zA-Z0-9{SPACE_CLASS}_]", "")
    joined = F.regexp_replace(F.regexp_replace(kept, " +", "_"), "_+", "_")
    return F.lower(F.btrim(joined, F.lit("_")))


def slug_compact(c: Column) -> Column:
    """``AC/DC`` -> ``acdc``."""
    return F.lower(F.regexp_replace(fold_ascii(c), "[^a-zA-Z0-9]", ""))


def shard_letter(slug: Column) -> Column:
    """First letter of a slug, ``0-9`` for anything else."""
    return F.when(slug.rlike("^[a-z]"), F.substring(slug, 1, 1)).otherwise(F.lit("0-9"))
