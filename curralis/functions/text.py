"""Text functions as Column expressions: folding, tokens of the search index, normalised labels."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folding() -> tuple[str, str]:
    """Every character that decomposes into one base character and marks, and that base: derived from the Unicode data, not listed."""
    found = {}
    for code in (*range(0xC0, 0xAC00), *range(0xD7A4, 0xD800), *range(0xF900, 0xFFFE)):
        base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn")
        if len(base) == 1 and base != chr(code):
            found[chr(code)] = base
    return "".join(found), "".join(found.values())


_FROM, _TO = _folding()
#: Endings and words of the rough Spanish singular; fixed values.
PROTECTED = ("https", "ips", "ids", "ftps", "smtps", "imaps", "ldaps", "pop3s", "bus")
_KEPT = "\ue000"


def bare(text: Column) -> Column:
    """text in small letters, without marks; Hangul syllables as their two or three letters, as canonical decomposition has them."""
    plain = F.translate(F.regexp_replace(F.lower(text), r"\p{Mn}", ""), _FROM, _TO)
    parts = lambda first, n: F.array(*[F.lit(chr(first + k) if first + k != 0x11A7 else "") for k in range(n)])
    lead, vowel, tail = parts(0x1100, 19), parts(0x1161, 21), parts(0x11A7, 28)

    def one(c):
        code = F.ascii(c) - 0xAC00
        return F.when(c.between("\uac00", "\ud7a3"), F.concat(F.get(lead, F.floor(code / 588).cast("int")), F.get(vowel, F.floor(code % 588 / 28).cast("int")), F.get(tail, code % 28))).otherwise(c)

    return F.when(text.rlike("[\uac00-\ud7a3]"), F.array_join(F.transform(F.split(plain, ""), one), "")).otherwise(plain)


def fold(text: Column) -> Column:
    """Lower case without accents; typographic apostrophes become plain ones. Stays in generated code."""
    return F.regexp_replace(bare(text), "’", "'")


def tokens(folded: Column) -> Column:
    """Words of a folded text: letters and digits, joined by a period, apostrophe or underscore between them."""
    return F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{N}]+(?:[._'][\p{L}\p{N}]+)*"), F.lit(0))


def singular(word: Column) -> Column:
    stem = F.regexp_replace(word, "s$", "")
    stem = F.when((F.length(stem) > 2) & stem.endswith("e") & ~F.substring(stem, -2, 1).isin(*"aeiou"), F.substring(stem, F.lit(1), F.length(stem) - 1)).otherwise(stem)
    stem = F.when(stem.endswith("z"), F.concat(F.substring(stem, F.lit(1), F.length(stem) - 1), F.lit("c"))).otherwise(stem)
    return F.when(word.isin(*PROTECTED), word).otherwise(stem)


def normalize_label(label: Column) -> Column:
    """Folded, separators as single spaces, + and # kept right behind a letter and not before one, every word in the singular."""
    text = F.regexp_replace(bare(label), r"(?<=\p{L})([+#]++)(?!\p{L})", "$1" + _KEPT)
    text = F.regexp_replace(text, rf"[+#](?![+#]*{_KEPT})|[^\p{{L}}\p{{N}}+#{_KEPT}]", " ")
    words = F.transform(F.split(F.regexp_replace(text, _KEPT, ""), " +"), singular)
    return F.array_join(F.filter(words, lambda w: w != ""), " ")


def locator_ok(locator: Column) -> Column:
    from curralis.schema import LOCATOR

    return locator.rlike(LOCATOR)
