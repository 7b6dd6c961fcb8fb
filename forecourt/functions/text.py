"""Text normalisation as Spark expressions."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

# Every character that counts as white space, control separators included.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def _ranges(chars: str, gap: int = 1) -> str:
    """The inside of a character class that covers the characters with few ranges.

    With a larger gap the ranges also cover some characters between them.
    """
    codes = sorted(map(ord, chars))
    ranges = [[codes[0], codes[0]]]
    for code in codes[1:]:
        if code - ranges[-1][1] <= gap:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "".join(f"\\x{{{low:x}}}-\\x{{{high:x}}}" for low, high in ranges)


SPACE_RANGES = _ranges(SPACES)

# Expressions of built-in functions are right and quick for texts below this code point; what they
# would get wrong there is in ODD. Other texts go by tables of all code points.
LATIN_END = 0x17F
ODD = f"[\\u{LATIN_END + 1:04x}-\\x{{10ffff}}\u00aa\u00b5\u00ba\u0130\u0131\u0149\u017f]"
BEYOND = f"[\\u{LATIN_END + 1:04x}-\\x{{10ffff}}]"

_LATIN_CASED = r"\p{Lu}\p{Ll}\p{Lt}"
_MARK = "\ue000"
_SIGMA, _FINAL_SIGMA = "\u03a3", "\u03c2"
# Syllables of Hangul are numbered by lead, vowel and tail.
_SYLLABLES = (0xAC00, 0xD7A3)
_LEADS, _VOWELS, _TAILS = (
    "".join(map(chr, range(first, first + n))) for first, n in ((0x1100, 19), (0x1161, 21), (0x11A8, 27))
)


def _code_points(end: int = sys.maxunicode) -> list[str]:
    """All assigned characters but surrogates, up to `end`."""
    return [c for c in map(chr, range(end + 1)) if unicodedata.category(c) not in ("Cn", "Cs", "Co")]


def _once(value: Column, function) -> Column:
    """The function of a value that is worked out once, however often the function uses it."""
    return F.transform(F.array(value), function)[0]


def _base_form(char: str) -> str:
    """The letters that a character decomposes to in the end, marks left out."""
    spelling = [p for p in unicodedata.decomposition(char).split() if not p.startswith("<")]
    if spelling:
        return "".join(_base_form(chr(int(p, 16))) for p in spelling)
    return "" if unicodedata.combining(char) else char


@lru_cache(maxsize=2)
def _fold_tables(end: int) -> tuple[str, str, dict[str, str]]:
    """(characters, their one-letter forms, characters with longer forms), up to a code point.

    Combining marks come last in the first string and have no counterpart, so that `translate`
    deletes them. Syllables of Hangul are left to arithmetic.
    """
    changed = {c: form for c in _code_points(end) if (form := _base_form(c)) != c}
    single = {c: form for c, form in changed.items() if len(form) == 1}
    marks = [c for c, form in changed.items() if not form]
    longer = {c: form for c, form in changed.items() if len(form) > 1}
    return "".join([*single, *marks]), "".join(single.values()), longer


def _pieces(text: Column, members: str) -> Column:
    """The text cut into single members of a character class and runs of other characters."""
    return F.regexp_extract_all(text, F.lit(f"([{members}]|[^{members}]+)"), F.lit(1))


def _fold_by_table(text: Column, end: int) -> Column:
    chars, forms, longer = _fold_tables(end)
    by_size = sorted(longer, key=lambda c: -len(longer[c]))
    members = _ranges("".join(by_size))

    def spell(piece: Column) -> Column:
        nth = [
            F.translate(piece, "".join(by_size), "".join(longer[c][i] for c in by_size if len(longer[c]) > i))
            for i in range(len(longer[by_size[0]]))
        ]
        return F.when(piece.rlike(f"^[{members}]$"), F.concat(*nth)).otherwise(piece)

    # Most texts are through after a look for a few ranges.
    some = text.rlike(f"[{_ranges(''.join(by_size), gap=24)}]")
    expanded = F.when(some, F.array_join(F.transform(_pieces(text, members), spell), "")).otherwise(text)
    return F.translate(expanded, chars, forms)


def _fold_hangul(text: Column) -> Column:
    """Syllables as their two or three letters."""
    low, high = _SYLLABLES
    members = f"\\u{low:04x}-\\u{high:04x}"

    def spell(piece: Column) -> Column:
        number = F.ascii(piece) - low
        lead, vowel, tail = F.floor(number / 588), F.floor(number % 588 / 28), number % 28
        letters = F.concat(
            F.lit(_LEADS).substr((lead + 1).cast("int"), F.lit(1)),
            F.lit(_VOWELS).substr((vowel + 1).cast("int"), F.lit(1)),
            F.when(tail > 0, F.lit(_TAILS).substr(tail, F.lit(1))).otherwise(""),
        )
        return F.when(piece.rlike(f"^[{members}]$"), letters).otherwise(piece)

    return F.when(text.rlike(f"[{members}]"), F.array_join(F.transform(_pieces(text, members), spell), "")).otherwise(text)


def strip_accents(text: Column) -> Column:
    """Compatibility decomposition without combining marks, of any code point; ASCII text is left alone."""
    every = _once(text, lambda t: _once(_fold_hangul(t), lambda u: _fold_by_table(u, sys.maxunicode)))
    return (
        F.when(F.octet_length(text) == F.char_length(text), text)
        .when(text.rlike(BEYOND), every)
        .otherwise(_fold_by_table(text, LATIN_END))
    )


def trim_all(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def drop_hyphens_spaces(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("-"), F.lit("")), F.lit(" "), F.lit(""))


def drop_hyphens(text: Column) -> Column:
    return F.replace(text, F.lit("-"), F.lit(""))


@lru_cache(maxsize=1)
def _case_classes() -> tuple[str, str, str]:
    """Character classes: cased, ignored around a sigma, cased and not ignored.

    Which they are shows in how neighbours change: a letter stays small behind a cased one, and a
    sigma is final unless a cased one comes next, ignored ones aside.
    """
    cased, ignored, solid = [], [], []
    for c in _code_points():
        is_cased = (c + "a").title()[-1] == "a"
        sigma_before = [("a" + _SIGMA + c + more).lower()[1] == _FINAL_SIGMA for more in ("", "a")]
        is_ignored = sigma_before == [True, False]
        if is_cased:
            cased.append(c)
        if is_ignored:
            ignored.append(c)
        elif is_cased:
            solid.append(c)
    return _ranges("".join(cased)), _ranges("".join(ignored)), _ranges("".join(solid))


@lru_cache(maxsize=2)
def _case_table(kind: str) -> tuple[str, str, dict[str, str]]:
    """(characters, their forms in small letters or at a word's start, characters with longer forms)."""
    changed = {c: form for c in _code_points() if (form := getattr(c, kind)()) != c}
    single = {c: form for c, form in changed.items() if len(form) == 1}
    return "".join(single), "".join(single.values()), {c: form for c, form in changed.items() if len(form) > 1}


def _by_case_table(text: Column, kind: str) -> Column:
    """All characters by a case table; the longer forms first."""
    chars, forms, longer = _case_table(kind)
    for char, form in longer.items():
        text = F.replace(text, F.lit(char), F.lit(form))
    return F.translate(text, chars, forms)


def _first_by_case_table(char: Column) -> Column:
    """One character at a word's start."""
    chars, forms, longer = _case_table("title")
    names = F.create_map(*[F.lit(x) for pair in longer.items() for x in pair])
    return F.coalesce(F.try_element_at(names, char), F.translate(char, chars, forms))


def _final_sigmas(text: Column) -> Column:
    _, ignored, solid = _case_classes()
    final = f"([{solid}][{ignored}]*+){_SIGMA}(?![{ignored}]*+[{solid}])"
    return F.when(text.contains(_SIGMA), F.regexp_replace(text, final, f"$1{_FINAL_SIGMA}")).otherwise(text)


def lower_case(text: Column) -> Column:
    """Small letters, of any code point."""
    every = _once(text, lambda t: _by_case_table(_final_sigmas(t), "lower"))
    return F.when(text.rlike(ODD), every).otherwise(F.lower(text))


def title_case(text: Column) -> Column:
    """A capital after every character that is not a letter, small letters elsewhere.

    `initcap` sees word starts after spaces only, so a mark with a space goes in front of the
    other word starts and comes out afterwards. Texts with characters that it does not know go run
    by run of cased characters.
    """
    marked = F.regexp_replace(text, f"([^{_LATIN_CASED} ])(?=[{_LATIN_CASED}])", f"$1{_MARK} ")
    quick = F.replace(F.initcap(marked), F.lit(f"{_MARK} "), F.lit(""))

    def by_runs(given: Column) -> Column:
        cased = _case_classes()[0]
        runs = F.regexp_extract_all(_final_sigmas(given), F.lit(f"([{cased}]+|[^{cased}]+)"), F.lit(1))
        spelled = F.transform(
            runs, lambda r: F.concat(_first_by_case_table(F.substring(r, 1, 1)), _by_case_table(F.substring(r, 2, 2**31 - 1), "lower"))
        )
        return F.array_join(spelled, "")

    return F.when(text.rlike(ODD), _once(text, by_runs)).otherwise(quick)


def normalise_text(text: Column) -> Column:
    """Fold accents, drop hyphens and spaces, title case. Null stays null."""
    return title_case(drop_hyphens_spaces(lower_case(strip_accents(text))))


def canonical_name(text: Column, prefixes: dict[str, str]) -> Column:
    """The name of the first prefix the folded text starts with, else the text in title case."""
    trimmed = trim_all(text)
    key = drop_hyphens_spaces(strip_accents(lower_case(trimmed)))
    names = F.create_map(*[F.lit(x) for pair in prefixes.items() for x in pair])
    start = F.regexp_extract(key, "^(" + "|".join(re.escape(p) for p in prefixes) + ")", 1)
    return F.coalesce(F.try_element_at(names, start), title_case(trimmed))


def keyword_class(text: Column, rules) -> Column:
    """The class of the first rule one of whose parts occurs in the text, else null."""
    chosen = None
    for parts, name in rules:
        hit = text.contains(parts[0])
        for part in parts[1:]:
            hit = hit | text.contains(part)
        chosen = F.when(hit, F.lit(name)) if chosen is None else chosen.when(hit, F.lit(name))
    return chosen


def transmission_class(text: Column, rules) -> Column:
    return keyword_class(strip_accents(lower_case(trim_all(text))), rules)


def fuel_class(text: Column, rules) -> Column:
    return keyword_class(lower_case(trim_all(text)), rules)
