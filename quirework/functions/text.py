"""String functions with the white space, word edges and anchors of ECMAScript regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ECMAScript white space, as the inside of a Java character class. Letters fail at two tests: each part of a class is a call for each letter.
_WIDE_SPACE = r"\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
SPACE_SET = rf"\s[\u00A0-\uFEFF&&[{_WIDE_SPACE}]]"
SPACE = f"[{SPACE_SET}]"
_WHITE = "".join(map(chr, [9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
#: An ASCII word edge; Java's own \b is wider.
EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"

# Line patterns, in order of priority.
HEADING_PATTERNS = [
    rf"(?i)\Achapter{SPACE}+(\d+|[IVXLCDM]+)[:.{SPACE_SET}]*.*\z",
    rf"(?i)\Apart{SPACE}+(\d+|[IVXLCDM]+)[:.{SPACE_SET}]*.*\z",
    rf"(?i)\Asection{SPACE}+(\d+\.?\d*)[:.{SPACE_SET}]*.*\z",
    rf"\A(\d+\.?\d*){SPACE}+([A-Z][A-Za-z{SPACE_SET}]+)\z",
    rf"\A([A-Z][A-Z{SPACE_SET}]{{2,50}})\z",
    r"(?i)\A(abstract|introduction|conclusion|references|appendix)\z",
]
LIST_PATTERN = rf"\A(?:[-•*]{SPACE}+|\d+[.)]{SPACE}+|[A-Za-z][.)]{SPACE}+)"
CAPS_HEADING = rf"\A[A-Z][A-Z{SPACE_SET}]{{5,50}}\z"

#: No word character after, nor before a first character that was just read. The first character is read before the look back: most places fail at
#: it, at a fraction of the cost of looking back.
AFTER, FIRST = r"(?!\w)", r"(?<!\w{})"
_MONTH = "(?:J(?:anuary|une|uly)|February|Ma(?:rch|y)|A(?:pril|ugust)|September|October|November|December)"
_DIGIT, _WORD, _SIGN = rf"\d{FIRST.format('\\d')}", rf"\w{FIRST.format('\\w')}", r"[.%+-](?<=\w[.%+-])"

# Entity patterns in order of emission: type, confidence, pattern with the name in group 1. Those of one type are neighbours.
ENTITY_PATTERNS = [
    ("date", 0.9, rf"({_DIGIT}\d?[-/]\d{{1,2}}[-/]\d{{2,4}}){AFTER}"),
    ("date", 0.9, rf"({_DIGIT}\d{{3}}[-/]\d{{1,2}}[-/]\d{{1,2}}){AFTER}"),
    ("date", 0.9, rf"(?i)((?=[ADFJMNOS])(?<!\w){_MONTH}{SPACE}+\d{{1,2}},?{SPACE}+\d{{4}}){AFTER}"),
    ("money", 0.95, rf"(\$(?<=\w\$)[\d,]+(?:\.\d{{2}})?|(?:{_DIGIT}|,(?<=\w,))[\d,]*+(?:\.\d{{2}})?{SPACE}*(?:USD|EUR|GBP)){EDGE}"),
    ("email", 0.95, rf"((?:{_WORD}|{_SIGN})[\w.%+-]*+@[\p{{Alnum}}.-]+\.\p{{Alpha}}{{2,}}){AFTER}"),
    ("url", 0.95, rf"(h{FIRST.format('h')}ttps?://[\S&&[^<>\"{{}}|\\^`\[\]]&&[^[\u00A0-\uFEFF&&[{_WIDE_SPACE}]]]]+){EDGE}"),
    ("percentage", 0.9, rf"({_DIGIT}\d*+(?:\.\d++)?%){EDGE}"),
]


#: What joins the pages of a group, and stands for a summary where there is none (fixed values).
PAGE_BREAK = "\n\n--- Page Break ---\n\n"
NO_CONTENT, NO_SUMMARY = "No content available for summary.", "No summary available."


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def first_of_each(values: Column, same) -> Column:
    """Of a sorted array the first element of each run; ``same`` compares two neighbours."""
    return let(values, lambda v: F.filter(v, lambda x, i: (i == 0) | ~same(x, F.get(v, i - 1))))


def runs(values: Column, n: Column, starts: Column, f) -> Column:
    """``f`` of each slice of an array of ``n`` from one of ``starts`` (from 0) to before the next."""
    return F.transform(starts, lambda a, k: f(F.slice(values, a + 1, F.coalesce(F.get(starts, k + 1), n) - a)))


def places(n: Column, keep) -> Column:
    """Those of 0, 1, ..., n - 1 that ``keep`` holds for."""
    return F.filter(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), keep)


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(_WHITE))


def preview(text: Column, n: int, more: str = "...") -> Column:
    """The first ``n`` characters, marked if there are more."""
    return F.concat(F.substring(text, 1, n), F.when(F.length(text) > n, more).otherwise(""))


def capitalised(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 2147483647))


def truncate_sentence(text: Column, limit: int) -> Column:
    """Cut to ``limit``, at the last sentence end if that lies beyond 70 % of it, else with dots."""
    cut = F.substring(text, 1, limit)

    def last(mark: str) -> Column:
        back = F.instr(F.reverse(cut), mark)
        return F.when(back > 0, F.length(cut) - back).otherwise(-1)

    end = F.greatest(last("."), last("!"), last("?"))
    return F.when(F.length(text) <= limit, text).when(end > limit * 0.7, F.substring(cut, F.lit(1), end + 1)).otherwise(F.concat(cut, F.lit("...")))


def merge_content(a: Column, b: Column) -> Column:
    """Of two contents the longer if one holds the other, else both."""
    return F.when(F.contains(a, b) | F.contains(b, a), F.when(F.length(a) > F.length(b), a).otherwise(b)).otherwise(F.concat(a, F.lit("\n\n"), b))


def or_default(value: Column, default: Column | str) -> Column:
    """``default`` for null and the empty string."""
    return F.coalesce(F.nullif(value, F.lit("")), default if isinstance(default, Column) else F.lit(default))


def json_object(text: Column) -> Column:
    """From the first brace to the last, or the whole text."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found).otherwise(text)
