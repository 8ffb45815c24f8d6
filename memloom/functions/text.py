"""Text cleaning as Column expressions."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning for retrieval. Scores must equal those of the evaluation that they come from.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "into", "is", "it", "its", "of", "on", "or", "that", "the", "their", "to", "what", "with",
)

#: Damaged field separators in the order in which they are mended; # stands for the separator's core. Fixed values.
DAMAGED = (
    r"<\|#\|*?#\|>",
    r"<\|\\#\|>",
    r"(?<=\S)<\|+>(?=\S)",
    r"<.?\|#\|.?>",
    r"<\|?#\|?>",
    r"<[^|]#\|>|<\|#[^|]>",
    r"<\|#\|+(?!>)",
    r"<\|#:(?!>)",
    r"<\|+#>",
    r"(?<=\S)<\|\|(?!>)",
    r"(?<!<)\|#\|>",
    r"<\|#\|>\|",
    r"\|\|#\|\|",
)
#: What a text must hold for some of them to match: others need not be searched.
HELD = {r"<\|\\#\|>": "\\#|>", r"<\|#:(?!>)": "<|#:", r"<\|+#>": "|#>", r"(?<=\S)<\|\|(?!>)": "<||", r"<\|#\|>\|": "<|#|>|", r"\|\|#\|\|": "||#||"}
#: Characters that names are written with in full width or typographic form, and what they become. Fixed values.
WIDE, NARROW = "－＋／＊（）—　", "-+/*()- "
#: Tags that go, spaces that go beside Chinese characters, quotes that go around them. Fixed values.
TAGS = r"(?i)</?p\s*>|<p/>|</?br\s*>|<br/>"
HAN, LATIN = "[\\u4e00-\\u9fa5]", r"[a-zA-Z0-9()\[\]@#$%!&*\-=+_]"
OUTER_QUOTES = (('"', '"'), ("'", "'"), ("“", "”"), ("‘", "’"), ("《", "》"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value made once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def token_count(text: Column) -> Column:
    """White-space-separated tokens: the default count; any Column function can stand in its place."""
    return F.when(F.trim(text) == "", 0).otherwise(F.size(F.split(F.trim(text), r"\s+")))


def sanitize(text: Column) -> Column:
    """Trimmed, with the common character entities read, without control characters (tab, line feed and carriage return
    stay), lone surrogates and non-characters."""
    out = text
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("#x27", "'"), ("nbsp", "\u00a0"), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return stripped(F.regexp_replace(out, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\uFFFE\uFFFF]", ""))


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def half_width(text: Column) -> Column:
    """Full-width letters, digits and the marks of WIDE in half width."""
    pairs = [(chr(0xFEE0 + ord(c)), c) for c in string.ascii_letters + string.digits]
    return F.translate(text, "".join(w for w, _ in pairs) + WIDE, "".join(n for _, n in pairs) + NARROW)


def normalize_extracted(text: Column, inner_quotes: bool = False) -> Column:
    """Names and descriptions: half width, without paragraph tags, spaces beside Chinese characters, and outer quotes that no
    inner one matches; with inner_quotes without the typographic ones inside, too. Bare numbers of fewer than three
    digits, and runs of digits and dots shorter than six, become null."""

    def wide(out: Column) -> Column:
        out = half_width(out)
        for left, right in ((HAN, HAN), (HAN, LATIN), (LATIN, HAN)):
            out = F.regexp_replace(out, rf"(?<={left})\s+(?={right})", "")
        out = unquoted(out, OUTER_QUOTES)
        if inner_quotes:
            out = F.regexp_replace(F.translate(out, "\u00a0", " "), "[“”‘’]", "")
            out = F.regexp_replace(out, rf"['\"]+(?={HAN})|(?<={HAN})['\"]+", "")
            out = F.regexp_replace(out, "(?<=[^0-9])\u202f", " ")
        return stripped(out)

    def ascii_only(out: Column) -> Column:
        """The same where no other character stands, at a fraction of the work."""
        out = F.when(F.substring(out, 1, 1).isin('"', "'"), unquoted(out, OUTER_QUOTES[:2])).otherwise(out)
        return F.btrim(out, F.lit(" \t\n\x0b\f\r"))

    def unquoted(out: Column, quotes: tuple) -> Column:
        for a, b in quotes:
            out = F.regexp_replace(out, rf"(?s)^{a}([^{a}{b}]*){b}$", "$1")
        return out

    bare = lambda x: (F.length(x) <= 5) & (x.rlike("^[0-9]{1,2}$") | (x.rlike("^[0-9.]{1,5}$") & F.contains(x, F.lit("."))))
    out = F.when(F.contains(text, F.lit("<")), F.regexp_replace(text, TAGS, "")).otherwise(text)
    out = let(out, lambda x: F.when(F.octet_length(x) == F.length(x), ascii_only(x)).otherwise(wide(x)))
    return let(out, lambda x: F.when(bare(x), None).otherwise(x))


#: Characters that make a type invalid wherever they stand. Fixed values.
FORBIDDEN = r"['()<>|/\\]"


def clean_type(text: Column) -> Column:
    """The first non-empty part of a comma list, lower case without spaces; null if there is none, or if any part holds
    forbidden characters."""
    first = F.get(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0))
    return F.when(text.rlike(FORBIDDEN), None).otherwise(F.lower(F.replace(first, F.lit(" "), F.lit(""))))


def truncate_identifier(text: Column, chars: int = 256, octets: int = 512) -> Column:
    """At most so many characters, then at most so many UTF-8 bytes, never cutting a character."""
    cut = F.substring(text, 1, chars)
    fit = F.aggregate(F.split(cut, ""), F.lit(""), lambda a, c: F.when(F.octet_length(F.concat(a, c)) <= octets, F.concat(a, c)).otherwise(a))
    return F.when(F.octet_length(cut) <= octets, cut).otherwise(fit)


def repair_delimiters(text: Column, core: str = "#") -> Column:
    """Damaged field separators as whole ones; what stands between spaces in prose stays."""
    for damaged in DAMAGED:
        mend = lambda x: F.regexp_replace(x, damaged.replace("#", f"\\Q{core}\\E"), f"<|{core}|>")  # noqa: B023, E731
        held = HELD.get(damaged)
        text = mend(text) if held is None else let(text, lambda x: F.when(F.contains(x, F.lit(held.replace("#", core))), mend(x)).otherwise(x))  # noqa: B023
    return text


def strip_markup(text: Column) -> Column:
    """Without internal ids and drawings that have no caption; citations keep their text."""
    out = F.regexp_replace(text, r"(?i)<drawing\b[^>]*/>", "")
    out = F.regexp_replace(out, r"(?is)<cite\b[^>]*>(.*?)</cite>", "$1")
    return F.regexp_replace(out, r"""\s(?:id|refid)=["'][^"']*["']""", "")


def eval_tokens(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9 longer than one, without stop words."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))


def merge_ids(a: Column, b: Column) -> Column:
    """a then b, each id once, order kept."""
    return F.array_distinct(F.concat(a, b))


def subtract_ids(a: Column, b: Column) -> Column:
    """a without what b holds; repeated ids of a stay repeated."""
    return F.filter(a, lambda x: ~F.array_contains(b, x))


def incremental_ids(current: Column, old: Column, new: Column) -> Column:
    """current without old - new, then new - old appended."""
    return merge_ids(subtract_ids(current, subtract_ids(old, new)), subtract_ids(new, old))


def cap_ids(ids: Column, most: int, newest: bool = False) -> Column:
    """The oldest ids, or the newest."""
    return F.when(F.size(ids) <= most, ids).otherwise(F.slice(ids, -most, most) if newest else F.slice(ids, 1, most))


def cap_paths(paths: Column, most: int = 75, newest: bool = False) -> Column:
    """Capped paths, with a mark where some were left out."""
    mark = "...truncated...(FIFO)" if newest else "...truncated...(KEEP Old)"
    return F.when(F.size(paths) <= most, paths).otherwise(F.array_append(cap_ids(paths, most, newest), F.lit(mark)))
