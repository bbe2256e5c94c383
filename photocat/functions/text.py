"""Text rules as column expressions."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from photocat.functions import fixed_values as fixed

WORD = r"[\p{L}\p{N}\p{M}]"


def present(c: Column) -> Column:
    """Not NULL and not only white space."""
    return F.coalesce(F.regexp_like(c, F.lit(r"\S")), F.lit(False))


def unix_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def strip(c: Column) -> Column:
    """Trim any white space, line breaks included."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean(c: Column) -> Column:
    """Unix line ends, trimmed, empty becomes NULL."""
    return F.nullif(strip(unix_lines(c)), F.lit(""))


def collapse(c: Column) -> Column:
    """White space runs become one space; NULL becomes empty."""
    return F.coalesce(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))


def lang_alt_text(m: Column) -> Column:
    """A map of languages as one text: the default language, else the first that is not empty."""
    default = F.nullif(F.try_element_at(m, F.lit("x-default")), F.lit(""))
    first = F.try_element_at(F.filter(F.map_values(m), lambda v: v != ""), F.lit(1))
    return clean(F.coalesce(default, first))


def list_text(items: Column) -> Column:
    """A list as one text: blank items dropped, joined with a comma."""
    return clean(F.array_join(F.filter(F.transform(items, strip), lambda v: v != ""), ", "))


# cp1252 characters of the bytes 0x80-0x9f that have one, in byte order
_CP1252 = [(b, bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
_CP1252_CHARS = "".join(ch for _, ch in _CP1252 if ch)
_C1_CHARS = "".join(chr(b) for b, ch in _CP1252 if ch)


def mangle_utf8(c: Column) -> Column:
    """UTF-8 text wrongly read as cp1252 (the damage repair_mojibake undoes)."""
    return F.translate(F.decode(F.encode(c, "UTF-8"), "ISO-8859-1"), _C1_CHARS, _CP1252_CHARS)


def repair_mojibake(c: Column) -> Column:
    """Undo UTF-8 read as cp1252; text whose bytes are not valid UTF-8 stays."""
    bytes_as_text = F.translate(c, _CP1252_CHARS, _C1_CHARS)
    one_byte = bytes_as_text.rlike(r"^[\x00-\xff]*$") & bytes_as_text.rlike(r"[\x80-\xff]")
    fixed_text = F.try_validate_utf8(F.encode(bytes_as_text, "ISO-8859-1").cast("string"))
    return F.when(one_byte, F.coalesce(fixed_text, c)).otherwise(c)


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode NFC, which Spark has no function for."""
    return s.str.normalize("NFC")


def is_shape_note(c: Column) -> Column:
    """A description that only states an array shape, as some image writers leave behind."""
    return F.coalesce(
        c.rlike(r'^\s*\{(.*,)?\s*"shape"\s*:\s*\[\s*(-?\d+\s*(,\s*-?\d+\s*)*)?\]\s*(,.*)?\}[\s\x00]*$'), F.lit(False)
    )


def is_marker_keyword(c: Column) -> Column:
    """A processing marker rather than a description of the photo."""
    k = F.lower(strip(c))
    return k.startswith("date:") | k.endswith(" analyzed") | k.isin("back", "negative")


DATE_MARKER = r"(?i)^\s*DATE:\s*(Y[!?~@](?:M[!?~@])?(?:D[!?~@])?)\s*$"


def is_date_marker(c: Column) -> Column:
    """Only the well-formed date marker ("DATE: Y!M~")."""
    return F.coalesce(c.rlike(DATE_MARKER), F.lit(False))


def starts_with_any(c: Column, prefixes: list[str]) -> Column:
    """Starts with one of the prefixes, ending at a word boundary ("scan" is not in "Scandinavia")."""
    parts = []
    for p in prefixes:
        q = "".join("\\" + ch if not (ch.isalnum() or ch == "_" or ord(ch) > 127) else ch for ch in p.lower())
        ends_in_word = p[-1].isalnum()
        parts.append(q + (f"(?!{WORD})" if ends_in_word else ""))
    return F.lower(c).rlike("^(?:" + "|".join(parts) + ")")


def text_case(c: Column, case: str) -> Column:
    """upper, lower, or title: the first letter of each word raised, the rest untouched."""
    if case == "upper":
        return F.upper(c)
    if case == "lower":
        return F.lower(c)
    if case == "title":
        raised = F.transform(F.split(c, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))
        return F.array_join(raised, " ")
    raise ValueError(f"unknown case {case!r}")


def truncate_words(c: Column, n: int) -> Column:
    """At most n characters: cut with an ellipsis, at a word end when one is near; 0 is no limit."""
    if n == 0:
        return c
    if n == 1:
        return F.substring(c, 1, 1)
    head = F.substring(c, 1, n - 1)
    cuts_word = F.substring(c, n - 1, 2).rlike(f"^{WORD}{{2}}$")
    # 0-based place of the last space or line break in the head, -1 when there is none
    space = n - 1 - F.instr(F.translate(F.reverse(head), "\n", " "), " ")
    space = F.when(F.instr(F.translate(head, "\n", " "), " ") > 0, space).otherwise(F.lit(-1))
    near = cuts_word & (space >= F.lit(0.6 * (n - 1)))
    kept = F.when(near, F.substr(head, F.lit(1), space)).otherwise(head)
    short = F.concat(F.regexp_replace(kept, r"\s+$", ""), F.lit("…"))
    return F.when(F.length(c) > n, short).otherwise(c)


def markup_to_plain(c: Column) -> Column:
    """Drop styling stars and one level of backslash escapes."""
    return F.regexp_replace(c, r"(?s)\\(.)|\*", "$1")


def escape_markup(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\*])", r"\\$1")


EMPTY_MARK = "\u0000"


def tidy_lines(c: Column) -> Column:
    """Lines left blank by empty fields go (they hold EMPTY_MARK and nothing visible); blank lines
    written on purpose stay, but are not doubled by a removed line and not kept at either end."""
    lines = F.split(c, "\n")
    state = F.aggregate(
        lines,
        F.struct(
            F.array().cast("array<string>").alias("kept"),
            F.lit(False).alias("dropped"),
            F.lit(False).alias("last_blank"),
        ),
        lambda s, line: _tidy_step(s, line),
    )
    text = F.array_join(state["kept"], "\n")
    return F.regexp_replace(F.regexp_replace(text, r"^(?:[ \t]*\n)+", ""), r"(?:\n[ \t]*)+$", "")


def _tidy_step(s: Column, line: Column) -> Column:
    had_empty = F.contains(line, F.lit(EMPTY_MARK))
    lead = F.regexp_replace(line, "^[ \t]*\u0000[ \t\u0000]*", "")
    text = F.regexp_replace(F.regexp_replace(lead, "[ \t\u0000]+$", ""), "\u0000", "")
    blank = ~text.rlike(r"\S")
    drop = blank & (had_empty | (s["last_blank"] & s["dropped"]))
    return F.struct(
        F.when(drop, s["kept"]).otherwise(F.concat(s["kept"], F.array(text))).alias("kept"),
        F.when(drop, s["dropped"] | had_empty).otherwise(F.lit(False)).alias("dropped"),
        F.when(drop, s["last_blank"]).otherwise(blank).alias("last_blank"),
    )


_STRIPPED = "[\u007f-\u009f\u200e\u200f\u202a-\u202e\u2066-\u2069\ufeff]"


def _trim_name(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ .]+|[ .]+$", "")


def safe_file_name(c: Column, stem: Column) -> Column:
    """A name every file system takes: forbidden characters replaced, direction and control marks
    dropped, at most 200 bytes, reserved device names prefixed, never empty."""
    one_line = F.translate(c, "\n", " ")
    name = _trim_name(F.regexp_replace(F.regexp_replace(one_line, _STRIPPED, ""), r'[<>:"/\\|?*\x00-\x1f]', "_"))
    # whole characters that fit. A character takes at least one byte, so no more than the first
    # FILE_NAME_BYTES characters can; their sizes are added up only where the name is too long
    fits = F.aggregate(
        F.split(F.substring(name, 1, fixed.FILE_NAME_BYTES), ""),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("kept")),
        lambda s, ch: F.struct(
            (s["n"] + F.octet_length(ch)).alias("n"),
            (s["kept"] + F.when(s["n"] + F.octet_length(ch) <= fixed.FILE_NAME_BYTES, 1).otherwise(0)).alias("kept"),
        ),
    )["kept"]
    name = F.when(F.octet_length(name) > fixed.FILE_NAME_BYTES, _trim_name(F.substr(name, F.lit(1), fits))).otherwise(name)
    base = F.upper(F.rtrim(F.substring_index(name, ".", 1)))
    name = F.when(base.isin(*fixed.RESERVED_STEMS), F.concat(F.lit("_"), name)).otherwise(name)
    return F.coalesce(F.nullif(name, F.lit("")), F.nullif(stem, F.lit("")), F.lit("photo"))


def csv_safe(c: Column) -> Column:
    """A cell a spreadsheet shows as text and never runs as a formula."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def natural_key(c: Column) -> Column:
    """Sort key with numbers as numbers, case ignored: text runs and zero-padded digit runs."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"\d+|\D+"), F.lit(0))
    digits = r"^0*(\d+)$"
    return F.transform(
        runs,
        lambda r: F.when(
            r.rlike(r"^\d"),
            # longer numbers sort after shorter ones: length first, then the digits
            F.concat(
                F.lit("0"),
                F.lpad(F.length(F.regexp_replace(r, digits, "$1")).cast("string"), 4, "0"),
                F.regexp_replace(r, digits, "$1"),
            ),
        ).otherwise(F.concat(F.lit("1"), r)),
    )


def glyphs(c: Column) -> Column:
    """Letters and digits of a word that is mostly letters, digits and marks, in any script; else 0."""
    t = strip(c)
    word_chars = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}\p{M}]", ""))
    alnum = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]", ""))
    return F.when(word_chars >= 0.5 * F.length(t), alnum).otherwise(F.lit(0)).cast("long")


def join_names(names: Column, sep: str = ", ", last: str = " and ") -> Column:
    """ "A, B and C" """
    n = F.size(names)
    many = F.concat(F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(0))), sep), F.lit(last), F.try_element_at(names, F.lit(-1)))
    return F.when(n == 0, F.lit("")).when(n == 1, F.try_element_at(names, F.lit(1))).otherwise(many)


def reasons(*pairs) -> Column:
    """Distinct texts of the conditions that hold: pairs of (condition, text)."""
    texts = [F.when(cond, text if isinstance(text, Column) else F.lit(text)) for cond, text in pairs]
    return F.array_distinct(F.array_compact(F.array(*texts)))


def any_of(*conds: Column) -> Column:
    return reduce(lambda a, b: a | b, conds)
