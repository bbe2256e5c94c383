"""Caption templates as Column expressions.

A template is a list of Python objects made with ``tok``, ``lit`` and ``group``. It is turned into
expressions once, when the plan is built; every photo then runs in one projection.

    [tok("title"), group(lit(", "), tok("date", fmt="yyyy", as_of="2026-01-01")), lit("\\n"), tok("names")]
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from photocat.functions import dates, text

#: For all tokens; for dates; for names; for keywords.
OPTIONS = {"case", "max", "column"} | {"fmt", "as_of", "certainty", "circa"} | {"rows", "order", "sep", "last", "row_sep", "labels"} | {"exclude", "markers"}


@dataclass(frozen=True)
class Lit:
    text: str


@dataclass(frozen=True)
class Tok:
    name: str
    options: dict = field(default_factory=dict)

    @property
    def key(self) -> tuple:
        """Equal for tokens that print the same."""
        return self.name, tuple(sorted((k, tuple(v) if isinstance(v, list) else v) for k, v in self.options.items()))


@dataclass(frozen=True)
class Group:
    items: tuple


def lit(s: str) -> Lit:
    return Lit(s)


def tok(name: str, **options) -> Tok:
    """A token; options: case, max (characters; whole words), column, and for dates fmt with as_of (the column holds
    the date as it was written, and is printed in this format), certainty (the column that rates its parts) and circa (what
    marks a guess). Names (order, sep, last, and with rows: row_sep and labels) and keywords (sep, exclude, markers="show")
    are lists, which ``operators.captions.bind`` prepares."""
    if unknown := set(options) - OPTIONS:
        raise ValueError(f"unknown token options: {', '.join(sorted(unknown))}")
    if "fmt" in options and "as_of" not in options:
        raise ValueError("a date format needs as_of, the day after which no date is believed")
    return Tok(name, options)


def group(*items) -> Group:
    return Group(tuple(items))


def token_text(t: Tok, raw: Column | None = None) -> Column:
    """The token's text; empty when the photo has none. ``raw`` takes the place of its column."""
    v = F.col(t.options.get("column", t.name)).cast("string") if raw is None else raw
    if "as_of" in t.options:
        rating = t.options.get("certainty")
        v = dates.rendered_date(v, t.options["as_of"], t.options.get("fmt"), F.col(rating) if rating else None, t.options.get("circa", "c. "))
    v = text.strip(text.unix_lines(F.coalesce(v, F.lit(""))))
    if t.options.get("case"):
        v = text.text_case(v, t.options["case"])
    limit = t.options.get("max", 0)
    return text.truncate_words(v, limit) if limit else v


#: Where a token's text comes from: an expression over the fields, or the column it was bound to.
At = Callable[[Tok], Column]


def tokens(items) -> list[Tok]:
    out: list[Tok] = []
    for i in items:
        out += [i] if isinstance(i, Tok) else tokens(i.items) if isinstance(i, Group) else []
    return out


def _shows(items, at: At) -> Column:
    """Any token at any depth that is printed (a dropped group prints none)."""
    out = F.lit(False)
    for i in items:
        if isinstance(i, Tok):
            out = out | (at(i) != "")
        elif isinstance(i, Group):
            out = out | (~_dropped(i, at) & _shows(i.items, at))
    return out


def _dropped(g: Group, at: At) -> Column:
    """A group goes when a token directly in it is empty, or it holds tokens and prints none."""
    direct = [t for t in g.items if isinstance(t, Tok)]
    gone = text.any_of(*[at(t) == "" for t in direct]) if direct else F.lit(False)
    return gone | ~_shows(g.items, at) if tokens(g.items) else gone


def render(items, at: At = token_text) -> Column:
    """Marked text: an empty token or dropped group leaves EMPTY_MARK for the line clean-up."""
    parts = []
    for i in items:
        if isinstance(i, Lit):
            parts.append(F.lit(i.text))
        elif isinstance(i, Tok):
            v = at(i)
            parts.append(F.when(v == "", F.lit(text.EMPTY_MARK)).otherwise(text.escape_markup(v)))
        else:
            parts.append(F.when(_dropped(i, at), F.lit(text.EMPTY_MARK)).otherwise(render(i.items, at)))
    return F.concat(*parts)


def caption(items, at: At = token_text) -> Column:
    """The plain caption: rendered, lines tidied, markup read."""
    return text.markup_to_plain(text.tidy_lines(render(items, at)))


def empty_tokens(items, at: At = token_text) -> Column:
    """Names of the tokens that came out empty, sorted."""
    names = [F.when(at(t) == "", F.lit(t.name)) for t in tokens(items)]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*names))))


def only_optional(items, name: str) -> bool:
    """The token occurs, and only inside optional groups: then an empty value is expected."""
    top = [i.name for i in items if isinstance(i, Tok)]
    return name not in top and name in [t.name for t in tokens(items)]
