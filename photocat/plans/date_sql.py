"""The date rules as DuckDB WITH entries, for the oracle side."""

from __future__ import annotations

import re

from photocat.functions import fixed_values as fixed
from photocat.functions.dates import AMBIGUOUS, PATTERN, SHAPES, YEAR_PART, last_year

AS_OF = "2026-01-01"


def _back(nums: str) -> str:
    return "".join("\\" + n for n in nums)


def parsed(name: str, source: str, columns: str, value: str, as_of: str = AS_OF) -> str:
    """WITH entries ending in ``name``: the columns plus y, m, d (y is NULL when not an exact date)."""
    cases = " ".join(
        f"WHEN regexp_matches({value}, '{p}') THEN regexp_replace({value}, '{p}', "
        f"'{_back(y)}|{_back(a)}|{_back(b)}|{kind}|{_back(w)}')"
        for p, (y, a, b, w), kind in SHAPES
    )
    return f"""{name}_h AS MATERIALIZED (SELECT {columns}, CASE {cases} END AS head FROM {source}),
{name}_p AS (SELECT *, try_cast(split_part(head, '|', 1) AS int) AS y0, split_part(head, '|', 2) AS p1,
   try_cast(nullif(split_part(head, '|', 2), '') AS int) AS a, try_cast(nullif(split_part(head, '|', 3), '') AS int) AS b,
   split_part(head, '|', 4) AS kind, lower(substr(split_part(head, '|', 5), 1, 3)) AS wd FROM {name}_h),
{name}_q AS (SELECT *, CASE WHEN kind = 'named' THEN cast((instr('janfebmaraprmayjunjulaugsepoctnovdec', lower(substr(p1, 1, 3))) + 2) / 3 AS int)
     WHEN kind = 'order' THEN CASE WHEN a > 12 AND b <= 12 THEN b WHEN (b > 12 AND a <= 12) OR a = b THEN a END ELSE a END AS m1,
   CASE WHEN kind = 'order' THEN CASE WHEN a > 12 AND b <= 12 THEN a WHEN (b > 12 AND a <= 12) OR a = b THEN b END ELSE b END AS d1
   FROM {name}_p),
{name}_r AS (SELECT *, CASE WHEN kind = 'iso' THEN nullif(m1, 0) ELSE m1 END AS m2,
   CASE WHEN kind = 'iso' AND coalesce(m1, 0) = 0 THEN NULL WHEN kind = 'iso' THEN nullif(d1, 0) ELSE d1 END AS d2 FROM {name}_q),
{name}_s AS (SELECT *, head IS NOT NULL AND y0 BETWEEN {fixed.FIRST_YEAR} AND {last_year(as_of)}
   AND (kind = 'iso' OR m2 IS NOT NULL)
   AND coalesce(m2, 1) BETWEEN 1 AND 12 AND coalesce(d2, 1) >= 1
   AND (d2 IS NULL OR try_cast(printf('%04d-%02d-%02d', y0, m2, d2) AS date) IS NOT NULL) AS good FROM {name}_r),
{name} AS MATERIALIZED (SELECT {columns}, CASE WHEN ok THEN y0 END AS y, CASE WHEN ok THEN m2 END AS m, CASE WHEN ok THEN d2 END AS d
   FROM (SELECT *, coalesce(good, false) AND (wd = '' OR wd = substr('montuewedthufrisatsun',
           3 * (isodow(try_cast(printf('%04d-%02d-%02d', y0, m2, d2) AS date)) - 1) + 1, 3)) AS ok FROM {name}_s) AS t)"""


def iso(y="y", m="m", d="d") -> str:
    return (
        f"CASE WHEN {d} IS NOT NULL THEN printf('%04d-%02d-%02d', {y}, {m}, {d}) WHEN {m} IS NOT NULL"
        f" THEN printf('%04d-%02d', {y}, {m}) WHEN {y} IS NOT NULL THEN printf('%04d', {y}) END"
    )


def month_name(m="m") -> str:
    names = ", ".join(f"'{n}'" for n in fixed.MONTHS)
    return f"list_extract([{names}], cast({m} AS int))"


def rough(value: str, y: str = "y") -> str:
    return (
        f"CASE WHEN {y} IS NULL AND regexp_matches(coalesce({value}, ''), '[1-9]') THEN"
        f" trim(regexp_replace({value}, '\\s+', ' ', 'g')) ELSE '' END"
    )


def certain_year(value: str, as_of: str = AS_OF) -> str:
    def part(nums):
        return f"try_cast(regexp_replace({value}, '{AMBIGUOUS}', '{_back(nums)}') AS int)"

    y = (
        f"CASE WHEN regexp_matches({value}, '{AMBIGUOUS}') THEN CASE WHEN {part('135')} BETWEEN 1 AND 12 AND"
        f" {part('246')} BETWEEN 1 AND 12 THEN {part('7')} END WHEN regexp_matches({value}, '{YEAR_PART}')"
        f" THEN try_cast(regexp_replace({value}, '{YEAR_PART}', '\\1') AS int) END"
    )
    return f"CASE WHEN {y} BETWEEN {fixed.FIRST_YEAR} AND {last_year(as_of)} THEN {y} END"


def cut(name: str, source: str, columns: str, pattern: str) -> str:
    """WITH entry: y, m, d cut to what the pattern rates, plus no_year, gy, gm, gd and known."""

    def flag(i):
        return f"regexp_extract(upper(trim(coalesce({pattern}, ''))), '{PATTERN}', {i})"

    return f"""{name}_f AS (SELECT *, regexp_matches(upper(trim(coalesce({pattern}, ''))), '{PATTERN}') AS rated,
   {flag(1)} AS fy, {flag(2)} AS fm, {flag(3)} AS fd FROM {source}),
{name}_g AS (SELECT *, CASE WHEN NOT rated OR fm IN ('!', '~', '@') THEN m END AS cm FROM {name}_f),
{name}_k AS (SELECT *, CASE WHEN NOT rated OR (cm IS NOT NULL AND fd IN ('!', '~', '@')) THEN d END AS cd FROM {name}_g),
{name} AS (SELECT {columns}, y, cm AS m, cd AS d, rated AND fy = '?' AS no_year, rated AND fy IN ('~', '@') AS gy,
   rated AND cm IS NOT NULL AND fm <> '!' AS gm, rated AND cd IS NOT NULL AND fd <> '!' AS gd,
   y IS NOT NULL AND (NOT rated OR fy <> '?' OR cm IS NOT NULL) AS known FROM {name}_k)"""


def in_words(y="y", m="m", d="d") -> str:
    """The automatic format."""
    return (
        f"CASE WHEN {d} IS NOT NULL THEN {month_name(m)} || ' ' || {d} || ', ' || printf('%04d', {y}) WHEN {m} IS NOT NULL"
        f" THEN {month_name(m)} || ' ' || printf('%04d', {y}) WHEN {y} IS NOT NULL THEN printf('%04d', {y}) ELSE '' END"
    )


def rendered(value: str) -> str:
    """The automatic rendering over a ``cut`` entry's columns."""
    words = (
        f"CASE WHEN no_year AND d IS NOT NULL THEN {month_name()} || ' ' || d WHEN no_year THEN {month_name()}"
        f" ELSE {in_words()} END"
    )
    return (
        f"CASE WHEN y IS NULL THEN {rough(value)} WHEN NOT known THEN ''"
        f" WHEN (gy AND NOT no_year) OR gm OR gd THEN 'c. ' || {words} ELSE {words} END"
    )


def one_line(sql: str) -> str:
    return re.sub(r"\s+", " ", sql)
