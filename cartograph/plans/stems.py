"""The Porter2 rules as DuckDB SQL, for the oracles of full-text queries: one
step of the rules per table expression, over the different words."""

from __future__ import annotations

from cartograph.functions import porter2 as P
from cartograph.functions.text import STOP_WORDS, TOKEN_SPLIT


def _ends(w: str, suffix: str) -> str:
    return f"suffix({w}, '{suffix}')"


def _cut(w: str, n: int) -> str:
    return f"left({w}, length({w}) - {n})"


def _longest(suffixes, found) -> str:
    """CASE over suffixes, longest first; ``found(suffix)`` is the new word."""
    order = sorted(suffixes, key=lambda s: (-len(s), s))
    return "CASE " + " ".join(f"WHEN {_ends('w', s)} THEN {found(s)}" for s in order) + " ELSE w END"


def _region(word: str) -> str:
    """Characters of ``word`` before its region (all, if it has none)."""
    m = f"length(regexp_extract({word}, '^(.*?{P.V}{P.C})', 1))"
    return f"CASE WHEN {m} > 0 THEN {m} ELSE length({word}) END"


def _in(suffix: str, region: str) -> str:
    return f"length(w) - {len(suffix)} >= {region}"


def stem_ctes(words: str, name: str = "st") -> str:
    """``WITH`` items that end in ``name(token, term)``: stems of the words
    that the query ``words`` selects as ``token``."""
    vowel = lambda w: f"regexp_matches({w}, '{P.V}')"
    short = lambda w: f"regexp_matches({w}, '({P.C}{P.V}[^aeiouywxY]|^{P.V}{P.C})$')"

    def plural(s):
        return {"sses": _cut("w", 2), "s": f"CASE WHEN {vowel(_cut('w', 2))} THEN {_cut('w', 1)} ELSE w END", "us": "w", "ss": "w"}.get(
            s, f"CASE WHEN length(w) > 4 THEN {_cut('w', 2)} ELSE {_cut('w', 1)} END")

    def past(s):
        if s.startswith("ee"):
            return f"CASE WHEN {_in(s, 'p1')} THEN {_cut('w', len(s))} || 'ee' ELSE w END"
        return f"CASE WHEN {vowel(_cut('w', len(s)))} THEN {_cut('w', len(s))} || '+' ELSE w END"

    def second(s):
        extra = {"ogi": f" AND {_ends('w', 'logi')}", "li": f" AND regexp_matches(w, '[{P.LI_ENDINGS}]li$')"}.get(s, "")
        return f"CASE WHEN {_in(s, 'p1')}{extra} THEN {_cut('w', len(s))} || '{P.STEP_2[s]}' ELSE w END"

    def third(s):
        return f"CASE WHEN {_in(s, 'p2' if s == 'ative' else 'p1')} THEN {_cut('w', len(s))} || '{P.STEP_3[s]}' ELSE w END"

    def fourth(s):
        extra = " AND regexp_matches(w, '[st]ion$')" if s == "ion" else ""
        return f"CASE WHEN {_in(s, 'p2')}{extra} THEN {_cut('w', len(s))} ELSE w END"

    x = _cut("w", 1)  # the word without the mark of a removed ending
    joined = " OR ".join(_ends(x, s) for s in ("at", "bl", "iz"))
    doubled = " OR ".join(_ends(x, s) for s in P.DOUBLES)
    own = "CASE " + " ".join(f"WHEN starts_with(w, '{p}') THEN {len(p)}" for p in P.PREFIXES) + f" ELSE {_region('w')} END"
    whole = " ".join(f"WHEN token = '{k}' THEN '{v}'" for k, v in P.WHOLE.items())
    kept = ", ".join(f"'{v}'" for v in P.AFTER_PLURAL)
    steps = [
        _longest(("eed", "eedly", "ed", "edly", "ing", "ingly"), past),
        f"CASE WHEN NOT {_ends('w', '+')} THEN w WHEN {joined} THEN {x} || 'e' WHEN {doubled} THEN {_cut('w', 2)} "
        f"WHEN p1 >= length(w) - 1 AND {short(x)} THEN {x} || 'e' ELSE {x} END",
        f"CASE WHEN regexp_matches(w, '^..+[yY]$') AND regexp_matches(w, '{P.C}[yY]$') THEN {x} || 'i' ELSE w END",
        _longest(P.STEP_2, second), _longest(P.STEP_3, third), _longest(P.STEP_4, fourth),
        f"CASE WHEN {_ends('w', 'e')} AND ({_in('e', 'p2')} OR {_in('e', 'p1')} AND NOT {short(x)}) THEN {x} "
        f"WHEN {_ends('w', 'll')} AND {_in('l', 'p2')} THEN {x} ELSE w END",
    ]
    out = [f"{name}_0 AS (SELECT DISTINCT token, regexp_replace(regexp_replace(token, '^y', 'Y'), '({P.V})y', '\\1Y', 'g') AS w FROM ({words}))",
           f"{name}_1 AS (SELECT *, {own} AS p1 FROM {name}_0)",
           f"{name}_2 AS (SELECT *, p1 + {_region('substr(w, p1 + 1)')} AS p2 FROM {name}_1)",
           f"{name}_3 AS (SELECT token, p1, p2, {_longest(('sses', 'ied', 'ies', 'us', 'ss', 's'), plural)} AS w FROM {name}_2)",
           f"{name}_4 AS (SELECT *, w AS plural FROM {name}_3)"]
    for i, step in enumerate(steps, 5):
        out.append(f"{name}_{i} AS (SELECT token, p1, p2, plural, {step} AS w FROM {name}_{i - 1})")
    out.append(f"{name} AS (SELECT token, CASE WHEN length(token) <= 2 THEN token {whole} WHEN plural IN ({kept}) THEN plural "
               f"ELSE replace(w, 'Y', 'y') END AS term FROM {name}_{4 + len(steps)})")
    return ",\n".join(out)


def lexeme_ctes(name: str, source: str, text: str, keys: str) -> str:
    """``WITH`` items that end in ``name(<keys>, v)``: the different lexemes of
    the SQL expression ``text`` for every row of ``source`` (a table or query
    whose ``keys`` are unique); rows without any have an empty list."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    toks = (f"list_distinct(list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '{TOKEN_SPLIT}'), "
            f"lambda t: t <> '' AND NOT list_contains([{stop}], t)))")
    on = " AND ".join(f"a.{k.strip()} IS NOT DISTINCT FROM b.{k.strip()}" for k in keys.split(","))
    return f"""{name}_t AS (SELECT {keys}, {toks} AS toks FROM {source}),
{name}_u AS (SELECT {keys}, unnest(toks) AS token FROM {name}_t),
{stem_ctes(f"SELECT token FROM {name}_u", f"{name}_s")},
{name}_v AS (SELECT {keys}, list(DISTINCT term) AS v FROM {name}_u JOIN {name}_s USING (token) GROUP BY {keys}),
{name} AS (SELECT a.*, coalesce(b.v, []) AS v FROM {name}_t a LEFT JOIN {name}_v b ON {on})"""
