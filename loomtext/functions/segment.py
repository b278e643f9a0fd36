"""Sentences, as one regular expression: each match is a sentence.

A sentence is a run of pieces up to its end. Pieces that may hold a full stop are told first: initials behind a space, a
mark or the sentence's beginning (each may follow another directly), abbreviations, and numbers. The loop over pieces is
possessive: nothing is tried twice and the stack doesn't grow, so it takes time in proportion to the text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from loomtext.functions import tables as T

#: White space as the patterns mean it: in any engine the same.
WHITE = "\\t\\n\\x0b\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
_ENDS, _CLOSERS = re.escape(T.SENTENCE_ENDS), re.escape(T.CLOSERS)
#: A full stop that isn't part of a run of ends.
_STOP = f"\\.(?![{_ENDS}])"
_INITIALS = f"(?:[A-Za-z]{_STOP})*+"
_SHORT = "|".join(sorted(T.ABBREVIATIONS, key=len, reverse=True))
_PIECES = "|".join(
    [
        f"(?i:{_SHORT}){_STOP}",  # tried where a run of letters begins, as runs are taken whole
        "[A-Za-z]++",
        "[0-9]++(?:\\.(?=[0-9]))?+",
        f"(?![\\r\\n])[{WHITE}(\"']{_INITIALS}",
        f"[^{_ENDS}{WHITE}(\"'A-Za-z0-9]++",
    ]
)
SENTENCE = f"{_INITIALS}(?:{_PIECES})*+(?:[{_ENDS}]++[{_CLOSERS}]*+|[\\r\\n]|\\z)"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{WHITE}]+|[{WHITE}]+$", "")


def sentences(text: Column | str) -> Column:
    """Trimmed sentences that have a letter or digit; none of a null text. Line breaks end a sentence, closing marks stay with theirs.

    A full stop inside a number, behind an initial or an abbreviation ends none.
    """
    text = F.col(text) if isinstance(text, str) else text
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SENTENCE), F.lit(0))
    return F.filter(F.transform(found, trimmed), lambda s: F.rlike(s, F.lit("[\\p{L}\\p{N}]")))


def duck_sentences(source: str, key: str, text: str) -> str:
    """DuckDB SQL for (key, place, sentence) of a relation: ends found by what stands around them, without lookahead.

    Tokens are line breaks, ends with their closing marks, and what lies between. Whether a lone full stop behind one
    letter is an initial's depends on the end before it, which may be of the same kind: behind a quote, at a sentence's
    beginning and behind a bare initial it is; behind another closing mark it is what the one before isn't.
    """
    ends, closers = T.SENTENCE_ENDS, T.CLOSERS.replace("'", "''")
    white = "\\t\\n\\x0b\\f\\r \\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}"
    closing = f"[{closers}]".replace("\"''’”)]»", "\"''’”)\\]»")
    short = ", ".join(f"'{a}'" for a in T.ABBREVIATIONS)
    return f"""(
    with words as (select {key} as k, unnest(t) as token, generate_subscripts(t, 1) as i from (
        select {key}, regexp_extract_all({text}, '[\\r\\n]|[{ends}]+{closing}*|[^{ends}\\r\\n]+') as t from {source})),
    around as (select *, lag(token) over w as p, lag(token, 2) over w as q, lead(token) over w as nxt from words window w as (partition by k order by i)),
    kinds as (select *, regexp_matches(token, '^[{ends}]') as is_end, token in (chr(10), chr(13)) as is_line,
        regexp_matches(token, '^[.]([^{ends}]|$)') as lone, length(token) = 1 as bare,
        case when p is null or regexp_matches(p, '^[{ends}\\r\\n]') then '' else p end as before from around),
    told as (select *, lone and (
            bare and regexp_matches(before, '[0-9]$') and regexp_matches(coalesce(nxt, ''), '^[0-9]')
            or lower(regexp_extract(before, '([A-Za-z]+)$', 1)) in ({short})) as plain_exception,
        lone and regexp_matches(before, '[{white}("''][A-Za-z]$') as sure_initial,
        lone and regexp_matches(before, '^[A-Za-z]$') as single,
        q is null or q in (chr(10), chr(13)) or regexp_matches(q, '["'']$') as single_sure from kinds),
    ended as (select * from told where is_end or is_line),
    linked as (select *, lag(plain_exception) over e as q_plain, lag(sure_initial) over e as q_sure, lag(single) over e as q_single, lag(bare) over e as q_bare,
        lag(is_line) over e as q_line from ended window e as (partition by k order by i)),
    based as (select *, case when not single then sure_initial when single_sure or coalesce(q_line, true) then true
        when q_plain then false when q_bare then true when q_sure then false when q_single then null else true end as known from linked),
    runs as (select *, count(known) over (partition by k order by i) as run from based),
    turned as (select *, first_value(known) over (partition by k, run order by i) = ((row_number() over (partition by k, run order by i)) % 2 = 1) as initial from runs),
    cuts as (select k, i, is_line or not (plain_exception or coalesce(initial, false)) as cut from turned),
    numbered as (select w.k, w.i, w.token, coalesce(c.cut, false) as cut,
        coalesce(sum(case when c.cut then 1 else 0 end) over (partition by w.k order by w.i rows between unbounded preceding and 1 preceding), 0) as s
        from words w left join cuts c on c.k = w.k and c.i = w.i),
    joined as (select k, s, regexp_replace(string_agg(token, '' order by i), '^[{white}]+|[{white}]+$', '', 'g') as sentence from numbered group by k, s)
    select k as {key}, cast(row_number() over (partition by k order by s) - 1 as integer) as place, sentence from joined
    where regexp_matches(sentence, '[\\p{{L}}\\p{{N}}]'))"""
