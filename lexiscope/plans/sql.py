"""SQL fragments that the oracles share."""

from __future__ import annotations

LIST = r"^\s*(?:[-*+]\s+|\d+[.)]\s+)"


def r6(x: str, digits: int = 6) -> str:
    return f"floor(({x}) * 1e{digits} + 0.5) / 1e{digits}"


def trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def tokens(x: str, name: str = "w") -> str:
    return rf"list_filter(list_transform(string_split_regex({x}, '\s+'), lambda {name}: regexp_replace({name}, '^[^\pL\pN]+|[^\pL\pN]+$', '', 'g')), lambda {name}: {name} <> '')"


def sentences(x: str) -> str:
    return rf"list_filter(list_transform(string_split_regex({x}, '[.!?]+\s+|\n+'), lambda s: regexp_replace({trim('s')}, '[.!?]+$', '')), lambda s: s <> '')"


def units(unit: str = "line", source: str = "documents") -> str:
    """CTEs up to u(doc_id, lang, source, para_idx, text, sentences, counts, tokens)."""
    split = {"line": r"\r?\n", "paragraph": r"\n\s*\n"}[unit]
    return rf"""
p0 as (select doc_id, lang, source, list_filter(list_transform(string_split_regex(coalesce(text, ''), '{split}'), lambda x: {trim('x')}), lambda x: x <> '') as ps from {source}),
p1 as (select doc_id, lang, source, generate_subscripts(ps, 1) as para_idx, unnest(ps) as text from p0),
p2 as (select *, list_filter(string_split_regex(text, '\r?\n'), lambda x: not regexp_matches(x, '{LIST}')) as plain from p1),
p3 as (select *, list_position(list_transform(plain, lambda x: ends_with({trim('x')}, ':')), true) as colon from p2),
p4 as (select *, array_to_string(case when coalesce(colon, 0) > 0 and len(plain) - colon >= 2 then list_slice(plain, 1, colon) else plain end, chr(10)) as prose from p3),
p5 as (select doc_id, lang, source, para_idx, text, {sentences('prose')} as sentences from p4),
p6 as (select *, list_transform(sentences, lambda s: {tokens('s')}) as st from p5),
u as (select doc_id, lang, source, para_idx, text, sentences, list_transform(st, lambda t: len(t)) as counts, flatten(st) as tokens from p6)"""


def whole(source: str = "documents") -> str:
    """CTEs up to d(doc_id, lang, source, text, sentences, counts, tokens): documents as one unit."""
    return (
        units("paragraph", source)
        + f""",
d0 as (select doc_id, flatten(list(sentences order by para_idx)) as sentences, flatten(list(counts order by para_idx)) as counts, flatten(list(tokens order by para_idx)) as tokens from u group by doc_id),
d as (select x.doc_id, x.lang, x.source, coalesce(x.text, '') as text, coalesce(d0.sentences, []) as sentences, coalesce(d0.counts, []) as counts, coalesce(d0.tokens, []) as tokens from {source} x left join d0 using (doc_id))"""
    )


SQUARES = "list_sum(list_transform(counts, lambda c: c * c))"
CV = f"case when len(counts) >= 2 and list_sum(counts) > 0 then sqrt((len(counts) * {SQUARES} - list_sum(counts) * list_sum(counts))::double) / list_sum(counts) end"


def band(x: str, low: float, high: float) -> str:
    return f"case when {x} < {low} then 'low' when {x} > {high} then 'high' when {x} is not null then 'mid' end"


def mattr(source: str, keys: str, window: int, name: str = "m") -> str:
    """CTEs up to `name`(keys, n_tokens, mattr)."""
    k = keys
    return f"""
{name}0 as (select {k}, len(tokens) as n, generate_subscripts(tokens, 1) - 1 as i, unnest(tokens) as token from {source}),
{name}1 as (select *, coalesce(lag(i) over (partition by {k}, lower(token) order by i), -1) as p from {name}0),
{name}2 as (select {k}, n, sum(greatest(0, least(i, n - {window}) - greatest(0, i - {window} + 1, p + 1) + 1)) as s, count(*) filter (where p = -1) as types from {name}1 group by {k}, n),
{name} as (select {k}, n as n_tokens, {r6(f'case when n >= {window} then s::double / ({window} * (n - {window} + 1)) else types::double / n end')} as mattr from {name}2)"""
