"""SQL for DuckDB of the queries that SQL can express. Token ids, fingerprints and fitted models are beyond it; byte
strings, edit links and keyed permutations are held against brute force in the tests."""

from __future__ import annotations

from millrace.llm import mixing, queries

SPACE = r"[\x20\x09-\x0D]"
WORDS = f"list_filter(string_split_regex(coalesce(text, ''), '{SPACE}+'), lambda x: x <> '')"

OP2 = f"""
with d as (select doc_id, coalesce(text, '') as text, {WORDS} as ws from documents),
l as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from d),
w as (select doc_id, i, list_slice(ws, i, i + 7) as win from (select doc_id, ws, unnest(range(1, len(ws) - 6)) as i from d)),
r as (select doc_id, i, count(*) over (partition by doc_id, win) as n from w),
c as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest(range(i, i + 8)) as p from r where n > 1) group by 1),
m as (select d.doc_id, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars,
  cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols, cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines,
  coalesce(n_repeat_words, 0) as n_repeat_words, cast(len(ls) as bigint) as n_lines, cast(len(regexp_extract_all(text, '!')) as bigint) as n_shouts
  from d join l using (doc_id) left join c using (doc_id)),
b as (select *, n_words < 20 as f0, 100 * n_repeat_words > 30 * n_words as f1, 5 * n_symbols > n_words as f2, 2 * n_dup_lines > n_lines as f3,
  word_chars < 2 * n_words or word_chars > 20 * n_words as f4, 5 * n_shouts > n_words as f5 from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_shouts, f0 or f1 as base_failed,
 not (f0 or f1 or f2 or f3 or f4 or f5) as kept,
 cast(f0::int + 2 * f1::int + 4 * f2::int + 8 * f3::int + 16 * f4::int + 32 * f5::int as bigint) as failed_bits from b"""

FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TERMS = f"list_filter(string_split_regex({FOLDED}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

OP6 = f"""
with d as (select doc_id, {TERMS} as ws from documents),
b as (select item_id, {TERMS} as ws from benchmark),
iw as (select distinct item_id, list_slice(ws, i, i + 9) as win from (select item_id, ws, unnest(range(1, greatest(len(ws) - 8, 2))) as i from b where len(ws) > 0)),
ls as (select distinct len(win) as n from iw),
dw as (select doc_id, i, n, list_slice(ws, i, i + n - 1) as win from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from d, ls)),
h as (select doc_id, item_id, i, n from dw join iw using (win)),
p as (select doc_id, count(distinct x) as n_hit from (select doc_id, unnest(range(i, i + n)) as x from h) group by 1),
s as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from h) group by 1)
select doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
 coalesce(n_hit, 0) > 0 as contaminated from d left join p using (doc_id) left join s using (doc_id)"""

ESCAPED = r"replace(replace({}, '\', '\s'), '<', '\l')"

OP10 = rf"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
g as (select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '') as lost,
  cast(sum(length('<|turn|><|says|><|end|>') + length({ESCAPED.format("role")}) + length({ESCAPED.format("text")})) as bigint) as formatted_chars from c group by 1)
select conv_id, n_turns, turns_sha256, cast(length(lost) as bigint) as loss_chars, sha256(lost) as loss_sha256, formatted_chars from g"""


def rake_sql(rounds: int = 80, keep: float = mixing.KEEP) -> str:
    """A round of fits at a time, as many as bring the shares to their targets."""
    dims = ("source", "lang", "topic")
    fit = "r where i < {}".format(rounds)
    for d in dims:
        fit = f"(select * replace (w * coalesce(g_{d} / nullif(sum(w) over (partition by {d}), 0), 0) as w) from {fit})"
    given = {d: ", ".join(f"('{k}', {v})" for k, v in queries.MIX[f"_{d}"].items()) for d in dims}
    shares = [f"s_{d} as (select {d} as k, sum(tokens) / any_value(total) as share, any_value(v) as v from totals left join (values {given[d]}) t(k, v) on {d} = k group by 1)" for d in dims]
    goals = [f"r_{d} as (select k, coalesce(v, (select greatest(0, 1 - coalesce(sum(v), 0)) from s_{d}) * share / (select sum(share) from s_{d} where v is null)) as r from s_{d}), g_{d} as materialized (select k, r / (select sum(r) from r_{d}) as g from r_{d})" for d in dims]
    joined = " ".join(f"join g_{d} on {d} is not distinct from g_{d}.k" for d in dims)
    dense = lambda mark, times: f"{times} * (length(text) - length(replace(text, '{mark}', ''))) > length(text)"
    return f"""
with recursive t as (select doc_id, source, lang, case when {dense("|", 40)} then 'table' when {dense("@", 400)} then 'contact'
  when {dense("!", 100)} then 'exclaimed' else 'prose' end as topic, cast(len({WORDS}) as bigint) as n_tokens from documents),
cells as materialized (select source, lang, topic, cast(sum(n_tokens) as double) as tokens from t group by 1, 2, 3),
totals as materialized (select *, sum(tokens) over () as total from cells),
{", ".join(shares)}, {", ".join(goals)},
w0 as materialized (select totals.*, g_source.g as g_source, g_lang.g as g_lang, g_topic.g as g_topic, tokens / total as w from totals {joined}),
r as (select 0 as i, * from w0 union all select * replace (i + 1 as i) from {fit}),
f as materialized (select *, case when tokens > 0 then w / (tokens / total) else 0 end as weight from r where i = {rounds}),
o as (select *, coalesce(sum(tokens) over (order by weight desc, source, lang, topic rows between unbounded preceding and 1 preceding), 0) as filled,
  sum(tokens * weight) over (order by weight desc, source, lang, topic rows between current row and unbounded following) as rest from f),
s as (select arg_max((({keep} * total - filled) / rest), weight) filter (where (({keep} * total - filled) / rest) * weight <= 1) as first_scale from o where rest > 0),
p as (select source, lang, topic, weight, case when tokens = 0 then 1.0 else least(1.0, weight * first_scale) end as probability from f, s)
select doc_id, t.source, t.lang, t.topic, n_tokens, round(weight, 6) as weight, round(probability, 6) as probability,
 cast('0x' || substr(md5('mix:' || doc_id), 1, 13) as bigint) / 4503599627370496.0 < probability as kept
from t join p on t.source is not distinct from p.source and t.lang is not distinct from p.lang and t.topic = p.topic"""


SQL: dict[str, str] = {"op1_rake_mixture": rake_sql(), "op2_rule_ledger": OP2, "op6_winnow_decontam": OP6, "op10_typed_chat": OP10}
