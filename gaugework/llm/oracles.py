"""SQL counterparts of the operators that SQL can express, for DuckDB."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

FILL_MIDDLE = """
with drawn as (
    select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents
), numbers as (
    select doc_id, t, length(t) as n, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2,
        cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4
    from drawn
), cut as (
    select doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
        case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain'
            when h4 % 100 < 20 then 'spm' else 'psm' end as form
    from numbers
), parts as (
    select *, substring(t, 1, a) as p, substring(t, a + 1, b - a) as m, substring(t, b + 1) as s from cut
)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(a as bigint) end as prefix_chars,
    case when form <> 'plain' then cast(b - a as bigint) end as middle_chars,
    sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
        else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
    sha256(t) as restored_sha256
from parts
"""

CASCADE = rf"""
with texts as (
    select doc_id, row_number() over () as r, coalesce(text, '') as t from documents
), split as (
    select *, regexp_extract_all(t, '{_WORD}') as w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{_WORD}')) as lines
    from texts
), windows as (
    select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as window_text from split, unnest(generate_series(1, len(w) - 2)) as g(i)
), covered as (
    select r, count(distinct p) as n_repeat_words
    from (select r, i, count(*) over (partition by r, window_text) as times from windows), unnest([i, i + 1, i + 2]) as u(p)
    where times > 1 group by r
), figures as (
    select doc_id, w, lines, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
        len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
    from split left join covered using (r)
), judged as (
    select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
        10 * n_symbols > n_words
        or word_chars < 2 * n_words or word_chars > 15 * n_words
        or 2 * n_dup_lines > len(lines)
        or 10 * len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) < 6 * n_words
        or 2 * len(list_filter(w, lambda x: not regexp_matches(x, '[a-zß-öø-ÿ]') and regexp_matches(x, '[A-ZÀ-ÖØ-Þ].*[A-ZÀ-ÖØ-Þ]'))) > n_words
        or 10 * len(list_filter(w, lambda x: regexp_matches(x, '[!?][!?]$'))) > 3 * n_words
        or 10 * len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) > 3 * len(lines)
        or 10 * len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) > 9 * len(lines) as rejected
    from figures
)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
    cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words, base_failed,
    not base_failed and not rejected as kept
from judged
"""

# The checksum's table follows from its rule: eight steps of a shift and the fixed polynomial.
_STEP = "case when {0} & 1 = 1 then xor({0} >> 1, 3988292384) else {0} >> 1 end"
TRIE = f"""
with turns as (
    select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
        row_number() over (partition by conv_id order by turn nulls first, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) as pos
    from conversations where conv_id is not null
), table_of as (
    select list(list_reduce(list_concat([cast(b as bigint)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: {_STEP.format("c")}) order by b) as t from range(256) as r(b)
), convs as (
    select conv_id, conv_id - conv_id % 100 as first,
        xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(cast(conv_id as varchar), ''), lambda d: cast(ord(d) as bigint))),
            lambda c, d: xor(c >> 8, t[(xor(c, d) & 255) + 1]))) % 6 as h
    from (select distinct conv_id from turns), table_of
), rebuilt as (
    select c.conv_id, 1 as part, u.pos, u.role, u.text from convs c join turns u on u.conv_id = c.first and u.pos <= c.h
    union all
    select c.conv_id, 2, u.pos, u.role, u.text from convs c join turns u on u.conv_id = c.conv_id and u.pos > c.h
), sequences as (
    select c.conv_id, coalesce(list({{'role': r.role, 'text': r.text}} order by part, pos) filter (r.part is not null), []) as s
    from convs c left join rebuilt r using (conv_id) group by c.conv_id
), paths as (
    select conv_id, d, s[1:d] as prefix, s[1:d - 1] as above, len(s) as size from sequences, unnest(generate_series(0, len(s))) as g(d)
), nodes as (
    select prefix, any_value(d) as depth, any_value(above) as above, min(conv_id) as conv_id, count(*) as n_convs, max(size) = any_value(d) as childless,
        sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (size = d), '')) as ends_sha256
    from paths group by prefix
), priced as (
    select *, case when depth = 0 then 0 else (n_convs - 1) * length(prefix[depth].text) end as tokens from nodes
), summed as (
    select prefix[1:g.d] as top, count(*) filter (childless) as n_leaves, sum(tokens) as saved_tokens
    from priced, unnest(generate_series(0, depth)) as g(d) group by 1
)
select n.conv_id, cast(n.depth as bigint) as depth, p.conv_id as parent_conv_id, n.n_convs,
    (select count(*) from nodes c where c.depth = n.depth + 1 and c.above = n.prefix) as n_children,
    s.n_leaves, cast(s.saved_tokens as bigint) as saved_tokens, n.ends_sha256
from nodes n join summed s on s.top = n.prefix left join nodes p on n.depth > 0 and p.prefix = n.above and p.depth = n.depth - 1
"""
