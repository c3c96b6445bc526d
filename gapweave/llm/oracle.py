"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from gapweave.llm.license_scan import TEMPLATES, THRESHOLD, template_bigrams
from gapweave.llm.line_dedup import MAX_RATIO, MIN_PAGES
from gapweave.llm.quality_rules import BITS

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
SPACE = r"' ' || chr(9) || chr(11) || chr(12) || chr(13)"

OP2 = f"""
with sized as (
  select doc_id, source, len({WORDS}) as size, md5(coalesce(cast(doc_id as varchar), '')) as k from documents),
totals as (
  select source, cast(sum(size) as bigint) as source_size,
         row_number() over (order by source nulls last) - 1 as rank
  from sized group by source),
weighed as (select *, [1.0, 2.0, 3.0][cast(rank % 3 as int) + 1]::double as weight from totals),
steps as (
  select *, sum(source_size) over () - coalesce(sum(3.0 * source_size) over (
             order by source_size / weight, rank rows between unbounded preceding and 1 preceding), 0) as rest,
         sum(weight) over (order by source_size / weight, rank rows between current row and unbounded following) as w
  from weighed),
full_or_not as (select *, 3.0 * source_size * w <= rest * weight as is_full from steps),
open_ones as (select max(w) as w, arg_max(rest, w) as rest from full_or_not where not is_full),
targets as (
  select source, source_size, rank,
         case when is_full then 3.0 * source_size else o.rest * weight / o.w end::double as target
  from full_or_not left join open_ones o on true),
placed as (
  select s.doc_id, s.size, t.source_size, t.target, t.rank, s.k,
         coalesce(sum(size) over (partition by s.source order by k, doc_id, size
                  rows between unbounded preceding and 1 preceding), 0) + size / 2.0 as middle,
         cast(coalesce(floor(target / nullif(source_size, 0)), 0) as bigint) as whole
  from sized s join targets t on s.source is not distinct from t.source),
copied as (
  select *, case when size = 0 then 0
                 else whole + case when middle < target - whole * source_size then 1 else 0 end end as copies
  from placed),
shared as (select *, case when copies > 0 then least(1.0, middle / target) end::double as u from copied)
select doc_id, size, source_size, target, cast(size * copies as bigint) as taken, cast(copies as int) as copies,
  round(case when copies = 0 then null
    when rank % 3 = 0 then least(1.0, 2 * u / (sqrt(greatest(0.0, 2.25 - 2 * u)) + 1.5))
    when rank % 3 = 1 then least(1.0, 2 * u / (1 + 1))
    when u <= 0.3125 then least(0.5, 2 * u / (sqrt(0.25 + u) + 0.5))
    else least(1.0, 0.5 + 2 * (u - 0.3125) / (sqrt(0.5625 + 5 * (u - 0.3125)) + 0.75)) end, 6) as first_position
from shared
"""

_TEMPLATE_ROWS = ", ".join(
    "('{}', [{}])".format(k, ", ".join(f"'{g}'" for g in template_bigrams(v))) for k, v in TEMPLATES.items()
)
OP3 = rf"""
with templates(license, grams) as (values {_TEMPLATE_ROWS}),
norm as (
  select doc_id, regexp_replace(lower(text), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') as t from documents where text is not null),
units as (
  select doc_id, 0 as line, replace(t, chr(10), ' ') as body from norm where contains(t, chr(10))
  union all
  select doc_id, unnest(range(1, len(string_split(t, chr(10))) + 1)) as line, unnest(string_split(t, chr(10))) from norm),
worded as (select doc_id, line, list_filter(string_split(body, ' '), lambda x: x <> '') as w from units),
grams as (
  select doc_id, line, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as g
  from worded where len(w) between 2 and 120),
scored as (
  select doc_id, line, license, len(g) as n_bigrams,
         2.0 * len(list_intersect(g, grams)) / (len(g) + len(grams)) as dice
  from grams g join templates t on len(g.g) between len(t.grams) * {THRESHOLD} / (2 - {THRESHOLD})
                                               and len(t.grams) * (2 - {THRESHOLD}) / {THRESHOLD})
select doc_id, cast(line as int) as line, license, round(dice::double, 6) as dice, cast(n_bigrams as int) as n_bigrams
from scored where dice >= {THRESHOLD}
"""

_BIT = lambda name, test: f"case when {test} then {BITS[name]} else 0 end"
OP5 = rf"""
with words as (select row_number() over () as r, doc_id, coalesce(text, '') as text, {WORDS} as w from documents),
grams as (
  select r, unnest(range(1, len(w) - 1)) as i,
         unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as g
  from words where len(w) >= 3),
twice as (select r, i from (select r, i, count(*) over (partition by r, g) as n from grams) where n > 1),
covered as (select r, count(distinct i + d) as n from twice, (values (0), (1), (2)) x(d) group by r),
lines as (
  select r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from words),
measured as (
  select doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
         len(l) - len(list_distinct(l)) as n_dup_lines, len(l) as n_lines, coalesce(n, 0) as n_repeat_words
  from words join lines using (r) left join covered using (r)),
judged as (
  select *, {_BIT('few_words', 'n_words < 50')}
   + {_BIT('repeated_words', '100 * n_repeat_words > 50 * n_words')}
   + {_BIT('symbols', '100 * n_symbols > 30 * n_words')}
   + {_BIT('repeated_lines', '100 * n_dup_lines > 30 * n_lines')}
   + {_BIT('short_words', '10 * word_chars < 15 * n_words')}
   + {_BIT('long_words', 'word_chars > 25 * n_words')} as failed
  from measured)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed & 3) <> 0 as base_failed, failed = 0 as kept, cast(failed as int) as failed
from judged
"""

_RENDER = """'<|im_start|>' || coalesce(replace(t.role, '<|', '< |'), 'user') || chr(10)
  || replace(coalesce(t.text, ''), '<|', '< |') || '<|im_end|>' || chr(10)"""
OP8 = f"""
with numbered as (
  select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as i
  from conversations where conv_id is not null),
ends as (select conv_id, max(case when role = 'assistant' then i else 0 end) as e from numbered group by conv_id),
replies as (select n.conv_id, text from numbered n join ends using (conv_id) where i = e),
sides as (
  select conv_id, 'chosen' as side, i, role, text from numbered join ends using (conv_id) where e = 0 or i <= e
  union all
  select conv_id, 'rejected', i, role, text from numbered join ends using (conv_id) where e = 0 or i < e
  union all
  select e.conv_id, 'rejected', e.e, 'assistant', r.text from ends e join replies r on r.conv_id = xor(e.conv_id, 1)
  where e.e > 0),
turns as (
  select a.conv_id, a.i,
         b.i is not null and a.role is not distinct from b.role and a.text is not distinct from b.text as same
  from sides a left join sides b on a.conv_id = b.conv_id and a.i = b.i and b.side = 'rejected' where a.side = 'chosen'),
prefix as (
  select conv_id, coalesce(min(case when not same then i end) - 1, count(*)) as n from turns group by conv_id),
parts as (
  select conv_id, case when i <= n then 'prompt' else side end as part, i, t.role, {_RENDER} as r,
         length('<|im_start|>' || coalesce(replace(t.role, '<|', '< |'), 'user')) + 1 as head
  from sides t join prefix using (conv_id) where i > n or side = 'chosen'),
placed as (
  select *, coalesce(sum(length(r)) over (partition by conv_id, part order by i
              rows between unbounded preceding and 1 preceding), 0) as begun from parts),
joined as (
  select conv_id, part, string_agg(r, '' order by i) as body,
         string_agg(cast(begun + head as bigint) || '-' || cast(begun + length(r) - 1 as bigint), ',' order by i)
           filter (where role = 'assistant') as spans
  from placed group by conv_id, part)
select p.conv_id, cast(p.n as int) as n_prefix, coalesce(a.body, '') as prompt, coalesce(b.body, '') as chosen,
       coalesce(c.body, '') as rejected, coalesce(b.spans, '') as chosen_spans, coalesce(c.spans, '') as rejected_spans
from prefix p
  left join joined a on a.conv_id = p.conv_id and a.part = 'prompt'
  left join joined b on b.conv_id = p.conv_id and b.part = 'chosen'
  left join joined c on c.conv_id = p.conv_id and c.part = 'rejected'
"""

OP9 = f"""
with docs as (select row_number() over () as r, * from documents),
lines as (
  select r, source, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i,
         unnest(string_split(text, chr(10))) as line from docs where text is not null),
bare as (select *, trim(line, {SPACE}) as b from lines),
counts as (select source, b, count(distinct r) as n from bare where b <> '' and source is not null group by source, b),
pages as (select source, count(*) as pages from documents group by source),
boiler as (
  select source, b from counts join pages using (source) where n >= {MIN_PAGES} and n > pages * {MAX_RATIO}),
marked as (select r, i, line, b, exists (select 1 from boiler x where x.source = bare.source and x.b = bare.b) as bad from bare),
kept as (
  select r, count(*) as n_lines, count(*) filter (where bad) as n_bad, count(*) filter (where b <> '' and not bad) as n_good,
         string_agg(line, chr(10) order by i) filter (where not bad) as rest
  from marked group by r)
select doc_id, source, cast(coalesce(n_lines, 0) as int) as n_lines,
       cast(case when n_good > 0 then n_bad else 0 end as int) as n_dropped,
       case when n_good > 0 and n_bad > 0 then rest else text end as text
from docs left join kept using (r)
"""

OP13 = f"""
with judged as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as body, {WORDS} as w from documents),
marks as (select doc_id, max(quality) as good, max(toxic) as toxic from labels where doc_id is not null group by doc_id),
failing as (
  select part, j.doc_id, m.good, m.toxic, cast(len(w) < 200 as int)
    + 2 * cast(100 * len(list_distinct(w)) < 50 * len(w) as int)
    + 4 * cast(100 * length(regexp_replace(body, '[^A-Z]+', '', 'g')) > 3 * length(body) as int)
    + 8 * cast(regexp_matches(body, '[#$%&*|]') as int)
    + 16 * cast(coalesce(min(j.doc_id) over (partition by body) < j.doc_id, false) as int) as fails
  from judged j left join marks m on j.doc_id = m.doc_id),
counts as (
  select part, fails, count(*) as n, count(*) filter (where good = 1) as good, count(*) filter (where toxic = 1) as toxic
  from failing group by part, fails),
letters(letter, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders as (
  select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order,
         [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
  from letters a, letters b, letters c, letters d, letters e where a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps as (
  select filter_order, step, bits[step] as bit, list_sum(bits[1:step]) - bits[step] as earlier
  from orders, (select unnest(range(1, 6)) as step)),
done as (
  select part, filter_order, cast(step as int) as step, bit,
    coalesce(sum(n) filter (where fails & (earlier | bit) = 0), 0)::bigint as kept,
    coalesce(sum(n) filter (where fails & earlier = 0 and fails & bit <> 0), 0)::bigint as removed,
    coalesce(sum(n) filter (where fails & earlier <> 0 and fails & bit <> 0), 0)::bigint as redundant,
    coalesce(sum(n) filter (where fails = bit), 0)::bigint as unique_fails,
    coalesce(sum(good) filter (where fails & earlier = 0 and fails & bit <> 0), 0)::bigint as good_lost,
    coalesce(sum(toxic) filter (where fails & earlier = 0 and fails & bit <> 0), 0)::bigint as toxic_lost
  from counts, (select filter_order, step, bit, cast(earlier as bigint) as earlier from steps)
  group by part, filter_order, step, bit)
select * exclude (bit), cast(sum(removed) over (partition by part, bit) as bigint) as shapley from done
"""

ORACLE = {
    "op2_curriculum_mix": OP2,
    "op3_license_dice": OP3,
    "op5_rule_ledger": OP5,
    "op8_preference_pairs": OP8,
    "op9_site_lines": OP9,
    "op13_filter_interactions": OP13,
}
