"""The numbered queries in DuckDB's SQL, where it can express them."""

WORD = r"[^\x20\x09-\x0D]+"

#: All pairs of documents that share a shingle, and what can be reached by similar ones.
OP1 = rf"""
with recursive docs as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') as w from documents),
runs as (
  select doc_id, unnest(case when len(w) < 5 then [w]
    else list_transform(range(0, len(w) - 4), lambda i: w[i + 1:i + 5]) end) as s from docs),
bags as (select doc_id, s, count(*) as n from runs group by doc_id, s),
sizes as (select doc_id, sum(n) as total from bags group by doc_id),
common as (
  select a.doc_id as a, b.doc_id as b, sum(least(a.n, b.n)) as c
  from bags a join bags b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (
  select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b
  where 5 * c >= 4 * (x.total + y.total - c)),
near as (select a, b from links union all select b, a from links),
reach(doc_id, other) as (
  select doc_id, doc_id from docs
  union select r.doc_id, n.b from reach r join near n on r.other = n.a)
select doc_id, min(other) as class_id, min(other) = doc_id as is_first from reach group by doc_id
"""

OP5 = r"""
with given as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
turns as (
  select *,
    replace(replace(replace(replace(role, '%', '%25'), ':', '%3A'), '<', '%3C'), '#', '%23') as r,
    replace(replace(replace(text, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>') as t
  from given),
chats as (
  select conv_id, count(*) as n_turns,
    string_agg(role || chr(10) || text || chr(10), '' order by turn, role, md5(text)) as said,
    coalesce(string_agg(text, '' order by turn, role, md5(text))
             filter (where role = 'assistant'), '') as loss,
    sum(length(r) + length(t) + 14) as formatted_chars
  from turns group by conv_id)
select conv_id, n_turns, sha256(said) as turns_sha256, length(loss) as loss_chars,
  sha256(loss) as loss_sha256, cast(formatted_chars as bigint) as formatted_chars
from chats
"""

OP6 = rf"""
with sizes as (
  select doc_id, source,
    coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint as size from documents),
sources as (
  select source, sum(size)::bigint as source_size,
    case (row_number() over (order by source nulls last) - 1) % 3
      when 0 then 5 when 1 then 2 else 1 end as weight
  from sizes group by source),
units as (
  select *, 2.0::double * source_size / weight as full_at,
    (1.5::double * sum(source_size) over ()
      - 2.0::double * coalesce(sum(source_size) over before, 0))
    / (sum(weight) over () - coalesce(sum(weight) over before, 0)) as unit
  from sources
  window before as (order by 2.0::double * source_size / weight, coalesce('=' || source, '')
                    rows between unbounded preceding and 1 preceding)),
level as (
  select arg_min(unit, (full_at, coalesce('=' || source, ''))) as level
  from units where unit <= full_at),
targets as (
  select source, source_size,
    least(2.0::double * source_size, coalesce(level * weight, 2.0::double * source_size)) as target
  from units, level),
classes as (
  select source, sum(case when size >= 512 then size else 0 end)::bigint as w2,
    sum(case when size >= 64 and size < 512 then size else 0 end)::bigint as w1,
    sum(case when size < 64 then size else 0 end)::bigint as w0
  from sizes group by source),
tried as (
  select t.*, w0, w1, w2,
    target / nullif(w2 * 4.0::double + w1 * 3.0::double + w0 * 2.0::double, 0) as r2,
    (target - 2.0::double * w2) / nullif(w1 * 3.0::double + w0 * 2.0::double, 0) as r1,
    (target - 2.0::double * (w2 + w1)) / nullif(w0 * 2.0::double, 0) as r0
  from targets t join classes c on t.source is not distinct from c.source),
rates as (
  select *, case when r2 * 4.0::double <= 2 then r2 when r1 * 3.0::double <= 2 then r1
    when r0 * 2.0::double <= 2 then r0 end as rate
  from tried),
expected as (
  select *, case when source_size > 0 then least(2.0::double, coalesce(rate * 2.0::double, 2)) else 0 end as e0,
    case when source_size > 0 then least(2.0::double, coalesce(rate * 3.0::double, 2)) else 0 end as e1,
    case when source_size > 0 then least(2.0::double, coalesce(rate * 4.0::double, 2)) else 0 end as e2
  from rates),
plan as (
  select *, target - (floor(e0) * w0 + floor(e1) * w1 + floor(e2) * w2) as room
  from expected),
chances as (
  select s.*, p.source_size, p.target, p.room,
    case when size >= 512 then 2 when size >= 64 then 1 else 0 end as class,
    case when size >= 512 then e2 when size >= 64 then e1 else e0 end as e
  from sizes s join plan p on s.source is not distinct from p.source),
drawn as (
  select *, floor(e) as copies, e - floor(e) as rest,
    (('0x' || substr(md5('mix-1:' || doc_id::varchar), 1, 13))::bigint + 0.5::double)
      / 4503599627370496.0::double as u
  from chances),
ranked as (
  select *, case when rest > 0 then
    (u / (1 - u)) * ((1 - rest) / rest) / (1 + (u / (1 - u)) * ((1 - rest) / rest)) end as rank
  from drawn),
summed as (
  select *, sum(case when rest > 0 then size else 0 end) over (partition by source
                            order by rank nulls last, doc_id, class
                            rows between unbounded preceding and current row) as words_to
  from ranked),
fit as (
  select *, rest > 0 and words_to <= room as sampled,
    coalesce(max(case when rest > 0 and words_to <= room then words_to end)
      over (partition by source), 0) as fit_words
  from summed),
extra as (
  select *, row_number() over (
      partition by source,
        (rest > 0 and not sampled and size > 0 and size <= room - fit_words)
      order by size desc, rank, doc_id, class) = 1
    and rest > 0 and not sampled and size > 0 and size <= room - fit_words as added
  from fit)
select doc_id, size, source_size, target,
  (size * (copies + (sampled or added)::int))::bigint as taken
from extra
"""

OP7 = """
with whole as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where embedding is not null and len(embedding) > 0
    and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
scored as (
  select q.vec_id as query_id, c.vec_id,
    list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::bigint as score
  from whole q join whole c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v)),
ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank
  from scored)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""

#: The thresholds of the quality rules; ``lgamma`` gives the exact binomial terms.
OP8 = rf"""
with texts as (
  select row_number() over () as r, doc_id, coalesce(lang, '') as stratum,
    coalesce(text, '') as text from documents),
words as (
  select r, i, w from (
    select r, unnest(regexp_extract_all(text, '{WORD}')) as w,
      generate_subscripts(regexp_extract_all(text, '{WORD}'), 1) as i from texts)),
windows as (
  select r, i, [w, lead(w) over s, lead(w, 2) over s, lead(w, 3) over s, lead(w, 4) over s] as five,
    lead(w, 4) over s is not null as whole
  from words window s as (partition by r order by i)),
again as (
  select r, i from windows where whole
  qualify count(*) over (partition by r, five) > 1),
covered as (
  select r, sum(least(5, i - before)) as n from (
    select r, i, coalesce(lag(i) over (partition by r order by i), -5) as before from again)
  group by r),
lines as (
  select r, count(*) as n_lines, count(*) - count(distinct line) as n_dup
  from (select r, unnest(string_split(text, chr(10))) as line from texts)
  where regexp_matches(line, '{WORD}') group by r),
counts as (
  select r, count(*) as n_words, sum(length(w)) as word_chars from words group by r),
measured as (
  select t.doc_id, t.stratum, coalesce(c.n_words, 0)::bigint as n_words,
    coalesce(c.word_chars, 0)::bigint as word_chars,
    (length(t.text) - length(translate(t.text, '#*$%&|<>', '')))::bigint as n_symbols,
    coalesce(l.n_dup, 0)::bigint as n_dup_lines, coalesce(l.n_lines, 0) as n_lines,
    coalesce(v.n, 0)::bigint as n_repeat_words
  from texts t left join counts c using (r) left join lines l using (r)
  left join covered v using (r)),
rated as (
  select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
    [case when word_chars > 0 then n_symbols / word_chars else 0 end,
     case when n_lines > 0 then n_dup_lines / n_lines else 0 end,
     case when n_words > 0 then n_repeat_words / n_words else 0 end,
     case when n_words > 0 then word_chars / n_words else 0 end] as ratio
  from measured),
good as (
  select doc_id from labels where quality is not null group by doc_id having min(quality) = 1),
held as (select stratum, ratio from rated join good using (doc_id) where not base_failed),
tried as (
  select unnest([1, 1, 1, 1, 1, 1, 1, 1, 2, 2, 2, 2, 2, 2, 2, 2, 3, 3, 3, 3, 3, 3, 3, 3,
                 4, 4, 4, 4, 4, 4, 4, 4]) as rule,
    unnest([0.01, 0.02, 0.04, 0.06, 0.1, 0.15, 0.2, 0.3,
            0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9,
            0.01, 0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.18,
            8, 9, 10, 12, 15, 20, 40, 100])::double as cutoff),
tested as (
  select stratum, rule, cutoff, count(*) as n, count(*) filter (where ratio[rule] > cutoff) as k,
    (select greatest(count(distinct stratum), 1) from held) * 32 as tests
  from held, tried group by stratum, rule, cutoff),
certified as (
  select stratum, rule, min(cutoff) as cutoff from tested
  where list_sum(list_transform(range(0, k + 1), lambda j: exp(
      lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1)
      + j * ln(0.004) + (n - j) * ln(0.996)))) <= 0.05 / tests
  group by stratum, rule),
rejecting as (
  select stratum, list((rule, cutoff)) as cuts from certified group by stratum)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not coalesce(list_bool_or(
    list_transform(cuts, lambda c: ratio[c[1]] > c[2])), false) as kept
from rated left join rejecting using (stratum)
"""

#: All windows of all texts, in hexadecimal; texts are taken apart in pieces first.
OP10 = """
with docs as (
  select doc_id, hex(encode(coalesce(text, ''))) as h,
    octet_length(encode(coalesce(text, '')))::bigint as n from documents),
pieces as (
  select doc_id, c, substr(h, 2 * c + 1, 610) as piece, least(256, n - 49 - c) as k
  from (select *, unnest(range(0, greatest(n - 49, 0), 256)) as c from docs)),
windows as (
  select doc_id, c + i as s, substr(piece, 2 * i + 1, 100) as w
  from (select *, unnest(range(0, k)) as i from pieces)),
firsts as (
  select w, min(doc_id) as first from windows group by w having min(doc_id) < max(doc_id)),
gone as (select distinct doc_id, s from windows join firsts using (w) where doc_id > first),
stepped as (
  select *, coalesce(s > lag(s) over (partition by doc_id order by s) + 50, true) as new from gone),
numbered as (
  select *, sum(new::int) over (partition by doc_id order by s) as span from stepped),
spans as (
  select doc_id, min(s) as a, max(s) + 50 as b from numbered group by doc_id, span),
kept as (
  select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) as x, a as y from spans
  union all
  select doc_id, max(b), any_value(n) from spans join docs using (doc_id) group by doc_id),
rest as (
  select doc_id, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' order by x) as h
  from kept join docs using (doc_id) group by doc_id),
totals as (
  select doc_id, sum(b - a)::bigint as n_removed, count(*) as n_spans from spans group by doc_id)
select doc_id, n as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(coalesce(rest.h, docs.h))) as kept_sha256
from docs left join totals using (doc_id) left join rest using (doc_id)
"""

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Every document that shares a term with an item is scored.
OP11 = rf"""
with docs as (
  select row_number() over () as r, doc_id, regexp_extract_all({LOWER}, '{TERM}') as terms
  from documents),
sized as (select r, doc_id, len(terms)::bigint as n from docs where len(terms) > 0),
totals as (select count(*) as n_docs, sum(n)::bigint as n_terms from sized),
held as (
  select r, term, count(*) as tf from (select r, unnest(terms) as term from docs) group by r, term),
asked as (
  select distinct i, item_id, term from (
    select row_number() over () as i, item_id,
      unnest(regexp_extract_all({LOWER}, '{TERM}')) as term from benchmark)),
weights as (
  select term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::bigint as w
  from held, totals where term in (select term from asked) group by term, n_docs),
adds as (
  select r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (
    100 - 50 + (50 * n * n_docs) // n_terms))) as points
  from held join weights using (term) join sized using (r), totals),
scored as (
  select i, item_id, r, doc_id, sum(points)::bigint as score
  from asked join adds using (term) group by i, item_id, r, doc_id having sum(points) > 0)
select item_id, cast(row_number() over (
    partition by i order by score desc, doc_id asc nulls last) as integer) as rank, doc_id, score
from scored qualify rank <= 50
"""

#: A url up to its path, its query and its fragment.
URL = r"(?s)^(.*?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"

#: Counts every combination of a labelled url's frequent tokens.
OP13 = rf"""
with parts as (
  select page_id, url,
    {", ".join(f"coalesce(regexp_extract(url, '{URL}', {i + 1}), '') as {n}" for i, n in enumerate(
      ("scheme", "upper_host", "path", "query", "fragment")))}
  from pages),
hosts as (
  select *, translate(upper_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    list_reverse(string_split(translate(
      upper_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '.')) as l
  from parts),
shown as (
  select page_id, url, host, path,
    case when host = '' then [] else list_sort(list_distinct(list_concat(
      ['scheme:' || regexp_replace(translate(
        scheme, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g')],
      list_transform(list_filter(range(0, len(l)), lambda i: l[i + 1] <> ''),
        lambda i: 'host:' || i || '.' || l[i + 1]),
      list_transform(list_filter(
        string_split(regexp_replace(path, '\.[^./]*\z', ''), '/'), lambda v: v <> ''),
        lambda v: 'path:' || regexp_replace(v, '[0-9]+', '0', 'g')),
      list_transform(list_filter(
        [regexp_extract(string_split(path, '/')[-1], '\.([^.]*)\z', 1)], lambda v: v <> ''),
        lambda v: 'type:' || regexp_replace(v, '[0-9]+', '0', 'g')),
      list_transform(list_filter(list_transform(
        string_split(query, '&'), lambda v: regexp_extract(v, '^[^=]*')), lambda v: v <> ''),
        lambda v: 'query:' || regexp_replace(v, '[0-9]+', '0', 'g')),
      case when fragment <> '' then ['#'] else [] end))) end as tokens
  from hosts),
bad as (
  select doc_id, bool_or(quality = 0 or toxic = 1) as unwanted from labels
  where doc_id is not null group by doc_id having unwanted is not null),
labelled as (
  select row_number() over () as n, tokens, unwanted from shown
  join bad on doc_id = try_cast(
    regexp_extract(path, '/([0-9]{{1,18}})(?:\.[^./]*)?/?\z', 1) as bigint)
  where len(tokens) > 0),
least as (select greatest(ceil(0.005::double * count(*)), 2) as least from labelled),
frequent as (
  select token from (select unnest(tokens) as token from labelled)
  group by token having count(*) >= (select least from least)),
kept as (
  select n, unwanted, list(token order by token) as k
  from (select n, unwanted, unnest(tokens) as token from labelled) join frequent using (token)
  group by n, unwanted having count(*) <= 12),
combinations as (
  select unwanted, list_filter(k, lambda t, i: (mask >> (i - 1)) & 1 = 1) as tokens
  from (select unwanted, k, unnest(range(1, 1 << len(k))) as mask from kept)),
rules as (
  select tokens from combinations group by tokens
  having count(*) filter (where unwanted) >= (select least from least)
    and count(*) filter (where unwanted) / count(*) >= 0.5),
minimal as (
  select tokens from rules a where not exists (
    select 1 from rules b where len(b.tokens) < len(a.tokens) and list_has_all(a.tokens, b.tokens))),
hits as (
  select s.tokens, count(*) as n_mined, min(array_to_string(m.tokens, ' ')) as mined
  from (select distinct tokens from shown) s join minimal m on list_has_all(s.tokens, m.tokens)
  group by s.tokens),
listed(place, verdict, rule) as (
  values (1, 'allow', 'example.net/en/'), (2, 'block', 'example.com/de/'), (3, 'allow', 'org/fr/'),
    (4, 'block', 'net/')),
given as (
  select host, path, min(place) as place
  from (select distinct host, path from shown) join listed on
    (host = split_part(rule, '/', 1) or ends_with(host, '.' || split_part(rule, '/', 1)))
    and starts_with(path, substr(rule, strpos(rule, '/')))
  group by host, path)
select page_id, s.host, s.path, rule,
  coalesce(verdict, case when n_mined is null then 'allow' else 'block' end) as verdict,
  coalesce(n_mined, 0) as n_mined, mined
from shown s left join given g on s.host = g.host and s.path = g.path
left join listed using (place) left join hits on hits.tokens = s.tokens
"""

ORACLE_SQL = {
    "op1_near_dedup": OP1,
    "op5_chat_formatting": OP5,
    "op6_mixing": OP6,
    "op7_top_k": OP7,
    "op8_quality_rules": OP8,
    "op10_suffix_dedup": OP10,
    "op11_lexical_search": OP11,
    "op13_url_filter": OP13,
}
