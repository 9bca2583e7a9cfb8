"""DuckDB SQL of the numbered queries that SQL can express."""

OP1_QUALITY_RULES = r"""
with base as (
  select row_number() over () as r, doc_id, source, coalesce(text, '') as t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from documents),
counted as (
  select r, doc_id, source, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols, w, t
  from base),
lines as (
  select r, count(*) - count(distinct line) as n_dup_lines
  from (select r, unnest(string_split(t, chr(10))) as line from base)
  where regexp_matches(line, '[^\x20\x09-\x0D]') group by r),
windows as (
  select r, i, array_to_string(w[i:i+7], ' ') as v
  from (select r, w, unnest(range(1, len(w) - 6)) as i from base where len(w) >= 8)),
hits as (
  select r, i from (select r, i, count(*) over (partition by r, v) as c from windows) where c >= 2),
covered as (
  select r, count(distinct i + j) as n_repeat_words from hits, (select unnest(range(8)) as j) group by r),
judged as (
  select c.doc_id, c.source, c.n_words::bigint as n_words, c.word_chars, c.n_symbols::bigint as n_symbols,
    coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
    c.n_words < 20 or 100 * coalesce(n_repeat_words, 0) > 30 * c.n_words as base_failed
  from counted c left join lines using (r) left join covered using (r)),
hosts as (
  select source, count(*) as n, sum(base_failed::int)::double as f from judged group by source),
total as (
  select sum(n) as docs, sum(f) / sum(n) as m, count(*) as h, sum(f * f / n) / sum(n) as sq from hosts),
spread as (
  select m, m * (1 - m) as chance, sq - m * m - m * (1 - m) * (h - 1) / docs as between_ from total),
prior_ as (
  select m, case when between_ > 1e-12 then least(1e6, greatest(1.0, chance / between_ - 1)) else 1e6 end as worth from spread),
verdicts as (
  select source, (f + m * worth) / (n + worth) <= 0.5 as host_kept from hosts, prior_)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and host_kept as kept
from judged j join verdicts v on j.source is not distinct from v.source
"""

OP8_LINE_DEDUP = r"""
with lines as (
  select r, doc_id, i, line, key from (
    select r, doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
    from (select r, doc_id, unnest(l) as line, unnest(range(len(l))) as i
      from (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents)))),
shared as (
  select key, min(coalesce(doc_id, 9223372036854775807)) as first_doc from lines where length(key) >= 10
  group by key having count(distinct coalesce(doc_id, 9223372036854775807)) > 1),
marked as (
  select l.*, s.key is not null and coalesce(l.doc_id, 9223372036854775807) <> s.first_doc as gone
  from lines l left join shared s using (key))
select doc_id, count(*) as n_lines, sum(gone::int)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from marked group by r, doc_id
"""

OP2_NGRAM_JOIN = r"""
with recursive words as (
  select coalesce(doc_id, 9223372036854775807) as d, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
sets as (
  select d, list_distinct(case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) end) as s
  from words),
items as (select d, len(s) as n, unnest(s) as x from sets),
pairs as (
  select a.d as d, b.d as e from items a join items b on a.x = b.x and a.d <> b.d
  group by a.d, b.d, a.n, b.n having count(*) >= 0.8 * (a.n + b.n - count(*))),
reach as (
  select d, d as e from sets union select r.d, p.e from reach r join pairs p on p.d = r.e),
least_ as (select d, min(e) as c from reach group by d),
degrees as (select d, count(*) as k from pairs group by d)
select nullif(s.d, 9223372036854775807) as doc_id, nullif(c, 9223372036854775807) as class_id, coalesce(k, 0)::bigint as n_links
from sets s join least_ using (d) left join degrees using (d)
"""

OP4_TOOL_CALLS = r"""
with talks as (select conv_id, turn, role, text from conversations),
calls as (
  select u.conv_id, 'c' || u.turn as call_id, u.turn, u.text, r.turn as result_turn, r.text as content, r.conv_id is not null as answered
  from talks u left join talks r on r.conv_id = u.conv_id and r.turn = u.turn + 1 and r.role = 'assistant'
  where u.role = 'user')
select conv_id, call_id, 'call' as kind, turn, result_turn, turn as order_turn, 0 as order_level, '' as errors,
  '{"arguments":{"message":' || to_json(text) || ',"turn":' || turn || '},"id":"' || call_id || '","name":"reply"'
    || case when answered then ',"result":' || to_json(content) else '' end || '}' as json
from calls
union all
select r.conv_id, 'c' || (r.turn - 1), 'orphan_result', r.turn, r.turn, r.turn, 0, '',
  '{"content":' || to_json(r.text) || ',"id":"c' || (r.turn - 1) || '"}'
from talks r where role = 'assistant'
  and not exists (select 1 from talks u where u.conv_id = r.conv_id and u.turn = r.turn - 1 and u.role = 'user')
union all
select conv_id, null, 'message', turn, null, turn, 0, '', '{"content":' || to_json(text) || ',"role":' || to_json(role) || '}'
from talks where role not in ('user', 'assistant')
"""


OP11_HARD_NEGATIVES = r"""
with base as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
scored as (
  select a.vec_id as anchor_id, a.label = b.label as same, b.vec_id, list_dot_product(a.v, b.v)::bigint as score
  from base a join base b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id and len(a.v) = len(b.v)),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, p.positive_id, n.vec_id as negative_id, p.positive_score, n.score as negative_score,
  row_number() over (partition by p.anchor_id, p.positive_id order by n.score desc, n.vec_id)::int as rank
from positives p join scored n on n.anchor_id = p.anchor_id and not n.same
  and 30 * p.positive_score <= 100 * n.score and 100 * n.score <= 90 * p.positive_score
qualify rank <= 10
"""

OP12_MERKLE_MANIFEST = r"""
with recursive base as (
  select doc_id, lang, n_chars, coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') as a,
    coalesce(strlen(source) || ':' || source, '-') as b, coalesce(strlen(lang) || ':' || lang, '-') as tree,
    coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as d, coalesce(strlen(text) || ':' || text, '-') as e,
    list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
        lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end)) as inverted
  from documents),
leaves as (
  select doc_id, lang, tree, sha256(a || b || tree || d || e) as leaf,
    case when xor(inverted, 4294967295::bigint) % 7 = 0
      then sha256(a || b || tree || coalesce(strlen((n_chars + 1)::varchar) || ':' || (n_chars + 1), '-') || e)
      else sha256(a || b || tree || d || e) end as altered
  from base),
placed as (
  select *, row_number() over (partition by tree order by doc_id nulls last, leaf) - 1 as i, count(*) over (partition by tree) as n
  from leaves),
nodes as (
  select 0 as l, tree, i, leaf as h, n from placed
  union all
  select l + 1, tree, i // 2, sha256(string_agg(h, '' order by i)), any_value((n + 1) // 2) from nodes where n > 1 group by l, tree, i // 2),
subroots as (
  select tree, h, row_number() over (order by lang nulls first) - 1 as i, count(*) over () as n
  from (select tree, h from nodes where n = 1) join (select distinct tree, lang from leaves) using (tree)),
upper_ as (
  select 0 as l, i, h, n from subroots
  union all
  select l + 1, i // 2, sha256(string_agg(h, '' order by i)), any_value((n + 1) // 2) from upper_ where n > 1 group by l, i // 2),
root_ as (select h as root from upper_ where n = 1),
steps as (
  select p.tree, p.i, a.l, s.h as sibling, (p.i >> a.l) & 1 as slot
  from placed p join nodes a on a.tree = p.tree and a.n > 1 and a.i = p.i >> a.l
  left join nodes s on s.tree = p.tree and s.l = a.l and s.i = xor(a.i, 1)
  union all
  select p.tree, p.i, 1000 + a.l, s.h, (r.i >> a.l) & 1
  from placed p join subroots r on r.tree = p.tree join upper_ a on a.n > 1 and a.i = r.i >> a.l
  left join upper_ s on s.l = a.l and s.i = xor(a.i, 1)),
proofs as (
  select tree, i, string_agg(coalesce(sibling, ''), '' order by l) as proof, list(coalesce(sibling, '') order by l) as siblings, list(slot order by l) as slots
  from steps group by tree, i),
fold as (
  select p.tree, p.i, 1 as k, altered as h, siblings, slots from placed p left join proofs q using (tree, i)
  union all
  select tree, i, k + 1, sha256(case when slots[k] = 1 then siblings[k] || h else h || siblings[k] end), siblings, slots
  from fold where k <= len(siblings))
select p.doc_id, p.leaf, s.h as subroot, root, sha256(coalesce(proof, '')) as proof_sha256, f.h as folded_root, f.h = root as verified
from placed p join subroots s on s.tree = p.tree join root_ on true left join proofs q on q.tree = p.tree and q.i = p.i
  join fold f on f.tree = p.tree and f.i = p.i and f.k = coalesce(len(f.siblings), 0) + 1
"""

OP13_NEAR_VECTORS = r"""
with recursive base as (
  select row_number() over () as r, vec_id, embedding::double[] as v from embeddings),
usable as (
  select r, vec_id, v, sqrt(list_dot_product(v, v)) as norm from base
  where v is not null and len(list_filter(v, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
links as (
  select a.r as a, b.r as b from usable a join usable b on a.r <> b.r and len(a.v) = len(b.v)
    and list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.95),
reach as (select r as a, r as b from base union select reach.a, links.b from reach join links on links.a = reach.b),
components as (select a, min(vec_id) as component_id from reach join base on b = r group by a),
degrees as (select a, count(*) as n from links group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from base join components c on c.a = r left join degrees d on d.a = r
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": OP1_QUALITY_RULES,
        "op2_ngram_join": OP2_NGRAM_JOIN,
        "op4_tool_calls": OP4_TOOL_CALLS,
        "op8_line_dedup": OP8_LINE_DEDUP,
        "op11_hard_negatives": OP11_HARD_NEGATIVES,
        "op12_merkle_manifest": OP12_MERKLE_MANIFEST,
        "op13_near_vectors": OP13_NEAR_VECTORS,
    }
