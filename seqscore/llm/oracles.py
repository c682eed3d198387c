"""DuckDB SQL of the operators that SQL can express."""

#: crc32 of a number's decimal text, bit by bit (fixed polynomial 0xEDB88320).
CRC32 = """xor(list_reduce(list_concat([4294967295::UBIGINT], flatten(list_transform(string_split(cast(doc_id as varchar), ''),
  lambda x: [ascii(x)::UBIGINT, 0, 0, 0, 0, 0, 0, 0]))),
  lambda c, b: xor(xor(c, b) >> 1, 3988292384::UBIGINT * (xor(c, b) & 1))), 4294967295::UBIGINT)"""

#: Runs as islands of strings of 2^s words whose nearest equal string before is one period away.
PERIODIC_RUNS = f"""
with recursive h as (
  select doc_id, {CRC32}::bigint as c, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents
), ap as (
  select *, len(words) as n, case when c % 10 = 0 and len(words) > 0 then (c // 10) % len(words) end as a from h
), looped as (
  select doc_id, n, case when a is null then words else list_transform(range(n), lambda i:
      words[case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + (c // 10) % 8)) end + 1]) end as words
  from ap
), w as (
  select doc_id, n, unnest(words) as word, unnest(range(n)) as i from looped
), grams as (
  select doc_id, n, i, hash(word) as h, 1::bigint as g from w
  union all
  select doc_id, n, i, hash(h, nxt), 2 * g
  from (select *, lead(h, g) over (partition by doc_id order by i) as nxt from grams)
  where nxt is not null and n >= 4 * (g + 1)
), prev as (
  select doc_id, g, i, i - lag(i) over (partition by doc_id, g, h order by i) as p from grams
), island as (
  select doc_id, p, g, i, i - row_number() over (partition by doc_id, g, p order by i) as k
  from prev where p <= g and 2 * p > g
), runs as (
  select doc_id, min(i) - p as start, max(i) + g - (min(i) - p) as length, p as period
  from island group by doc_id, g, p, k
  having max(i) + g - (min(i) - p) >= greatest(6, 4 * p)
), per as (
  select doc_id, count(*) as n_runs, arg_min(struct_pack(s := start, l := length, p := period), struct_pack(e := -length / period, s := start, p := period)) as b,
    string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as listed
  from runs group by doc_id
), gone as (
  select distinct doc_id, unnest(range(start + period, start + length)) as i from runs
), kept as (
  select doc_id, string_agg(word, ' ' order by i) as body from w anti join gone using (doc_id, i) group by doc_id
)
select d.doc_id, coalesce(n_runs, 0) as n_runs, b.s as start, b.l as length, b.p as period, 1000 * b.l // b.p as exponent_milli,
  sha256(coalesce(listed, '')) as runs_sha256, sha256(coalesce(body, '')) as collapsed_sha256
from documents d left join per using (doc_id) left join kept using (doc_id)
"""

_FIELDS = "[cast(doc_id as varchar), source, lang, cast(n_chars as varchar), {text}]"


def _leaf(text: str) -> str:
    return f"sha256(array_to_string(list_transform({_FIELDS.format(text=text)}, lambda v: coalesce(strlen(v) || ':' || v, '-')), ''))"


MERKLE_MANIFEST = f"""
with recursive leaves as (
  select doc_id, {_leaf("text")} as leaf, case when {CRC32} % 2 = 0 then {_leaf("replace(text, chr(10), '')")} else {_leaf("text")} end as other,
    coalesce('1' || source, '0') as key
  from documents
), placed as (
  select *, row_number() over (partition by key order by doc_id nulls first, leaf) - 1 as pos from leaves
), up as (
  select key, 0 as level, pos, leaf as h, count(*) over (partition by key) as n from placed
  union all
  select key, level + 1, pos // 3, sha256(string_agg(h, '' order by pos)), (n + 2) // 3 from up where n > 1 group by key, level, pos // 3, n
), subroots as (
  select key, h, row_number() over (order by key) - 1 as pos from up where n = 1
), top as (
  select 0 as level, pos, h, count(*) over () as n from subroots
  union all
  select level + 1, pos // 3, sha256(string_agg(h, '' order by pos)), (n + 2) // 3 from top where n > 1 group by level, pos // 3, n
), runs as (
  select key, level, pos // 3 as run, list(h order by pos) as hs from up where n > 1 group by all
  union all
  select '', level, pos // 3, list(h order by pos) from top where n > 1 group by all
), climb as (
  select doc_id, key, key as tree, 0 as level, pos, leaf, other as folded, '' as proof, false as done from placed
  union all
  select c.doc_id, c.key, case when r.hs is null then '' else c.tree end, case when r.hs is null then 0 else c.level + 1 end,
    case when r.hs is null then s.pos else c.pos // 3 end, c.leaf,
    case when r.hs is null then c.folded else sha256(array_to_string(list_concat(r.hs[:c.pos % 3], [c.folded], r.hs[c.pos % 3 + 2:]), '')) end,
    case when r.hs is null then c.proof else c.proof || array_to_string(list_concat(r.hs[:c.pos % 3], r.hs[c.pos % 3 + 2:]), '') end,
    r.hs is null and c.tree = ''
  from climb c left join runs r on r.key = c.tree and r.level = c.level and r.run = c.pos // 3 join subroots s on s.key = c.key
  where not c.done
)
select c.doc_id, c.leaf, s.h as subroot, t.h as root, sha256(c.proof) as proof_sha256, c.folded as folded_root, c.folded = t.h as verified
from climb c join subroots s on s.key = c.key join top t on t.n = 1
where c.done
"""

#: All pairs of texts that share a shingle, and the components of those that link.
MINHASH_JOIN = """
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as words
  from documents
), s as (
  select doc_id, list_distinct(list_transform(range(greatest(len(words) - 3, least(len(words), 1))), lambda i: array_to_string(words[i + 1:i + 4], ' '))) as grams from w
), g as (
  select doc_id, len(grams) as n, hash(unnest(grams)) as gram from s
), links as (
  select x.doc_id as a, y.doc_id as b from g x join g y on x.gram = y.gram and x.doc_id <> y.doc_id
  group by x.doc_id, y.doc_id, x.n, y.n having 100 * count(*) >= 80 * (x.n + y.n - count(*))
), reach as (
  select distinct a as doc_id, a as other from links
  union
  select r.doc_id, l.b from reach r join links l on l.a = r.other
), least_id as (
  select doc_id, min(other) as other from reach group by doc_id
)
select doc_id, len(grams) as n_shingles, least(doc_id, coalesce(other, doc_id)) as component_id, doc_id <= coalesce(other, doc_id) as kept
from s left join least_id using (doc_id)
"""
