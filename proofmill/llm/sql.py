"""DuckDB SQL for the queries that SQL can express."""

from .licenses import WHOLE
from .rules import RULES

CRC32 = """
crc_table as (
  select list(c order by i) as t from (
    select i, list_reduce(list_prepend(i::ubigint, range(8)::ubigint[]), lambda c, k:
      case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end) as c
    from range(256) r(i))
)"""

OP2 = f"""
with {CRC32.strip()},
r as (select doc_id, coalesce(text, '') as text from documents),
s as (select doc_id, text, (strlen(text) + 16)::bigint as size, md5(text) as k from r),
c as (
  select doc_id, text, size, k, sum(size) over ()::bigint as total,
    (sum(size) over (order by k, doc_id nulls first rows unbounded preceding))::bigint - size as st,
    (sum(size) over (partition by k))::bigint as g
  from s),
a as (
  select *, case when g > floor(total::double / 40 * 0.01::double) then st else min(st) over (partition by k) end as pos from c),
d as (select *, least(pos * 40 // total, 39)::int as shard from a)
select doc_id, size,
  xor(4294967295::ubigint, list_reduce(list_prepend(4294967295::ubigint,
    list_transform(range(1, strlen(text) * 2, 2), lambda i: ('0x' || substr(hex(text), i, 2))::ubigint)),
    lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::bigint])))::bigint as text_crc32,
  'bytes' as law, shard,
  (row_number() over (partition by shard order by k, doc_id nulls first) - 1)::bigint as slot,
  null::int as grown_shard
from d, crc_table
"""

_GRID = ", ".join(f"('{r}', {k}, {c}::double)" for r, cs in RULES.items() for k, c in enumerate(cs))

#: CTEs from ``documents`` and ``labels`` to ``verdicts``: the features of each document and ``kept``.
RULE_CTES = f"""
rw as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as ls
  from documents),
wins as (
  select rid, i, array_to_string(w[i:i + 7], ' ') as g
  from (select rid, w, unnest(range(1, len(w) - 6)) as i from rw where len(w) >= 8)),
rep as (
  select rid, count(distinct j) as n from (
    select rid, i + unnest(range(8)) as j from (select rid, i, count(*) over (partition by rid, g) as c from wins) where c > 1)
  group by rid),
feat as (
  select doc_id, text, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words,
    (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::bigint as caps, len(ls) as n_lines
  from rw left join rep using (rid)),
scored as (
  select *, (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed,
    (n_words > 100)::int + (n_words > 400)::int + (n_words > 1600)::int as stratum,
    if(word_chars > 0, n_symbols::double / word_chars, 0) as symbols, if(n_words > 0, n_repeat_words::double / n_words, 0) as repeats,
    if(n_lines > 0, n_dup_lines::double / n_lines, 0) as dup_lines, if(word_chars > 0, caps::double / word_chars, 0) as capitals
  from feat),
good as (select * from scored where doc_id in (select doc_id from labels where quality = 1)),
grid as (select * from (values {_GRID}) v(rule, k, cutoff)),
cells as (
  select stratum, rule, k, cutoff, count(*)::double as n,
    sum((case rule when 'symbols' then symbols when 'repeats' then repeats when 'dup_lines' then dup_lines else capitals end > cutoff)::int)::double as x
  from good, grid group by all),
tails as (
  select *, case when x >= n * 0.01 then 1 else list_sum(list_transform(range(0, x::bigint + 1), lambda i:
      exp(lgamma(n + 1) - lgamma(i + 1.0) - lgamma(n - i + 1) + i * ln(0.01) + (n - i) * ln(0.99)))) end as p from cells),
safe as (select *, min((p <= 0.05 / 16)::int) over (partition by stratum, rule order by k) as ok from tails),
cuts as (select stratum, rule, min(cutoff) as cutoff from safe where ok = 1 group by all),
verdicts as (
  select s.*, not base_failed and not exists (
    select 1 from cuts c where c.stratum = s.stratum and c.cutoff <
      case c.rule when 'symbols' then s.symbols when 'repeats' then s.repeats when 'dup_lines' then s.dup_lines else s.capitals end) as kept
  from scored s)"""

OP10 = f"""
with {RULE_CTES.strip()}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept from verdicts
"""

#: All windows of 100 bytes (cut from blocks of hex digits) by their MD5; those that are not the first of their kind are repeats, which merge to runs.
OP4 = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, ''))::bigint as n from documents),
block as (select doc_id, b, n, substr(h, 2 * b + 1, 2 * 1123) as t from (select doc_id, h, n, unnest(range(0, n - 99, 1024)) as b from d where n >= 100)),
win as (select doc_id, b + i as i, md5_number(substr(t, 2 * i + 1, 200)) as g from (select doc_id, b, t, unnest(range(0, least(1024, n - 99 - b))) as i from block)),
rep as (select doc_id, i from (select doc_id, i, row_number() over (partition by g order by doc_id, i) as k from win) where k > 1),
cut as (
  select doc_id, min(i) as a, max(i) + 100 as b from (
    select doc_id, i, sum(new) over (partition by doc_id order by i) as run from (
      select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 100 then 0 else 1 end as new from rep))
  group by doc_id, run),
piece as (
  select d.doc_id, d.n, d.h, a, b, coalesce(lag(b) over (partition by d.doc_id order by a), 0) as after from d left join cut using (doc_id)),
kept as (
  select doc_id, any_value(n) as n, any_value(h) as h, coalesce(sum(b - a), 0)::bigint as removed, count(a) as spans, coalesce(max(b), 0) as last,
    coalesce(string_agg(substr(h, 2 * after + 1, 2 * (a - after)), '' order by a), '') as head
  from piece group by doc_id)
select doc_id, n as n_bytes, removed as n_removed, spans as n_spans, sha256(unhex(head || substr(h, 2 * last + 1))) as kept_sha256 from kept
"""

#: An exact similarity join on the rarest shingles of each set, then all that is reachable from each document.
_LINKED = """
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
sh as (select distinct doc_id, unnest(case when len(w) < WORDS then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - WORDS + 2), lambda i: array_to_string(w[i:i + WORDS - 1], ' ')) end) as s from w where len(w) > 0),
n as (select doc_id, count(*) as n from sh group by doc_id),
f as (select s, count(*) as c from sh group by s),
r as (
  select doc_id, s, n from (select sh.doc_id, s, n, row_number() over (partition by sh.doc_id order by c, s) as k from sh join f using (s) join n using (doc_id))
  where k <= n - (80 * n + 99) // 100 + 1),
cand as (select distinct x.doc_id as a, y.doc_id as b from r x join r y on x.s = y.s and x.doc_id < y.doc_id where 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)),
both_ as (select a, b, count(*) as k from cand join sh x on x.doc_id = a join sh y on y.doc_id = b and y.s = x.s group by a, b),
link as (select a, b from both_ join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
edge as (select a, b from link union all select b, a from link),
reach as (select doc_id, doc_id as other from documents union select reach.doc_id, edge.b from reach join edge on edge.a = reach.other),
least_ as (select doc_id, min(other) as component_id from reach group by doc_id)
"""

OP9 = _LINKED.replace("WORDS", "2").strip() + """
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, component_id, d.doc_id = component_id as kept from documents d join least_ using (doc_id) left join n using (doc_id)
"""

OP11 = _LINKED.replace("WORDS", "5").strip() + """
, degree as (select a as doc_id, count(*) as k from edge group by a)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, component_id, coalesce(degree.k, 0)::bigint as n_links
from documents d join least_ using (doc_id) left join n using (doc_id) left join degree using (doc_id)
"""

_CAPITALS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _crc(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes, from the table of CRC32."""
    return f"""xor(4294967295::ubigint, list_reduce(list_prepend(4294967295::ubigint,
    list_transform(range(1, strlen({text}) * 2, 2), lambda i: ('0x' || substr(hex({text}), i, 2))::ubigint)),
    lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::bigint])))"""


#: Words that differ by one replaced character leave the same rest without it; by one more or less, the shorter is a rest of the longer.
OP12 = f"""
with recursive {CRC32.strip()},
run as (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_CAPITALS}), '[A-Za-zÀ-ÿ]+')) as r from documents),
kind as (select doc_id, r, count(*) as k from run group by all),
keyed as (select r, k, {_crc("coalesce(doc_id::varchar, '') || ':' || r")} as h from kind, crc_table),
damaged as (select case when h % 199 = 0 then substr(r, 1, (h % length(r))::bigint) || substr(r, (h % length(r))::bigint + 2) else r end as word, k from keyed),
v as (select word, sum(k)::bigint as n from damaged where length(word) >= 6 group by word having sum(k) >= 5),
less as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from v)),
near as (
  select x.word, y.word as other, y.n as other_n from less x join less y on x.i = y.i and x.rest = y.rest and x.word <> y.word
  union select x.word, y.word, y.n from less x join v y on x.rest = y.word
  union select y.word, x.word, x.n from less x join v y on x.rest = y.word),
best as (select word, count(*)::bigint as n_near, max(other_n) as best_n, arg_min(other, (-other_n, other)) as best from near group by word),
formed as (
  select v.word, case when best_n >= 5 * n then best end as form, n, coalesce(n_near, 0)::bigint as n_near, case when best_n >= 5 * n then best_n end as form_n
  from v left join best using (word)),
walk as (select word, word as here, 0 as d from formed union all select walk.word, formed.form, d + 1 from walk join formed on formed.word = walk.here where formed.form is not null),
ending as (select word, arg_max(here, d) as root from walk group by word)
select word, form, root, n, n_near, form_n from formed join ending using (word)
"""

OP13 = f"""
with {CRC32.strip()},
d as (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_CAPITALS}), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) as w from documents),
b as (select unnest(regexp_extract_all(translate(coalesce(text, ''), {_CAPITALS}), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) as w from benchmark),
hashed as (select w, ({_crc("w")} % 10000)::bigint as bucket from (select w from d union select w from b), crc_table),
s as (select bucket, count(*)::double as s from d join hashed using (w) group by bucket),
t as (select bucket, count(*)::double as t from b join hashed using (w) group by bucket),
total as (select (select count(*)::double from d) as s, (select count(*)::double from b) as t),
gain as (
  select s.bucket, floor(1000 * ln(((coalesce(t.t, 0) + 1) * (total.s + 10000)) / ((s.s + 1) * (total.t + 10000))))::bigint as gain
  from s left join t using (bucket), total),
weighed as (select doc_id, count(*)::bigint as n, floor(sum(gain)::double / count(*))::bigint as weight from d join hashed using (w) join gain using (bucket) group by doc_id),
scored as (
  select doc_id, coalesce(n, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id::varchar), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score
  from documents left join weighed using (doc_id)),
ranked as (select doc_id, row_number() over (order by score desc, doc_id)::bigint as rank from scored where n_features >= 20)
select doc_id, n_features, weight, score, case when rank <= (select count(*) * 10 // 100 from ranked) then rank end as rank from scored left join ranked using (doc_id)
"""

_NAMES = "[" + ", ".join(f"'{n}'" for n in WHOLE) + "]"
_NTH = lambda text: f"{_NAMES}[(length({text}) * 7 + ascii({text})) % {len(WHOLE)} + 1]"

#: The nearest licence file above each page, which holds no licence itself.
LICENCE_TREES = f"""
with f as (select page_id, regexp_extract(url, '//([^/]*)', 1) as host, regexp_extract(url, '//[^/]*/([a-z]*)', 1) as folder from pages),
l as (
  select distinct host || '/LICENSE' as path, host as dir, {_NTH("host")} as licence from f
  union select distinct host || '/' || folder || '/COPYING', host || '/' || folder, {_NTH("(folder || host)")} from f where folder <> '' and (length(host) + ascii(folder)) % 3 = 0)
select path, licence, 'file' as how, null as licence_dir from l
union all select host || '/' || folder || '/' || page_id, coalesce(near.licence, top.licence), 'inherited', coalesce(near.dir, top.dir)
from f left join l near on near.dir = host || '/' || folder left join l top on top.dir = host
"""

ORACLES: dict[str, str] = {"op2_sharding": OP2, "op4_suffix_dedup": OP4, "op9_near_duplicates": OP9, "op10_quality_rules": OP10, "op11_jaccard_join": OP11, "op12_spelling_variants": OP12, "op13_resampling": OP13, "licence_trees": LICENCE_TREES}
