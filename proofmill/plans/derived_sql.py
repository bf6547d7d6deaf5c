"""DuckDB SQL for the queries of ``derived``."""

from __future__ import annotations

from . import samples
from .oracles import CAND, NORMAL, PAGES, REQUIRED, SELECTION, VIEW, literal, sentences

_LOGS = literal([s for _, _, s in samples.LOGS])
_BLOCKS = """b as (select regexp_extract(url, '//([^/]*)', 1) as doc_id, page_id as page, regexp_extract(html, 'lang="([a-z]*)"', 1) as lang, substr(regexp_extract(html, '<h1>([^<]*)</h1>', 1), 1, 200) as body, page_id::varchar as number from pages),
      r as (select *, page % 5 = 0 as near, count(*) over (partition by doc_id, lang) > 1 as again from b where doc_id <> '')"""
_FIVE = VIEW.format("text")
_INNER = f"""{PAGES}, v as (select *, {_FIVE} as view from p), q as (select doc_id * 1000 + page as item_id, doc_id, array_to_string(string_split(view, ' ')[2:6], ' ') || case when doc_id % 3 = 0 and page % 2 = 0 then ' zzz' else '' end as quote from v),
      f as (select q.item_id, any_value(q.doc_id) as doc_id, any_value(quote) as quote, min(page) as page, arg_min(instr(view, quote), page) as pos, arg_min(text, page) as text from q join v on v.doc_id = q.doc_id and contains(view, quote) where regexp_matches(quote, '\\S') group by item_id)"""
_CHOICE = lambda values, index: f"({literal(list(values))})[({index} % {len(values)}) + 1]"
_FRONT = [(("1.2", None, True)), ("1.2", None, True), (None, "lines: 2", True), (None, "open quote", True), (None, "quote inside", True), (None, "double quotes", True), (None, "separators: 0", None), (None, "separators: 2", None), (None, "lines: 0", True)]

DERIVED: dict[str, str] = {
    "nfkc_forms": f"select doc_id, md5({_FIVE}) as normal from documents",
    "cjk_sentences": f"select doc_id, (unnest(range(len(s))))::int as ord, unnest(s) as sentence from (select doc_id, {sentences(chr(114) + 'eplace(replace(text, ' + repr('. ') + ', ' + repr('。') + '), ' + repr(', ') + ', ' + repr('.中') + ')')} as s from documents)",
    "dehyphenated": r"select doc_id, md5(regexp_replace(regexp_replace(text, '(\p{L})ing ', '\1-ing ', 'g'), '(\p{L})-[ \t]*\r?\n[ \t]*(\p{L})', '\1\2', 'g')) as joined from documents",
    "edge_exclusions": f"""with {_BLOCKS} select doc_id, page, 0 as span_start, (length(lang) + 1)::int as span_end, lang as line, 'top' as edge from r where again and not near
      union all select doc_id, page, (length(lang) + 1 + length(body))::int, (length(lang) + 2 + length(body) + length(number))::int, number, 'bottom' from r""",
    "mixed_edge_exclusions": f"""with {_BLOCKS}, e as (select *, length(number)::int as n, length(lang)::int as l, length(body)::int as d from r)
      select doc_id, page, 0 as span_start, n + 1 as span_end, number as line, 'bottom' as edge from e where page % 2 = 0 union all select doc_id, page, n + 1, n + l + 2, lang, 'top' from e where page % 2 = 0 and again and not near
      union all select doc_id, page, d, d + l + 1, lang, 'top' from e where page % 2 = 1 and again and not near union all select doc_id, page, d + 1 + l, d + l + n + 2, number, 'bottom' from e where page % 2 = 1""",
    "body_bounds": """with d as (select doc_id, length(text)::int as n, length(string_split(text, chr(10))[1])::int as a, (length(text) - length(string_split(text, chr(10))[-1]))::int as b from documents where len(string_split(text, chr(10))) > 2),
      e as (select *, case when doc_id % 4 = 0 and n // 2 >= a and n // 2 + 1 <= b then 'non-outer edge' end as error from d) select doc_id, case when error is null then a end as body_start, case when error is null then b end as body_end, error from e""",
    "resolved_pages": f"""with {REQUIRED}, d as (select distinct doc_id from p), u as (select doc_id, page from p where role <> 'user'),
      l as (select doc_id, string_agg(page::varchar, ',' order by page) as t from req where page % 4 <> 1 and (doc_id, page) not in (select (doc_id, page) from u) group by doc_id),
      k as (select doc_id, string_agg(page::varchar, ',' order by page) as t from (select doc_id, page from req where page % 4 = 1 union select doc_id, page from req semi join u using (doc_id, page) where page % 4 <> 1) group by doc_id)
      select doc_id, coalesce(l.t, '') as required_now, coalesce(k.t, '') as resolved_now from d left join l using (doc_id) left join k using (doc_id)""",
    "cache_update": f"""with {PAGES}, o as (select doc_id, 'c' || doc_id as path, case when doc_id % 7 = 3 then 'old' else 'same' end as sha, page, text from p),
      n as (select doc_id, 'c' || doc_id as path, case when doc_id % 7 = 0 and page % 4 = 0 then 'other' else 'same' end as sha, page, 'new ' || text as text from p where page % 2 = 0),
      w as (select path, min(sha) as sha, count(distinct sha) as c from n group by path),
      kept as (select o.* from o left join w on w.path = o.path where w.path is null or c > 1 or w.sha = o.sha)
      select path, sha as pdf_sha256, page, md5(text) as text, null as error from kept where (path, sha, page) not in (select (n.path, n.sha, n.page) from n join w on w.path = n.path where c = 1)
      union all select n.path, n.sha, page, md5(text), case when c > 1 then 'several fingerprints' end from n join w on w.path = n.path""",
    "toc_entries": f"with {PAGES}, e as (select *, (row_number() over (partition by doc_id order by page) - 1)::int as ord from p where doc_id % 9 <> 0) select doc_id::varchar as path, ord, 1 as level, role as title, page::int as page from e where page % 2 = 0",
    "page_cache_rows": f"with {PAGES} select doc_id::varchar as path, 'sha' || doc_id as pdf_sha256, page::int as page, md5(text) as text from p where doc_id % 5 <> 0 and doc_id % 7 <> 0",
    "foreign_digests": "select doc_id, case when doc_id % 3 = 1 and text <> '' then 'foreign digest' end as error from documents",
    "draft_fields": """select event_id, case event_id % 9 when 1 then 'approach: null | unknown: invented' when 2 then 'approach: null | paper.year: string' when 3 then 'approach: null | missing: confidence' when 4 then 'approach: null | unknown: paper.pages'
      when 5 then 'approach: null | paper.authors[]: number' when 6 then 'not an object' when 7 then 'approach: null | findings: string | paper: array' when 8 then 'not an object' else 'approach: null' end as errors from events""",
    "abstract_sources": "select doc_id, case when lang = 'en' and doc_id % 3 = 2 then 'source beyond the abstract' end as error from documents",
    "canonical_quotes": f"""with {CAND}, n as (select *, {NORMAL} as v, sha256({NORMAL}) as own from cand), c as (select doc_id, page, v, min_by(quote, ord) as quote, min_by(own, ord) as id from n group by all)
      select n.doc_id, n.page as start_page, n.ord, case when n.page % 3 > 0 then md5(c.quote) else md5(regexp_replace(c.quote, ' ', chr(10), 'g')) end as quote, case when n.page % 3 > 0 then c.id else 'late' end as id from n join c using (doc_id, page, v)""",
    "span_places": f"""with {_INNER}, d as (select *, substr(text, 1, (pos - 1)::bigint) as before, substr(text, 1, (pos - 1 + length(quote))::bigint) as upto from f)
      select item_id, doc_id, page as start_page, (pos - 1 + length(before) - length(replace(before, chr(10), '')))::int as start_offset, page as end_page, (pos - 1 + length(quote) + length(upto) - length(replace(upto, chr(10), '')))::int as end_offset from d""",
    "proved_items": f"""with {_INNER} select q.item_id, f.page, f.page as end_page, case when f.page is null then 'Section 5（p.9）' else 'Section 5' end as source,
      case when len({sentences('q.quote')}) > 2 then 'sentences' when f.page is null then 'not in source' end as error from q left join f using (item_id)""",
    "span_places_over_edges": rf"""with {PAGES}, n as (select *, lead(page) over w as next_page, lead(text) over w as nt from p window w as (partition by doc_id order by page))
      select doc_id * 1000 + page as item_id, doc_id, page as start_page, (25 + length(text) - length(regexp_extract(text, '(?:\S+\s+){{0,11}}\S+\s*$')))::int as start_offset, next_page as end_page, (25 + length(regexp_extract(nt, '^\s*(?:\S+\s+){{0,11}}\S+')))::int as end_offset
      from n where next_page = page + 1""",
    "source_labels": """select doc_id, source || case when doc_id % 3 = 2 then ' p.3 of it' else '' end || case when doc_id % 2 = 1 then '（p.' || (doc_id % 5) || '–' || (doc_id % 5 + 1) || '）' else '' end as label from documents""",
    "normalized_inputs": """with e as (select *, case doc_id % 9 when 1 then 'path must be absolute' when 2 then 'kind' when 3 then 'abstract' when 4 then 'unreadable' when 5 then 'not an object' when 6 then 'schema' when 7 then 'level' when 8 then 'abstract'
        else case when trim(text, ' ') = '' then 'abstract' end end as error from documents)
      select case when doc_id % 9 = 1 then 'docs/' else '/docs/' end || doc_id || '.json' as path, error, case when error is null then false end as leaks, case when error is null then md5(text) end as abstract from e""",
    "text_papers": """select doc_id, case when doc_id % 3 <> 0 then source end as title, case when doc_id % 3 <> 0 and doc_id % 5 <> 0 then (2000 + doc_id % 20)::int end as year, null::varchar as venue, md5(text) as body from documents""",
    "prepared_kinds": f"with {PAGES} select doc_id, doc_id % 4 = 2 as literal, case doc_id % 4 when 2 then 0 when 3 then null else count(*) end::int as items from p group by doc_id",
    "topology_gates": f"select c_custkey::varchar as run_id, {_LOGS}[(c_custkey % {len(samples.LOGS)}) + 1] as producer_status from customer",
    "topology_reasons": f"select s_suppkey::varchar as run_id, {_CHOICE([r for _, r in samples.REASONS], 's_suppkey')} as reasons from supplier",
    "contract_gates": f"select s_suppkey::varchar as run_id, {_CHOICE([s for *_, s in samples.CONTRACTS], 's_suppkey')} as producer_status, case when {_CHOICE([s for *_, s in samples.CONTRACTS], 's_suppkey')} = 'PASS' then 0 else 3 end as exit_code from supplier",
    "json_kinds": f"select event_id, {_CHOICE(('NUMBER', 'NULL', 'MISSING', 'STRING', 'BOOLEAN', 'ARRAY', 'OBJECT', 'MISSING', 'MISSING'), 'event_id')} as kind from events",
    "frontmatter": f"select doc_id, {_CHOICE([v for v, _, _ in _FRONT], 'doc_id')} as version, {_CHOICE([e for _, e, _ in _FRONT], 'doc_id')} as error, {_CHOICE([j for *_, j in _FRONT], 'doc_id')} as joined from documents",
    "install_purity": r"""with f as (select distinct * from (select regexp_extract(url, '//([^/]*)', 1) as tree, regexp_extract(url, '//[^/]*/([^?#]*)', 1) || case page_id % 7 when 0 then '/tests/x.py' when 1 then '/test_run.py' when 2 then '/conftest.py' when 3 then '/latest/test_notes.md' else '' end as path from pages
        union all select regexp_extract(url, '//([^/]*)', 1), case when page_id % 2 = 0 then 'GUIDE.md' else 'notes.md' end from pages))
      select tree, path, 'must not be there' as error from f where list_contains(string_split(path, '/'), 'tests') or regexp_matches(string_split(path, '/')[-1], '^test_.*\.py$') or string_split(path, '/')[-1] = 'conftest.py'
      union all select tree, 'GUIDE.md', 'missing' from f group by tree having not bool_or(path = 'GUIDE.md') union all select tree, 'en/', 'missing' from f group by tree having not bool_or(starts_with(path, 'en/'))""",
    "revalidation": """with d as (select distinct l_suppkey as k, l_partkey % 2 = 1 as run from lineitem where l_partkey % 97 = 0 and l_partkey in (select p_partkey from part)), h as (select k, bool_or(run) as run from d group by k)
      select s_suppkey as case_id, case when coalesce(run, false) or s_suppkey % 5 = 0 then 'EXECUTE_CURRENT' when k is not null then 'REJUDGE_PRIOR_EVIDENCE' else 'REUSE_PRIOR_PASS' end as decision from supplier left join h on k = s_suppkey""",
    "outer_states": "select doc_id, case when doc_id % 4 = 0 or quality <> 1 then 'CASE_NOT_STARTED' when toxic = 1 then 'BLOCKED' else 'PASS' end as status from labels",
    "retry_verdicts": """with recursive a as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as i, case event_id % 11 when 0 then 'PASS' when 1 then 'FAIL_PRODUCER' when 2 then 'INVALID_TEST_EXECUTION' when 3 then 'NOT_TESTED' else 'BLOCKED' end as status,
        event_id % 13 > 0 as transport, event_type = 'error' as bad, case when event_id % 17 = 0 then 'other' else 'frozen' end as inputs from events),
      fold as (select user_id, 0::bigint as i, null::varchar as frozen, null::varchar as status, 0 as tries, false as done, 0::bigint as used, 0::bigint as ignored from a group by user_id
        union all select a.user_id, a.i, case when bad then frozen else coalesce(frozen, inputs) end, case when done or bad or inputs <> coalesce(frozen, inputs) then f.status else a.status end,
          case when not done and not bad and inputs = coalesce(frozen, inputs) and a.status = 'BLOCKED' and transport then tries + 1 else tries end,
          done or (not bad and inputs = coalesce(frozen, inputs) and (a.status <> 'BLOCKED' or not transport or tries >= 3)),
          used + (not done and not bad and inputs = coalesce(frozen, inputs))::int, ignored + (done or bad or inputs <> coalesce(frozen, inputs))::int
        from fold f join a on a.user_id = f.user_id and a.i = f.i + 1)
      select user_id, coalesce(arg_max(status, i), 'CASE_NOT_STARTED') as status, case when bool_or(done) then 'STOP' when max(used) > 0 then 'RETRY' else 'START' end as decision, max(used)::bigint as used, max(ignored)::bigint as ignored from fold group by user_id""",
    "stored_program": """with s as (select page_id, page_id % 3 as k, html, (length(html) - length(replace(html, '<title>', ''))) // 7 as n, replace(replace(html, '<title>', '<h1>'), 'href=', 'src=') as two from pages),
      e as (select *, case k when 0 then case when n <> 1 then 'step 1: expected once, found ' || n when not contains(two, 'href=') and not contains(two, '<nav>') then 'step 3: missing' when contains(two, 'track(1)') then 'step 4: left over' end
        when 1 then case when not contains(html, '<table>') then 'step 1: missing' end else 'no program none' end as error from s)
      select page_id, case when error is null then md5(case k when 0 then two else replace(html, '<b>', '') end) end as result, error from e""",
    "marked_round_trip": "select conv_id as doc_id, turn::int as page, md5(text) as text from conversations",
    "streamed_replacements": f"with {SELECTION} select doc_id, page, md5('v2 ' || text) as text from sel join p using (doc_id, page) where role <> 'user'",
    "published_batches": "select doc_id, md5(text) as digest, quality, toxic from documents left join (select * from labels where quality = 1) using (doc_id)",
}
