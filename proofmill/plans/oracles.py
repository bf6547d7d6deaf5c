"""DuckDB SQL for the registered queries. Where SQL lacks the function, the expected rows are given by hand."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from ..operators.evidence import FACT_FIELDS
from . import samples


def literal(x: object) -> str:
    if x is None:
        return "null"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, (int, float)):
        return str(x)
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(literal, x)) + "]"
    return " || ".join(f"chr({ord(c)})" if c in "\n\r" else "'" + c.replace("'", "''") + "'" for c in _pieces(str(x))) or "''"


def _pieces(text: str) -> Iterable[str]:
    held = ""
    for c in text:
        if c in "\n\r":
            if held:
                yield held
            yield c
            held = ""
        else:
            held += c
    if held:
        yield held


def values(rows: Sequence[Sequence[object]], columns: str) -> str:
    """A query that gives ``rows`` under "name type, ..."."""
    names = [c.strip().split(" ", 1) for c in columns.split(",")]
    return "select " + ", ".join(f"{n}::{t} as {n}" for n, t in names) + " from (values " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") v({', '.join(n for n, _ in names)})"


VIEW = r"trim(regexp_replace(regexp_replace({0}, '\s+', ' ', 'g'), '^ | $', '', 'g'))"
BENCH = f"q as (select item_id, {VIEW.format('text')} as quote from benchmark), d as (select doc_id, {VIEW.format('text')} as view from documents)"
PAIRS = f"{BENCH}, pairs as (select item_id, doc_id, instr(view, quote) - 1 as pos from q join d on contains(view, quote))"


def sentences(text: str) -> str:
    steps = [(r"'i\.e\.'", "'i' || chr(2) || 'e' || chr(2)"), (r"'e\.g\.'", "'e' || chr(2) || 'g' || chr(2)"), (r"'\n\s*\n'", "chr(1)"), (r"'([.!?])\s+'", r"'\1' || chr(1)"), (r"'([.!?])([\p{Han}\p{Hiragana}\p{Katakana}])'", r"'\1' || chr(1) || '\2'"), (r"'([。！？])\s*'", r"'\1' || chr(1)")]
    for old, new in steps:
        text = f"regexp_replace({text}, {old}, {new}, 'g')"
    return f"list_filter(list_transform(string_split({text}, chr(1)), lambda s: trim(replace(s, chr(2), '.'), ' ' || chr(9) || chr(10) || chr(13))), lambda s: s <> '')"


def listed(source: str, keys: str) -> str:
    return f"select {keys}, (unnest(range(len(s))))::int as ord, unnest(s) as quote from (select {keys}, {sentences('text')} as s from {source})"


PAGES = "p as (select conv_id as doc_id, turn as page, role, text from conversations)"
QUALITY = "ql as (select p.doc_id, p.page, case when quality = 0 then 'untrusted' else 'ok' end as tier from labels join p on p.doc_id = labels.doc_id)"
SELECTION = f"""{PAGES}, sel as (select distinct doc_id, page from (select *, max(page) over (partition by doc_id) as e from p)
  where page = 0 or page > e - 2 or contains(lower(text), 'tion the') or contains(lower(text), 'license'))"""
REQUIRED = f"{SELECTION}, {QUALITY}, req as (select doc_id, page from ql semi join sel using (doc_id, page) where tier = 'untrusted')"
BAD = f"{REQUIRED}, bad as (select distinct doc_id, page from (select doc_id, page from ql where tier = 'untrusted' union all select * from req))"
MERGED = f"{BAD}, merged as (select doc_id, page, case when ok then 'ocr ' || replace(text, 'e', '3') else text end as text, ok as resolved from (select p.*, b.doc_id is not null and p.role <> 'user' as ok from p left join bad b using (doc_id, page)))"
NORMAL = VIEW.format("quote")
CAND = f"{PAGES}, cand as ({listed('p', 'doc_id, page')})"
ITEMS = f"""{CAND}, it as (select (doc_id * 1000 + page) * 1000 + ord as item_id, ord, doc_id,
    case doc_id % 5 when 1 then left(quote, length(quote) - 1) when 4 then repeat(quote, 400) else quote end as quote,
    case when doc_id % 5 = 2 then page + 1000 else page end as page, case when doc_id % 5 = 3 then repeat('0', 64) else sha256({NORMAL}) end as id from cand)"""
CHECKED = f"""{ITEMS}, ck as (select it.*, sha256({NORMAL.replace('quote', 'it.quote')}) as quote_id, case when length(it.quote) > 2000 then 'exceeds'
    when not exists (select 1 from cand c where c.doc_id = it.doc_id and c.quote = it.quote) then 'prepared candidate'
    when not exists (select 1 from cand c where c.doc_id = it.doc_id and c.quote = it.quote and c.page = it.page) then 'quote and page'
    when it.id <> sha256({NORMAL.replace('quote', 'it.quote')}) then 'does not match' end as error from it)"""
DOC_CAND = f"dc as ({listed('documents', 'doc_id')})"


def found(text: str, markers: Sequence[str], present: bool) -> str:
    return f"array_to_string(list_filter({literal(list(markers))}, lambda m: {'' if present else 'not '}contains({text}, m)), '|')"


def once(text: str, old: str, new: str) -> tuple[str, str]:
    n = f"((length({text}) - length(replace({text}, '{old}', ''))) // {len(old)})"
    return f"case when {n} = 1 then replace({text}, '{old}', '{new}') end", f"case when {n} <> 1 then 'expected once, found ' || {n} end"


_TITLE = once("html", "<title>", "<h1>")
_STEP2 = once("s1", "</title>", "</h1>")
_STEP4 = once("s3", "</nav>", "")
_SPLIT_CJK = [["将来の課題である。", "次に進む。"], ["We stop here.", "次の文である.", "さらに続く。"], ["We use it, i.e. the first.", "Then the second."], ["One line", "another line.", "End"], ["本当！", "そうですか？", "はい"], []]

ORACLES: dict[str, str] = {
    "locate_first": f"with {PAIRS} select item_id, min(doc_id) as doc_id, arg_min(pos, doc_id)::int as view_offset from pairs group by item_id",
    "locate_anchored": f"with {PAIRS} select item_id, doc_id from pairs",
    "unmatched_quotes": f"with {PAIRS} select item_id from benchmark where item_id not in (select item_id from pairs)",
    "quality_gated_locate": f"with {PAIRS} select item_id, doc_id from pairs where doc_id not in (select doc_id from labels where quality = 0)",
    "sentence_candidates": f"with {DOC_CAND} select *, sha256({NORMAL}) as id from dc",
    "quote_ids": f"select item_id, sha256({VIEW.format('text')}) as id from benchmark",
    "source_fingerprints": "select doc_id, 'sha256:' || sha256(text) as fingerprint from documents",
    "repeated_edge_lines": "select edge, line, count(distinct doc_id) as pages from (select doc_id, 'top' as edge, string_split(text, chr(10))[1] as line from documents union all select doc_id, 'bottom', string_split(text, chr(10))[-1] from documents) group by all having count(distinct doc_id) >= 2",
    "adjacent_pages": f"with {PAGES} select * from (select doc_id, page, lead(page) over (partition by doc_id order by page) as next_page from p) where next_page = page + 1",
    "stitched_locate": f"""with {PAGES}, h as (select doc_id, page, case when page % 3 = 1 then 'rupted ' else '' end || text || case when page % 3 = 0 then ' inter-' else '' end as t from p),
      n as (select *, lead(page) over w as next_page, lead(t) over w as nt from h window w as (partition by doc_id order by page))
      select doc_id * 1000 + page as item_id, doc_id, page as start_page, (length(t) - length(regexp_extract(t, '(?:\\S+\\s+){{0,11}}\\S+\\s*$')))::int as start_offset, next_page as end_page, length(regexp_extract(nt, '^\\s*(?:\\S+\\s+){{0,11}}\\S+'))::int as end_offset
      from n where next_page = page + 1""",
    "page_selection": f"with {SELECTION} select * from sel",
    "ocr_required": f"with {REQUIRED} select * from req",
    "ocr_merge": f"with {MERGED} select * from merged",
    "ocr_unsupplied": f"with {REQUIRED} select * from req where (doc_id, page) not in (select (doc_id, page) from p where role <> 'user')",
    "refreshed_candidates": f"with {MERGED} {listed('merged', 'doc_id, page')}",
    "prepare_summary": f"with {CAND} select doc_id, count(*) as candidate_count, string_agg(distinct page::varchar, ',' order by page::varchar) as candidate_pages from (select *, page from cand) group by doc_id",
    "unlabelled_documents": "select doc_id from documents anti join labels using (doc_id)",
    "item_error_codes": f"with {CHECKED} select item_id, error from ck",
    "duplicate_ids": f"with {DOC_CAND} select doc_id, sha256({NORMAL}) as id, count(*) as n from dc group by all having count(*) > 1",
    "sentence_cap": f"select item_id, case when len({sentences('text')}) > 2 then 'sentences' end as error from benchmark",
    "facts_join": f"""with {DOC_CAND}, ids as (select doc_id, string_agg(sha256({NORMAL}), ',' order by ord) as ids from dc group by doc_id),
      s as (select doc_id, doc_id % 7 as k, quality, 'sha256:' || sha256(text) as fp, ids from labels join documents using (doc_id) left join ids using (doc_id)),
      j as (select d.doc_id as analysis, case when s.doc_id is null then 'no sidecar' when quality = 0 then 'status' when k = 1 then 'evidence level' when k in (2, 3) then 'fingerprint' end as error, ids from documents d left join s using (doc_id))
      select analysis, error, case when error is null then ids end as future_work_ids from j""",
    "sidecar_files": f"with {CHECKED} select doc_id || '.future_work.json' as path, count(*)::int as items from ck where doc_id not in (select doc_id from ck where error is not null) group by doc_id",
    "cache_states": "select doc_id::varchar as path, case when doc_id not in (select doc_id from labels) then 'no source' when doc_id % 3 = 0 then 'metadata is missing' when doc_id % 3 = 1 then 'stale' end as error from documents",
    "fulltext_cache_stamps": """with s as (select d.doc_id::varchar as path, d.text, sha256(d.text) as sha, l.doc_id is not null as known from documents d left join (select distinct doc_id from labels) l using (doc_id))
      select path, case when known then md5(text) end as text, case when known then path || '.meta.json' end as metadata_path, case when known then '{"schema":1,"pdf_sha256":"' || sha || '"}' end as metadata, case when not known then 'no source' end as error from s""",
    "fulltext_cache_copies": """with s as (select d.doc_id::varchar as path, d.text, sha256(d.text) as sha, case when l.doc_id is null then 'no source' when d.doc_id % 5 in (0, 1, 3) then 'metadata is missing' when d.doc_id % 5 = 2 then 'stale' end as error
        from documents d left join (select distinct doc_id from labels) l using (doc_id))
      select path, case when error is null then md5(text) end as text, case when error is null then sha end as pdf_sha256, error from s""",
    "prepared_documents": f"""with {CAND}, {QUALITY}, sel as (select distinct doc_id, page from (select *, max(page) over (partition by doc_id) as e from p) where role = 'system' or page > e - 2 or contains(lower(text), 'tion the'))
      select doc_id, max(case when page = 0 then sha256(text) end) as pdf_sha256, (2 * count(*) filter (where role = 'system'))::int as toc_entries,
        (select count(*)::int from ql where ql.doc_id = p.doc_id) as tiers, (select coalesce(string_agg(page::varchar, ',' order by page), '') from sel where sel.doc_id = p.doc_id) as selected,
        coalesce(string_agg(page::varchar, ',' order by page) filter (where role = 'system'), '') as toc_pages, (select count(*)::int from cand where cand.doc_id = p.doc_id) as candidates,
        (select md5(coalesce(string_agg(sha256({NORMAL}), ',' order by page, ord), '')) from cand where cand.doc_id = p.doc_id) as ids, count(*)::int as pages,
        (select coalesce(string_agg(page::varchar, ',' order by page), '') from ql semi join sel using (doc_id, page) where ql.doc_id = p.doc_id and tier = 'untrusted') as required
      from p group by doc_id""",
    "quality_reports": f"""with {PAGES}, s as (select doc_id, regexp_matches(coalesce(text, ''), '\\p{{L}}') as lettered, length(regexp_replace(text, '[^\\p{{L}}\\s]', '', 'g')) / length(text) as share from p), t as (select doc_id, case when lettered then share else 0 end as score, lettered from s)
      select doc_id, count(*) as pages, count(*) filter (where lettered and score >= 0.97) as ok, count(*) filter (where lettered and score < 0.97) as untrusted, count(*) filter (where not lettered) as empty, round(min(score), 9) as least_score, 0.97::double as threshold from t group by doc_id""",
    "json_file_errors": "select event_id, case when event_id % 7 = 0 then 'unreadable JSON' end as error from events",
    "markdown_items": f"with {PAGES} select doc_id, (row_number() over (partition by doc_id order by page) - 1)::int as ord, trim(string_split(text, chr(10))[1]) as quote, 'x' as translation_zh, 'Turn' as source, page::int as page from p",
    "marked_pages": "select conv_id as doc_id, string_agg('<!-- PDF_PAGE: ' || (turn + 1) || ' -->' || chr(10) || text, chr(10) order by turn) as text from conversations group by conv_id",
    "page_tiers": r"select conv_id as doc_id, turn as page, case when not regexp_matches(text, '\p{L}') then 'empty' when length(regexp_replace(text, '[^\p{L}\s]', '', 'g')) * 2 < length(text) then 'untrusted' else 'ok' end as tier from conversations",
    "edge_dedup": "select distinct l_suppkey as sender, l_partkey as receiver from lineitem",
    "child_counts": "select n_regionkey as sender, count(distinct n_nationkey) as children from nation group by 1",
    "edge_total": "select count(*) as relations from (select distinct l_suppkey, l_partkey from lineitem)",
    "ownership_conflicts": "select l_partkey as receiver, count(distinct l_suppkey) as senders from lineitem group by 1 having count(distinct l_suppkey) > 1",
    "topology_verdicts": """with c as (select c_custkey, count(o_orderkey)::int as n from customer left join orders on o_custkey = c_custkey group by 1)
      select c_custkey::varchar as run_id, case n when 3 then 'PASS' when 0 then 'NOT_TESTED' else 'FAIL_PRODUCER' end as producer_status, n as nested_direct_child_count, n + 1 as formal_spawn_relation_count,
      case n when 3 then 0 when 0 then 4 else 1 end as exit_code from c
      union all select 'e' || event_id, case when event_id % 12 in (8, 9) then 'BLOCKED' else 'INVALID_TEST_EXECUTION' end, 0, 0, case when event_id % 12 in (8, 9) then 2 else 3 end from events""",
    "json_paths": "select try_cast(props->>'k' as bigint) as k, count(*) as n from events group by 1",
    "marker_gate": f"select *, missing = '' and unwanted = '' as passed from (select page_id, {found('html', ['<title>', '</html>', '<nav>', 'href='], False)} as missing, {found('html', ['%%%', 'track(1)'], True)} as unwanted from pages)",
    "missing_markers": "select page_id, marker from pages, (values ('<table>'), ('<nav>'), ('utm_source'), ('</p>')) m(marker) where not contains(html, marker)",
    "short_quotes": f"with b as ({listed('benchmark', 'item_id')}), q as (select distinct {NORMAL} as short from b where len(regexp_split_to_array(quote, '\\s+')) < 10), d as (select doc_id, {VIEW.format('text')} as view from documents) select short, count(*) as documents, min(doc_id) as first_doc from q join d on contains(view, short) group by short",
    "word_markers": "with m as (select distinct unnest(regexp_extract_all(text, '[A-Za-z]{8,}')) as marker from conversations) select marker, count(*) as documents from m join documents on contains(text, marker) group by marker",
    "ordered_markers": "select page_id, instr(html, '<nav>') > 0 and instr(html, '</nav>') > instr(html, '<nav>') as nav, instr(html, '</body>') > 0 and instr(html, '<body>') > instr(html, '</body>') as reversed from pages",
    "mutation_gate": "select doc_id, marker, length(mutant)::int as left, not contains(mutant, marker) as caught from (select doc_id, marker, array_to_string(list_filter(string_split(text, chr(10)), lambda x: not contains(x, marker)), chr(10)) as mutant from documents, (values ('License'), ('under the')) m(marker))".replace("as left", 'as "left"'),
    "replace_once": f"select page_id, md5({once('html', '<body>', '<main>')[0]}) as done, {once('html', '<body>', '<main>')[1]} as error, md5({once('html', '<li>', '<dd>')[0]}) as done_li, {once('html', '<li>', '<dd>')[1]} as error_li from pages",
    "rewrite_program": f"""with a as (select page_id, coalesce({_TITLE[0]}, html) as s1, {_TITLE[1]} as e1 from pages), b as (select page_id, coalesce({_STEP2[0]}, s1) as s2, e1, {_STEP2[1]} as e2 from a),
      c as (select page_id, replace(s2, '<a href=', '<A HREF=') as s3, e1, e2 from b), d as (select page_id, {_STEP4[0]} as s4, coalesce('step 1: ' || e1, 'step 2: ' || e2, 'step 4: ' || {_STEP4[1]}) as error from c)
      select page_id, case when error is null then md5(s4) end as result, error from d""",
    "patch_section": """select page_id, md5(case when b > 0 then (case when a > 0 and a < b then left(m, a) else left(m, b) end) || '<nav>' || chr(10) || 'page ' || page_id || chr(10) || substr(m, b + 1) end) as patched,
      case when not (a > 0 and b > a and len(string_split(html, '<nav>')) = 2 and len(string_split(html, '</nav>')) = 2) then 'anchors' end as error from (select *, instr(m, chr(10) || '<nav>' || chr(10)) as a, instr(m, chr(10) || '</nav>' || chr(10)) as b from (select *, replace(replace(html, '<nav>', chr(10) || '<nav>' || chr(10)), '</nav>', chr(10) || '</nav>' || chr(10)) as m from pages))""",
    "html_title_and_text": r"select page_id, regexp_extract(html, '<title>((?s:.*?))</title>', 1) as title, md5(ltrim(regexp_replace(regexp_replace(html, '<script>[^\n]*?</script>|<style>[^\n]*?</style>', '', 'g'), '<[^>]*>', ' ', 'g'), ' ' || chr(9) || chr(10))) as body from pages",
    "artifact_paths": "select doc_id, '/out/' || doc_id || '.md.future_work.json' as sidecar, '/out/' || doc_id || '.md.facts.json' as facts, '/out/' || doc_id || '.md.meta.json' as metadata, case when not starts_with(source, '/') then 'path must be absolute' end as error from documents",
    "finalized_analyses": f"""with {CHECKED}, g as (select doc_id, min_by(error, item_id) filter (where error is not null) as bad, count(distinct quote_id) < count(*) as twice, count(*)::int as n,
        string_agg('- 原文：' || quote || chr(10) || '  译：' || chr(10) || '  出处：§', chr(10) order by item_id) as bullets from ck group by doc_id),
      e as (select d.doc_id, coalesce(bad, case when twice then 'duplicate id' end) as error, coalesce(n, 0) as n, coalesce(bullets, '') as bullets from (select distinct doc_id from p) d left join g using (doc_id))
      select doc_id as analysis, case when error is null then md5('# ' || doc_id || chr(10) || '## Next' || chr(10) || bullets || chr(10) || '## Notes' || chr(10) || 'kept' || chr(10)) end as markdown, case when error is null then n end as items, error from e""",
    "upgraded_analyses": f"""with {PAGES}, w as (select doc_id, page, array_to_string(list_filter(regexp_split_to_array(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: true)[1:5], ' ') || case when doc_id % 3 = 0 and page = 0 then ' zzz' else '' end as quote from p),
      c as (select *, case when len({sentences('quote')}) > 2 then 'sentences' when doc_id % 3 = 0 and page = 0 then 'not in source' end as error, sha256({NORMAL}) as id from w),
      g as (select doc_id, min_by(error, page) filter (where error is not null) as bad, count(distinct id) < count(*) as twice, count(*)::int as n, string_agg(page::varchar, ',' order by page) as starts,
        string_agg('- 原文：' || quote || chr(10) || '  译：x' || chr(10) || '  出处：Turn', chr(10) order by page) as bullets from c group by doc_id),
      e as (select *, coalesce(bad, case when twice then 'duplicate id' end) as error, '- 原文：elsewhere' || chr(10) || '  译：x' || chr(10) || '  出处：y' || chr(10) as other from g)
      select doc_id::varchar as analysis, case when error is null then n end as items, case when error is null then starts end as starts,
        case when error is null then md5('# T' || chr(10) || '## Before' || chr(10) || other || '## Next' || chr(10) || bullets || chr(10) || '## Notes' || chr(10) || other) end as markdown, error from e""",
    "validated_caches": """with s as (select conv_id::varchar as path, l.quality, l.toxic, case when l.doc_id is null then 'no source' when quality = 0 then 'stale' when toxic = 1 then 'missing pages' end as error from (select distinct conv_id from conversations) left join labels l on l.doc_id = conv_id)
      select path, turn as page, md5(text) as text, error from s join conversations on conv_id::varchar = path where error is null union all select path, null, null, error from s where error is not null""",
    "candidates_markdown": f"""with {CAND}, b as (select doc_id, page, '<!-- PDF_PAGE: ' || page || ' -->' || chr(10) || string_agg('- ' || quote, chr(10) order by ord) as t from cand group by doc_id, page)
      select doc_id, md5(string_agg(t, chr(10) || chr(10) order by page)) as markdown from b group by doc_id""",
}
ORACLES["finished_facts"] = f"""with f as ({ORACLES['facts_join']}),
      r as (select f.analysis, case when n_chars < 300 then 'not an object' when doc_id % 11 = 5 then 'no input' else error end as error, future_work_ids as ids, 'sha256:' || sha256(text) as print from f join documents on doc_id = f.analysis)
      select analysis, case when error is null then analysis || '.facts.json' end as path, case when error is null then '{{"schema":1,"kind":"analysis-facts","generator_version":"facts-v1","analysis":' || analysis || ',"evidence_level":"fulltext","input_fingerprint":"' || print
        || '","status":"ok","future_work_ids":[' || case when ids = '' then '' else '"' || replace(ids, ',', '","') || '"' end || '],"facts":{{' || (select string_agg('"' || k || '":"x"', ',' order by k) from (values {', '.join(f"('{k}')" for k in FACT_FIELDS)}) v(k)) || '}}}}' end as json,
        case when error is null then print end as input_fingerprint, error from r"""

from .derived_sql import DERIVED  # noqa: E402

ORACLES |= DERIVED
