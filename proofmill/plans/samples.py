"""Inline rows for behaviour that the tables do not show."""

import json

NFKC = [(1, "ﬁnal  oﬃce"), (2, "Ｆｕｌｌ　ｗｉｄｔｈ"), (3, "ﾊﾟﾘ"), (4, " plain \n text "), (5, "x² ① Å"), (6, "")]
NFKC_FORMS = ["final office", "Full width", "パリ", "plain text", "x2 1 Å", ""]
CJK = [
    (1, "将来の課題である。次に進む。"), (2, "We stop here.次の文である.さらに続く。"), (3, "We use it, i.e. the first. Then the second."),
    (4, "One line\n\nanother line. End"), (5, "本当！そうですか？はい"), (6, ""),
]
HYPHENS = [(1, "conti-\nnent"), (2, "long- lasting"), (3, "in- line"), (4, "a-\r\n  b"), (5, "1-\n2"), (6, "end-"), (7, "é-\nè")]
BLOCK_SCHEMA = "doc_id int, page int, ord int, edge string, top double, bottom double, line_height double, start int, end int, text string"
#: Running header on pages 1 and 2, page numbers, a header too near to the body, one that is no outer block, one that does not repeat.
BLOCKS = [
    (1, 1, 0, "top", 0.02, 0.04, 0.02, 0, 6, "HEADER"), (1, 1, 1, None, 0.1, 0.8, 0.02, 8, 20, "body one"), (1, 1, 2, "bottom", 0.95, 0.97, 0.02, 22, 23, "1"),
    (1, 2, 0, "top", 0.02, 0.04, 0.02, 0, 6, "HEADER"), (1, 2, 1, None, 0.1, 0.8, 0.02, 7, 20, "body two"), (1, 2, 2, "bottom", 0.95, 0.97, 0.02, 21, 26, "notes"),
    (1, 3, 0, "top", 0.02, 0.04, 0.02, 0, 6, "HEADER"), (1, 3, 1, None, 0.05, 0.8, 0.02, 7, 20, "body three"),
    (1, 4, 0, None, 0.0, 0.01, 0.01, 0, 3, "pre"), (1, 4, 1, "top", 0.02, 0.04, 0.02, 4, 10, "HEADER"), (1, 4, 2, None, 0.1, 0.8, 0.02, 12, 20, "body"),
]
#: (page, blocks in extraction order) for both orders of mixed edges before and after the body, stacked headers, one too near to the body, one inside it.
_MIXED = [
    (1, "ntb"), (2, "tnb"), (3, "btn"), (4, "bnt"), (5, "tsb"), (6, "tcb"), (7, "btb"), (8, "tn"),
]
_SHAPES = {"n": ("bottom", 0.95, 0.97, "7"), "t": ("top", 0.02, 0.03, "Title"), "s": ("top", 0.035, 0.045, "Section"), "c": ("top", 0.035, 0.07, "controls"), "b": (None, 0.1, 0.8, "body")}
MIXED_BLOCKS = [(d, p, k, _SHAPES[x][0], *_SHAPES[x][1:3], 0.02, 10 * k, 10 * k + 8, _SHAPES[x][3]) for d in (1,) for p, shape in _MIXED for k, x in enumerate(shape)]
MIXED_BLOCKS += [(1, 9, 0, *_SHAPES["s"][:3], 0.02, 0, 8, "Section"), (1, 9, 1, *_SHAPES["b"][:3], 0.02, 10, 18, "body")]
#: By hand: page, start, end, text, edge.
MIXED_SPANS = [
    (1, 0, 10, "7", "bottom"), (1, 10, 20, "Title", "top"), (2, 0, 10, "Title", "top"), (2, 10, 20, "7", "bottom"), (3, 8, 18, "Title", "top"), (3, 18, 28, "7", "bottom"), (4, 8, 18, "7", "bottom"), (4, 18, 28, "Title", "top"),
    (5, 0, 10, "Title", "top"), (5, 10, 20, "Section", "top"), (8, 0, 10, "Title", "top"), (8, 10, 18, "7", "bottom"), (9, 0, 10, "Section", "top"),
]
BOUNDS = [(1, "HH body F", [(0, 3), (8, 9)]), (2, "a b c d e", [(0, 1), (4, 5), (8, 9)]), (3, "plain", []), (4, "all", [(0, 3)]), (5, "ab cd", [(0, 1), (1, 3)])]
MERGES = [(1, [18, 19, 22], [], [18, 22]), (2, [19], [18, 22], [19]), (3, [], [18, 19, 22], [19]), (4, [5], [1], [7])]
CACHE_OLD = [("p", "old", 1, "stale"), ("q", "same", 1, "one"), ("q", "same", 2, "two"), ("r", "x", 1, "kept"), ("s", "old", 1, "stays")]
CACHE_NEW = [("p", "new", 2, "fresh"), ("q", "same", 2, "two again"), ("s", "a", 1, "of a"), ("s", "b", 2, "of b")]
TOCS = [("a", '[[1,"Opening",1],[2,"Details",2]]'), ("b", '[[1,"No page"],[1,"Numbered",7],["x","Level",3]]'), ("c", '{"toc":[]}'), ("d", "[]"), ("e", "no json")]
PROGRAM = [
    ("plain", 10, "once", "<title>", "<h1>"), ("plain", 20, "all", "href=", "src="), ("plain", 30, "keep", "<nav>", None), ("plain", 40, "drop", "track(1)", None),
    ("gate", 1, "keep", "<table>", None), ("gate", 2, "all", "<b>", ""), ("other", 1, "all", "a", "b"),
]
PAGE_CACHES = [("a", '{"schema":1,"pdf_sha256":"x","pages":{"1":"one","12":"twelve"}}'), ("b", '{"schema":2,"pdf_sha256":"x","pages":{"1":"one"}}'), ("c", "no json")]
DRAFTS = [(1, '{"a":1,"b":2}'), (2, '{"a":1,"b":2,"future_work_ids":[]}'), (3, '{"a":1}'), (4, "[1]"), (5, '{"c":0,"b":2,"a":1}')]
LOCATED = [(1, 2, "We will extend it.", "new"), (1, 3, "We will extend it.", "new"), (2, 1, "Other.", "o")]
CANDIDATES = [(1, 2, 1, "We will  extend it.", "late"), (1, 2, 0, "We will\nextend it.", "first"), (1, 4, 0, "We will extend it.", "elsewhere")]
SPAN_PAGES = [
    (1, 1, "Intro.  We plan to demon-\nstrate ﬁne models."), (1, 2, "Later work. The method stops at a page"), (1, 3, "end and goes on. Later work."),
    (2, 1, "A word is bro-"), (2, 2, "ken here. Later work."), (2, 4, "Not adjacent. ken here"),
]
SPAN_QUOTES = [
    (1, 1, "to demonstrate fine models.", None), (2, 1, "Later work.", None), (3, 1, "Later work.", 3), (4, 1, "at a page end and goes", None), (5, 2, "is broken here.", None),
    (6, 2, "work. Not adjacent.", None), (7, 1, "never said", None), (8, 1, "long- to", None),
]
#: By hand: item, doc, start page and offset, end page and offset (code points of the raw pages).
SPAN_PLACES = [(1, 1, 1, 16, 1, 44), (2, 1, 2, 0, 2, 11), (3, 1, 3, 17, 3, 28), (4, 1, 2, 29, 3, 12), (5, 2, 1, 7, 2, 9)]
#: Four pages of a bilingual catalogue: a shelf mark of two lines on top, a folio in letters at the foot; on page 10 a mark inside the body.
EDGE_PAGES = [
    (1, 7, "Shelf K\nRow 4\nDas Regal endet hier, und\nfolio vii"), (1, 8, "Shelf K\nRow 4\n次の棚は empty today; see the man-\nfolio viii"), (1, 9, "Shelf K\nRow 4\nual of 1911."), (1, 10, "Shelf K\nRow 4\nMore here.\nRow 4\nNo end."),
]
_HEAD = [(0, 8, "Shelf K", "top"), (8, 14, "Row 4", "top")]
EDGE_SPANS = [(1, 7, [*_HEAD, (39, 49, "folio vii", "bottom")]), (1, 8, [*_HEAD, (44, 55, "folio viii", "bottom")]), (1, 9, _HEAD), (1, 10, [*_HEAD, (25, 30, "Row 4", "top")])]
EDGE_SPAN_SCHEMA = "doc_id long, page long, edge_exclusions array<struct<start:int,end:int,text:string,edge:string>>"
EDGE_QUOTES = [
    (1, 1, "endet hier, und 次の棚は empty", None), (2, 1, "the manual of 1911.", None), (3, 1, "of 1911. More here.", None), (4, 1, "Row 4 次の棚は", None), (5, 1, "und folio vii", None),
]
#: By hand: page 10 has a mark inside its body, so it is joined to none; inside a page nothing is left out.
EDGE_PLACES = [(1, 1, 7, 24, 8, 24), (2, 1, 8, 36, 9, 26), (4, 1, 8, 8, 8, 18), (5, 1, 7, 36, 7, 49)]
LABELS = [(1, "Section 5（p.3）", 3, 3), (2, "Section 5 (p. 3)", 2, 3), (3, "Section 5", 1, 1), (4, "p.3 of the notes", 4, 4)]
INPUT_KIND = "abstract-record"
_GOOD = {"schema": 1, "kind": INPUT_KIND, "level": "abstract", "source": "s", "item_key": "k", "metadata": {"title": "t", "authors": ["a"], "year": 2020, "venue": "v", "doi": "d"}, "abstract": "We show."}
INPUTS = [
    ("/a.json", json.dumps(_GOOD)), ("b.json", json.dumps(_GOOD)), ("/c.json", json.dumps(_GOOD | {"kind": "other"})), ("/d.json", json.dumps({k: v for k, v in _GOOD.items() if k != "abstract"})),
    ("/e.json", "{"), ("/f.json", "[]"), ("/g.json", json.dumps(_GOOD | {"schema": 2})), ("/h.json", json.dumps(_GOOD | {"level": "fulltext"})), ("/i.json", json.dumps(_GOOD | {"abstract": " "})),
]
TEXT_PAPERS = [(1, "TITLE: On x\nAUTHORS: A; B\nYEAR: 2021\nVENUE: V\nDOI: 10/x\n---\nBody here."), (2, "No header at all"), (3, "TITLE: t\nYEAR: soon\n---\nBody\n---\nmore")]
PREPARED = [(1, '{"items":[{"q":1},{"q":2}]}'), (2, '[{"q":1}]'), (3, '{"source_pages":[],"items":[]}'), (4, '{"source_pages":null}')]
JSON_KINDS = [(1, '{"a":{"b":1}}'), (2, '{"a":{"b":null}}'), (3, '{"a":{}}'), (4, '{"a":{"b":"x"}}'), (5, '{"a":{"b":true}}'), (6, '{"a":{"b":[1]}}'), (7, '{"a":{"b":{"c":1}}}'), (8, '{"a":[1]}'), (9, "x")]
FRONTMATTER = [
    (1, "name: a\nversion: 1.2\n---\nbody"), (2, "version: '1.2'\n---\nbody"), (3, "version: 1\nversion: 2\n---\nb"), (4, "version: 'open\n---\nb"), (5, "version: 'a''b'\n---\nb"), (6, 'version: "x"\n---\nb'),
    (7, "no separator"), (8, "version: 1\n---\nb\n---\nc"), (9, "name: a\n---\nb"),
]
PATHS = ["skill/scripts/run.py", "skill/tests/x.py", "skill/scripts/test_run.py", "skill/conftest.py", "skill/latest/test_notes.md"]
REVALIDATION = (
    [(1, True), (2, True), (3, True), (4, False)], [("a.py",), ("judge.py",)],
    [(1, "a.py", "runtime"), (1, "judge.py", "judge"), (2, "judge.py", "judge"), (3, "b.py", "runtime"), (4, "b.py", "runtime")],
)

CONTRACT_ID = "event-contract@1"
CONTRACT = json.dumps({
    "contract_id": CONTRACT_ID, "response_field_map": {"thread_id": "output.thread_id", "app_server_events": "output.app_server_events"},
    "dispatch_evidence_item_types": ["collabAgentToolCall"], "app_server_event_envelope": {"dispatch_methods": ["item/started", "item/completed"], "item_source": "message.params.item"},
    "raw_identity_path": {"formal_spawn_relation": {"tool": "spawnAgent"}}, "delegation": {"fail_closed": {}},
})


def spawn(sender, receivers, method="item/completed", tool="spawnAgent", kind="collabAgentToolCall", **more):
    item = {"type": kind, "tool": tool, "senderThreadId": sender, "receiverThreadIds": receivers, **more}
    return {"message": {"method": method, "params": {"item": {k: v for k, v in item.items() if v != "absent"}}}}


def log(events, passed=True, version="v1", thread="root", **more):
    return json.dumps({"passed": passed, "version": version, "output": {"thread_id": thread, "app_server_events": events}, **more})


_TREE = [spawn("root", ["outer"]), spawn("outer", ["a"]), spawn("outer", ["b", "c"])]
#: (name, log, status)
LOGS = [
    ("healthy", log(_TREE), "PASS"),
    ("failed run, proven tree", log(_TREE, passed=False), "PASS"),
    ("each edge twice", log([*_TREE, spawn("outer", ["a"], "item/started"), spawn("root", ["outer"], "item/started")]), "PASS"),
    ("started without receivers", log([*_TREE, spawn("absent", "absent", "item/started"), spawn("x", [], "item/started"), spawn("x", None, "item/started")]), "PASS"),
    ("other tools", log([*_TREE, spawn("outer", ["z"], tool="wait"), spawn("outer", ["z"], tool="sendInput"), spawn("outer", ["z"], kind="message")]), "PASS"),
    ("other methods", log([*_TREE, {"message": {"method": "turn/started"}}, {"message": {}}]), "PASS"),
    ("identity is not read", log([*_TREE, spawn("outer", ["a"], agentRole=5, agent_type=[])], child_thread_reads="x"), "PASS"),
    ("a later child", log([*_TREE, spawn("a", ["deeper"])]), "PASS"),
    ("one nested", log(_TREE[:2]), "FAIL_PRODUCER"),
    ("two nested", log([_TREE[0], _TREE[2]]), "FAIL_PRODUCER"),
    ("four nested", log([*_TREE, spawn("outer", ["d"])]), "FAIL_PRODUCER"),
    ("root spawns itself", log([spawn("root", ["root"])]), "FAIL_PRODUCER"),
    ("none nested", log(_TREE[:1]), "NOT_TESTED"),
    ("no events", log([]), "BLOCKED"),
    ("null events", log(None), "BLOCKED"),
    ("missing events", json.dumps({"passed": True, "version": "v", "output": {"thread_id": "root"}}), "BLOCKED"),
    ("two outer", log([*_TREE, spawn("root", ["outer2"])]), "BLOCKED"),
    ("null version", log(_TREE, version=None), "BLOCKED"),
    ("blank version", log(_TREE, version="  "), "BLOCKED"),
    ("missing version", json.dumps({"passed": True, "output": {"thread_id": "root", "app_server_events": _TREE}}), "BLOCKED"),
    ("number as version", log(_TREE, version=3), "INVALID_TEST_EXECUTION"),
    ("passed as text", log(_TREE, passed="true"), "INVALID_TEST_EXECUTION"),
    ("passed null", log(_TREE, passed=None), "INVALID_TEST_EXECUTION"),
    ("no thread", log(_TREE, thread=""), "INVALID_TEST_EXECUTION"),
    ("number as thread", log(_TREE, thread=4), "INVALID_TEST_EXECUTION"),
    ("events as object", log({}), "INVALID_TEST_EXECUTION"),
    ("event as text", log(["x"]), "INVALID_TEST_EXECUTION"),
    ("message as list", log([{"message": []}]), "INVALID_TEST_EXECUTION"),
    ("method as list", log([{"message": {"method": ["item/completed"]}}]), "INVALID_TEST_EXECUTION"),
    ("no item", log([{"message": {"method": "item/completed", "params": {}}}]), "INVALID_TEST_EXECUTION"),
    ("null item", log([{"message": {"method": "item/completed", "params": {"item": None}}}]), "INVALID_TEST_EXECUTION"),
    ("completed without receivers", log([spawn("root", "absent")]), "INVALID_TEST_EXECUTION"),
    ("completed with none", log([spawn("absent", [])]), "INVALID_TEST_EXECUTION"),
    ("receivers as text", log([spawn("root", "outer")]), "INVALID_TEST_EXECUTION"),
    ("empty receiver", log([spawn("root", ["outer", ""])]), "INVALID_TEST_EXECUTION"),
    ("number as receiver", log([spawn("root", [7])]), "INVALID_TEST_EXECUTION"),
    ("no sender", log([spawn("absent", ["outer"], "item/started")]), "INVALID_TEST_EXECUTION"),
    ("two owners", log([*_TREE, spawn("a", ["b"])]), "INVALID_TEST_EXECUTION"),
    ("two owners and two outer", log([*_TREE, spawn("root", ["x"]), spawn("a", ["x"])]), "INVALID_TEST_EXECUTION"),
    ("response as list", "[]", "INVALID_TEST_EXECUTION"),
    ("no json", "{", "INVALID_TEST_EXECUTION"),
    ("key twice", '{"passed": true, "passed": true}', "INVALID_TEST_EXECUTION"),
    ("unreadable", None, "INVALID_TEST_EXECUTION"),
]
#: By hand, for logs of each kind.
REASONS = [
    ("healthy", ""), ("one nested", "outer: nested children 1"), ("four nested", "outer: nested children 4"), ("none nested", "outer: nested children 0"), ("no events", "root: no child"),
    ("two outer", "root: children outer, outer2"), ("null version", "version: none"), ("number as version", "version: not a string"), ("passed null", "passed: not a boolean"), ("no thread", "thread_id: missing"),
    ("events as object", "events: not a list"), ("event as text", "event 0: event: not an object"), ("two owners", "several owners: b"), ("two owners and two outer", "several owners: x"),
    ("response as list", "response: not an object"), ("no json", "response: unreadable"),
]
_CONTRACT = json.loads(CONTRACT)
CONTRACTS = [
    ("good", CONTRACT, "PASS"), ("other id", json.dumps(_CONTRACT | {"contract_id": "other"}), "INVALID_TEST_EXECUTION"), ("no envelope", json.dumps(_CONTRACT | {"app_server_event_envelope": 1}), "INVALID_TEST_EXECUTION"),
    ("no item types", json.dumps(_CONTRACT | {"dispatch_evidence_item_types": []}), "INVALID_TEST_EXECUTION"), ("no identity", json.dumps(_CONTRACT | {"raw_identity_path": {}}), "INVALID_TEST_EXECUTION"),
    ("no delegation", json.dumps(_CONTRACT | {"delegation": {}}), "INVALID_TEST_EXECUTION"), ("unreadable", "{", "INVALID_TEST_EXECUTION"),
]
