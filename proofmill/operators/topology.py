"""Verdicts over event logs: who spawned whom, and is the tree of the expected shape.

Any number of runs goes through one plan without a shuffle: a log is one row, its events become typed
structs in a few steps, edges, owners and both hops follow from the array of distinct edges, then one ordered CASE.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import variants as V

#: Statuses with exit codes, the kind of item that records a spawn, where a contract names its tool.
EXIT_CODES = {"PASS": 0, "FAIL_PRODUCER": 1, "BLOCKED": 2, "INVALID_TEST_EXECUTION": 3, "NOT_TESTED": 4}
ITEM_TYPE = "collabAgentToolCall"
SPAWN_TOOL = ("raw_identity_path", "formal_spawn_relation", "tool")
COMPLETED = "item/completed"
NESTED = 3


@dataclass(frozen=True)
class Rules:
    contract_id: str
    methods: tuple[str, ...]
    item_path: str
    tool: str
    thread_path: str | None
    events_path: str | None


def contract_rules(contract: object, pinned_id: str) -> tuple[Rules | None, list[str]]:
    """The rules that a contract declares, or all that is wrong with it. A contract is one small document and is read on the driver."""
    if not isinstance(contract, dict):
        return None, ["contract: not an object"]
    wrong = [] if contract.get("contract_id") == pinned_id else ["contract_id: not the pinned one"]
    envelope = contract.get("app_server_event_envelope")
    if not isinstance(envelope, dict):
        return None, [*wrong, "app_server_event_envelope: missing"]
    methods, path = envelope.get("dispatch_methods"), envelope.get("item_source")
    types = contract.get("dispatch_evidence_item_types")
    tool = reduce(lambda x, k: x.get(k) if isinstance(x, dict) else None, SPAWN_TOOL, contract)
    delegation = contract.get("delegation")
    fields = contract.get("response_field_map", {})
    named = lambda k: fields.get(k) if isinstance(fields, dict) and isinstance(fields.get(k), str) else None
    checks = (
        ("dispatch_methods: not a list of names", isinstance(methods, list) and methods and all(isinstance(m, str) and m for m in methods)),
        ("item_source: not a dotted path", isinstance(path, str) and path),
        (f"dispatch_evidence_item_types: lacks {ITEM_TYPE}", isinstance(types, list) and ITEM_TYPE in types),
        (f"{'.'.join(SPAWN_TOOL)}: missing", isinstance(tool, str) and tool),
        ("delegation.fail_closed: missing", isinstance(delegation, dict) and isinstance(delegation.get("fail_closed"), dict)),
    )
    wrong += [said for said, fine in checks if not fine]
    if wrong:
        return None, wrong
    return Rules(contract["contract_id"], tuple(methods), path, tool, named("thread_id"), named("app_server_events")), []


def _read_events(gated: DataFrame, rules: Rules) -> DataFrame:
    """``gated`` with what its events say: problems (array<struct<index, problem>>) and edges (distinct array<struct<sender, receiver>>).

    Each step walks its paths once and keeps what it found for the next one.
    """
    methods = F.array(*map(F.lit, rules.methods))
    opened = gated.withColumn("_e", F.transform("events", lambda e: F.struct(
        V.is_object(e).alias("whole"), V.lookup(e, "message").alias("message"), V.lookup(e, rules.item_path).alias("item"),
    )))
    named = opened.withColumn("_e", F.transform("_e", lambda x: F.struct(
        x["whole"].alias("whole"), V.is_object(x["message"]).alias("message"), V.lookup(x["message"], "method").alias("method"), x["item"].alias("item"), V.is_object(x["item"]).alias("is_item"),
        V.lookup(x["item"], "type").alias("type"), V.lookup(x["item"], "tool").alias("tool"), V.lookup(x["item"], "senderThreadId").alias("sender"), V.lookup(x["item"], "receiverThreadIds").alias("receivers"),
    )))
    typed = named.withColumn("_e", F.transform("_e", lambda x: F.struct(
        x["whole"].alias("whole"), x["message"].alias("message"), V.text(x["method"]).alias("method"), (V.is_object(x["method"]) | V.elements(x["method"]).isNotNull()).alias("nested"),
        x["item"].isNotNull().alias("has_item"), x["is_item"].alias("is_item"), F.coalesce((V.text(x["type"]) == ITEM_TYPE) & (V.text(x["tool"]) == rules.tool), F.lit(False)).alias("formal"),
        V.text(x["sender"]).alias("sender"), V.elements(x["receivers"]).alias("received"), (x["receivers"].isNull() | F.is_variant_null(x["receivers"])).alias("absent"),
    )))
    listed = typed.withColumn("_e", F.transform("_e", lambda x: F.struct(
        x["whole"].alias("whole"), x["message"].alias("message"), x["nested"].alias("nested"), x["has_item"].alias("has_item"), x["is_item"].alias("is_item"), x["formal"].alias("formal"),
        F.coalesce(F.array_contains(methods, x["method"]), F.lit(False)).alias("dispatch"), (x["method"] == COMPLETED).alias("completed"), (F.coalesce(x["sender"], F.lit("")) != "").alias("sent"), x["sender"].alias("sender"),
        F.transform(x["received"], V.text).alias("receivers"), (x["absent"] | (F.size(x["received"]) == 0)).alias("none"),
    )))
    is_completed = lambda x: F.lit(COMPLETED in rules.methods) & x["completed"]
    names = lambda x: F.coalesce(F.forall(x["receivers"], lambda r: F.coalesce(r != "", F.lit(False))), F.lit(False))
    # receivers are judged before the sender; what is no dispatch, or another tool, is passed over
    problem = lambda x: (
        F.when(~x["whole"], "event: not an object").when(~x["message"], "message: not an object").when(x["nested"], "method: not a name").when(~x["dispatch"], None)
        .when(~x["has_item"], "item: missing").when(~x["is_item"], "item: not an object").when(~x["formal"], None)
        .when(x["none"] & is_completed(x), "receivers: none though completed").when(x["none"], None).when(~names(x), "receivers: malformed").when(~x["sent"], "sender: missing")
    )
    edge = lambda x: x["dispatch"] & x["formal"] & ~x["none"] & names(x) & x["sent"]
    judged = listed.withColumns({
        "problems": F.filter(F.transform("_e", lambda x, k: F.struct(k.alias("index"), problem(x).alias("problem"))), lambda p: p["problem"].isNotNull()),
        "edges": F.array_distinct(F.flatten(F.transform(F.filter("_e", edge), lambda x: F.transform(x["receivers"], lambda r: F.struct(x["sender"].alias("sender"), r.alias("receiver")))))),
    })
    return judged.drop("events", "_e")


def child_counts(edges: DataFrame, by: list[str]) -> DataFrame:
    """Different receivers of each sender."""
    return edges.groupBy(*by, "sender").agg(F.count_distinct("receiver").alias("children"))


def ownership_conflicts(edges: DataFrame, by: list[str]) -> DataFrame:
    """Receivers that different senders claim."""
    return edges.groupBy(*by, "receiver").agg(F.count_distinct("sender").alias("senders")).filter("senders > 1")


def verdicts(runs: DataFrame, contract_json: str, pinned_id: str) -> DataFrame:
    """A verdict for each (run_id, response): ``response`` is the log as JSON text (null: unreadable).

    JSON with a key twice or NaN counts as unreadable, and a method that is a list or an
    object as malformed evidence; both end as INVALID_TEST_EXECUTION.
    """
    try:
        rules, wrong = contract_rules(json.loads(contract_json), pinned_id)
    except ValueError:
        rules, wrong = None, ["contract: unreadable"]
    if rules is None:
        return _verdict(runs.select("run_id"), F.lit("INVALID_TEST_EXECUTION"), F.array(F.lit("; ".join(wrong))))
    v = F.col("v")
    at = lambda p: V.lookup(v, p) if p else F.parse_json(F.lit("null"))
    looked = runs.select("run_id", V.parse(F.col("response")).alias("v")).select(
        "run_id", v.isNull().alias("unread"), V.is_object(v).alias("whole"), V.lookup(v, "version").alias("version"), V.lookup(v, "passed").alias("passed"), V.text(at(rules.thread_path)).alias("thread"), at(rules.events_path).alias("events"),
    )
    version, passed, thread, events = (F.col(c) for c in ("version", "passed", "thread", "events"))
    gate = (
        F.when(F.col("unread"), F.array(F.lit("INVALID_TEST_EXECUTION"), F.lit("response: unreadable")))
        .when(~F.col("whole"), F.array(F.lit("INVALID_TEST_EXECUTION"), F.lit("response: not an object")))
        .when(V.kind(passed) != "BOOLEAN", F.array(F.lit("INVALID_TEST_EXECUTION"), F.lit("passed: not a boolean")))
        .when(V.kind(version).isin("MISSING", "NULL") | (F.btrim(V.text(version), F.lit(" \t\r\n\x0b\f")) == ""), F.array(F.lit("BLOCKED"), F.lit("version: none")))
        .when(V.kind(version) != "STRING", F.array(F.lit("INVALID_TEST_EXECUTION"), F.lit("version: not a string")))
        .when(F.coalesce(thread == "", F.lit(True)), F.array(F.lit("INVALID_TEST_EXECUTION"), F.lit("thread_id: missing")))
        .when(~V.kind(events).isin("MISSING", "NULL", "ARRAY"), F.array(F.lit("INVALID_TEST_EXECUTION"), F.lit("events: not a list")))
    )
    gated = looked.select("run_id", gate.alias("gate"), V.text(F.col("version")).alias("version"), F.col("thread").alias("root"), F.when(gate.isNull(), V.elements(F.col("events"))).alias("events"))
    empty = F.array().cast("array<string>")
    owned = _read_events(gated, rules).withColumn("_r", F.array_sort(F.transform("edges", lambda e: e["receiver"])))
    # edges are distinct, so a receiver that stands twice has two senders
    twice = F.array_distinct(F.filter("_r", lambda r, k: (k > 0) & (F.get("_r", F.greatest(k - 1, F.lit(0))) == r)))
    below = lambda sender: F.array_sort(F.transform(F.filter("edges", lambda e: e["sender"] == sender), lambda e: e["receiver"]))
    hop = owned.withColumns({
        "conflicts": F.when(F.size(twice) > 0, twice), "relations": F.when(F.col("edges").isNull(), 0).otherwise(F.size("edges")), "outers": F.coalesce(below(F.col("root")), empty),
        "problems": F.when(F.size("problems") > 0, F.transform("problems", lambda p: F.concat(F.lit("event "), p["index"].cast("string"), F.lit(": "), p["problem"]))),
    })
    # the second hop counts where the first one is of one child
    facts = hop.withColumn("nested", F.when(F.size("outers") == 1, F.coalesce(below(F.get("outers", F.lit(0))), empty)).otherwise(empty)).drop("edges", "_r")
    n, m = F.size("outers"), F.size("nested")
    status = (
        F.when(F.col("gate").isNotNull(), F.col("gate")[0])
        .when(F.col("problems").isNotNull() | F.col("conflicts").isNotNull(), "INVALID_TEST_EXECUTION")
        .when(n != 1, "BLOCKED").when(m == NESTED, "PASS").when(m == 0, "NOT_TESTED").otherwise("FAIL_PRODUCER")
    )
    reasons = (
        F.when(F.col("gate").isNotNull(), F.array(F.get("gate", F.lit(1))))
        .when(F.col("problems").isNotNull(), F.col("problems"))
        .when(F.col("conflicts").isNotNull(), F.array(F.concat(F.lit("several owners: "), F.array_join("conflicts", ", "))))
        .when(n == 0, F.array(F.lit("root: no child"))).when(n > 1, F.array(F.concat(F.lit("root: children "), F.array_join("outers", ", "))))
        .when(m == NESTED, empty).otherwise(F.array(F.concat(F.lit("outer: nested children "), m.cast("string"))))
    )
    clean = F.col("gate").isNull() & F.col("problems").isNull() & F.col("conflicts").isNull()
    versioned = F.coalesce(F.get("gate", F.lit(1)).isin("thread_id: missing", "events: not a list"), F.lit(True))
    rooted = F.coalesce(F.get("gate", F.lit(1)) == "events: not a list", F.lit(True))
    return _verdict(
        facts, status, reasons, root=F.when(rooted, F.col("root")), children=F.when(clean, n), outer=F.when(clean & (n == 1), F.get("outers", F.lit(0))),
        nested=F.when(clean & (n == 1), F.col("nested")), relations=F.when(clean, F.col("relations")), version=F.when(versioned, F.col("version")), contract=F.lit(rules.contract_id),
    )


def _verdict(df: DataFrame, status: Column, reasons: Column, root: Column | None = None, children: Column | None = None, outer: Column | None = None, nested: Column | None = None, relations: Column | None = None, version: Column | None = None, contract: Column | None = None) -> DataFrame:
    text = lambda c: F.lit(None).cast("string") if c is None else c
    number = lambda c: F.lit(0) if c is None else F.coalesce(c, F.lit(0))
    ids = F.array().cast("array<string>") if nested is None else F.coalesce(F.sort_array(nested), F.array().cast("array<string>"))
    codes = F.create_map(*(F.lit(x) for pair in EXIT_CODES.items() for x in pair))
    return df.select(
        "run_id", F.lit(2).alias("schema"), status.alias("producer_status"), text(root).alias("root_thread_id"), number(children).alias("root_direct_child_count"), text(outer).alias("outer_thread_id"),
        F.size(ids).alias("nested_direct_child_count"), ids.alias("nested_child_thread_ids"), number(relations).alias("formal_spawn_relation_count"), reasons.alias("reasons"),
        F.struct(text(version).alias("eval_version"), text(contract).alias("contract_id")).alias("provenance"), codes[status].alias("exit_code"),
    )
