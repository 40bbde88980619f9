"""Deeply nested results turned into flat related tables (problem 3).

One pass: a depth-first visitor reads each payload once and emits (tag, parent key, own key, payload) for every node
that it meets; ``flat_table`` then applies the schema of one tag. Nothing is parsed twice and no level needs a shuffle.

Defined results: keys of objects may be in snake_case or camelCase; a single object or value stands for a list of one;
``cells`` and ``fields`` may be objects keyed by their id; any part may be a JSON string that holds JSON; null, empty
and broken JSON give no rows for that column; a node without its own id gives no row (its children that need it
neither), a null ``job_id`` gives no rows; repeated links count once; extra keys go to the payload.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.session import spread

KINDS = ("table", "row", "cell", "cell_ref", "evidence", "node", "entity", "field", "field_ref", "requirement")
NODE_SCHEMA = "job_id string, node_kind string, parent_key string, child_key string, payload string"

_HUMP = re.compile(r"(?<=[a-z0-9])([A-Z])")


def snake(key: str) -> str:
    """camelCase to snake_case."""
    return _HUMP.sub(lambda m: "_" + m[1].lower(), key)


def _loads(text):
    """The JSON in ``text``, or None."""
    try:
        return json.loads(text)
    except (ValueError, TypeError, RecursionError):
        return None


def _open(x):
    """``x``, read as JSON for as long as it is a string that holds an array or object."""
    while isinstance(x, str):
        s = x.strip()
        if s[:1] not in ("[", "{", '"'):
            return x
        y = _loads(s)
        if y is None:
            return x
        x = y
    return x


def _obj(x) -> dict | None:
    x = _open(x)
    if not isinstance(x, dict):
        return None
    out: dict = {}
    for k, v in x.items():
        k = snake(k)
        if out.get(k) is None:
            out[k] = v
    return out


def _objects(x, id_key: str, keyed: bool = False) -> list[dict | None]:
    """The members of a list, of a list of one or, where ``keyed``, of an object keyed by id."""
    x = _open(x)
    if isinstance(x, dict):
        o = _obj(x)
        if keyed and id_key not in o and "raw_value" not in o:
            members = []
            for k, v in x.items():  # the ids themselves keep their spelling
                m = _obj(v)
                m = dict(m) if m is not None else {"raw_value": v}
                if not _key(m.get(id_key)):
                    m[id_key] = k
                members.append(m)
            return members
        return [o]
    if isinstance(x, list):
        return [_obj(v) for v in x]
    return []


def _key(x) -> str | None:
    if isinstance(x, bool) or x is None or isinstance(x, (dict, list)):
        return None
    s = x if isinstance(x, str) else str(x)
    return _whole(s) if s.strip() else None


def _whole(s: str) -> str:
    """``s`` with lone surrogates, which JSON escapes can spell and no column can hold, replaced."""
    return s if s.isascii() else s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _ids(x) -> list[str]:
    x = _open(x)
    return [k for v in (x if isinstance(x, list) else [x]) if (k := _key(v))]


def _payload(o: dict, *without: str) -> str:
    return _whole(json.dumps({k: v for k, v in o.items() if k not in without}, ensure_ascii=False, sort_keys=True))


def visit(job: str, tables, evidence, extracted, payloads: bool = False) -> Iterator[tuple[str, str, str, str | None]]:
    """(kind, parent, child, payload) of every node of one result, depth first."""
    pay = _payload if payloads else (lambda *_: None)

    def part(text, name: str):
        x = _open(text) if isinstance(text, str) else None
        if isinstance(x, dict) and len(x) == 1:  # a part may come wrapped in its own name
            (k, v), = x.items()
            if snake(k) == name:
                return _open(v)
        return x if isinstance(x, (dict, list)) else None

    for t in _objects(part(tables, "tables"), "table_id"):
        tid = _key(t.get("table_id")) if t else None
        if not tid:
            continue
        yield "table", job, tid, pay(t, "table_id", "rows")
        for n, r in enumerate(_objects(t.get("rows"), "row_id"), 1):
            if r is None:
                continue
            rid = f"{tid}#{n}"
            yield "row", tid, rid, pay(r, "cells")
            for c in _objects(r.get("cells"), "column_id", keyed=True):
                cid = _key(c.get("column_id")) if c else None
                if not cid:
                    continue
                ck = f"{rid}#{cid}"
                yield "cell", rid, ck, pay(c, "column_id", "evidence_refs")
                for e in _ids(c.get("evidence_refs")):
                    yield "cell_ref", ck, e, None
    for v in _objects(part(evidence, "evidence"), "evidence_id"):
        eid = _key(v.get("evidence_id")) if v else None
        if not eid:
            continue
        yield "evidence", job, eid, pay(v, "evidence_id", "source_node_ids")
        for s in _ids(v.get("source_node_ids")):
            yield "node", eid, s, None
    data = _obj(part(extracted, "extracted_data"))
    if not data:
        return
    for en in _objects(data.get("entities"), "entity_id"):
        if en and (k := _key(en.get("entity_id"))):
            yield "entity", job, k, pay(en, "entity_id")
    for f in _objects(data.get("fields"), "field_id", keyed=True):
        k = _key(f.get("field_id")) if f else None
        if not k:
            continue
        yield "field", _key(f.get("entity_id")) or job, k, pay(f, "field_id", "entity_id", "evidence_refs")
        for e in _ids(f.get("evidence_refs")):
            yield "field_ref", k, e, None
    for q in _objects(data.get("requirements"), "requirement_id"):
        if q and (k := _key(q.get("requirement_id"))):
            yield "requirement", job, k, pay(q, "requirement_id")


def nested_nodes(results: DataFrame, payloads: bool = True) -> DataFrame:
    """(job_id, node_kind, parent_key, child_key, payload): every node of every result, tagged, in one pass."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["job_id", "node_kind", "parent_key", "child_key", "payload"]
        kind = pa.schema([(n, pa.string()) for n in names])
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for job, t, e, x in zip(*(b.column(i) for i in range(4))):
                job = job.as_py()
                for k, parent, child, pay in visit(job, t.as_py(), e.as_py(), x.as_py(), payloads):
                    for col, v in zip(out, (job, k, parent, child, pay)):
                        col.append(v)
                if len(out[0]) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], schema=kind)
                    out = [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], schema=kind)

    rows = results.where(F.col("job_id").isNotNull()).select("job_id", "tables_json", "evidence_json", "extracted_json")
    return spread(rows).mapInArrow(emit, NODE_SCHEMA)


def nested_links(results: DataFrame) -> DataFrame:
    """(job_id, node_kind, parent_key, child_key): distinct parent-child links."""
    return nested_nodes(results, payloads=False).drop("payload").distinct()


#: What ``flat_table`` reads from the payload of each kind.
PAYLOAD_SCHEMAS = {
    "table": "table_type string, title string, footnotes array<string>",
    "row": "row_id string, row_key string",
    "cell": "raw_value string",
    "evidence": "source_text string, page string, bbox_status string",
    "entity": "entity_type string, linked_table_ids array<string>",
    "field": "semantic_key string, raw_value string",
    "requirement": "requirement_text string, status string",
}


def flat_table(nodes: DataFrame, kind: str) -> DataFrame:
    """One flat table: (job_id, parent_key, child_key) and the columns of the kind's payload schema."""
    rows = nodes.where(F.col("node_kind") == kind).drop("node_kind")
    schema = PAYLOAD_SCHEMAS.get(kind)
    if not schema:
        return rows.drop("payload").distinct()
    return rows.withColumn("p", F.from_json("payload", schema)).select("job_id", "parent_key", "child_key", "p.*").distinct()


def write_tables(nodes: DataFrame, path: str) -> None:
    """All tags in one job, a folder per tag; each is then read with its own schema."""
    nodes.write.mode("overwrite").partitionBy("node_kind").parquet(path)
