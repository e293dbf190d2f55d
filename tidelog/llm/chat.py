r"""Chat formatting: the fingerprint of a record's field paths selects how it becomes turns.

A record (JSON) is reduced to its sorted nested field paths, list items being one path; their hash looks up a
declarative mapping (where the turns are, or which fields hold which role), so a new layout is a new entry and no
code.  Turns are written as `### role: text </turn>` and a line feed.  Inside roles and texts a backslash goes before
each backslash, `#`, `<` and, in roles, `:`, so no text can open or close a turn, and undoing it is exact.

Cases: null text is the empty text, null role the empty role; turns keep the order of turn, then role, then text, so
ties and repeated rows have one result (each stays a turn); a record of no known layout is read by the largest layout whose
paths it holds, its other fields aside, and if there is none it becomes one turn of the role unknown that holds the record
as JSON, outside the loss mask; a conversation is one row, whatever its length, as its formatted text is one string;
no rows, no records; further columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow

OPEN, CLOSE = "### ", " </turn>\n"


def paths(value: Any, at: str = "$") -> set[str]:
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in paths(v, f"{at}.{k}")} or {at}
    if isinstance(value, list):
        return {p for v in value for p in paths(v, f"{at}[]")} or {f"{at}[]"}
    return {at}


def fingerprint(record: Any) -> str:
    return hashlib.sha1("\n".join(sorted(paths(record))).encode()).hexdigest()


#: The paths of each known layout.
_PATHS: dict[str, frozenset[str]] = {}


def _shape(*p: str) -> str:
    shape = hashlib.sha1("\n".join(sorted(p)).encode()).hexdigest()
    _PATHS[shape] = frozenset(p)
    return shape


#: Layouts by fingerprint: ("list", path, role field, text field, role names), or ("fields", [(role, field), ...]).
LAYOUTS: dict[str, tuple] = {
    _shape("$.messages[].role", "$.messages[].content"): ("list", "messages", "role", "content", {}),
    _shape("$.messages[]"): ("list", "messages", "role", "content", {}),
    _shape("$.conversations[].from", "$.conversations[].value"): ("list", "conversations", "from", "value", {"human": "user", "gpt": "assistant"}),
    _shape("$[].role", "$[].content"): ("list", "", "role", "content", {}),
    _shape("$.prompt", "$.completion"): ("fields", [("user", "prompt"), ("assistant", "completion")]),
    _shape("$.prompt", "$.response"): ("fields", [("user", "prompt"), ("assistant", "response")]),
    _shape("$.instruction", "$.output"): ("fields", [("user", "instruction"), ("assistant", "output")]),
    _shape("$.system", "$.instruction", "$.output"): ("fields", [("system", "system"), ("user", "instruction"), ("assistant", "output")]),
    _shape("$.instruction", "$.input", "$.output"): ("fields", [("user", "instruction"), ("user", "input"), ("assistant", "output")]),
}


def canonical(record: Any) -> list[tuple[str, str]]:
    layout = LAYOUTS.get(fingerprint(record))
    if layout is None:
        held = paths(record)
        inside = [k for k, p in _PATHS.items() if p <= held and len(p) > 1]
        if not inside:
            return [("unknown", json.dumps(record, ensure_ascii=False, sort_keys=True))]
        layout = LAYOUTS[max(inside, key=lambda k: (len(_PATHS[k]), k))]
    if layout[0] == "fields":
        return [(role, _said(record[f])) for role, f in layout[1]]
    _, path, role, text, names = layout
    turns = record[path] if path else record
    return [(names.get(x := _said(m.get(role)), x), _said(m.get(text))) if isinstance(m, dict) else ("", _said(m)) for m in turns]


def _said(value: Any) -> str:
    """A field as text; what is no text is JSON."""
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False, sort_keys=True)


def _put(text: str) -> str:
    return re.sub(r"[\\#<]", r"\\\g<0>", text)


def _put_role(text: str) -> str:
    return re.sub(r"[\\#<:]", r"\\\g<0>", text)


def _undo(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and its loss mask: spans of the assistant's texts in it."""
    out, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{_put_role(role)}: ", _put(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        out.append(f"{head}{body}{CLOSE}")
        at += len(out[-1])
    return "".join(out), mask


_TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.)*+)</turn>\n", re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m or not m[2].endswith(" "):
            raise ValueError(f"no turn at {at}")
        out.append((_undo(m[1]), _undo(m[2][:-1])))  # without the space before the end
        at = m.end()
    return out


def as_records(conversations: DataFrame) -> DataFrame:
    """Rows by turn to one record a conversation (conv_id, record), in the layout that its roles fit."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    grouped = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("t"))
    roles = F.transform("t", lambda x: x["role"])
    said = lambda i: F.col("t")[i]["content"]
    fits = lambda *names: roles == F.array(*map(F.lit, names))
    record = (
        F.when(fits("user", "assistant"), F.to_json(F.struct(said(0).alias("prompt"), said(1).alias("completion"))))
        .when(fits("system", "user", "assistant"), F.to_json(F.struct(said(0).alias("system"), said(1).alias("instruction"), said(2).alias("output"))))
        .otherwise(F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))))
    )
    return grouped.select("conv_id", record.alias("record"))


SCHEMA = "conv_id long, formatted string, mask array<struct<start:long,stop:long>>, fingerprint string"


def format_chats(records: DataFrame) -> DataFrame:
    """(conv_id, record) to formatted text, its loss mask and the layout's fingerprint."""

    def run(batches):
        for b in batches:
            rows = [json.loads(x) for x in b.column(1).to_pylist()]
            done = [render(canonical(x)) for x in rows]
            masks = pa.array([[{"start": a, "stop": z} for a, z in m] for _, m in done], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
            yield pa.record_batch([b.column(0), pa.array([f for f, _ in done], pa.string()), masks, pa.array(map(fingerprint, rows), pa.string())], names=["conv_id", "formatted", "mask", "fingerprint"])

    return in_arrow(records.select("conv_id", "record"), run, SCHEMA)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, fingerprint string"


def digests(formatted: DataFrame) -> DataFrame:
    """Read back from the formatted text and its mask alone."""

    def run(batches):
        for b in batches:
            rows = []
            for conv, text, mask, shape in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                turns = parse(text)
                loss = "".join(_undo(text[m["start"] : m["stop"]]) for m in mask)
                said = "".join(f"{role}\n{x}\n" for role, x in turns)
                rows.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text), shape))
            names = [x.split()[0] for x in DIGESTS.split(", ")]
            types = [pa.string() if "string" in x else pa.int64() for x in DIGESTS.split(", ")]
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return in_arrow(formatted, run, DIGESTS)
