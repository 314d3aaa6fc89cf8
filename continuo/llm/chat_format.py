"""Chat formatting behind schema fingerprints.

A record's fingerprint is the hash of its sorted nested field paths, of those that any layout
knows (so further fields do no harm). It selects a declarative mapping from the layout to canonical
turns; a layout with optional paths has a fingerprint for each choice of them. Where the whole fingerprint is
unknown, because fields of several layouts meet, the first layout counts whose own paths alone give one of its
fingerprints. A table of turns is a layout too: the nested field paths of its schema are the paths.

Template, per turn: ``<|turn|>`` role ``<|text|>`` text ``<|end|>``. In roles and texts a backslash
is doubled and ``<|`` becomes ``<\\|``, so no control string can occur inside, and dropping one
backslash before each escaped character gives the original back. The loss mask covers the escaped
text of every assistant turn.

Null roles and texts count as empty. Messages that are no objects are left out; texts that are lists of parts are
their parts' texts, a line each; other values are their JSON. Turns go by number, nulls first, then by formatted
text; repeated rows are turns of their own. Rows with a null id form one conversation. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from continuo.llm.common import bound_batches, frame

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"

#: Layout: its paths, those that may be missing, and how turns come out of it. ``first``: (role, path) pairs of texts
#: ahead, skipped if blank; ``each``: a list of messages with their role and text paths; ``turns``: (role, paths)
#: pairs, the texts of several paths on lines of their own; ``columns``: a table of turns.
LAYOUTS = {
    "turn_rows": {"paths": ["conv_id", "role", "text", "turn"], "columns": {"id": "conv_id", "order": "turn", "role": "role", "text": "text"}},
    "messages": {
        "paths": ["messages[]", "messages[].content", "messages[].role"], "optional": ["system"],
        "first": [("system", "system")], "each": ("messages", "role", "content"),
    },
    "message_parts": {
        "paths": ["messages[]", "messages[].content[]", "messages[].content[].text", "messages[].role"],
        "optional": ["messages[].content", "messages[].content[].type", "system"], "first": [("system", "system")], "each": ("messages", "role", "content"),
    },
    "conversations": {
        "paths": ["conversations[]", "conversations[].from", "conversations[].value"], "optional": ["system"],
        "first": [("system", "system")], "each": ("conversations", "from", "value"),
    },
    "instruction": {
        "paths": ["instruction", "output"], "optional": ["input", "system"], "first": [("system", "system")],
        "turns": [("user", ("instruction", "input")), ("assistant", ("output",))],
    },
    "prompt_response": {
        "paths": ["prompt", "response"], "optional": ["system"], "first": [("system", "system")],
        "turns": [("user", ("prompt",)), ("assistant", ("response",))],
    },
    "prompt_completion": {
        "paths": ["completion", "prompt"], "optional": ["system"], "first": [("system", "system")],
        "turns": [("user", ("prompt",)), ("assistant", ("completion",))],
    },
    "question": {
        "paths": ["answer", "question"], "optional": ["context", "system"], "first": [("system", "system")],
        "turns": [("user", ("context", "question")), ("assistant", ("answer",))],
    },
}
#: Other names of the canonical roles.
ROLE_NAMES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def all_paths(layout: dict) -> set[str]:
    return {*layout["paths"], *layout.get("optional", ())}


def known_paths(layouts) -> set[str]:
    return {p for layout in layouts.values() for p in all_paths(layout)}


def field_paths(value, prefix: str = "") -> set[str]:
    """Nested field paths; a list adds ``[]``."""
    if isinstance(value, dict):
        out = set()
        for name, inner in value.items():
            path = f"{prefix}.{name}" if prefix else name
            out |= field_paths(inner, path) or {path}
        return out
    if isinstance(value, list):
        return {prefix + "[]"}.union(*[field_paths(inner, prefix + "[]") for inner in value])
    return {prefix} if prefix else set()


def schema_paths(kind: T.DataType, prefix: str = "") -> set[str]:
    """The same paths of a table's schema."""
    if isinstance(kind, T.StructType):
        return {p for f in kind.fields for p in schema_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)}
    if isinstance(kind, T.ArrayType):
        return {prefix + "[]", *schema_paths(kind.elementType, prefix + "[]")}
    return {prefix}


def _print(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def fingerprint(paths, layouts=LAYOUTS) -> str:
    known = known_paths(layouts)
    return _print(p for p in paths if p in known)


def prints_of(layout: dict) -> set[str]:
    """The fingerprints of a layout: its paths with each choice of the optional ones."""
    more = layout.get("optional", ())
    return {_print([*layout["paths"], *some]) for n in range(len(more) + 1) for some in combinations(more, n)}


def selector(layouts=LAYOUTS):
    """A function from paths to the layout's name (None if there is none); the prints are worked out once."""
    every, known = {name: prints_of(layout) for name, layout in layouts.items()}, known_paths(layouts)
    by_print = {p: name for name, prints in every.items() for p in prints}
    own = {name: all_paths(layout) for name, layout in layouts.items()}

    def select(paths) -> str | None:
        found = by_print.get(_print(p for p in paths if p in known))
        return found or next((n for n in layouts if _print(p for p in paths if p in own[n]) in every[n]), None)

    return select


def select_layout(paths, layouts=LAYOUTS) -> str | None:
    return selector(layouts)(paths)


def _text(value) -> str:
    if value is None:
        return ""
    if isinstance(value, str):
        try:
            value.encode()
            return value
        except UnicodeEncodeError:  # half a surrogate pair, which JSON can spell but no text may hold
            return value.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    if isinstance(value, list) and all(isinstance(x, (dict, str)) for x in value):
        return "\n".join(x if isinstance(x, str) else _text(x.get("text")) for x in value)
    return json.dumps(value, ensure_ascii=False, sort_keys=True)


def turns_of(record: dict, layout: dict) -> list[tuple[str, str]]:
    """(role, text) pairs of a record of this layout."""
    found = [(r, _text(record.get(p))) for r, p in layout.get("first", ())]
    found = [(r, t) for r, t in found if t.strip()]
    if "each" in layout:
        items, role, text = layout["each"]
        found += [(_text(m.get(role)), _text(m.get(text))) for m in record[items] if isinstance(m, dict)]
    for r, paths in layout.get("turns", ()):
        texts = [_text(record.get(p)) for p in paths]
        found.append((r, "\n".join(t for t in texts if t)))
    return [(ROLE_NAMES.get(r, r), t) for r, t in found]


def records_to_turns(records: DataFrame, json_column: str = "record", layouts=LAYOUTS) -> DataFrame:
    """(conv_id, fingerprint, layout, turn, role, text) of JSON records with ids in ``conv_id``.

    A record of unknown layout, without turns, or that is no JSON object, gives one row with null turn.
    """
    bound_batches(records.sparkSession)  # a worker holds a batch as text, objects and turns at once
    records_only = {name: layout for name, layout in layouts.items() if "columns" not in layout}

    def batches_to_turns(batches):
        select = selector(records_only)

        def convert(record):
            try:
                value = json.loads(record)
                paths = field_paths(value) if isinstance(value, dict) else set()
                name = select(paths) if paths else None
                return fingerprint(paths, records_only), name, turns_of(value, records_only[name]) if name else []
            except (ValueError, RecursionError):
                return fingerprint((), records_only), None, []

        for batch in batches:
            rows = []
            for conv_id, record in zip(batch["conv_id"], batch["record"], strict=True):
                print_, name, found = convert(record or "")
                own = (None if conv_id is None else int(conv_id), print_, name)
                rows += [(*own, k, r, t) for k, (r, t) in enumerate(found)] or [(*own, None, None, None)]
            yield frame(rows, ["conv_id", "fingerprint", "layout", "turn", "role", "text"], "conv_id", "turn")

    # ids travel as text: beside nulls pandas would make them floats
    conv_id = F.col("conv_id").cast("long").cast("string").alias("conv_id")
    picked = records.select(conv_id, F.col(json_column).cast("string").alias("record"))
    return picked.mapInPandas(batches_to_turns, "conv_id long, fingerprint string, layout string, turn long, role string, text string")


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", text)


def format_turns(rows: DataFrame, layouts=LAYOUTS) -> DataFrame:
    """conv_id, turn, piece, loss_start, loss_length of each turn; a conversation is its pieces in order.

    The layout comes from the fingerprint of the table's schema, among the layouts of tables.
    """
    name = select_layout(schema_paths(rows.schema), {n: x for n, x in layouts.items() if "columns" in x})
    if name is None:
        raise ValueError(f"no layout for the columns {rows.columns}")
    at = layouts[name]["columns"]
    role, text = (F.coalesce(F.col(at[c]).cast("string"), F.lit("")) for c in ("role", "text"))
    head = F.concat(F.lit(TURN), escape(role), F.lit(TEXT))
    learned = role == "assistant"
    return rows.select(
        F.col(at["id"]).cast("long").alias("conv_id"),
        F.col(at["order"]).cast("long").alias("turn"),
        F.concat(head, escape(text), F.lit(END)).alias("piece"),
        F.when(learned, F.length(head)).otherwise(0).cast("long").alias("loss_start"),
        F.when(learned, F.length(escape(text))).otherwise(0).cast("long").alias("loss_length"),
    )


def parse_piece(piece: str) -> tuple[str, str]:
    """(role, text) back from a formatted turn."""
    if not (piece.startswith(TURN) and piece.endswith(END)):
        raise ValueError("not a formatted turn")
    role, _, text = piece[len(TURN) : -len(END)].partition(TEXT)
    return unescape(role), unescape(text)


def digest(formatted: DataFrame) -> DataFrame:
    """Reads formatted conversations back, turn by turn in order: hashes are streamed, no conversation is gathered."""
    bound_batches(formatted.sparkSession)
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    names = [c.split()[0] for c in schema.split(", ")]

    def read(batches):
        last, state, out = (), None, []

        def close():
            turns, all_text, loss_chars, loss, chars = state
            return (last[0], turns, all_text.hexdigest(), loss_chars, loss.hexdigest(), chars)

        for batch in batches:
            for conv_id, piece, start, length in zip(batch["conv_id"], batch["piece"], batch["loss_start"], batch["loss_length"], strict=True):
                key = (None if conv_id is None else int(conv_id),)
                if key != last:
                    if last:
                        out.append(close())
                    last, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse_piece(piece)
                learned = unescape(piece[start : start + length])
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(learned)
                state[3].update(learned.encode())
                state[4] += len(piece)
            if out:
                yield frame(out, names, "conv_id")
                out = []
        if last:
            yield frame([close()], names, "conv_id")

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "piece")
    return ordered.select(F.col("conv_id").cast("string").alias("conv_id"), "piece", "loss_start", "loss_length").mapInPandas(read, schema)
