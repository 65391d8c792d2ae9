"""Chat formatting by schema fingerprint.

A record (VARIANT) is reduced to its nested field paths; their hash selects a declarative layout that says where the
turns, roles and texts are.  Canonical turns of all records of a conversation are put in order, written with a
template that marks turns and escapes control strings, and given a run-length loss mask over code points.

Defined results: null texts and roles are empty; records of a layout nobody declared keep ``layout`` null and add no
turns (``survey`` counts them); records of a conversation with equal sequence numbers are ordered by their turns;
null sequence numbers come first; a null conversation id is a conversation of its own.  A conversation is one output
row, so its text must fit one row, as must its two digests.  No rows give no conversations.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """``paths`` are the nested fields (``a.b``, ``a[].b``) of one layout.

    Either ``each`` names an array (or ``$`` for the record itself) whose elements have a ``role`` and a ``text``
    path, or ``fixed`` lists (role, paths): one turn per entry, its texts joined by a blank line, none if all lack.
    """

    name: str
    paths: tuple[str, ...]
    each: str = ""
    role: str = ""
    text: str = ""
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: dict[str, str] = field(default_factory=dict)


SHARED_ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
LAYOUTS = (
    Layout("turn_row", ("role", "text"), each="$", role="$.role", text="$.text"),
    Layout("messages", ("messages[].role", "messages[].content"), each="$.messages", role="$.role", text="$.content",
           roles=SHARED_ROLES),
    Layout("conversations", ("conversations[].from", "conversations[].value"), each="$.conversations", role="$.from",
           text="$.value", roles=SHARED_ROLES),
    Layout("prompt", ("prompt", "completion"), fixed=(("user", ("$.prompt",)), ("assistant", ("$.completion",)))),
    Layout("prompt_response", ("prompt", "response"), fixed=(("user", ("$.prompt",)), ("assistant", ("$.response",)))),
    Layout("instruction", ("instruction", "output"),
           fixed=(("user", ("$.instruction",)), ("assistant", ("$.output",)))),
    Layout("instruction_input", ("instruction", "input", "output"),
           fixed=(("user", ("$.instruction", "$.input")), ("assistant", ("$.output",)))),
    Layout("system_messages", ("system", "messages[].role", "messages[].content"), each="$.messages", role="$.role",
           text="$.content", fixed=(("system", ("$.system",)),), roles=SHARED_ROLES),
)


def paths_text(paths: tuple[str, ...]) -> str:
    """The text whose hash is the fingerprint of records with these paths."""
    tree: dict = {}
    for p in paths:
        node = tree
        for part in p.split("."):
            node = node.setdefault(part, {})

    def show(node: dict) -> str:
        parts = []
        for name in sorted(node):
            key, inner = name.removesuffix("[]"), show(node[name]) if node[name] else ""
            kind = f"ARRAY<{inner}>" if name.endswith("[]") else inner
            parts.append(f"{key}: {kind}" if kind else key)
        return f"OBJECT<{', '.join(parts)}>"

    return show(tree)


def field_paths(record: Column) -> Column:
    """Nested field names of a record, without the types of its values."""
    return F.regexp_replace(F.schema_of_variant(record), ": (?!OBJECT<|ARRAY<)[A-Z_]+(\\([0-9, ]*\\))?", "")


def fingerprint(record: Column) -> Column:
    return F.xxhash64(field_paths(record))


def _turns(record: Column, layout: Layout) -> Column:
    text = lambda v, path: F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))

    def role(name: Column) -> Column:
        for old, new in layout.roles.items():
            name = F.when(name == old, new).otherwise(name)
        return name

    parts = []
    for name, paths in layout.fixed:
        texts = F.filter(F.array(*[text(record, p) for p in paths]), lambda t: t != "")
        parts.append(F.when(F.size(texts) > 0, F.array(F.struct(F.lit(name).alias("role"), F.array_join(
            texts, "\n\n").alias("text")))).otherwise(F.array().cast(TURNS)))
    if layout.each:
        items = F.array(record) if layout.each == "$" else F.coalesce(
            F.try_variant_get(record, layout.each, "array<variant>"), F.array().cast("array<variant>"))
        parts.append(F.transform(items, lambda v: F.struct(role(text(v, layout.role)).alias("role"),
                                                           text(v, layout.text).alias("text"))))
    return F.concat(*parts).cast(TURNS)


def canonical(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(conv_id, seq, record) -> (conv_id, seq, layout, turns)."""
    keyed = records.select("conv_id", "seq", "record", fingerprint(F.col("record")).alias("_fp"))
    name, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    for la in layouts:
        here = F.col("_fp") == F.xxhash64(F.lit(paths_text(la.paths)))
        name, turns = F.when(here, la.name).otherwise(name), F.when(here, _turns(F.col("record"), la)).otherwise(turns)
    return keyed.select("conv_id", "seq", name.alias("layout"), turns.alias("turns"))


def survey(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Counts by fingerprint, with the layout's name or null: what still needs a declaration."""
    known = {paths_text(la.paths): la.name for la in layouts}
    name = F.lit(None).cast("string")
    for text, la in known.items():
        name = F.when(F.col("paths") == text, la).otherwise(name)
    return records.groupBy(field_paths(F.col("record")).alias("paths")).agg(F.count(F.lit(1)).alias("n")).select(
        F.xxhash64("paths").alias("fingerprint"), "paths", name.alias("layout"), "n")


# ---------------------------------------------------------------- template
OPEN, CLOSE = "<s>", "</s>\n"
#: control strings, by their first character and the rest; a backslash between the two makes them plain text
CONTROL = "([<\\[])(/?s>|/?INST\\]|\\|im_start\\|>|\\|im_end\\|>|\\|endoftext\\|>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, "$1\\\\$2")


def format_turns(canon: DataFrame) -> DataFrame:
    """(conv_id, seq, turns) -> (conv_id, formatted, mask): mask is [(code points, trained on)] over ``formatted``."""
    whole = canon.groupBy("conv_id").agg(F.flatten(F.transform(
        F.sort_array(F.collect_list(F.struct("seq", "turns"))), lambda r: r["turns"])).alias("_turns"))
    parts = F.transform("_turns", lambda t: F.struct(
        F.concat(F.lit(OPEN), F.replace(escape(t["role"]), F.lit("\n"), F.lit("\\\n")), F.lit("\n")).alias("head"),
        escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss")))
    run = lambda n, loss: F.struct(n.cast("bigint").alias("n"), loss.alias("loss"))
    return whole.withColumn("_p", parts).select(
        "conv_id",
        F.array_join(F.transform("_p", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.flatten(F.transform("_p", lambda p: F.array(
            run(F.length(p["head"]), F.lit(False)), run(F.length(p["body"]), p["loss"]),
            run(F.lit(len(CLOSE)), F.lit(False))))).alias("mask"))


_ESCAPED = re.compile(r"\\(.)", re.S)
_HEAD = re.compile(r"((?:[^\\\n]|\\.)*+)\n", re.S)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted conversation."""
    out = []
    for turn in formatted.split(OPEN)[1:]:
        head = _HEAD.match(turn)
        out.append((unescape(head[1]), unescape(turn[head.end():-len(CLOSE)])))
    return out


def trained_on(formatted: str, mask) -> str:
    """All text under the loss mask, unescaped."""
    at, out = 0, []
    for run in mask:
        if run["loss"]:
            out.append(unescape(formatted[at:at + run["n"]]))
        at += run["n"]
    return "".join(out)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of turns and trained text, taken from the formatted output alone."""

    @F.pandas_udf("n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string")
    def digests(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for texts, masks in batches:
            rows = []
            for text, mask in zip(texts, masks, strict=True):
                turns, loss = parse(text), trained_on(text, mask)
                rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)))
            yield pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256"])

    return formatted.withColumn("_d", digests("formatted", "mask")).select(
        "conv_id", "_d.*", F.length("formatted").cast("bigint").alias("formatted_chars"))
