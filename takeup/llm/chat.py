"""Chat formatting with a template that is only ever called, never inspected.

A template turns a list of (role, text) into a string. Rendering successive prefixes of a
conversation and comparing each output with the one before gives the span that a turn added;
if the earlier output is not a prefix of the later one, the template rewrites history and the
turn is counted in ``rewrites``. The part of an assistant turn to learn from lies between the
render with a generation prompt and the closing markup, whose length the same turn with
an empty text shows.

Spans hold for the final output. Those that reach beyond the place of a later rewrite, and turns whose markup was not
recognised, are looked for anew: the text is marked at both ends in an otherwise equal conversation, and if the output differs
by the two marks alone, the text stands between them. What is not found so has no span (null), and if it was to be
learnt from, it is counted in ``lost_loss``: nothing but what the template makes of a learnt turn's own text is ever under the mask. Every
learnt turn costs four renders of its prefix, so the work grows with the square of a conversation's length.

Conversations are grouped with their rows sorted by turn, then role and text; a conversation is
the unit of work, as its rendering needs all of it. Null texts and roles are empty, a null
conversation id is a conversation of its own, a repeated row is a further turn. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from takeup.llm.common import bounded_batches

Turns = list[tuple[str, str]]
Template = Callable[[Turns, bool], str]

#: Markup of the default template. A backslash after the first character takes the meaning away.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[TEXT]", "[/ROLE]")
_SPECIAL = re.compile("|".join(re.escape(c) for c in ("\\", *CONTROL)))
_TURN = re.compile(r"<s>\[INST\] (?P<user>.*) \[/INST\]| (?P<assistant>.*) </s>|"
                   r"<s>\[ROLE\] (?P<role>.*) \[TEXT\] (?P<text>.*) \[/ROLE\]", re.DOTALL)
OUTPUT = ("struct<formatted string, turns array<struct<role string, start int, stop int>>,"
          " loss array<struct<start int, stop int>>, rewrites int, lost_loss int>")


def escape(text: str) -> str:
    return _SPECIAL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)|\\$", lambda m: m[1] or "\\", text, flags=re.DOTALL)


_marked: dict[tuple[str, str], str] = {}


def _markup(turn: tuple[str, str]) -> str:
    role, text = turn
    if role == "user":
        return f"<s>[INST] {escape(text)} [/INST]"
    if role == "assistant":
        return f" {escape(text)} </s>"
    return f"<s>[ROLE] {escape(role)} [TEXT] {escape(text)} [/ROLE]"


def instruct_template(turns: Turns, generation_prompt: bool = False) -> str:
    """The default template. It remembers turns it has seen, as prefixes repeat them, until ``forget``."""
    out = []
    for turn in turns:
        known = _marked.get(turn)
        if known is None:
            known = _marked[turn] = _markup(turn)
        out.append(known)
    return "".join(out) + " " * generation_prompt


instruct_template.forget = _marked.clear


def read_turn(segment: str) -> tuple[str, str]:
    """Role and text of one formatted turn of the default template."""
    m = _TURN.fullmatch(segment)
    if m["user"] is not None:
        return "user", unescape(m["user"])
    if m["assistant"] is not None:
        return "assistant", unescape(m["assistant"])
    return unescape(m["role"]), unescape(m["text"])


def _common(a: str, b: str) -> int:
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:  # the longest common prefix, by halving
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return low


_OPEN, _CLOSE = "\ue000", "\ue001"


def find_text(turns: Turns, at: int, template: Template, final: str) -> tuple[int, int] | None:
    """Where the text of a turn stands in the final output, if marks around it are all that changes."""
    role, text = turns[at]
    marked = template([*turns[:at], (role, _OPEN + text + _CLOSE), *turns[at + 1:]], False)
    if _OPEN in final or _CLOSE in final or marked.count(_OPEN) != 1 or marked.count(_CLOSE) != 1:
        return None
    start, stop = marked.index(_OPEN), marked.index(_CLOSE) - 1
    return (start, stop) if start <= stop and marked[:start] + marked[start + 1:stop + 1] + marked[stop + 2:] == final else None


def render(turns: Turns, template: Template, learn: tuple[str, ...] = ("assistant",)) -> dict:
    """Final output, span of every turn, spans to learn from, turns that rewrote history, learnt turns without a span."""
    before, spans, loss, rewrites = template([], False), [], {}, 0
    unsure: set[int] = set()
    for i, (role, text) in enumerate(turns):
        now = template(turns[:i + 1], False)
        start = _common(before, now)
        if start < len(before):
            rewrites += 1
            unsure |= {j for j in range(i) if spans[j]["stop"] > start}
            unsure.add(i)
        spans.append({"role": role, "start": start, "stop": len(now)})
        if role in learn:
            opened, empty = template(turns[:i], True), template([*turns[:i], (role, "")], False)
            closing = len(empty) - len(opened)
            if now.startswith(opened) and closing >= 0 and empty.endswith(now[len(now) - closing:] if closing else ""):
                loss[i] = {"start": len(opened), "stop": len(now) - closing}
            else:
                loss[i] = None
        before = now
    lost = 0
    for i in sorted(unsure | {i for i, span in loss.items() if span is None}):
        place = find_text(turns, i, template, before)
        if i in unsure:
            spans[i].update(start=place and place[0], stop=place and place[1])
        if i in loss:
            loss[i] = {"start": place[0], "stop": place[1]} if place else None
            lost += place is None
    return {"formatted": before, "turns": spans, "loss": [loss[i] for i in sorted(loss) if loss[i]], "rewrites": rewrites, "lost_loss": lost}


def format_conversations(rows: DataFrame, template: Template = instruct_template, id_column: str = "conv_id",
                         turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """One row per conversation: id, formatted, turns, loss, rewrites, lost_loss (positions in code points)."""
    bounded_batches(rows.sparkSession)

    @F.arrow_udf(OUTPUT)
    def formatted(conversations: pa.Array) -> pa.Array:
        span = [("start", pa.int32()), ("stop", pa.int32())]
        kind = pa.struct([("formatted", pa.string()), ("turns", pa.list_(pa.struct([("role", pa.string()), *span]))),
                          ("loss", pa.list_(pa.struct(span))), ("rewrites", pa.int32()), ("lost_loss", pa.int32())])
        out = []
        for c in conversations:
            out.append(render([(t["role"], t["text"]) for t in c.as_py()], template))
            getattr(template, "forget", list)()
        return pa.array(out, type=kind)

    empty = F.lit("")
    turns = rows.select(F.col(id_column), F.struct(
        F.col(turn_column).alias("turn"), F.coalesce(F.col(role_column), empty).alias("role"),
        F.coalesce(F.col(text_column), empty).alias("text")).alias("t"))
    whole = turns.groupBy(id_column).agg(F.array_sort(F.collect_list("t")).alias("c"))
    return whole.select(id_column, formatted(F.transform("c", lambda t: F.struct(
        t["role"].alias("role"), t["text"].alias("text")))).alias("o")).select(id_column, "o.*")


DIGESTS = "struct<n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long>"


def said(formatted: pa.Array, turns: pa.Array, loss: pa.Array) -> pa.Array:
    """Digests of what the formatted text of the default template says."""
    def digest(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    out = []
    for text, spans, mask in zip(formatted.to_pylist(), turns.to_pylist(), loss.to_pylist()):
        read = [read_turn(text[s["start"]:s["stop"]]) for s in spans]
        learnt = "".join(unescape(text[s["start"]:s["stop"]]) for s in mask)
        out.append({"n_turns": len(read), "turns_sha256": digest("".join(f"{r}\n{t}\n" for r, t in read)),
                    "loss_chars": len(learnt), "loss_sha256": digest(learnt), "formatted_chars": len(text)})
    return pa.array(out, type=pa.struct([("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                                         ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))


def chat_report(rows: DataFrame) -> DataFrame:
    """Digests read back from the formatted conversations."""
    done, read_back = format_conversations(rows), F.arrow_udf(said, DIGESTS)
    return done.select("conv_id", read_back("formatted", "turns", "loss").alias("r"), "rewrites").select(
        "conv_id", "r.*", "rewrites")
