"""Chat formatting with a grammar round trip.

A conversation is rendered with control strings around its turns, parsed again
by a deterministic parser, and compared with its source.  Turns whose content
conflicts with the grammar are escaped, more broadly each time, until the
parser gives back exactly what went in.

Rows arrive sorted by conversation and turn, so a task holds one part of one
conversation at a time, however long the conversation is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMATTED = "conv_id long, part int, n_turns int, escaped int, formatted string, loss_spans array<struct<start:int,end:int>>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_escaped long, n_parts long"


@dataclass(frozen=True)
class Template:
    """Control strings; a turn is opening, text, closing.

    marks: role -> (opening, what precedes the closing control, closing control).
    An opening may be plain text for one role, here the assistant's.  Other
    roles are named inside ``other``'s opening.
    """

    begin: str = "<s>"
    marks: dict = field(
        default_factory=lambda: {
            "system": ("<<SYS>>\n", "\n", "<</SYS>>"),
            "user": ("[INST] ", " ", "[/INST]"),
            "assistant": (" ", "", "</s>"),
        }
    )
    other: tuple = ("[TURN]", "", "[/TURN]")
    controls: tuple = ("<<SYS>>", "<</SYS>>", "<s>", "</s>", "[INST]", "[/INST]", "[TURN]", "[/TURN]")
    loss_roles: tuple = ("assistant",)

    def __post_init__(self):
        any_control = "|".join(re.escape(c) for c in self.controls)
        heads = "".join(sorted({c[0] for c in self.controls}))
        put = lambda k, v: object.__setattr__(self, k, v)
        put("token", re.compile(rf"\\[\\{re.escape(heads)}]|{any_control}"))
        put("undo", re.compile(rf"\\([\\{re.escape(heads)}])"))
        put("narrow", re.compile(rf"\\|{any_control}"))
        put("broad", re.compile(rf"[\\{re.escape(heads)}]"))

    def escape(self, text: str, level: int) -> str:
        """Level 0: as it is; 1: backslashes and control strings; 2: every character that can begin one."""
        return text if not level else (self.narrow if level == 1 else self.broad).sub(r"\\\g<0>", text)

    def unescape(self, text: str) -> str:
        return self.undo.sub(r"\1", text) if "\\" in text else text

    def render(self, role: str, text: str, level: int) -> tuple[str, int, int]:
        """The turn, and where its text starts and ends in it."""
        if role in self.marks:
            opening, before, closing = self.marks[role]
        else:
            (mark, before, closing) = self.other
            opening = f"{mark} {self.escape(role, 2)}{mark}\n"
        body = self.escape(text, level)
        return f"{opening}{body}{before}{closing}", len(opening), len(opening) + len(body)

    def _control(self, s: str, at: int) -> tuple[int, str]:
        """The next control string from a place that isn't escaped."""
        for m in self.token.finditer(s, at):
            if m[0][0] != "\\":
                return m.start(), m[0]
        raise ValueError("the text ends inside a turn")

    def parse(self, s: str) -> list[tuple[str, str, int, int]]:
        """(role, text, start, end) of each turn; ValueError where the grammar is broken."""
        at, turns = len(self.begin) if s.startswith(self.begin) else 0, []
        named = f"{self.other[0]} "
        plain = next((r for r, (o, _, _) in self.marks.items() if not any(c in o for c in self.controls)), None)
        while at < len(s):
            role = next((r for r, (o, _, _) in self.marks.items() if r != plain and s.startswith(o, at)), None)
            if role is None and s.startswith(named, at):
                start, c = self._control(s, at + len(named))
                if c != self.other[0] or s[start + len(c) : start + len(c) + 1] != "\n":
                    raise ValueError("a turn's name isn't closed")
                role, at, (_, before, closing) = self.unescape(s[at + len(named) : start]), start + len(c) + 1, self.other
            else:
                role = plain if role is None else role
                if role is None or not s.startswith(self.marks[role][0], at):
                    raise ValueError("no turn begins here")
                opening, before, closing = self.marks[role]
                at += len(opening)
            end, c = self._control(s, at)
            inner = end - len(before)
            if c != closing or inner < at or s[inner:end] != before:
                raise ValueError("a turn is closed by something else")
            turns.append((role, self.unescape(s[at:inner]), at, inner))
            at = end + len(closing)
        return turns

    def same(self, s: str, turns: list[tuple[str, str]]) -> bool:
        try:
            return [t[:2] for t in self.parse(s)] == turns
        except ValueError:
            return False

    def round_trip(self, turns: list[tuple[str, str]], first: bool = True) -> tuple[str, list[tuple[int, int]], int]:
        """Rendered text, spans under the loss mask, and the number of escaped turns."""
        levels = [0] * len(turns)
        for _ in range(3):
            out, at, spans = [self.begin] if first else [], len(self.begin) if first else 0, []
            for (role, text), level in zip(turns, levels, strict=True):
                s, a, b = self.render(role, text, level)
                if role in self.loss_roles:
                    spans.append((at + a, at + b))
                out.append(s)
                at += len(s)
            if self.same(whole := "".join(out), turns):
                return whole, spans, sum(map(bool, levels))
            bad = {i for i, t in enumerate(turns) if not self.same(self.render(*t, levels[i])[0], [t])}
            levels = [min(2, level + (i in bad or not bad)) for i, level in enumerate(levels)]
        raise ValueError("the grammar can't hold this conversation")


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(n).to_pylist() for n in names), strict=True)


def _batches(rows: Iterator[dict], schema: pa.Schema, chars: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r.get("formatted") or "") + 100
        if size > chars:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def format_chats(convs: DataFrame, template: Template | None = None, part_chars: int = 1 << 24) -> DataFrame:
    """Render conversations, one row for each, as in FORMATTED.

    A conversation over ``part_chars`` characters is spread over several parts
    at turn boundaries, numbered from 0; joined in order they are its text.
    Rows are ordered by turn, then role, then text, so ties have one result and
    repeated rows are repeated turns.  A null text or role counts as empty, and
    null turns come first.  Rows with a null conv_id form one conversation.  An
    empty table gives an empty result.  Other columns are ignored.
    """
    template = template or Template()
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("n_turns", pa.int32()), ("escaped", pa.int32()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])

    def rendered(rows: Iterator[tuple]) -> Iterator[dict]:
        key, turns, size, part = (), [], 0, 0

        def flush() -> dict:
            s, spans, escaped = template.round_trip(turns, part == 0)
            return {"conv_id": key[0], "part": part, "n_turns": len(turns), "escaped": escaped, "formatted": s, "loss_spans": [{"start": a, "end": b} for a, b in spans]}

        for conv, role, text in rows:
            if turns and (key != (conv,) or size > part_chars):
                yield flush()
                part, turns, size = part + 1 if key == (conv,) else 0, [], 0
            key = (conv,)
            turns.append((role, text))
            size += len(text)
        if turns:
            yield flush()

    rows = (
        convs.select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )
    return rows.mapInArrow(lambda it: _batches(rendered(_rows(it, ["conv_id", "role", "text"])), schema), FORMATTED)


def read_chats(formatted: DataFrame, template: Template | None = None, ordered: bool = False) -> DataFrame:
    """Parse what format_chats() made and digest each conversation, as in DIGESTS.

    ordered: the parts of a conversation already follow each other in one
    partition, as they do straight after format_chats().

    Rows with a null conv_id are one conversation.  Parts are streamed, so a
    conversation of any length needs the memory of one part.  Repeated rows are
    repeated parts.  A null text is an error, as the formatter writes none.  An
    empty table gives an empty result; other columns are ignored.
    """
    template = template or Template()
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_escaped", pa.int64()), ("n_parts", pa.int64())])

    def digests(rows: Iterator[tuple]) -> Iterator[dict]:
        key, now = None, None

        def done() -> dict:
            return {**now, "turns_sha256": all_turns.hexdigest(), "loss_sha256": loss.hexdigest()}

        for conv, escaped, s, spans in rows:
            if now is None or key != (conv,):
                if now is not None:
                    yield done()
                key, all_turns, loss = (conv,), hashlib.sha256(), hashlib.sha256()
                now = {"conv_id": conv, "n_turns": 0, "loss_chars": 0, "formatted_chars": 0, "n_escaped": 0, "n_parts": 0}
            for role, text, _, _ in template.parse(s):
                all_turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                now["n_turns"] += 1
            for span in spans:
                text = template.unescape(s[span["start"] : span["end"]])
                loss.update(text.encode("utf-8", "surrogatepass"))
                now["loss_chars"] += len(text)
            now["formatted_chars"] += len(s)
            now["n_escaped"] += escaped
            now["n_parts"] += 1
        if now is not None:
            yield done()

    if not ordered:
        formatted = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return formatted.mapInArrow(lambda it: _batches(digests(_rows(it, ["conv_id", "escaped", "formatted", "loss_spans"])), schema), DIGESTS)
