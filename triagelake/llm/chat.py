r"""Conversations of typed content parts as marked text.

A visitor flattens the parts of a turn: text is escaped, images, audio and documents become placeholders in their order, and each is
recorded with its reference, its place in the text and the number of tokens that it expands to. A turn is
`<|im_start|>role\ncontent<|im_end|>\n`. Texts that hold control strings are escaped: a backslash goes between `<` and `|`, one more
where there are some already, so that no text makes a `<|`, and unescaping gives the text again. In a role, backslashes and line ends are escaped too.

Turns are sorted in ranges of (conversation, turn) and put together in chunks of whole turns of about `CHUNK` characters; nearly every conversation is
one chunk. A conversation with very many turns is spread over ranges, and no more than a chunk and a turn of it is in memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters from which a chunk is closed.
CHUNK = 1 << 20
PART = "struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
START, END = "<|im_start|>", "<|im_end|>"
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
_HELD = re.compile(r"<\\(\\*)\|")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: str) -> str:
    return _HELD.sub(r"<\1|", text)


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


@dataclass(frozen=True)
class PartVisitor:
    """What becomes of each type of part: its kind, and the number of tokens that its placeholder stands for. Numbers that are missing or
    negative count as 0, and every attachment is one token at least.

    Images take a token for each square of `patch` pixels that they touch, audio `per_second`, documents `per_page`.
    """

    patch: int = 28
    per_second: float = 12.5
    per_page: int = 256

    def visit_image(self, part: Column) -> Column:
        side = lambda n: F.ceil(part[n] / F.lit(float(self.patch)))
        return side("width") * side("height")

    def visit_audio(self, part: Column) -> Column:
        return F.ceil(part["seconds"] * F.lit(self.per_second))

    def visit_document(self, part: Column) -> Column:
        return part["pages"].cast("long") * self.per_page

    def visit(self, part: Column) -> tuple[Column, Column]:
        """(kind, tokens) of a part that isn't text; a type that is unknown is an attachment of one token."""
        kinds = {"image": self.visit_image, "audio": self.visit_audio, "document": self.visit_document}
        kind, tokens = F.lit("attachment"), F.lit(1).cast("long")
        for name, of in kinds.items():
            kind, tokens = F.when(part["type"] == name, F.lit(name)).otherwise(kind), F.when(part["type"] == name, of(part)).otherwise(tokens)
        return kind, F.greatest(F.coalesce(tokens.cast("long"), F.lit(1)), F.lit(1)).cast("long")

    def flatten(self, parts: Column) -> Column:
        """struct(content, attachments, runs) of an array of parts (PART), null parts and arrays counting as none.

        attachments have kind, ref, at (characters of the content before the placeholder) and tokens; runs (at, n) are the stretches of text.
        Texts without an attachment between them are one stretch: it is escaped as a whole.
        """
        attachment, stretch = "array<struct<kind: string, ref: string, at: int, tokens: bigint>>", "array<struct<at: int, n: int>>"
        empty = F.struct(F.lit("").alias("content"), F.lit("").alias("run"), F.array().cast(attachment).alias("attachments"), F.array().cast(stretch).alias("runs"))

        def closed(acc: Column) -> tuple[Column, Column]:
            text = escape(acc["run"])
            run = F.struct(F.length(acc["content"]).alias("at"), F.length(text).alias("n"))
            return F.concat(acc["content"], text), F.when(acc["run"] == "", acc["runs"]).otherwise(F.concat(acc["runs"], F.array(run)))

        def add(acc: Column, part: Column) -> Column:
            content, runs = closed(acc)
            kind, tokens = self.visit(part)
            found = F.struct(kind.alias("kind"), part["ref"].alias("ref"), F.length(content).alias("at"), tokens.alias("tokens"))
            placed = F.struct(F.concat(content, F.lit("<|"), kind, F.lit("|>")).alias("content"), F.lit("").alias("run"), F.concat(acc["attachments"], F.array(found)).alias("attachments"), runs.alias("runs"))
            more = F.struct(acc["content"].alias("content"), F.concat(acc["run"], F.coalesce(part["text"], F.lit(""))).alias("run"), acc["attachments"].alias("attachments"), acc["runs"].alias("runs"))
            return F.when(F.coalesce(part["type"], F.lit("text")) == "text", more).otherwise(placed)

        def finish(acc: Column) -> Column:
            content, runs = closed(acc)
            return F.struct(content.alias("content"), acc["attachments"].alias("attachments"), runs.alias("runs"))

        given = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
        return F.aggregate(given, empty, add, finish)


def text_part(text: Column) -> Column:
    """An array of one text part."""
    null = lambda kind: F.lit(None).cast(kind)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), null("string").alias("ref"), null("int").alias("width"), null("int").alias("height"), null("double").alias("seconds"), null("int").alias("pages")))


_CHUNKS = "conv_id long, range int, chunk int, formatted string, n_turns int, loss array<struct<at: int, n: int>>, attachments array<struct<kind: string, ref: string, at: int, tokens: bigint>>, n_tokens long"


def _table(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    """Rows whose first column is a whole number or null; pandas would make floats of those."""
    return pd.DataFrame(rows, columns=columns).assign(conv_id=pd.array([r[0] for r in rows], "Int64"))


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Marked turns in order to chunks; places in a turn become places in its chunk."""
    at, columns, chunk = TaskContext.get().partitionId(), [c.split()[0] for c in re.sub(r"<.*?>(?=,)", "", _CHUNKS).split(", ")], 0
    held: dict | None = None

    def row() -> tuple:
        return (held["conv"], at, chunk, "".join(held["texts"]), len(held["texts"]), held["loss"], held["attachments"], sum(a["tokens"] for a in held["attachments"]))

    for batch in batches:
        out = []
        for conv, marked, n, head, loss, runs, attachments in zip(*(batch[c] for c in ("conv", "marked", "n", "head", "in_loss", "runs", "attachments")), strict=True):
            conv = None if conv is None else int(conv)
            if held is not None and (held["conv"] != conv or held["n"] >= CHUNK):
                out.append(row())
                chunk, held = (chunk + 1 if held["conv"] == conv else 0), None
            held = held or {"conv": conv, "n": 0, "texts": [], "loss": [], "attachments": []}
            start = held["n"] + int(head)
            held["texts"].append(marked)
            held["loss"] += [{"at": start + r["at"], "n": r["n"]} for r in runs] if loss else []
            held["attachments"] += [{**a, "at": start + a["at"]} for a in (x if isinstance(x, dict) else x.asDict() for x in attachments)]
            held["n"] += int(n)
        yield _table(out, columns)
    if held is not None:
        yield _table([row()], columns)


def format_conversations(turns: DataFrame, *, visitor: PartVisitor = PartVisitor(), loss_role: str = "assistant") -> DataFrame:
    """Chunks of formatted conversations: conv_id, range, chunk, formatted, n_turns, loss, attachments, n_tokens.

    `turns` has conv_id (long), turn (any order, null first), role and parts (an array of PART). loss lists the stretches of text of
    `loss_role` turns, in characters of the chunk; attachments list the placeholders likewise, n_tokens is what they expand to. The chunks of a conversation in
    order of (range, chunk) are the conversation. Rows with a null conv_id are one conversation; null roles and texts are empty; equal turns go by role and content.
    """
    flat = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), visitor.flatten(F.col("parts")).alias("f"))
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    flat = flat.select("conv_id", F.col("conv_id").cast("string").alias("conv"), "turn", "role", F.concat(head, "f.content", F.lit(f"{END}\n")).alias("marked"), F.length(head).alias("head"), (F.col("role") == loss_role).alias("in_loss"), "f.runs", "f.attachments")
    order = ["conv_id", "turn", "role", "marked"]
    dealt = flat.withColumn("n", F.length("marked")).repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.mapInPandas(_chunks, _CHUNKS)


_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chunks in order, those of a conversation together, to a row for each conversation."""
    columns, conv, row, out = [c.split()[0] for c in _READ.split(", ")], None, None, []

    def ended() -> tuple:
        return (conv, row["turns"], row["all"].hexdigest(), row["loss"], row["learned"].hexdigest(), row["chars"])

    for batch in batches:
        for c, text, spans in zip(batch["conv"], batch["formatted"], batch["loss"], strict=True):
            c = None if c is None else int(c)
            if row is None or c != conv:
                if row is not None:
                    out.append(ended())
                conv, row = c, {"turns": 0, "all": hashlib.sha256(), "loss": 0, "learned": hashlib.sha256(), "chars": 0}
            place = 0
            for m in _TURN.finditer(text):
                if m.start() != place:
                    raise ValueError(f"conversation {conv}: no turn at {place}")
                place = m.end()
                row["turns"] += 1
                row["all"].update(f"{unescape_role(m[1])}\n{unescape(m[2])}\n".encode())
            if place != len(text):
                raise ValueError(f"conversation {conv}: no turn at {place}")
            for s in spans:
                learned = unescape(text[s["at"] : s["at"] + s["n"]])
                row["loss"] += len(learned)
                row["learned"].update(learned.encode())
            row["chars"] += len(text)
        yield _table(out, columns)
        out = []
    if row is not None:
        yield _table([ended()], columns)


def read_back(chunks: DataFrame) -> DataFrame:
    """One row a conversation from formatted chunks: n_turns, turns_sha256 (of role, line end, content, line end of each turn, unescaped), loss_chars, loss_sha256
    (of all text under the mask, unescaped), formatted_chars. Text that isn't a sequence of marked turns is an error.

    SHA-256 takes its input in order, so the chunks of one conversation are read by one task, one at a time.
    """
    rows = chunks.select(F.col("conv_id").cast("string").alias("conv"), "range", "chunk", "formatted", "loss")
    return rows.repartition("conv").sortWithinPartitions("conv", "range", "chunk").mapInPandas(_read_back, _READ)
