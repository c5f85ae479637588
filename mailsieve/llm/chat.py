"""Chat formatting with typed content parts.

A message is a role and either a text or a list of parts (text, image, audio, document). ``PartVisitor`` turns the
parts, in their order, into one text in which every attachment is a placeholder, and records its reference and how many
tokens the placeholder expands to. ``format_turns`` renders each message on its own; ``conversations`` brings the
rendered turns of a conversation together in order and gives each its place; ``read_back`` recovers roles, texts and
what is under the loss mask from the rendered text alone.

Template: ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``. Control strings in roles and texts are escaped reversibly: a
backslash is doubled and ``<|`` becomes ``<\\|``, so ``<|`` in the output is always the template's; a line feed in a
role becomes backslash and n. The loss mask covers the texts of ``learned_role``, without the marks.

Turns stream through sorted partitions: a conversation of any length is held one batch at a time. Missing text, parts
or role: empty. Missing conv_id: one conversation of its own. Missing turn: first. Equal turns: by role and text; fully
equal rows all stay. Unknown part types become a document. Other columns are not carried.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
ATTACHMENT = "struct<kind:string,ref:string,at:long,tokens:long>"
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
_TURN = f"formatted string, loss_start long, loss_end long, attachments array<{ATTACHMENT}>, expanded_tokens long"


@dataclass(frozen=True)
class Expansion:
    """How many tokens an attachment stands for."""
    image_tile: int = 28
    audio_per_second: float = 25.0
    document_page: int = 256


@dataclass
class PartVisitor:
    rules: Expansion = Expansion()
    text: list[str] = field(default_factory=list)
    length: int = 0
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part) -> None:
        kind = part["type"]
        getattr(self, f"visit_{kind}" if kind in ("text", "image", "audio") else "visit_document")(part)

    def _put(self, text: str) -> None:
        self.text.append(text)
        self.length += len(text)

    def _attach(self, kind: str, part, tokens: float) -> None:
        self.attachments.append({"kind": kind, "ref": part["ref"], "at": self.length, "tokens": max(1, math.ceil(tokens))})
        self._put(f"<|{kind}|>")

    def visit_text(self, part) -> None:
        self._put(escape(part["text"] or ""))

    def visit_image(self, part) -> None:
        across, down = (math.ceil((part[side] or 0) / self.rules.image_tile) for side in ("width", "height"))
        self._attach("image", part, across * down)

    def visit_audio(self, part) -> None:
        seconds = part["seconds"]
        self._attach("audio", part, (0 if seconds is None or seconds != seconds else seconds) * self.rules.audio_per_second)

    def visit_document(self, part) -> None:
        self._attach("document", part, (part["pages"] or 0) * self.rules.document_page)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


_escaped = re.compile(r"\\(.)", re.DOTALL)


def unescape(text: str) -> str:
    return _escaped.sub(lambda m: "\n" if m[1] == "n" else m[1], text) if "\\" in text else text


def _present(value) -> bool:
    return value is not None and value == value


def format_turns(messages: DataFrame, learned_role: str = "assistant", rules: Expansion = Expansion()) -> DataFrame:
    """conv_id, turn, role, text and, for each message, its rendered text, the loss span in it (empty for other
    roles), its attachments (``at`` counts from the start of the rendered text) and their tokens in all.
    ``messages`` has conv_id, turn, role and text, and may have ``parts`` (array of ``PART``), which then counts
    instead of text unless it is null."""
    parts = F.col("parts").cast(f"array<{PART}>") if "parts" in messages.columns else F.lit(None).cast(f"array<{PART}>")
    kept = messages.select("conv_id", "turn", F.col("role").cast("string"), F.col("text").cast("string"), parts.alias("parts"))

    names = ["formatted", "loss_start", "loss_end", "attachments", "expanded_tokens"]

    @F.pandas_udf(_TURN)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for role, text, given in zip(*batch):
                visitor = PartVisitor(rules)
                for part in [{"type": "text", "text": text if _present(text) else ""}] if given is None else given:
                    if part is not None:
                        visitor.visit(part)
                role = role if _present(role) else ""
                head = f"{START}{escape(role)}\n".replace("\n", "\\n", escape(role).count("\n"))
                end = len(head) + visitor.length if role == learned_role else len(head)
                for a in visitor.attachments:
                    a["at"] += len(head)
                out.append(("".join([head, *visitor.text, END]), len(head), end, visitor.attachments,
                            sum(a["tokens"] for a in visitor.attachments)))
            yield pd.DataFrame({n: [o[k] for o in out] for k, n in enumerate(names)})

    rendered = kept.withColumn("turned", run("role", "text", "parts"))
    return rendered.select("conv_id", "turn", "role", "text", "turned.*")


def conversations(turns: DataFrame) -> DataFrame:
    """Rendered turns, those of a conversation next to each other in one partition and in order."""
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


class _Read:
    """What is read back of one conversation, turn by turn."""

    def __init__(self) -> None:
        self.turns = self.loss = self.chars = 0
        self.all, self.learned = hashlib.sha256(), hashlib.sha256()

    def take(self, formatted: str, loss_start: int, loss_end: int) -> None:
        at = 0
        while at < len(formatted):
            line = formatted.index("\n", at)
            end = formatted.index(END, line)
            role, text = unescape(formatted[at + len(START):line]), unescape(formatted[line + 1:end])
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            self.turns += 1
            at = end + len(END)
        learned = unescape(formatted[loss_start:loss_end])
        self.learned.update(learned.encode("utf-8", "surrogatepass"))
        self.loss += len(learned)
        self.chars += len(formatted)

    def row(self, conversation) -> tuple:
        return conversation, self.turns, self.all.hexdigest(), self.loss, self.learned.hexdigest(), self.chars


READ = ("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def read_back(ordered: DataFrame) -> DataFrame:
    """One row for each conversation of ``conversations``, from the rendered texts and loss spans only."""
    names = ["conv_id", *[c.split()[0] for c in READ.split(", ")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, read, out = None, None, []
        for batch in batches:
            for conversation, formatted, a, b in zip(batch["conv_id"], batch["formatted"], batch["loss_start"], batch["loss_end"]):
                if read is None or conversation != current:
                    if read is not None:
                        out.append(read.row(current))
                    current, read = conversation, _Read()
                read.take(formatted, a, b)
            if out:
                yield pd.DataFrame(out, columns=names)
                out = []
        if read is not None:
            yield pd.DataFrame([read.row(current)], columns=names)

    # ids travel as text: pandas would turn numbers beside a missing one into floats
    kept = ordered.select(F.col("conv_id").cast("string"), "formatted", "loss_start", "loss_end")
    found = kept.mapInPandas(run, f"conv_id string, {READ}")
    return found.withColumn("conv_id", F.col("conv_id").cast("long"))
