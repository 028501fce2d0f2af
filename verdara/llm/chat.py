"""Chat formatting from typed content parts.

A visitor walks the parts of a turn in order. Text is kept; image, audio and document parts become
placeholders numbered within the turn, each with its attachment's reference and the tokens it expands to.
A turn is written `<|im_start|>role\\ntext<|im_end|>\\n`. In roles and texts every `<`, run of backslashes
and `|` gets one backslash more, so no control string survives inside them and the change reads back
exactly; line feeds and backslashes of a role are escaped as well. The loss mask covers each assistant
text, without its markers.

Rows are formatted one turn at a time and a conversation is the ordered run of its turns' rows, so no task
holds a whole conversation. `digest` streams the sorted rows through running hashes.

Defined cases: null text is empty, a null role an empty role; null conv_ids form one conversation; turns
are ordered by turn (nulls first), ties by role, then text; repeated rows are separate turns; a part of
another type, or of none, is an attachment of kind `unknown` that expands to no tokens, a null part is nothing;
an empty table gives no rows; extra columns are ignored, and so is a `content` that isn't an array of structs with
a string `type`.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType, NumericType, StringType, StructType

from verdara.llm.common import tidy

START, END = "<|im_start|>", "<|im_end|>"
_BARE = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return _BARE.sub(r"<\1\\|", text) if "<" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "<" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


@dataclass(frozen=True)
class Attachment:
    kind: str
    reference: str
    tokens: int
    at: int  # of its placeholder in the flattened text


@dataclass
class Flattener:
    """Visits typed parts; text goes in escaped, the others as placeholders."""

    image_patch: int = 14
    image_merge: int = 2
    audio_per_second: int = 25
    document_per_page: int = 1024
    out: list[str] = field(default_factory=list)
    attachments: list[Attachment] = field(default_factory=list)
    size: int = 0

    def _add(self, text: str) -> None:
        self.out.append(text)
        self.size += len(text)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append(Attachment(kind, part.get("ref") or "", tokens, self.size))
        self._add(f"<|{kind}_{len(self.attachments)}|>")

    def text(self, part: dict) -> None:
        self._add(escape(part.get("text") or ""))

    def image(self, part: dict) -> None:
        side = self.image_patch * self.image_merge
        self._attach("image", part, math.ceil(float(part.get("width") or side) / side) * math.ceil(float(part.get("height") or side) / side))

    def audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil(float(part.get("seconds") or 0) * self.audio_per_second))

    def document(self, part: dict) -> None:
        self._attach("document", part, math.ceil(part.get("pages") or 1) * self.document_per_page)

    def unknown(self, part: dict) -> None:
        self._attach("unknown", part, 0)

    def visit(self, parts: list[dict | None]) -> Flattener:
        handlers = {"text": self.text, "image": self.image, "audio": self.audio, "document": self.document}
        for part in parts:
            if part is not None:
                handlers.get(part.get("type"), self.unknown)(part)
        return self


def format_turn(role: str | None, parts: list[dict]) -> tuple[str, tuple[int, int] | None, list[Attachment]]:
    """(formatted turn, span under the loss mask, attachments)."""
    flat = Flattener().visit(parts)
    head, body = f"{START}{escape_role(role or '')}\n", "".join(flat.out)
    span = (len(head), len(head) + len(body)) if role == "assistant" else None
    return head + body + END + "\n", span, flat.attachments


_FORMATTED = "conv_id {}, turn long, role string, formatted string, loss_start long, loss_end long, attachments array<struct<kind:string,reference:string,tokens:long,at:long>>, extra_tokens long"


def _is_typed(kind: DataType) -> bool:
    if not isinstance(kind, ArrayType) or not isinstance(kind.elementType, StructType):
        return False
    fields = {f.name: f.dataType for f in kind.elementType.fields}
    numbers = all(isinstance(fields[n], NumericType) for n in ("width", "height", "seconds", "pages") if n in fields)
    return isinstance(fields.get("type"), StringType) and numbers and all(isinstance(fields[n], StringType) for n in ("text", "ref") if n in fields)


def format_conversations(turns: DataFrame) -> DataFrame:
    """A row a turn: the formatted text, its loss span, attachments and the tokens they expand to.

    `content`, an array of typed parts, is used if that column exists and isn't null; else `text`.
    """
    kind = dict(turns.dtypes)["conv_id"]
    typed = "content" in turns.columns and _is_typed(turns.schema["content"].dataType)
    columns = [F.col("conv_id"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"), *([F.col("content")] if typed else [])]
    attachment = pa.struct([("kind", pa.string()), ("reference", pa.string()), ("tokens", pa.int64()), ("at", pa.int64())])

    def run(batches):
        for batch in batches:
            role, text = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            content = batch.column(4).to_pylist() if typed else [None] * len(role)
            done = [format_turn(r, [{"type": "text", "text": t}] if c is None else c) for r, t, c in zip(role, text, content, strict=True)]
            spans = [d[1] or (0, 0) for d in done]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), batch.column(2), pa.array([d[0] for d in done], pa.string()), pa.array([s[0] for s in spans], pa.int64()), pa.array([s[1] for s in spans], pa.int64()),
                    pa.array([[vars(a) for a in d[2]] for d in done], pa.list_(attachment)), pa.array([sum(a.tokens for a in d[2]) for d in done], pa.int64()),
                ],
                ["conv_id", "turn", "role", "formatted", "loss_start", "loss_end", "attachments", "extra_tokens"],
            )

    return turns.select(*columns).mapInArrow(tidy(run), _FORMATTED.format(kind))


def digest(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the output."""
    kind = dict(formatted.dtypes)["conv_id"]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        key, open_, n, chars, loss, size = None, False, 0, 0, None, 0
        whole = None
        done: list[tuple] = []

        def close() -> None:
            if open_:
                done.append((key, n, whole.hexdigest(), chars, loss.hexdigest(), size))

        for batch in batches:
            for conv, text, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if not open_ or conv != key:
                    close()
                    key, open_, n, chars, size = conv, True, 0, 0, 0
                    whole, loss = hashlib.sha256(), hashlib.sha256()
                for m in _TURN.finditer(text):
                    whole.update(f"{unescape_role(m[1])}\n{unescape(m[2])}\n".encode())
                    n += 1
                under = unescape(text[a:b])
                loss.update(under.encode())
                chars += len(under)
                size += len(text)
            if done:
                yield _batch(done)
                done.clear()
        close()
        if done:
            yield _batch(done)

    arrow_id = to_arrow_type(formatted.schema["conv_id"].dataType)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [arrow_id, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted")
    return ordered.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(tidy(run), f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
