"""Chat formatting: typed content parts, flattened by a visitor into one text with attachments and a loss mask."""

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby
from math import ceil
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ChatParams(NamedTuple):
    #: tokens that attachments stand for: pixels to a side of a patch, audio frames a second, tokens of a page
    patch: int = 14
    frames: int = 25
    page: int = 256
    trained_roles: tuple[str, ...] = ("assistant",)


TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: fixed values: strings that some chat template gives a meaning; none may stand in a formatted text but as this template's own mark
CONTROL = (
    TURN, BODY, END, "<|image|>", "<|audio|>", "<|document|>",
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|user|>", "<|assistant|>", "<|system|>",
    "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>", "<bos>", "<eos>", "<start_of_turn>", "<end_of_turn>",
)
_CONTROL = re.compile(r"\\|" + "|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """Double each backslash, and put one after the first character of each control string. Control strings don't overlap, so none is left."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


class Part(NamedTuple):
    kind: str  # text, image, audio or document
    text: str | None = None
    uri: str | None = None
    width: int | None = None
    height: int | None = None
    seconds: float | None = None
    pages: int | None = None


class Flatten:
    """Visits the parts of a conversation's turns in order. It gathers the formatted text, the attachments (kind, uri,
    tokens, place of the placeholder) and the spans to train on (from, to); places are in code points."""

    def __init__(self, params: ChatParams = ChatParams()):
        self.params, self.out, self.size, self.turns = params, [], 0, 0
        self.attachments: list[tuple[str, str | None, int, int]] = []
        self.spans: list[tuple[int, int]] = []

    def _put(self, text: str) -> None:
        self.out.append(text)
        self.size += len(text)

    def turn(self, role: str, parts: list[Part]) -> None:
        self._put(TURN + escape(role) + BODY)
        self.turns += 1
        begin = self.size
        for kind, run in groupby(parts, lambda part: part.kind):
            visit = getattr(self, f"visit_{kind}")
            if kind == "text":  # neighbours are one text: a control string could be dealt out over them
                visit(Part("text", "".join(part.text or "" for part in run)))
            else:
                for part in run:
                    visit(part)
        if role in self.params.trained_roles:
            self.spans.append((begin, self.size))
        self._put(END)

    def visit_text(self, part: Part) -> None:
        self._put(escape(part.text or ""))

    def visit_image(self, part: Part) -> None:
        side = self.params.patch
        self._attach(part, ceil((part.width or 0) / side) * ceil((part.height or 0) / side))

    def visit_audio(self, part: Part) -> None:
        self._attach(part, ceil((part.seconds or 0) * self.params.frames))

    def visit_document(self, part: Part) -> None:
        self._attach(part, (part.pages or 0) * self.params.page)

    def _attach(self, part: Part, tokens: int) -> None:
        self.attachments.append((part.kind, part.uri, tokens, self.size))
        self._put(f"<|{part.kind}|>")


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text; placeholders stay as they are."""
    turns = []
    for piece in formatted.split(TURN)[1:]:
        role, _, rest = piece.partition(BODY)
        turns.append((unescape(role), unescape(rest.removesuffix(END))))
    return turns


FORMATTED = "conv_id long, n_turns long, formatted string, spans array<struct<from:long,to:long>>, attachments array<struct<kind:string,uri:string,tokens:long,at:long>>"
_FORMATTED = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("n_turns", pa.int64()),
        ("formatted", pa.string()),
        ("spans", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))),
        ("attachments", pa.list_(pa.struct([("kind", pa.string()), ("uri", pa.string()), ("tokens", pa.int64()), ("at", pa.int64())]))),
    ]
)


def _format(params: ChatParams, typed: bool):
    def done(conv_id: int | None, f: Flatten) -> dict:
        return {"conv_id": conv_id, "n_turns": f.turns, "formatted": "".join(f.out), "spans": [{"from": a, "to": b} for a, b in f.spans], "attachments": [dict(zip(("kind", "uri", "tokens", "at"), x, strict=True)) for x in f.attachments]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, flat = None, None  # the conversation that the next rows may go on with
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if flat is None or r["conv_id"] != open_:
                    if flat is not None:
                        out.append(done(open_, flat))
                    open_, flat = r["conv_id"], Flatten(params)
                parts = [Part(**p) for p in r["parts"] or []] if typed else [Part("text", r["text"])]
                flat.turn(r["role"] or "", parts)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_FORMATTED)
        if flat is not None:
            yield pa.RecordBatch.from_pylist([done(open_, flat)], schema=_FORMATTED)

    return run


def format_chats(turns: DataFrame, params: ChatParams = ChatParams()) -> DataFrame:
    """One row for each conversation of turns (conv_id, turn, role, text, and instead of text perhaps parts, an array of
    structs like Part), as FORMATTED.

    Turns go by turn, those of one number by role and then text, null first; repeated rows are turns of their own.
    A null text, a null role and null parts are empty. Rows of a null conv_id are one conversation. A part of an unknown kind
    is an error. A conversation becomes one value, so it has to fit in a task; its rows arrive sorted and are read as a stream.
    An empty table gives an empty result.
    """
    typed = "parts" in turns.columns
    cols = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role")]
    if typed:
        have = turns.schema["parts"].dataType.elementType.fieldNames()
        as_part = lambda p: F.struct(*[(p[n] if n in have else F.lit(None)).cast(t).alias(n) for n, t in zip(Part._fields, ("string", "string", "string", "long", "long", "double", "long"), strict=True)])
        rows = turns.select(*cols, F.transform("parts", as_part).alias("parts")).withColumn("tie", F.to_json("parts"))
    else:
        rows = turns.select(*cols, F.col("text").cast("string").alias("text")).withColumn("tie", F.col("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "tie").drop("turn", "tie")
    return rows.mapInArrow(_format(params, typed), FORMATTED)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            text = r["formatted"]
            turns = read_back(text)
            seen = "".join(f"{role}\n{body}\n" for role, body in turns)
            loss = "".join(unescape(text[s["from"] : s["to"]]) for s in r["spans"])
            out.append({"conv_id": r["conv_id"], "n_turns": len(turns), "turns_sha256": hashlib.sha256(seen.encode()).hexdigest(), "loss_chars": len(loss), "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(), "formatted_chars": len(text)})
        yield pa.RecordBatch.from_pylist(out, schema=_DIGEST)


def digests(formatted: DataFrame) -> DataFrame:
    """What formatted texts hold, read back from them: DIGEST. No rows give none."""
    return formatted.mapInArrow(_digest, DIGEST)
