"""Conversations as training text: typed content parts, flattened by a visitor into one escaped template.

A turn's content is text, or a list of parts of the types text, image, audio and document. A visitor walks the parts in
order: text is escaped, any other part becomes a placeholder, with its reference, place and number of expanded tokens
recorded. The template marks turns with control strings; those that occur in a text or role get a backslash after their
first character (one more where they have some), so that the formatted text can be read back exactly.

Turns are dealt out by conversation and sorted there, and each conversation is written as its turns pass by: a task holds
one conversation at a time.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template. A conversation starts with START; a turn is an opening, its role, a line end, its content and a closing.
START, OPEN, CLOSE, OPEN_ANSWER, CLOSE_ANSWER = "<s>", "[INST]", "[/INST]", "[ANS]", "</s>"
KINDS = ("image", "audio", "document", "file")
_NAMES = r"/?s>|/?INST\]|ANS\]|\|(?:" + "|".join(KINDS) + r")\|>"
_ESCAPE = re.compile(rf"([<\[])(\\*)({_NAMES})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)({_NAMES})")
_CONTROL = re.compile(rf"[<\[](?:{_NAMES})")
_PLACEHOLDER = re.compile(r"<\|(" + "|".join(KINDS) + r")\|>")
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def _unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


class PartVisitor:
    """Flattens the parts of one turn: text pieces and placeholders in order, attachments, expanded tokens."""

    def __init__(self, count_tokens, patch: int = 28, tokens_per_second: float = 25.0, tokens_per_page: int = 512, unknown: int = 256):
        self.count_tokens, self.patch, self.per_second, self.per_page, self.unknown = count_tokens, patch, tokens_per_second, tokens_per_page, unknown
        self.pieces: list[str] = []
        self.pending: list[str] = []  # texts next to each other, escaped as one
        self.attachments: list[dict] = []
        self.tokens = self.length = 0

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        getattr(self, f"visit_{kind}" if kind in ("text", *KINDS) else "visit_file")(part)

    def visit_text(self, part: dict) -> None:
        text = part.get("text") or ""
        self.tokens += self.count_tokens(text)
        self.pending.append(text)

    def visit_image(self, part: dict) -> None:
        w, h = part.get("width"), part.get("height")
        self._attach("image", part, math.ceil(w / self.patch) * math.ceil(h / self.patch) if w and h and w > 0 and h > 0 else self.unknown)

    def visit_audio(self, part: dict) -> None:
        s = part.get("seconds")
        self._attach("audio", part, math.ceil(s * self.per_second) if s and 0 < s < float("inf") else self.unknown)

    def visit_document(self, part: dict) -> None:
        n = part.get("pages")
        self._attach("document", part, n * self.per_page if n and n > 0 else self.unknown)

    def visit_file(self, part: dict) -> None:
        self._attach("file", part, self.unknown)

    def done(self) -> None:
        """Write out the texts since the last attachment."""
        if self.pending:
            self._add(escape("".join(self.pending)))
            self.pending = []

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.done()
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "at": self.length, "tokens": tokens})
        self.tokens += tokens
        self._add(f"<|{kind}|>")

    def _add(self, piece: str) -> None:
        self.pieces.append(piece)
        self.length += len(piece)


def _token_counter(tokenizer_file: str | None):
    if tokenizer_file is None:
        return lambda text: -(-len(text.encode()) // 4)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file)
    t.encode_special_tokens = True
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_ATTACHED = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("turn", pa.int64()), ("at", pa.int64()), ("tokens", pa.int64())]))
_OUT = "conv_id long, formatted string, loss_spans array<struct<start:long,end:long>>, attachments array<struct<kind:string,ref:string,turn:long,at:long,tokens:long>>, n_turns long, n_tokens long"


def _format(tokenizer_file: str | None, answer_roles: tuple[str, ...], per_batch: int = 4 << 20):
    def run(batches):
        count = _token_counter(tokenizer_file)
        done: list[tuple] = []
        held, at, now = 0, None, None

        def ended():
            return (now["id"], "".join(now["text"]), now["spans"], now["attached"], now["turns"], now["tokens"])

        def emit():
            kinds = (pa.int64(), pa.string(), _SPAN, _ATTACHED, pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done), kinds)], ["conv_id", "formatted", "loss_spans", "attachments", "n_turns", "n_tokens"])

        for batch in batches:
            for conv, role, text, parts in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or conv != at:
                    if now is not None:
                        done.append(ended())
                        held += now["length"]
                    now = {"id": conv, "text": [START], "length": len(START), "spans": [], "attached": [], "turns": 0, "tokens": 0}
                    at = conv
                    if held > per_batch:
                        yield emit()
                        done, held = [], 0
                v = PartVisitor(count)
                for part in parts if parts is not None else [{"type": "text", "text": text}]:
                    v.visit(part or {})
                v.done()
                answer = role in answer_roles
                head = (OPEN_ANSWER if answer else OPEN) + _escape_role(role or "") + "\n"
                start = now["length"] + len(head)
                now["text"] += [head, *v.pieces, CLOSE_ANSWER if answer else CLOSE]
                now["length"] = start + v.length + len(CLOSE_ANSWER if answer else CLOSE)
                if answer:
                    now["spans"].append({"start": start, "end": start + v.length})
                now["attached"] += [a | {"at": start + a["at"], "turn": now["turns"]} for a in v.attachments]
                now["turns"] += 1
                now["tokens"] += v.tokens
        if now is not None:
            done.append(ended())
            yield emit()

    return run


def format_conversations(turns: DataFrame, tokenizer_file: str | None = None, answer_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conv_id of turns(conv_id, turn, role, text, optionally parts): conv_id, formatted, loss_spans, attachments, n_turns, n_tokens.

    Turns go by turn, ties by role and text; a null turn comes first. parts (PARTS), where not null, stands for text. Null texts
    and roles are empty; a null conv_id is one conversation; repeated rows are turns of their own; unknown types become a file.
    loss_spans: code points of the formatted text that the answers take. n_tokens: of the texts and the expanded attachments; texts
    count by the tokenizer file, or, without one, as a quarter of their UTF-8 bytes. Other columns are ignored.
    """
    parts = F.col("parts").cast(PARTS) if "parts" in turns.columns else F.lit(None).cast(PARTS)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", parts.alias("parts"))
    there = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text", "parts")
    return there.mapInArrow(_format(tokenizer_file, answer_roles), _OUT)


def read_back(formatted: str) -> list[tuple[str, str, list[str]]]:
    """(role, text, kinds of its attachments) of each turn of a formatted text; placeholders are left out of the text."""
    out, at = [], len(START)
    for m in _CONTROL.finditer(formatted, len(START)):
        if m[0] in (OPEN, OPEN_ANSWER):
            at = m.end()
        elif m[0] in (CLOSE, CLOSE_ANSWER):
            role, _, body = formatted[at : m.start()].partition("\n")
            pieces = _PLACEHOLDER.split(body)  # texts and, between them, kinds
            out.append((_unescape_role(role), "".join(map(unescape, pieces[::2])), pieces[1::2]))
    return out


def _digest(batches):
    for batch in batches:
        out = []
        for conv, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
            turns = hashlib.sha256()
            n = 0
            for role, body, _ in read_back(text):
                turns.update(f"{role}\n{body}\n".encode())
                n += 1
            under = [unescape(text[s["start"] : s["end"]]) for s in spans]
            loss = hashlib.sha256()
            for x in under:
                loss.update(x.encode())
            out.append((conv, n, turns.hexdigest(), sum(map(len, under)), loss.hexdigest(), len(text)))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], names)


def digest(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations: turns and the text under the loss mask."""
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
