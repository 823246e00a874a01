"""Chat formatting with typed content parts, reversible escapes and a loss mask.

A turn is a role and a list of parts.  A visitor flattens the parts in order: text is escaped, an
image, audio or document part becomes one placeholder, and its reference and the number of tokens that it will
expand to are recorded beside it.  Turns are rendered one by one, wherever their rows lie; only the rendered
turns of one conversation meet, in the one row that holds the formatted conversation.

Defined results
    * null text: empty text; null role: empty role; rows of null conversation id: one conversation of their own.
    * a conversation is one row, so its text must fit in a row of Spark; ids are passed on exactly.
    * turns with an equal number: by role, then text; null turn numbers come first; repeated rows all stay.
    * control strings and backslashes in texts and roles are escaped and come back unchanged from ``read_back``.
    * unknown part types: treated as text.  Texts side by side are one text.  Seconds that are no number, negative or too
      many: one token.  Counts of tokens end at MOST_TOKENS.
    * empty input: no rows.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Strings that a chat template may give a meaning; escaped wherever they occur in a text.
CONTROL = (TURN, END, *PLACEHOLDERS.values(), "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Tokens that one unit of an attachment expands to: an image patch, an audio frame, a document page.
PATCH_PIXELS, AUDIO_TOKENS_PER_SECOND, TOKENS_PER_PAGE = 28, 25, 512
#: Tokens of an attachment, at most.
MOST_TOKENS = (1 << 31) - 1
PART = "struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"

_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(re.escape(TURN) + r"(.*?)\n(.*?)" + re.escape(END) + r"\n", re.S)
_MEANING = {"\\": "\\", ".": "", "n": "\n"}


def escape(text: str) -> str:
    """Doubles backslashes and puts ``\\.`` behind the first character of each control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\." + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _MEANING[m[1]], text)


class FlattenVisitor:
    """Visits the parts of a turn in order; collects the text, the references and the token counts.

    Texts side by side are one text, so that no control string comes about between them.
    """

    def __init__(self) -> None:
        self.runs: list[list[str]] = [[]]  # texts between attachments
        self.kinds: list[str] = []
        self.references: list[str] = []
        self.tokens: list[int] = []

    def body(self, form: Callable[[str], str]) -> str:
        """The texts, each put into a form, and the placeholders between them."""
        texts = [form("".join(run)) for run in self.runs]
        return "".join(x for pair in zip(texts, [*(PLACEHOLDERS[k] for k in self.kinds), ""], strict=True) for x in pair)

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type')}", self.visit_text)(part)

    def visit_text(self, part: dict) -> None:
        self.runs[-1].append(part.get("text") or "")

    def visit_image(self, part: dict) -> None:
        across, down = (-(-int(part.get(k) or 0) // PATCH_PIXELS) for k in ("width", "height"))
        self._attach("image", part, min(MOST_TOKENS, max(1, across * down)))

    def visit_audio(self, part: dict) -> None:
        tokens = (part.get("seconds") or 0.0) * AUDIO_TOKENS_PER_SECOND
        self._attach("audio", part, max(1, round(tokens)) if 0 <= tokens <= MOST_TOKENS else 1)

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, min(MOST_TOKENS, max(1, int(part.get("pages") or 0) * TOKENS_PER_PAGE)))

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.runs.append([])
        self.kinds.append(kind)
        self.references.append(f"{kind}:{part.get('uri') or ''}")
        self.tokens.append(tokens)


def text_parts(text: Column) -> Column:
    """A plain text as a list of one text part."""
    null = {"uri": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *[F.lit(None).cast(t).alias(c) for c, t in null.items()]))


def format_conversations(turns: DataFrame, parts: Column | None = None, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``conv_id, turn, role, text`` (or a ``parts`` column) to one row for each conversation.

    Result: ``conv_id, formatted, loss_spans`` (start and length in code points of ``formatted``),
    ``attachments`` (reference and expanded tokens, in order) and ``expanded_tokens``.
    """
    parts = text_parts(F.col("text")) if parts is None else parts
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(parts, F.array().cast(f"array<{PART}>")).cast(f"array<{PART}>").alias("parts"))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads, plain, bodies, references, tokens = [], [], [], [], []
            for role, own in zip(b.column(2).to_pylist(), b.column(3), strict=True):
                visitor = FlattenVisitor()
                for part in own.as_py():
                    visitor.visit(part or {})
                heads.append(TURN + escape(role).replace("\n", "\\n") + "\n")
                plain.append(visitor.body(str))
                body = visitor.body(escape)
                bodies.append(None if body == plain[-1] else body)  # few texts need escapes
                references.append(visitor.references)
                tokens.append(visitor.tokens)
            made = [pa.array(heads, pa.string()), pa.array(plain, pa.string()), pa.array(bodies, pa.string()), pa.array(references, pa.list_(pa.string())), pa.array(tokens, pa.list_(pa.int32()))]
            yield pa.record_batch([*b.columns[:3], *made], names=["conv_id", "turn", "role", "head", "plain", "escaped", "refs", "tokens"])

    kind = turns.schema["conv_id"].dataType.simpleString()
    rendered = rows.mapInArrow(render, f"conv_id {kind}, turn long, role string, head string, plain string, escaped string, refs array<string>, tokens array<int>")
    lost = F.col("role").isin(*loss_roles)
    gathered = (
        rendered.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "plain", "escaped", "head", "refs", "tokens", lost.alias("lost"), F.length("head").alias("h"), F.length(F.coalesce("escaped", "plain")).alias("n")))).alias("t"))
        .withColumn("formatted", F.concat_ws("", F.transform("t", lambda t: F.concat(t["head"], F.coalesce(t["escaped"], t["plain"]), F.lit(END + "\n")))))
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    tail = len(END) + 1
    spans = F.aggregate(
        "t",
        start,
        lambda acc, t: F.struct(
            (acc["at"] + t["h"] + t["n"] + tail).alias("at"),
            F.when(t["lost"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + t["h"]).alias("start"), t["n"].cast("long").alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    attachments = F.flatten(F.transform("t", lambda t: F.zip_with(t["refs"], t["tokens"], lambda r, n: F.struct(r.alias("reference"), n.alias("tokens")))))
    return gathered.select("conv_id", "formatted", spans.alias("loss_spans"), attachments.alias("attachments")).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The roles and texts of a formatted conversation."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def digests(formatted: DataFrame) -> DataFrame:
    """Parses formatted conversations again and digests their turns and the text under the loss mask."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for formatted, spans in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                text = formatted.as_py()
                turns = read_back(text)
                loss = "".join(unescape(text[s["start"] : s["start"] + s["length"]]) for s in spans)
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                out.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            made = [pa.array(v, pa.string() if n.endswith("sha256") else pa.int64()) for n, v in zip(names, columns, strict=True)]
            yield pa.record_batch([b.column(0), *made], names=["conv_id", *names])

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(parse, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
