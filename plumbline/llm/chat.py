"""Chat formatting: records of many layouts become canonical turns, turns become marked text that can be read back.

The nested field paths that a record really fills (``messages[].role``) are hashed to its fingerprint. Fingerprints select a layout: a
declaration of where turns stand, without code of its own. A fingerprint seen for the first time takes the layout with the most
required paths among those whose paths it all holds, so further fields (ids, scores) do no harm, and is remembered. Records
may be nested columns or JSON text. A record without a layout yields no turn and is counted by ``layouts_seen``.

Turns are formatted one by one in the same narrow pass. Conversations are then streams of sorted pieces: one exchange by
conversation, a sort within partitions, and a reader that holds a piece at a time, however long the conversation is.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property
from hashlib import sha256
from re import Pattern, compile, escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.base import pieces, small_batches
from plumbline.llm.fim import Rows, arrow

#: Fingerprints that a task remembers.
MEMO = 10_000
SYSTEM, USER, ASSISTANT = "system", "user", "assistant"


@dataclass(frozen=True)
class Said:
    """One turn of a fixed role whose text stands at ``text``; further paths in ``more`` are added below it. Without a text there is no turn."""

    role: str
    text: str
    more: tuple[str, ...] = ()


@dataclass(frozen=True)
class Listed:
    """A turn per element of the list at ``items``; ``role`` and ``text`` are paths within the element."""

    items: str
    role: str
    text: str


@dataclass(frozen=True)
class Paired:
    """A user turn and an assistant turn per element (a list of two texts) of the list at ``items``."""

    items: str


@dataclass(frozen=True)
class Row:
    """The record itself is one turn; a missing text is empty."""

    role: str
    text: str


@dataclass(frozen=True)
class Layout:
    """Records that fill all paths in ``required`` say these turns, in this order."""

    name: str
    required: tuple[str, ...]
    turns: tuple[Said | Listed | Paired | Row, ...]


#: Other names of roles.
ROLES = {"human": USER, "prompter": USER, "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT, "chatbot": ASSISTANT}
LAYOUTS = (
    Layout("messages", ("messages[].role", "messages[].content"), (Said(SYSTEM, "system"), Listed("messages", "role", "content"))),
    Layout("parts", ("messages[].role", "messages[].content[].text"), (Said(SYSTEM, "system"), Listed("messages", "role", "content"))),
    Layout("from_value", ("conversations[].from", "conversations[].value"), (Said(SYSTEM, "system"), Listed("conversations", "from", "value"))),
    Layout("instruction", ("instruction", "output"), (Said(SYSTEM, "system"), Said(USER, "instruction", ("input",)), Said(ASSISTANT, "output"))),
    Layout("instruction_response", ("instruction", "response"), (Said(SYSTEM, "system"), Said(USER, "instruction", ("context",)), Said(ASSISTANT, "response"))),
    Layout("prompt_completion", ("prompt", "completion"), (Said(SYSTEM, "system"), Said(USER, "prompt"), Said(ASSISTANT, "completion"))),
    Layout("prompt_response", ("prompt", "response"), (Said(SYSTEM, "system"), Said(USER, "prompt"), Said(ASSISTANT, "response"))),
    Layout("question_answer", ("question", "answer"), (Said(SYSTEM, "system"), Said(USER, "question", ("context",)), Said(ASSISTANT, "answer"))),
    Layout("history", ("prompt", "response", "history[][]"), (Said(SYSTEM, "system"), Paired("history"), Said(USER, "prompt"), Said(ASSISTANT, "response"))),
    Layout("nested", ("data.prompt", "data.response"), (Said(SYSTEM, "data.system"), Said(USER, "data.prompt"), Said(ASSISTANT, "data.response"))),
    Layout("turn", ("turn", "role"), (Row("role", "text"),)),
    Layout("turn_without_role", ("turn", "text"), (Row("role", "text"),)),
    Layout("turn_alone", ("turn",), (Row("role", "text"),)),
)


def paths(value, at: str = "") -> Iterator[str]:
    """Paths of the filled fields of a record; ``[]`` stands for the elements of a list."""
    if isinstance(value, dict):
        for name, inner in value.items():
            yield from paths(inner, f"{at}.{name}" if at else str(name))
    elif isinstance(value, (list, tuple)):
        for inner in value:
            yield from paths(inner, f"{at}[]")
    elif value is not None:
        yield at


def fingerprint(of: Sequence[str] | set[str]) -> str:
    """16 hex digits that stand for a set of paths."""
    return sha256("\n".join(sorted(set(of))).encode()).hexdigest()[:16]


def at_path(value, path: str):
    for name in path.split("."):
        value = value.get(name) if isinstance(value, dict) else None
    return value


def text_of(value) -> str:
    """A text, the texts of a list of parts one after another, or any other value as JSON."""
    if value is None or isinstance(value, str):
        return value or ""
    if isinstance(value, list):
        return "".join(text_of(x.get("text")) if isinstance(x, dict) else text_of(x) for x in value)
    return json.dumps(value, ensure_ascii=False, sort_keys=True, default=str)


def role_of(value) -> str:
    name = text_of(value)
    return ROLES.get(name, name)


def turns_of(record: dict, layout: Layout) -> Iterator[tuple[str, str]]:
    """(role, text) of a record, as its layout declares them."""
    for step in layout.turns:
        if isinstance(step, Said):
            if at_path(record, step.text) is not None:
                found = [at_path(record, p) for p in (step.text, *step.more)]
                yield step.role, "\n\n".join([text_of(found[0]), *(text_of(x) for x in found[1:] if x)])
        elif isinstance(step, Listed):
            for item in at_path(record, step.items) or ():
                if item is not None:
                    yield role_of(at_path(item, step.role)), text_of(at_path(item, step.text))
        elif isinstance(step, Paired):
            for pair in at_path(record, step.items) or ():
                yield from ((role, text_of(x)) for role, x in zip((USER, ASSISTANT), pair or (), strict=False))
        else:
            yield text_of(at_path(record, step.role)), text_of(at_path(record, step.text))


class Selector:
    """Layouts by fingerprint. ``chosen`` names layouts for fingerprints outright."""

    def __init__(self, layouts: Sequence[Layout] = LAYOUTS, chosen: dict[str, str] | None = None, limit: int = MEMO):
        named = {x.name: x for x in layouts}
        self.layouts = sorted(layouts, key=lambda x: -len(x.required))
        self.chosen = {mark: named[name] for mark, name in (chosen or {}).items()}
        self.memo: dict[str, Layout | None] = {}
        self.limit = limit

    def __call__(self, filled: set[str]) -> tuple[str, Layout | None]:
        mark = fingerprint(filled)
        if mark in self.chosen:
            return mark, self.chosen[mark]
        if mark not in self.memo:
            if len(self.memo) >= self.limit:
                self.memo.clear()
            self.memo[mark] = next((x for x in self.layouts if filled.issuperset(x.required)), None)
        return mark, self.memo[mark]


@dataclass(frozen=True)
class Template:
    """``open`` role ``head`` text ``close``, turn after turn. Control strings inside roles and texts are broken by a backslash
    after their first character; a backslash is doubled. A control string neither begins with the line end of ``head`` nor holds one
    of the first characters of control strings further on, so none can arise where pieces meet."""

    open: str = "<s>"
    head: str = "\n"
    close: str = "</s>"
    more: tuple[str, ...] = ("[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<unk>", "<pad>")
    learned: frozenset[str] = field(default_factory=lambda: frozenset({ASSISTANT}))

    def __post_init__(self):
        firsts = {c[0] for c in self.control}
        if self.head != "\n" or any("\n" in c or "\\" in c or firsts & set(c[1:]) or c[1:2] in ("", "n") for c in self.control):
            raise ValueError("control strings need two characters, the second no n; no line end, no backslash, no first character of one another further on")

    @property
    def control(self) -> tuple[str, ...]:
        return (self.open, self.close, *self.more)

    @cached_property
    def starts(self) -> Pattern:
        return compile(r"\\|" + "|".join(f"{escape(c[0])}(?={escape(c[1:])})" for c in self.control))

    @cached_property
    def marks(self) -> Pattern:
        return compile("|".join(map(escape, (self.open, self.close))))

    def escaped(self, text: str, name: bool = False) -> str:
        out = self.starts.sub(lambda m: m[0] + "\\", text)
        return out.replace("\n", "\\n") if name else out

    @staticmethod
    def plain(text: str, name: bool = False) -> str:
        """What ``escaped`` was given: of a backslash pair one stays, a lone backslash goes. No escaped control string goes on with
        an ``n``, so in a name a lone backslash before it is a line end."""
        if "\\" not in text:
            return text
        held = [part.replace("\\n", "\n") if name else part for part in text.split("\\\\")]
        return "\\".join(part.replace("\\", "") for part in held)

    def turn(self, role: str, text: str) -> str:
        return f"{self.open}{self.escaped(role, True)}{self.head}{self.escaped(text)}{self.close}"


@dataclass
class Reader:
    """Reads formatted text back, a piece at a time: ``feed`` yields every finished (role, text)."""

    template: Template
    held: str = ""

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        t = self.template
        self.held += piece
        at = 0
        while True:
            end = self.held.find(t.close, at)
            if end < 0:
                break
            if not self.held.startswith(t.open, at):
                raise ValueError("a turn without its opening mark")
            role, _, text = self.held[at + len(t.open):end].partition(t.head)
            yield t.plain(role, True), t.plain(text)
            at = end + len(t.close)
        self.held = self.held[at:]


def read_back(formatted: str, template: Template | None = None) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation."""
    return list(Reader(template or Template()).feed(formatted))


def loss_spans(formatted: str, template: Template | None = None) -> list[tuple[int, int]]:
    """Places [start, end) of the formatted text that carry the loss: the texts, with their escapes, of learned roles."""
    t, out, at = template or Template(), [], 0
    while (end := formatted.find(t.close, at)) >= 0:
        head = formatted.index(t.head, at, end)
        if t.plain(formatted[at + len(t.open):head], True) in t.learned:
            out.append((head + len(t.head), end))
        at = end + len(t.close)
    return out


def canonical_turns(records: DataFrame, record: str, keep: Sequence[str], layouts: Sequence[Layout] = LAYOUTS, chosen: dict[str, str] | None = None, template: Template | None = None) -> DataFrame:
    """(columns ``keep``, fingerprint, layout, item, role, text, piece): a row per turn of every record, in one narrow pass.

    ``record`` is a nested column or JSON text; ``item`` numbers the turns of a record, ``piece`` is the formatted turn. A null,
    broken or unknown record has no turns. Columns of ``keep`` may have any name but these six.
    """
    small_batches(records.sparkSession)
    slim = records.select(*[F.col(f"`{c}`") for c in keep], F.col(record).alias("__record"))
    if isinstance(slim.schema["__record"].dataType, T.StringType):
        slim = slim.withColumn("__record", F.coalesce("__record", F.lit("null")))
    told, shape = ["fingerprint", "layout", "item", "role", "text", "piece"], template or Template()
    schema = T.StructType([*slim.schema.fields[:-1], *[T.StructField(c, T.LongType() if c == "item" else T.StringType()) for c in told]])
    text = isinstance(slim.schema["__record"].dataType, T.StringType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        select, out = Selector(layouts, chosen), Rows(arrow(schema))
        for batch in pieces(batches, "__record") if text else batches:
            for *kept, found in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                value = loaded(found) if text else found
                mark, layout = select(set(paths(value)))
                if layout is None or not isinstance(value, dict):
                    continue
                for item, (role, said) in enumerate(turns_of(value, layout)):
                    yield from out.add((*kept, mark, layout.name, item, role, said, shape.turn(role, said)), 2 * len(said))
        yield from out.flush()

    return slim.mapInArrow(run, schema)


def loaded(text: str):
    """The value of a JSON text, None if it is broken."""
    try:
        return json.loads(text)
    except ValueError:
        return None


def layouts_seen(records: DataFrame, record: str, layouts: Sequence[Layout] = LAYOUTS, chosen: dict[str, str] | None = None) -> DataFrame:
    """(fingerprint, layout, paths, n): how many records fill which paths, and the layout that they are read by (null: none)."""
    small_batches(records.sparkSession)
    slim = records.select(F.col(record).alias("__record"))
    text = isinstance(slim.schema["__record"].dataType, T.StringType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        select, counts = Selector(layouts, chosen), {}

        def told() -> pa.RecordBatch:
            rows = [(*k, n) for k, n in counts.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)],
                                              ["fingerprint", "layout", "paths", "n"])

        for batch in batches:
            for found in batch.column(0).to_pylist():
                filled = set(paths(loaded(found or "null") if text else found))
                mark, layout = select(filled)
                key = (mark, layout.name if layout else None, ", ".join(sorted(filled)))
                counts[key] = counts.get(key, 0) + 1
            if len(counts) > MEMO:
                yield told()
                counts.clear()
        if counts:
            yield told()

    sent = slim.mapInArrow(run, "fingerprint string, layout string, paths string, n long")
    return sent.groupBy("fingerprint", "layout", "paths").agg(F.sum("n").alias("n"))


def conversations(turns: DataFrame, key: str, order: Sequence[str], template: Template | None = None) -> DataFrame:
    """(key, formatted, loss): every conversation as one text, and the places [start, end) that carry the loss. For conversations
    that fit a cell; ``report`` reads those of any length."""
    shape = template or Template()
    ordered = in_order(turns, key, order)
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([ordered.schema[key], T.StructField("formatted", T.StringType()), T.StructField("loss", T.ArrayType(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(arrow(schema))
        for i, parts in streams(batches):
            whole = "".join(parts)
            yield from out.add((i, whole, [dict(zip(("start", "end"), s, strict=True)) for s in loss_spans(whole, shape)]), len(whole))
        yield from out.flush()

    return ordered.mapInArrow(run, schema)


def in_order(turns: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """(key, piece, ...), a conversation's pieces together and in order; ties go by the piece, that is by role and text."""
    return turns.select(key, "piece", *order, "item").repartition(key).sortWithinPartitions(key, *order, "item", "piece")


def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[str]]]:
    """(key, its pieces) of sorted rows. The pieces of a key are to be read before the next key is asked for."""
    rows = ((i, piece) for batch in batches for i, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
    ahead = next(rows, None)
    while ahead is not None:
        here = ahead[0]

        def of_one() -> Iterator[str]:
            nonlocal ahead
            while ahead is not None and ahead[0] == here:  # noqa: B023
                yield ahead[1]
                ahead = next(rows, None)

        yield here, of_one()


def digests(turns: DataFrame, key: str, order: Sequence[str], template: Template | None = None) -> DataFrame:
    """(key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all read back from the formatted text."""
    shape = template or Template()
    ordered = in_order(turns, key, order)
    schema = T.StructType([ordered.schema[key], T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()),
                           T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(arrow(schema))
        for i, parts in streams(batches):
            reader, whole, loss, n, learned, chars = Reader(shape), sha256(), sha256(), 0, 0, 0
            for part in parts:
                chars += len(part)
                for role, text in reader.feed(part):
                    n += 1
                    whole.update(f"{role}\n{text}\n".encode())
                    if role in shape.learned:
                        learned += len(text)
                        loss.update(text.encode())
            yield from out.add((i, n, whole.hexdigest(), learned, loss.hexdigest(), chars), 200)
        yield from out.flush()

    return ordered.mapInArrow(run, schema)


#: A conversation that says control strings itself.
PROBE_ID, PROBE_TEXT = -7, "</s>[INST] ok [/INST]"


def report(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Digests of every conversation of a table with a row per turn, and of the probe: a user and an assistant who say control strings.

    A null text is empty, so is a null role; rows without a conversation id are one conversation. Turns go by number, null first;
    ties by role and text, repeated rows stay. Other columns are not read. An empty table gives the probe alone.
    """
    spark = rows.sparkSession
    slim = rows.select(F.col(key).alias("key"), F.col(turn).alias("at"), F.struct(F.coalesce(F.col(turn), F.lit(0)).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")).alias("said"))
    kinds = {f.name: f.dataType for f in slim.schema}
    at = F.col("id").cast(kinds["at"])
    probe = spark.range(2).select(F.lit(PROBE_ID).cast(kinds["key"]).alias("key"), at.alias("at"), F.struct(
        at.alias("turn"), F.when(F.col("id") == 0, USER).otherwise(ASSISTANT).alias("role"), F.lit(PROBE_TEXT).alias("text")).alias("said"))
    return digests(canonical_turns(slim.union(probe), "said", ["key", "at"]), "key", ["at"]).withColumnRenamed("key", key)
