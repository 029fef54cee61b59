"""Chat formatting with a grammar round trip.

A template has four control strings around a turn's role and text, and others
that a text may not hold as they are, such as the end of a document. A turn is
rendered as it is, the rendered text is parsed again by the template's grammar,
and what the parser recovers is compared with the source. Turns that come back
different are escaped where they conflict and rendered anew, until all are
identical.

    conversation := turn*      turn := open role middle text close

Escaping is reversible: a control string whose first character is followed by
any number of escape characters gets one more, and the parser takes one away.
No control string has its first character once more further in, so no two of
them overlap, and what stands before or behind a text can't complete one.

Turns are dealt to tasks by conversation and by range of turns (TURNS of them),
each a part; a task reads its parts' turns in order, one after the other, and
holds one record of about RECORD_CHARS. A long part is several records, cut
between turns. So no conversation has to fit a task. Hashing a conversation's
turns is sequential by nature; conversations of more than one record are read
in order by one task, record by record, the others where their record lies.

Defined cases: a null role or text is empty; null turns come first; turns with
equal numbers go in order of role and text; repeated rows are turns of their
own; a null identifier is a conversation of its own; a very long text is a
record alone; an empty table gives no records. Only identifier, turn, role and
text are read, so other columns of any name don't matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Turns of a part, and characters from which a record is closed.
TURNS = 4096
RECORD_CHARS = 4 << 20
#: Identifiers of long conversations that are broadcast; more are joined by a shuffle.
BROADCAST = 1 << 20


@dataclass(frozen=True)
class Template:
    """Control strings of a turn, others that texts must not hold, the character that escapes, and whose texts a
    model learns (the loss mask)."""

    open: str = "<s>[INST]"
    middle: str = "[/INST]"
    close: str = "</s>"
    others: tuple[str, ...] = ("<s>", "[INST]", "<|endoftext|>")
    escape: str = "\\"
    learned: tuple[str, ...] = ("assistant",)
    _control: re.Pattern = field(init=False, repr=False, compare=False)
    _escaped: re.Pattern = field(init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        if len(self.escape) != 1:
            raise ValueError("one character escapes")
        # A control string that begins with another is known by that one.
        every = [self.open, self.middle, self.close, *self.others]
        least = [c for c in dict.fromkeys(every) if not any(c != o and c.startswith(o) for o in every)]
        firsts = {c[:1] for c in least}
        for c in least:
            if len(c) < 2 or self.escape in c or firsts & set(c[1:]):
                raise ValueError(f"control string {c!r}: two characters at least, none the escape, and no control string's first one further in")
        if any(a.startswith(b) for a in (self.open, self.middle, self.close) for b in (self.open, self.middle, self.close) if a is not b):
            raise ValueError("a turn's control strings have to be told apart")
        object.__setattr__(self, "_control", re.compile("|".join(re.escape(c) for c in sorted((self.open, self.middle, self.close), key=len, reverse=True))))
        tails = lambda first: "|".join(re.escape(c[1:]) for c in least if c[0] == first)
        object.__setattr__(self, "_escaped", re.compile("|".join(f"{re.escape(f)}{re.escape(self.escape)}*(?={tails(f)})" for f in sorted(firsts))))

    def escaped(self, text: str) -> str:
        return self._escaped.sub(lambda m: m[0] + self.escape, text)

    def plain(self, text: str) -> str:
        return self._escaped.sub(lambda m: m[0][:-1] if len(m[0]) > 1 else m[0], text)

    def parse(self, rendered: str) -> list[tuple[str, str, int, int]]:
        """Turns of a rendered text: role, text, and where the text's own place begins and ends in it. Anything but
        whole turns is an error."""
        out, at, places = [], 0, self._control.finditer(rendered)
        while at < len(rendered):
            found = [next(places, None) for _ in range(3)]
            if [m and m[0] for m in found] != [self.open, self.middle, self.close] or found[0].start() != at:
                raise ValueError("not a conversation in this template")
            begin, end = found[1].end(), found[2].start()
            out.append((self.plain(rendered[found[0].end() : found[1].start()]), self.plain(rendered[begin:end]), begin, end))
            at = found[2].end()
        return out

    def rendered(self, role: str, text: str) -> tuple[str, int, int]:
        """A turn that parses to that role and text, and where its text lies in it. Each round escapes what
        conflicts; one that changes nothing any more can't be mended."""
        as_role, as_text = role, text
        while True:
            out = f"{self.open}{as_role}{self.middle}{as_text}{self.close}"
            begin = len(self.open) + len(as_role) + len(self.middle)
            try:
                (turn,) = self.parse(out)
                same = turn == (role, text, begin, begin + len(as_text)) and not self._bare(as_role) and not self._bare(as_text)
            except ValueError:
                same = False
            if same:
                return out, begin, begin + len(as_text)
            if (as_role, as_text) != (role, text):
                raise ValueError("a turn that doesn't come back from this template")
            as_role, as_text = self.escaped(role), self.escaped(text)

    def _bare(self, text: str) -> bool:
        """Whether a control string stands in a rendered text as it is."""
        return any(len(m[0]) == 1 for m in self._escaped.finditer(text))


def _render(batches: Iterator[pa.RecordBatch], template: Template) -> Iterator[pa.RecordBatch]:
    """Records of sorted turns; a batch of them is of about RECORD_CHARS too."""
    rows: list[tuple] = []
    held = 0
    key: tuple | None = None
    number, turns, texts, spans, size = 0, [], [], [], 0

    def close_record() -> None:
        nonlocal turns, texts, spans, size, held, number
        record = "".join(texts)
        if [(role, text) for role, text, _, _ in template.parse(record)] != turns:
            raise ValueError("a record that doesn't come back from this template")
        rows.append((*key, number, len(turns), record, spans))
        held += size
        number += 1
        turns, texts, spans, size = [], [], [], 0

    def out() -> pa.RecordBatch:
        nonlocal rows, held
        ids, parts, numbers, counts, records, masks = zip(*rows, strict=True)
        span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        made = pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(parts, pa.int64()), pa.array(numbers, pa.int32()), pa.array(counts, pa.int32()), pa.array(records, pa.string()), pa.array([[{"start": a, "end": b} for a, b in m] for m in masks], pa.list_(span))], ["conv_id", "part", "record", "turns", "text", "loss"])
        rows, held = [], 0
        return made

    kind = pa.int64()
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for ident, part, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "role", "text")), strict=True):
            if key != (ident, part):
                if turns:
                    close_record()
                key, number = (ident, part), 0
            made, begin, end = template.rendered(role, text)
            if turns and size + len(made) > RECORD_CHARS:
                close_record()
            if role in template.learned:
                spans.append((size + begin, size + end))
            texts.append(made)
            size += len(made)
            turns.append((role, text))
            if held > RECORD_CHARS:
                yield out()
    if turns:
        close_record()
    if rows:
        yield out()


def format_chats(conversations: DataFrame, template: Template | None = None, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Records of formatted conversations: conv_id, part and record (in order), turns, text and loss (places in
    the text, in characters, that a model learns)."""
    template = template or Template()
    own = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = own.withColumn("part", F.coalesce(F.floor(F.col("turn") / TURNS), F.lit(-(2**62))))
    kind = own.schema["conv_id"].dataType.simpleString()
    dealt = own.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "turn", "role", "text").select("conv_id", "part", "role", "text")
    return dealt.mapInArrow(lambda it: _render(it, template), f"conv_id {kind}, part long, record int, turns int, text string, loss array<struct<start:int,end:int>>")


def _read_back(batches: Iterator[pa.RecordBatch], template: Template) -> Iterator[pa.RecordBatch]:
    """Digests of conversations whose records come in order."""
    rows: list[tuple] = []
    key, some = None, False
    kind = pa.int64()

    def start() -> None:
        nonlocal turns, chars, formatted, every, learned
        turns = chars = formatted = 0
        every, learned = hashlib.sha256(), hashlib.sha256()

    def out() -> pa.RecordBatch:
        nonlocal rows
        types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
        rows = []
        return made

    turns = chars = formatted = 0
    every, learned = hashlib.sha256(), hashlib.sha256()
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for ident, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss")), strict=True):
            if not some or ident != key:
                if some:
                    rows.append((key, turns, every.hexdigest(), chars, learned.hexdigest(), formatted))
                key, some = ident, True
                start()
            for role, said, _, _ in template.parse(text):
                every.update(f"{role}\n{said}\n".encode())
                turns += 1
            for span in loss:
                said = template.plain(text[span["start"] : span["end"]])
                learned.update(said.encode())
                chars += len(said)
            formatted += len(text)
        if len(rows) > common.BATCH_ROWS:
            yield out()
    if some:
        rows.append((key, turns, every.hexdigest(), chars, learned.hexdigest(), formatted))
        yield out()


def digests(records: DataFrame, template: Template | None = None) -> DataFrame:
    """A row for each conversation of written records, from their texts and masks alone. records: a table that is
    read several times: conversations of one record where they lie, the others in order."""
    template = template or Template()
    kind = records.schema["conv_id"].dataType.simpleString()
    fields = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    read = lambda df: df.select("conv_id", "text", "loss").mapInArrow(lambda it: _read_back(it, template), fields)
    longer = common.stored(records.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("conv_id").alias("id")), "chat-longer")
    n = longer.count()
    if not n:
        return read(records)
    ids = F.broadcast(longer) if n <= BROADCAST else longer
    same = F.col("conv_id").eqNullSafe(F.col("id"))
    parts = records.join(ids, same, "left_semi").repartition("conv_id").sortWithinPartitions("conv_id", "part", "record")
    return read(records.join(ids, same, "left_anti")).unionByName(read(parts))


#: A conversation whose texts are the template's own control strings.
ODD = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def query(spark, sf_dir: str) -> DataFrame:
    given = common.read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame(ODD, "conv_id long, turn long, role string, text string").select(*(F.col(c).cast(t).alias(c) for c, t in given.dtypes))
    return digests(common.stored(format_chats(given.unionByName(odd)), "chat-records"))


def _sql() -> str:
    t = Template()
    escaped = lambda c: f"regexp_replace({c}, '(<\\\\*)(s>|/s>|\\|endoftext\\|>)|(\\[\\\\*)(INST\\]|/INST\\])', '\\1\\3\\\\\\2\\4', 'g')"
    turns = "turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES " + ", ".join(f"({c}, {n}, '{r}', '{x}')" for c, n, r, x in ODD) + "))"
    learned = "coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')"
    return f"""WITH {turns}
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(length({learned}) AS BIGINT) AS loss_chars, sha256({learned}) AS loss_sha256,
  CAST(sum({len(t.open + t.middle + t.close)} + length({escaped("role")}) + length({escaped("text")})) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""


ORACLE_SQL = _sql()
