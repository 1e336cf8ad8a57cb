"""Chat formatting with offset-aligned loss masks.

The turns of a conversation are rendered into one string, which is encoded once with offsets. The sorted spans of the
assistant turns are intersected with the token spans by binary search: a token is under the loss mask if it holds
some character of an assistant text, and the mask's character ranges are the tokens' clipped to the turns' spans.
"""

from __future__ import annotations

import hashlib
import os
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Turns of a segment: a conversation with more is rendered in segments, so that none has to fit into one task.
#: A segment with more characters than LONGEST (repeated or very long turns) goes on in another part.
TURNS, LONGEST = 512, 4_000_000
#: Renderings that are encoded together: so many, or as many as have so many characters.
TOGETHER, CHARACTERS = 256, 4_000_000

TAGS = {"system": "SYS", "user": "INST", "assistant": "ANS"}
CONTROL = r"</?s>|\[/?(?:SYS|INST|ANS|ROLE)\]"
_TURN = re.compile(r"<s>\[(?:(SYS|INST|ANS)\] (.*?) \[/\1\]|ROLE\] (.*?) \[/ROLE\] (.*?))</s>", re.DOTALL)


def escape(text: str) -> str:
    """``text`` without control strings: a backslash becomes ``\\b``, and ``\\c`` goes after the first character of each control string."""
    return re.sub(CONTROL, lambda m: m.group()[0] + "\\c" + m.group()[1:], text.replace("\\", "\\b"))


def unescape(text: str) -> str:
    return text.replace("\\c", "").replace("\\b", "\\")


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The string of (role, text) turns and the spans in it of the escaped assistant texts."""
    out, spans, at = [], [], 0
    for role, text in turns:
        tag, body = TAGS.get(role), escape(text)
        head = f"<s>[{tag}] " if tag else f"<s>[ROLE] {escape(role)} [/ROLE] "
        tail = f" [/{tag}]</s>" if tag else "</s>"
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, tail]
        at += len(head) + len(body) + len(tail)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a rendered string."""
    roles = {tag: role for role, tag in TAGS.items()}
    return [(roles[m[1]], unescape(m[2])) if m[1] else (unescape(m[3]), unescape(m[4])) for m in _TURN.finditer(formatted)]


def loss_mask(offsets: list[tuple[int, int]], spans: list[tuple[int, int]]) -> tuple[list[bool], list[tuple[int, int]]]:
    """The mask of the tokens with ``offsets`` and its character ranges, one for each span that is not empty."""
    starts, ends = [a for a, _ in offsets], [b for _, b in offsets]
    mask, ranges = [False] * len(offsets), []
    for begin, end in spans:
        first, last = bisect_right(ends, begin), bisect_left(starts, end)
        if first < last and begin < end:
            mask[first:last] = [True] * (last - first)
            ranges.append((max(begin, starts[first]), min(end, ends[last - 1])))
    return mask, ranges


OUTPUT = "conv_id {}, segment long, part int, n_turns long, formatted string, ids array<int>, loss array<boolean>, loss_ranges array<struct<start: int, end: int>>"


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", tokenizer: str = TOKENIZER, turns_a_segment: int = TURNS, longest: int = LONGEST) -> DataFrame:
    """Rows (conv_id, segment, part, n_turns, formatted, ids, loss, loss_ranges): the rendered and encoded conversations.

    Turns stand by turn number, equal numbers by role and text; null numbers come first; null texts and roles are
    empty; a null conv_id is a conversation; repeated rows are turns of their own. A conversation is rendered and
    encoded once as a whole if it is one segment of one part, as all with up to ``turns_a_segment`` turns and
    ``longest`` characters are: a segment holds the turns whose numbers share a multiple of ``turns_a_segment``, and it
    goes on in another part beyond ``longest`` characters, each encoded once. Other columns are not read; an empty
    table gives no rows. The tokenizer file is read on the driver and sent along.
    """
    spark = turns.sparkSession
    with open(tokenizer, encoding="utf-8") as file:
        vocabulary = spark.sparkContext.broadcast(file.read())
    kind = turns.schema[conv_id].dataType
    schema = OUTPUT.format(kind.simpleString())
    arrow = pa.schema(
        [
            ("segment", pa.int64()),
            ("part", pa.int32()),
            ("n_turns", pa.int64()),
            ("formatted", pa.string()),
            ("ids", pa.list_(pa.int32())),
            ("loss", pa.list_(pa.bool_())),
            ("loss_ranges", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        ]
    )

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        encoder = Tokenizer.from_str(vocabulary.value)
        encoder.encode_special_tokens = True
        done, key, own, size, part, key_type, waiting = [], None, [], 0, 0, None, 0

        def close():
            nonlocal own, size, part, waiting
            if own:
                done.append((key, part, len(own), *render(own)))
                waiting += len(done[-1][3])
            own, size, part = [], 0, part + 1

        def flush():
            nonlocal waiting
            waiting = 0
            encoded = encoder.encode_batch([d[3] for d in done], add_special_tokens=False)
            columns = [[] for _ in arrow]
            for (k, p, n, formatted, spans), e in zip(done, encoded, strict=True):
                mask, ranges = loss_mask(e.offsets, spans)
                for column, value in zip(columns, (k[1], p, n, formatted, e.ids, mask, [{"start": a, "end": b} for a, b in ranges]), strict=True):
                    column.append(value)
            ids = pa.array([d[0][0] for d in done], key_type)
            arrays = [pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays([ids, *arrays], ["conv_id", *arrow.names])

        for batch in batches:
            key_type = batch.schema.field(0).type
            for conv, segment, who, what in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
                if (conv, segment) != key:
                    close()
                    key, part = (conv, segment), 0
                elif size > longest:
                    close()
                own.append((who, what))
                size += len(what)
                if len(done) >= TOGETHER or waiting >= CHARACTERS:
                    yield flush()
        close()
        if done:
            yield flush()

    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.coalesce(F.floor(F.col(turn) / turns_a_segment), F.lit(-(1 << 62))).cast("long").alias("segment"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    return rows.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "turn", "role", "text").mapInArrow(run, schema)


def chat_digests(chats: DataFrame) -> DataFrame:
    """Rows (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from ``format_chats``.

    The segments of a conversation are read in order, one at a time.
    """
    kind = chats.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        rows, state, key_type = [], None, None

        def close():
            if state:
                rows.append((state["key"], state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["length"]))

        def flush():
            columns = list(zip(*rows, strict=True))
            types = [key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            key_type = batch.schema.field(0).type
            for conv, formatted, ranges in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4)), strict=True):
                if state is None or state["key"] != conv:
                    close()
                    state = {"key": conv, "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "length": 0}
                turns = parse(formatted)
                state["n"] += len(turns)
                state["turns"].update("".join(f"{r}\n{t}\n" for r, t in turns).encode())
                loss = "".join(unescape(formatted[x["start"] : x["end"]]) for x in ranges)
                state["chars"] += len(loss)
                state["loss"].update(loss.encode())
                state["length"] += len(formatted)
            if len(rows) >= 1000:
                yield flush()
        close()
        if rows:
            yield flush()

    ordered = chats.select("conv_id", "segment", "part", "formatted", "loss_ranges").repartition("conv_id").sortWithinPartitions("conv_id", "segment", "part")
    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def control_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts are control strings of the template."""
    texts = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    return spark.createDataFrame(texts, "conv_id long, turn long, role string, text string")


#: SQL for the digests over the table conversations and conversation -7.
DIGEST_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, CASE role WHEN 'system' THEN 20 WHEN 'user' THEN 22 WHEN 'assistant' THEN 20 ELSE 23 + length(role) END
    + length(text) + length(text) - length(replace(text, '\', ''))
    + 2 * len(regexp_extract_all(text, '</?s>|\[/?(?:SYS|INST|ANS|ROLE)\]')) AS n
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
