"""Fill-in-middle transformation by overlapping chunks.

A text is cut at two ranks of its units. Whether a unit starts at a byte is a predicate of that byte and the one before
it, so a text falls into chunks that overlap by one byte and can be counted each for itself: no chunk needs to know what
another one found. Prefix sums over the counts give the number of units and, for a rank, the chunk that owns it; that
chunk alone is scanned again for the place. The chunks of a text are counted where the row is, so no text is moved, and
beside the text and its output only one chunk's marks are held at a time.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks of the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many are left plain, and of 100 others so many have the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
#: Bytes of a chunk.
CHUNK = 1 << 16

_NEWLINE = 0x0A
_SPACES = np.array([0x20, *range(0x09, 0x0E)], dtype=np.uint8)


def _char_starts(before: np.ndarray, here: np.ndarray) -> np.ndarray:
    """Every byte that does not go on with a character starts one."""
    return (here & 0xC0) != 0x80


def _word_starts(before: np.ndarray, here: np.ndarray) -> np.ndarray:
    """A word starts after white space; the white space behind it is its own."""
    return np.isin(before, _SPACES) & ~np.isin(here, _SPACES)


def _line_starts(before: np.ndarray, here: np.ndarray) -> np.ndarray:
    return before == _NEWLINE


#: Predicates of adjacent bytes: does a unit start at the second one? The text stands as if after a line break.
UNITS: dict[str, Callable] = {"char": _char_starts, "word": _word_starts, "line": _line_starts}


def count_chunks(text: np.ndarray, starts: Callable, chunk: int = CHUNK) -> np.ndarray:
    """Units before each chunk of the bytes ``text``, and last the number of all: prefix sums of the chunks' counts."""
    counts = [np.count_nonzero(_marks(text, i, starts, chunk)) for i in range(0, len(text), chunk)]
    return np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))


def place(text: np.ndarray, before: np.ndarray, rank: int, starts: Callable, chunk: int = CHUNK) -> int:
    """Byte at which the units of number ``rank`` and on begin: 0 for none before, the end for all."""
    if rank == 0:
        return 0
    if rank == before[-1]:
        return len(text)
    owner = int(np.searchsorted(before, rank, side="right")) - 1
    return owner * chunk + int(np.flatnonzero(_marks(text, owner * chunk, starts, chunk))[rank - before[owner]])


def _marks(text: np.ndarray, begin: int, starts: Callable, chunk: int) -> np.ndarray:
    """Which bytes of the chunk at ``begin`` start a unit; the chunk reaches back to the byte before it."""
    piece = text[begin - 1 : begin + chunk] if begin else np.concatenate((np.array([_NEWLINE], dtype=np.uint8), text[:chunk]))
    return starts(piece[:-1], piece[1:])


_RESULT = "n long, form string, prefix_chars long, middle_chars long, output string"


def _transform(unit: str, plain: int, suffix_first: int, chunk: int):
    """The Arrow function of a text and four numbers."""
    starts, marks = UNITS[unit], [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    chars = lambda part: int(np.count_nonzero(_char_starts(part, part)))

    def one(text: np.ndarray, h1: int, h2: int, h3: int, h4: int) -> tuple:
        before, raw = count_chunks(text, starts, chunk), text.tobytes()
        n = int(before[-1])
        if not raw or h3 % 100 >= 100 - plain or any(m in raw for m in marks):
            return n, "plain", None, None, raw
        ranks = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = (place(text, before, r, starts, chunk) for r in ranks)
        lengths = (ranks[0], ranks[1] - ranks[0]) if unit == "char" else (chars(text[:a]), chars(text[a:b]))
        parts = [marks[0] + raw[:a], marks[1] + raw[b:], marks[2] + raw[a:b]]
        spm = h4 % 100 < suffix_first
        return n, "spm" if spm else "psm", *lengths, b"".join([parts[1], parts[0], parts[2]] if spm else parts)

    @F.arrow_udf(_RESULT)
    def transform(texts: pa.Array, h1: pa.Array, h2: pa.Array, h3: pa.Array, h4: pa.Array) -> pa.Array:
        ends = np.frombuffer(texts.buffers()[1], dtype=np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
        rows = [one(data[a:b], *h) for a, b, *h in zip(ends[:-1].tolist(), ends[1:].tolist(), *(h.to_pylist() for h in (h1, h2, h3, h4)), strict=True)]
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        arrays = [pa.array(c, type=kind) for c, kind in zip(columns, kinds, strict=True)]
        arrays[4] = arrays[4].cast(pa.string())
        return pa.StructArray.from_arrays(arrays, names=["n", "form", "prefix_chars", "middle_chars", "output"])

    return transform


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: str = "char", seed: int = 1, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST, chunk: int = CHUNK) -> DataFrame:
    """``docs`` without its text, and with n, form (plain, psm or spm), prefix_chars, middle_chars and output.

    n counts the units (``UNITS``) of the text; prefix and middle end after two ranks of them that the SHA-256 digest of
    ``seed``, a colon and the doc_id gives, so reruns agree wherever a row is. Texts that are empty or hold a mark stay
    plain, and so do ``plain`` of 100 others; their prefix_chars and middle_chars (code points) are null. A null text
    counts as empty, a null doc_id as the empty string. Repeated rows are transformed alike, one by one. Columns of
    other names pass through; one that has the name of an output column gives way to it. An empty table gives no rows.
    Nothing is shuffled; a task holds the texts of one Arrow batch.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))), 256)
    numbers = [F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9, 17, 25)]
    made = _transform(unit, plain, suffix_first, chunk)(F.coalesce(F.col(f"`{text}`"), F.lit("")), *numbers)
    own = ["n", "form", "prefix_chars", "middle_chars", "output"]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text and c not in own]).alias("old"), made.alias("new"))
    return packed.select("old.*", "new.*")


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from: a plain one itself; else it holds each mark once, and the parts between go back in order."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    prefix, suffix, middle = (F.when(form == "spm", parts[b]).otherwise(parts[a]) for a, b in ((1, 2), (2, 1), (3, 3)))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, middle, suffix))


#: The same by substrings, over whole tables.
MIDDLE_SQL = """
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || CAST(doc_id AS VARCHAR)) AS d FROM documents),
numbers AS (
  SELECT doc_id, text, length(text) AS n, CAST('0x' || substr(d, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(d, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(d, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(d, 25, 8) AS BIGINT) AS h4
  FROM texts
), forms AS (
  SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers
), parts AS (SELECT *, substr(text, 1, a) AS p, substr(text, a + 1, b - a) AS m, substr(text, b + 1) AS s FROM forms)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
