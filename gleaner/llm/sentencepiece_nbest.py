"""SentencePiece encoding and decoding with the N best segmentations.

A text is a lattice of vocabulary pieces over its characters, and a segmentation's score is the sum of its pieces'.
Pieces never cross certain pairs of neighbouring characters, so the lattice falls into units there. A forward Viterbi
pass gives the best score of every prefix of every unit; used as heuristic it is exact, so that a backward A* search
pops complete paths in order of their score. Among the N best segmentations of a text at most N - 1 units differ from
their best path, and those are the units whose second best path loses least: only these are searched.

The forward pass is vectorised over the different units of a batch; a task holds one batch at a time. The search goes
on from a place of a unit at most N times, which is exact: no more than the N best ways from there to the unit's end
can be part of the N best paths. So long runs of one sign, where very many paths tie, cost no more than other units.
"""

from __future__ import annotations

import heapq
from collections import Counter
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 4
SPACE = "▁"
#: A score below this marks a placeholder of the vocabulary (runs of blanks); such a piece and an unknown character cost PENALTY more than the worst piece.
PLACEHOLDER, PENALTY = -1e8, 10.0
#: Characters of texts that are segmented together, and of the longest units whose paths are remembered.
CHUNK, LONG = 1_000_000, 64
#: Units of like length from which the forward pass runs over all of them at once.
TOGETHER = 24

ENCODED = "ids array<int>, score double, nbest array<struct<score: double, edits: array<struct<at: int, n: int, ids: array<int>>>>>"


class Pieces:
    """The vocabulary of a SentencePiece model file, as bytes."""

    def __init__(self, model: bytes):
        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.names, self.by_name, self.bytes = [], {}, {}
        for i in range(processor.get_piece_size()):
            name = processor.id_to_piece(i)
            self.names.append(name)
            if processor.is_byte(i):
                self.bytes[int(name[3:5], 16)] = i
            elif not (processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i)):
                self.by_name[name] = (i, processor.get_score(i))
        self.longest = max(map(len, self.by_name))
        self.unknown = min(s for _, s in self.by_name.values() if s > PLACEHOLDER) - PENALTY
        self.by_name = {name: (i, s if s > PLACEHOLDER else self.unknown) for name, (i, s) in self.by_name.items()}
        self.byte_of = {i: b for b, i in self.bytes.items()}

    def fallback(self, c: str) -> tuple[int, ...]:
        """Ids of a character that is no piece: those of its UTF-8 bytes. A literal ▁ of the text is one, so that decoding is exact."""
        return tuple(self.bytes[b] for b in c.encode())

    @cached_property
    def trie(self):
        """The node of each first character (0: none); sorted keys node * 2^21 + character and the node each leads to; each node's piece id or -1; each id's score."""
        children, ends = {}, {0: -1}
        for name, (i, _) in self.by_name.items():
            node = 0
            for c in name:
                node = children.setdefault((node << 21) | ord(c), len(children) + 1)
            ends[node] = i
        first = np.zeros(LITERAL + 1, np.int32)
        for key, node in children.items():
            if key <= LITERAL:
                first[key] = node
        keys = np.array(sorted(children), np.int64)
        piece = np.full(len(children) + 1, -1, np.int32)
        piece[list(ends)] = list(ends.values())
        score = np.zeros(len(self.names))
        for i, s in self.by_name.values():
            score[i] = s
        return first, keys, np.array([children[k] for k in keys.tolist()], np.int32), piece, score

    @cached_property
    def inner_pairs(self):
        """Sorted codes a * 2^21 + b of the neighbouring characters that some piece holds; all other pairs are cuts."""
        pairs = {(ord(a) << 21) | ord(b) for name in self.by_name for a, b in zip(name, name[1:], strict=False)}
        return np.array(sorted(pairs), np.int64)


def _member(sorted_values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return at, sorted_values[at] == x


#: Stands for a literal ▁ of a text inside the lattice; beyond Unicode, so no text and no piece holds it.
LITERAL = 0x1FFFFF
#: Stands for LITERAL in strings: a lone surrogate, which no piece holds either.
_LITERAL_CHAR = "\ud800"


def _string(codes: np.ndarray) -> str:
    """The string of lattice codes."""
    return "".join([_LITERAL_CHAR if c == LITERAL else chr(c) for c in codes.tolist()])


def lattice_codes(text: str) -> np.ndarray:
    """Code points of the lattice of a text: ▁ in front and for each blank; empty for the empty text."""
    if not text:
        return np.zeros(0, np.int64)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    codes = np.where(codes == ord(SPACE), LITERAL, np.where(codes == 32, ord(SPACE), codes))
    return np.concatenate(([ord(SPACE)], codes))


class Segmenter:
    def __init__(self, model: bytes, n_best: int = N_BEST):
        self.pieces, self.n_best, self.found = Pieces(model), n_best, {}

    def forward(self, units: np.ndarray, lengths: np.ndarray):
        """Viterbi over a matrix of units (padded): the best score and its piece's id and length for each prefix, and each unit's second best score."""
        first, keys, nodes, piece, score = self.pieces.trie
        rows, width = units.shape
        best = np.full((rows, width + 1), -np.inf)
        second = np.full((rows, width + 1), -np.inf)
        back, ids = np.zeros((rows, width + 1), np.int32), np.full((rows, width + 1), -1, np.int32)
        best[:, 0] = 0.0

        def put(at, start, end, cost, length, which):
            b1, b2 = best[at, start] + cost, second[at, start] + cost
            o1, o2 = best[at, end], second[at, end]
            better = b1 > o1
            second[at, end] = np.maximum(np.minimum(b1, o1), np.maximum(b2, o2))
            won = at[better]
            best[won, end] = b1[better]
            back[won, end] = length
            ids[won, end] = which[better] if isinstance(which, np.ndarray) else which

        for start in range(width):
            at = np.flatnonzero(lengths > start)
            known = np.zeros(rows, bool)
            for length in range(1, min(self.pieces.longest, width - start) + 1):
                if length == 1:
                    node = first[units[at, start]].astype(np.int64)
                    at, node = at[node > 0], node[node > 0]
                else:
                    inside = lengths[at] >= start + length
                    at, node = at[inside], node[inside]
                    if not len(at):
                        break
                    place, hit = _member(keys, (node << 21) | units[at, start + length - 1])
                    at, node = at[hit], nodes[place[hit]].astype(np.int64)
                which = piece[node]
                full = which >= 0
                if length == 1:
                    known[at[full]] = True
                put(at[full], start, start + length, score[which[full]], length, which[full])
            rest = np.flatnonzero((lengths > start) & ~known)
            put(rest, start, start + 1, self.pieces.unknown, 1, -1)
        return best, second, back, ids

    def forward_one(self, codes: np.ndarray):
        """``forward`` for one unit, place by place: lists of best, second, back and ids."""
        by_name, longest, text = self.pieces.by_name, self.pieces.longest, _string(codes)
        n = len(text)
        best, second = [0.0] + [-np.inf] * n, [-np.inf] * (n + 1)
        back, which = [0] * (n + 1), [-1] * (n + 1)
        for start in range(n):
            for end in range(start + 1, min(n, start + longest) + 1):
                i, cost = by_name.get(text[start:end]) or ((-1, self.pieces.unknown) if end == start + 1 else (0, None))
                if cost is None:
                    continue
                b1, b2, o1 = best[start] + cost, second[start] + cost, best[end]
                second[end] = max(min(b1, o1), b2, second[end])
                if b1 > o1:
                    best[end], back[end], which[end] = b1, end - start, i
        return best, second, back, which

    def search(self, codes: np.ndarray, ahead: np.ndarray) -> list[tuple[float, tuple[int, ...]]]:
        """The N best paths of a unit, best first, as (score, ids), by backward A*; ``ahead``: its forward scores.

        Ties go to the way whose end is nearest to the start of the unit. A way is a place with a link to the way that
        it came from; the edges into a place are tried from the best on, the next one as soon as one has been taken.
        """
        text, n = _string(codes), len(codes)
        if text in self.found:
            return self.found[text]
        pieces, ahead, into, visits = self.pieces, ahead.tolist(), {}, Counter()

        def edges(end):
            """(forward score, start, cost, ids) of the edges into a place, best first."""
            if end not in into:
                some = []
                for start in range(max(0, end - pieces.longest), end):
                    known = pieces.by_name.get(text[start:end])
                    if known is not None:
                        some.append((-ahead[start] - known[1], start, known[1], (known[0],)))
                    elif end - start == 1:
                        c = SPACE if text[start] == _LITERAL_CHAR else text[start]
                        some.append((-ahead[start] - pieces.unknown, start, pieces.unknown, pieces.fallback(c)))
                into[end] = sorted(some)
            return into[end]

        ways, out = [(n, 0.0, None, ())], []  # place, score from there on, the way it came from, ids of the last edge
        heap = [(edges(n)[0][0], edges(n)[0][1], 0, 0)]  # negative score, start, way, number of the edge into its place
        while heap and len(out) < self.n_best:
            _, start, way, k = heapq.heappop(heap)
            end, behind, _, _ = ways[way]
            some = edges(end)
            if k + 1 < len(some):
                heapq.heappush(heap, (some[k + 1][0] - behind, some[k + 1][1], way, k + 1))
            if visits[start] == self.n_best:
                continue
            visits[start] += 1
            ways.append((start, behind + some[k][2], way, some[k][3]))
            if start:
                first = edges(start)[0]
                heapq.heappush(heap, (first[0] - ways[-1][1], first[1], len(ways) - 1, 0))
                continue
            path, at = [], len(ways) - 1
            while at is not None:
                path += ways[at][3]
                at = ways[at][2]
            out.append((ways[-1][1], tuple(path)))
        if n <= LONG and len(self.found) < 20_000:
            self.found[text] = out
        return out

    def segment(self, texts: list[str]):
        """For each text (ids, score, nbest); see ``encode_texts``."""
        codes = [lattice_codes(t) for t in texts]
        sizes = np.array([len(c) for c in codes])
        flat = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        if not len(flat):
            return [([], 0.0, [(0.0, [])]) for _ in texts]
        ends = np.cumsum(sizes)
        cut = np.ones(len(flat), bool)
        cut[1:] = ~_member(self.pieces.inner_pairs, (flat[:-1] << 21) | flat[1:])[1]
        cut[ends[:-1][sizes[1:] > 0]] = True
        starts = np.flatnonzero(cut)
        lengths = np.diff(np.append(starts, len(flat)))
        first_unit = np.searchsorted(starts, ends - sizes)
        last_unit = np.searchsorted(starts, ends)

        # equal units by hash; places compares them character by character
        power = np.uint64(0x9E3779B97F4A7C15) ** np.arange(1, lengths.max() + 1, dtype=np.uint64)
        inside = np.arange(len(flat)) - np.repeat(starts, lengths)
        hashes = np.add.reduceat((flat.astype(np.uint64) + np.uint64(1)) * power[inside], starts)
        hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + lengths.astype(np.uint64)
        _, heads, unit = np.unique(hashes, return_index=True, return_inverse=True)
        if (lengths[heads][unit] != lengths).any() or (flat[np.repeat(starts[heads][unit], lengths) + inside] != flat).any():
            heads, unit = np.arange(len(starts)), np.arange(len(starts))

        u_start, u_length = starts[heads], lengths[heads]
        best, gap, id_lists = np.zeros(len(heads)), np.full(len(heads), np.inf), [None] * len(heads)
        flat_ids, flat_rows, flat_from = [], [], []
        prefix_at = np.cumsum(u_length + 1) - u_length - 1
        prefixes = np.empty(int((u_length + 1).sum()))  # the forward scores of all units
        order = np.argsort(u_length, kind="stable")
        at = 0
        while at < len(order):
            width = int(u_length[order[at]])
            limit = min(len(order), at + max(1, 1_500_000 // (width + 8)))
            some = order[at:limit]
            some = some[u_length[some] <= width + 3]
            at += len(some)
            if len(some) < TOGETHER:
                for u in some.tolist():
                    n = int(u_length[u])
                    b, s, back, ids = self.forward_one(flat[u_start[u] : u_start[u] + n])
                    prefixes[prefix_at[u] : prefix_at[u] + n + 1] = b
                    best[u], gap[u] = b[n], b[n] - s[n]
                    end, own_ids, own_from = n, [], []
                    while end:
                        own_ids.append(ids[end])
                        end -= back[end]
                        own_from.append(end)
                    flat_ids.append(np.array(own_ids, np.int32))
                    flat_rows.append(np.full(len(own_ids), u))
                    flat_from.append(np.array(own_from, np.int32))
                continue
            width = int(u_length[some].max())
            columns = np.arange(width)
            rows = np.where(columns < u_length[some, None], flat[np.minimum(u_start[some, None] + columns, len(flat) - 1)], 0)
            b, s, back, ids = self.forward(rows, u_length[some])
            own = np.arange(len(some))
            inner = np.arange(width + 1) <= u_length[some, None]
            prefixes[(prefix_at[some, None] + np.arange(width + 1))[inner]] = b[inner]
            best[some] = b[own, u_length[some]]
            gap[some] = best[some] - s[own, u_length[some]]
            place, alive = u_length[some].copy(), own
            while len(alive):
                end = place[alive]
                flat_ids.append(ids[alive, end])
                place[alive] = end - back[alive, end]
                flat_rows.append(some[alive])
                flat_from.append(place[alive])
                alive = alive[place[alive] > 0]
        all_ids, all_rows, all_from = np.concatenate(flat_ids), np.concatenate(flat_rows), np.concatenate(flat_from)
        sort = np.lexsort((all_from, all_rows))
        all_ids, all_rows, all_from = all_ids[sort], all_rows[sort], all_from[sort]
        unknown = np.flatnonzero(all_ids < 0)
        if len(unknown):  # a character by its bytes
            chars = flat[u_start[all_rows[unknown]] + all_from[unknown]]
            spelled = {c: np.array(self.pieces.fallback(SPACE if c == LITERAL else chr(c)), np.int32) for c in np.unique(chars).tolist()}
            widths = np.ones(len(all_ids), np.int64)
            widths[unknown] = [len(spelled[c]) for c in chars.tolist()]
            wide = np.repeat(all_ids, widths)
            offset = np.cumsum(widths) - widths
            for i, c in zip(unknown.tolist(), chars.tolist(), strict=True):
                wide[offset[i] : offset[i] + widths[i]] = spelled[c]
            all_ids, all_rows = wide, np.repeat(all_rows, widths)
        counts = np.bincount(all_rows, minlength=len(heads))
        begin = np.cumsum(counts) - counts

        unit_counts = counts[unit]
        token_end = np.cumsum(unit_counts)
        token_ids = all_ids[np.repeat(begin[unit] - (token_end - unit_counts), unit_counts) + np.arange(token_end[-1])]
        token_from = token_end - unit_counts
        out = []
        for k in range(len(texts)):
            a, b = int(first_unit[k]), int(last_unit[k])
            if a == b:
                out.append((token_ids[:0], 0.0, [(0.0, [])]))
                continue
            own = unit[a:b]
            score = float(best[own].sum())
            low = int(token_from[a])
            gaps = gap[own]
            picked = min(self.n_best - 1, len(gaps))
            some = np.argpartition(gaps, picked - 1)[:picked] if picked else np.zeros(0, int)
            if picked:  # ties by place
                worst = gaps[some].max()
                some = np.concatenate((np.flatnonzero(gaps < worst), np.flatnonzero(gaps == worst)))[:picked]
            some = np.sort(some[np.isfinite(gaps[some])])
            choices = []
            for j in some.tolist():
                u = int(own[j])
                mine = tuple(all_ids[begin[u] : begin[u] + counts[u]].tolist())
                paths = self.search(flat[u_start[u] : u_start[u] + u_length[u]], prefixes[prefix_at[u] : prefix_at[u] + u_length[u] + 1])
                others = [(float(best[u]) - s, p) for s, p in paths if p != mine][: self.n_best - 1]
                choices.append([(loss, *_edit(int(token_from[a + j]) - low, mine, p)) for loss, p in others])
            out.append((token_ids[low : int(token_end[b - 1])], score, _combined(score, choices, self.n_best)))
        return out


def _edit(at: int, old: tuple[int, ...], new: tuple[int, ...]) -> tuple[int, int, list[int]]:
    """The edit (at, n, ids) that turns the ids ``old`` from place ``at`` on into ``new``, without what both have at their ends."""
    most = min(len(old), len(new))
    head = next((i for i in range(most) if old[i] != new[i]), most)
    tail = next((i for i in range(most - head) if old[-1 - i] != new[-1 - i]), most - head)
    return at + head, len(old) - head - tail, list(new[head : len(new) - tail])


def _combined(score: float, choices: list, n: int) -> list:
    """The ``n`` best ways to take an alternative (loss, at, length, ids) or none at each of a few places, best first."""
    ways = [(0.0, ())]
    for place, others in enumerate(choices):
        ways += [(loss + other[0], edits + ((place, k),)) for loss, edits in ways for k, other in enumerate(others)]
        ways = heapq.nsmallest(n, ways)
    return [(score - loss, [choices[p][k][1:] for p, k in edits]) for loss, edits in ways]


def model_bytes(model: str) -> bytes:
    with open(model, "rb") as file:
        return file.read()


def encode_texts(docs: DataFrame, text: str = "text", model: str = MODEL, n_best: int = N_BEST) -> DataFrame:
    """``docs`` without ``text`` and with ids, score and nbest.

    ids are the piece ids of the best segmentation, ties going to the longer last piece; score is its sum of piece
    scores. nbest lists the ``n_best`` best segmentations, or all if there are fewer, best first: each as its score
    and its edits of ids, (at, n, ids): from place ``at`` on, ``n`` ids give way to the edit's. A blank in front is
    part of every text that is not empty. Null and empty texts have no ids, score 0 and one segmentation, the empty
    one. Repeated rows are encoded one by one; an empty table gives no rows. Columns of ``docs`` by the name of an
    output column, in any case, give way to it. The model file is read on the driver and sent along.
    """
    model = docs.sparkSession.sparkContext.broadcast(model_bytes(model))
    new = T.StructType.fromDDL(ENCODED)
    others = [c for c in docs.columns if c != text and c.lower() not in new.names]
    schema = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in others] + new.fields)
    edit = pa.struct([("at", pa.int32()), ("n", pa.int32()), ("ids", pa.list_(pa.int32()))])
    best = pa.list_(pa.struct([("score", pa.float64()), ("edits", pa.list_(edit))]))

    def run(batches):
        segmenter = Segmenter(model.value, n_best)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            sizes = pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False)
            total, at = np.cumsum(sizes), 0
            while at < len(batch):
                end = max(at + 1, int(np.searchsorted(total, total[at] - sizes[at] + CHUNK, "right")))
                done = segmenter.segment([t or "" for t in column.slice(at, end - at).to_pylist()])
                offsets = np.concatenate(([0], np.cumsum([len(d[0]) for d in done]))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.asarray(d[0], np.int32) for d in done])))
                nbest = pa.array([[{"score": s, "edits": [{"at": a, "n": n, "ids": i} for a, n, i in edits]} for s, edits in d[2]] for d in done], best)
                kept = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([*(kept.column(i) for i in range(len(others))), ids, pa.array([d[1] for d in done]), nbest], [*others, "ids", "score", "nbest"])
                at = end

    plain = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]  # mapInArrow can't take names with dots
    return docs.select(*plain, F.col(text).alias("text")).mapInArrow(run, schema)


def edited(ids: list[int], edits: list[tuple[int, int, list[int]]]) -> list[int]:
    """The ids of another segmentation: ``ids`` with its edits applied."""
    out, at = [], 0
    for start, n, new in sorted(edits):
        out += [*ids[at:start], *new]
        at = start + n
    return out + list(ids[at:])


def decode_ids(ids, pieces: Pieces, spelled: list[bytes] | None = None) -> str:
    """The text of piece ids; unknown bytes sequences are replaced, and the blank in front is dropped."""
    spelled = spelled or spellings(pieces)
    text = b"".join(map(spelled.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def spellings(pieces: Pieces) -> list[bytes]:
    """The bytes that each id stands for; control pieces stand for nothing."""
    out = [b""] * len(pieces.names)
    for name, (i, _) in pieces.by_name.items():
        out[i] = name.replace(SPACE, " ").encode()
    for b, i in pieces.bytes.items():
        out[i] = bytes([b])
    return out


def decoded(spark: SparkSession, column: str = "ids", model: str = MODEL):
    """A text column decoded from a column of ids; null stays null."""
    shipped = spark.sparkContext.broadcast(model_bytes(model))
    kept = {}

    @F.pandas_udf("string")
    def run(ids: pd.Series) -> pd.Series:
        if "pieces" not in kept:
            kept["pieces"] = Pieces(shipped.value)
            kept["spelled"] = spellings(kept["pieces"])
        return pd.Series([None if i is None else decode_ids(i.tolist(), kept["pieces"], kept["spelled"]) for i in ids], dtype=object)

    return run(F.col(column))
