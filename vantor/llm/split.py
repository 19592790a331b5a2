"""Splitting long texts at natural boundaries by agglomerative merging."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1500, 150
#: Strength of a boundary, weakest first; a forced one lies inside an unbroken run of more than the limit, a tight one inside a shorter run.
TIGHT, FORCED, WORD, SENTENCE, LINE, PARAGRAPH = range(6)
NAMES = ("tight", "forced", "word", "sentence", "line", "paragraph")
_BREAKS = " \t\r\n.!?;。！？；"
_ATOM = re.compile(f"[^{_BREAKS}]*[{_BREAKS}]+|[^{_BREAKS}]+")
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n[\s]*$")


def _strength(text: str, atom_end: int, start: int) -> int:
    """Strength of the boundary after an atom, from the breaks at its end."""
    at = atom_end
    while at > start and text[at - 1] in _BREAKS:
        at -= 1
    tail = text[at:atom_end]
    if tail.count("\n") > 1 or tail.count("\r\r") or _PARAGRAPH.search(tail):
        return PARAGRAPH
    if "\n" in tail or "\r" in tail:
        return LINE
    if any(c in "。！？；" for c in tail) or (tail and tail[0] in ".!?;" and len(tail) > 1):
        return SENTENCE
    return WORD


def _atoms(text: str, capacity: int, limit: int) -> list[tuple[int, int, int]]:
    """(start, end, strength of the boundary at end) of the atomic segments.

    A run without breaks stays whole up to the limit and is cut by the capacity beyond it. Breaks that make an atom too
    long stand alone.
    """
    out = []
    for m in _ATOM.finditer(text):
        start, end = m.span()
        strength = _strength(text, end, start)
        if end - start <= capacity:
            out.append((start, end, strength))
            continue
        run = end
        while run > start and text[run - 1] in _BREAKS:
            run -= 1
        if run - start > limit:
            while run - start > capacity:
                out.append((start, start + capacity, FORCED))
                start += capacity
        if run > start:
            out.append((start, run, WORD if run < end else strength))
        out += [(i, min(i + capacity, end), WORD if i + capacity < end else strength) for i in range(run, end, capacity)]
    return out


def _sentences(atoms: list[tuple[int, int, int]], capacity: int) -> list[list[tuple[int, int, int]]]:
    """The atoms of each sentence that fits together, other atoms by themselves: merging the weakest boundaries first would do just that."""
    out, first = [], 0
    for i, (_, end, strength) in enumerate(atoms):
        if strength >= SENTENCE or i == len(atoms) - 1:
            if end - atoms[first][0] <= capacity:
                out.append(atoms[first : i + 1])
            else:
                out += [[a] for a in atoms[first : i + 1]]
            first = i + 1
    return out


def _segments(units: list[list[tuple[int, int, int]]], limit: int, capacity: int) -> list[tuple[int, int, int]]:
    """(start, end, strength of the boundary at end) of segments that fit one after another, with overlaps between them.

    From the end of the text, each segment tells how much of the overlap must lie behind the cut before it. One that can't
    hold what the next asks for gives way: a sentence to its atoms, a single run to its halves.
    """
    todo, out, need = units[:], [], 0
    while todo:
        unit = todo.pop()
        start, end, strength = unit[0][0], unit[-1][1], unit[-1][2]
        size = end - start + need
        if size > limit:
            if len(unit) > 1:
                todo += [[a] for a in unit]
            else:
                middle = start + (end - start) // 2
                todo += [[(start, middle, TIGHT)], [(middle, end, strength)]]
            continue
        out.append((start, end, strength))
        need = max(0, size - capacity)
    return out[::-1]


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """(start, end, kind of the cut at its end) of consecutive pieces of at most `limit` characters, each sharing `overlap` characters with the next.

    Adjacent segments lie in a heap by the strength of the boundary between them; the weakest boundary is merged first
    (of equals the pair that is smallest, then the leftmost), as long as the pair and the overlap fit. A cut's overlap lies before it, except
    for what the piece after it can't hold (its segment being longer than limit - overlap): that part lies behind the cut. So a run of up to
    `limit` characters stays whole unless its neighbours are nearly as long ("tight"). The last piece's kind is "end".
    A text that fits is one piece; an empty one gives none.
    """
    if not 0 <= overlap * 3 < limit:
        raise ValueError("the overlap must be less than a third of the limit")
    n = len(text)
    if n <= limit:
        return [(0, n, "end")] if n else []
    capacity = limit - overlap
    fixed = _segments(_sentences(_atoms(text, capacity, limit), capacity), limit, capacity)
    count = len(fixed)
    start_of, end_of, strength_of = ([u[i] for u in fixed] for i in range(3))
    before, after = list(range(-1, count - 1)), [*range(1, count), -1]
    alive = [True] * count
    # what of the overlap with the next segment lies behind a segment's end
    behind = [0] * count
    for i in range(count - 2, -1, -1):
        behind[i] = max(0, end_of[i + 1] - start_of[i + 1] + behind[i + 1] - capacity)

    def push(i: int) -> None:
        j = after[i]
        if j >= 0 and end_of[j] - start_of[i] + behind[j] <= (limit if before[i] < 0 else capacity):
            heapq.heappush(heap, (strength_of[i], end_of[j] - start_of[i], start_of[i], i, j))

    heap: list[tuple[int, int, int, int, int]] = []
    for i in range(count):
        push(i)
    while heap:
        _, size, start, i, j = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or after[i] != j or end_of[j] - start_of[i] != size:
            continue
        alive[j] = False
        end_of[i], strength_of[i], after[i], behind[i] = end_of[j], strength_of[j], after[j], behind[j]
        if after[j] >= 0:
            before[after[j]] = i
        # the pair fits with its overlap before it, so the segments to its left may have more room than before
        at = before[i]
        while at >= 0:
            nxt = after[at]
            asked = max(0, end_of[nxt] - start_of[nxt] + behind[nxt] - capacity)
            changed, behind[at] = asked < behind[at], asked
            push(at)
            if not changed:
                break
            at = before[at]
        push(i)
    pieces, i, left = [], 0, 0
    while i >= 0:
        nxt = after[i]
        if nxt < 0:
            pieces.append((left, end_of[i], "end"))
            break
        # a first segment that is shorter than the overlap takes the rest from behind
        end = max(end_of[i] + behind[i], overlap + 1 if before[i] < 0 else 0)
        pieces.append((left, end, NAMES[strength_of[i]]))
        left, i = end - overlap, nxt
    return pieces


def _split(df: DataFrame, key: str, text: str, limit: int, overlap: int) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()
    names = [key, "piece_no", "start", "cut", "piece"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows: tuple[list, ...] = ([], [], [], [], [])
                for i, body in enumerate(part.column(1).to_pylist()):
                    for k, (start, end, cut) in enumerate(split_text(body, limit, overlap)):
                        for column, value in zip(rows, (i, k, start, cut, body[start:end]), strict=True):
                            column.append(value)
                keys = part.column(0).take(pa.array(rows[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.string()), pa.array(rows[4], pa.string())], names)

    long = df.select(F.col(key), F.col(text).alias("text")).where(F.length("text") > limit)
    return long.mapInArrow(run, f"`{key}` {kind}, piece_no int, start int, cut string, piece string")


def split_texts(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Rows (key, piece_no, start, cut, piece) for every text longer than the limit.

    piece_no counts from 0, start is the piece's first character in the text, cut the kind of boundary at the piece's
    end (paragraph, line, sentence, word, forced; end for the last). The cut is "forced" only inside a run of more than
    `limit` characters without white space or sentence end; where runs of nearly that length touch, one of them may be cut, of kind "tight".
    Lengths count Unicode code points. Null, empty and short texts give no rows; repeated rows of a key with one text
    give one set of pieces; other columns are ignored.
    """
    return _split(df, key, text, limit, overlap).dropDuplicates([key, "piece_no", "start", "cut", "piece"])


def split_kinds(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Rows (key, kind), one per key whose text was split: "forced" if one of its cuts had to lie inside an unbroken run, else "natural"."""
    cuts = _split(df, key, text, limit, overlap).select(key, (F.col("cut") == "forced").alias("forced"))
    return cuts.groupBy(key).agg(F.when(F.max("forced"), "forced").otherwise("natural").alias("kind"))
