"""Repeated consecutive cues: runs that say the same words become one cue with count and duration.

Method: adjacent agglomeration. In each file the non-blank cues form a linked list of runs; a
priority queue holds the similarity of neighbouring runs and the most similar pair merges first,
until no pair meets the similarity limit (and the limit on the silence between them, if one is
given).

Scale: files are cut into blocks of ``block`` cue indexes, so that a file with a third of all rows
is spread over many tasks. A block is one group of a sorted partition. Where no run can reach across
a place between two cues, whatever stands in other blocks, both sides are agglomerated apart. What
lies before the first such place of a block and behind the last one meets again by file, as cues with
equal neighbours joined: some cues a block, unless a run spans the block. So the runs don't depend on
where blocks end.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.llm.captions import is_blank, parse, same_words_key
from cuemill.llm.streams import groups, to_batches

BLOCK = 4096
SAME, ONE_SLIP, TWO_SLIPS = 1.0, 0.95, 0.9

_SCHEMA = "skey bigint, file_id bigint, blk bigint, first_cue bigint, last_cue bigint, n_cues bigint, start_ms bigint, end_ms bigint, content string, forms array<string>, edge int"
_ARROW = pa.schema([(n, pa.int64()) for n in ("skey", "file_id", "blk", "first_cue", "last_cue", "n_cues", "start_ms", "end_ms")] + [("content", pa.string()), ("forms", pa.list_(pa.string())), ("edge", pa.int32())])
_RUNS = "file_id bigint, first_cue bigint, last_cue bigint, n_cues bigint, start_ms bigint, end_ms bigint, content string"
_RUNS_ARROW = pa.schema([(n, pa.int64()) for n in ("file_id", "first_cue", "last_cue", "n_cues", "start_ms", "end_ms")] + [("content", pa.string())])


def cue_key(content: str | None) -> str | None:
    """What a cue says, as a comparable key; None if it is blank.

    ``w:`` and the words, with an ambiguous name before a colon kept apart; ``s:`` and the sound
    annotations for a cue without words; ``f:`` for a cue of nothing but fillers, which is like no
    other.
    """
    if is_blank(content):
        return None
    caption = parse(content)
    words = same_words_key(caption.text)
    if words:
        return f"w:{same_words_key(caption.label) if caption.bare else ''}\n{words}"
    return "s:" + " ".join(sorted(caption.sounds)) if caption.sounds else "f:"


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    i = 0
    while a[i] == b[i]:
        i += 1
    return i


def _after_slip(a: str, b: str) -> Iterator[tuple[str, str]]:
    """The rests of two texts after one slip at their start: a letter too many, too few, swapped
    with the next, or another letter inside a word of an alphabet. Slips never touch digits."""
    if a and not a[0].isdigit():
        yield a[1:], b
    if b and not b[0].isdigit():
        yield a, b[1:]
    if len(a) > 1 and len(b) > 1 and a[0] == b[1] and a[1] == b[0] and not a[0].isdigit() and not a[1].isdigit():
        yield a[2:], b[2:]


def _clauses(a: str, b: str) -> bool:
    """Whether different words before a colon share a part, as reporting clauses do and names don't."""
    return _common(a, b) >= 3 or _common(a[::-1], b[::-1]) >= (1 if a[-1] >= "\u2e80" else 3)


def similarity(a: str, b: str) -> float:
    """How much two cue keys say the same: 1 for the same words, a little less if one or both of
    them hold one small slip, 0 otherwise. Words before a colon that may be a label are compared as
    words first, and left out only if they cannot belong to the sentence."""
    if a == b:
        return 0.0 if a == "f:" else SAME
    if a[0] != "w" or b[0] != "w":
        return 0.0
    (before_a, a), (before_b, b) = a[2:].split("\n", 1), b[2:].split("\n", 1)
    near = _text_similarity(before_a + a, before_b + b)
    if near or not (before_a or before_b):
        return near
    if before_a and before_b:
        return 0.0 if _clauses(before_a, before_b) else _text_similarity(a, b)
    return _text_similarity(a, b)


def _text_similarity(a: str, b: str) -> float:
    if a == b:
        return SAME
    if abs(len(a) - len(b)) > 2 or min(len(a), len(b)) < 4:
        return 0.0
    start = _common(a, b)
    a, b = a[start:], b[start:]
    end = _common(a[::-1], b[::-1])
    if start + end < 3:
        return 0.0
    middle_a, middle_b = a[: len(a) - end], b[: len(b) - end]
    for rest_a, rest_b in _after_slip(middle_a, middle_b):
        if rest_a == rest_b:
            return ONE_SLIP
    if start + end < 12:
        return 0.0
    if len(middle_a) == len(middle_b) == 1 and (middle_a + middle_b).isalpha() and max(middle_a, middle_b) < "\u0e00":
        return ONE_SLIP
    for rest_a, rest_b in _after_slip(a, b):
        same = _common(rest_a, rest_b)
        if same < 2:
            continue
        rest_a, rest_b = rest_a[same:], rest_b[same:]
        if any(x == y for x, y in _after_slip(rest_a, rest_b)):
            return TWO_SLIPS
    return 0.0


class Run:
    """A run of cues; ``forms`` are the different keys of its cues, the first cue's first."""

    __slots__ = ("content", "count", "end", "first", "forms", "last", "start")

    def __init__(self, first: int, last: int, count: int, start: int | None, end: int | None, content: str, forms: list[str]):
        self.first, self.last, self.count, self.start, self.end, self.content, self.forms = first, last, count, start, end, content, forms

    def join(self, other: Run) -> None:
        self.last, self.count = other.last, self.count + other.count
        starts = [x for x in (self.start, other.start) if x is not None]
        ends = [x for x in (self.end, other.end) if x is not None]
        self.start, self.end = min(starts, default=None), max(ends, default=None)
        self.forms += [form for form in other.forms if form not in self.forms]


def runs_similarity(left: Run, right: Run, max_gap_ms: int | None) -> float:
    """Similarity of two neighbouring runs: of the closest pair of their forms, where each form of
    the right run must still say the same as the first cue."""
    if max_gap_ms is not None and left.end is not None and right.start is not None and right.start - left.end > max_gap_ms:
        return 0.0
    if any(not similarity(left.forms[0], form) for form in right.forms):
        return 0.0
    return max(similarity(a, b) for a in left.forms for b in right.forms)


def agglomerate(runs: list[Run], limit: float = TWO_SLIPS, max_gap_ms: int | None = None) -> list[Run]:
    """Merge neighbouring runs, the most similar first, while they reach ``limit``."""
    n = len(runs)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    queue: list[tuple[float, int, int]] = []

    def push(i: int, j: int) -> None:
        near = runs_similarity(runs[i], runs[j], max_gap_ms)
        if near >= limit:
            heapq.heappush(queue, (-near, i, j))

    for i in range(n - 1):
        push(i, i + 1)
    while queue:
        _, i, j = heapq.heappop(queue)
        if not alive[i] or not alive[j] or after[i] != j:
            continue
        runs[i].join(runs[j])
        alive[j] = False
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            push(i, after[i])
        if before[i] >= 0:
            push(before[i], i)
    return [run for run, keep in zip(runs, alive, strict=True) if keep]


def cuts_between(keys: list[str]) -> list[int]:
    """Places i such that no run of these cues holds both cue i and cue i + 1.

    All cues of a run say the same as its first one, so a run that starts at cue j ends before the
    first cue behind it that doesn't. How far each cue reaches is found from the right, up to the next
    cue with its own key, which reaches on from there.
    """
    n = len(keys)
    reach = list(range(n))
    again: dict[str, int] = {}
    for j in range(n - 1, -1, -1):
        twin, k = again.get(keys[j], n), j + 1
        while k < n and k != twin and similarity(keys[j], keys[k]):
            k += 1
        reach[j] = reach[k] if k == twin < n else k - 1
        if keys[j] != "f:":
            again[keys[j]] = j
    found, farthest = [], -1
    for i in range(n - 1):
        farthest = max(farthest, reach[i])
        if farthest == i:
            found.append(i)
    return found


#: Letters by which two cues that say the same differ at most, and of a word before a colon.
_SLIPS, _LABEL = 2, 16


def may_share(a: str, b: str) -> bool:
    """False only if no cue says the same as both: a slip changes two letters at most, and words before
    a colon may be left out."""
    if a == b:
        return a != "f:"
    if a[0] != "w" or b[0] != "w":
        return False
    forms = [[Counter(words), Counter(label + words)] for label, words in (key[2:].split("\n", 1) for key in (a, b))]
    for x in forms[0]:
        for y in forms[1]:
            more, less = (x - y).total(), (y - x).total()
            if min(more, less) <= 2 * _SLIPS and max(more, less) <= 2 * _SLIPS + _LABEL:
                return True
    return False


def _parts(runs: list[Run]) -> tuple[list[Run], list[list[Run]], list[Run] | None]:
    """The cues of a block that may share runs with blocks before it; those that are only among
    themselves, in parts that share no runs; and those that may share runs with blocks behind it, or
    None if all of the block may share runs with both."""
    keys = [run.forms[0] for run in runs]
    open_until = next((i for i, key in enumerate(keys) if not may_share(keys[0], key)), len(keys))
    certain = [i for i in cuts_between(keys) if i >= open_until - 1]
    if not certain:
        return runs, [], None
    return runs[: certain[0] + 1], [runs[a + 1 : b + 1] for a, b in zip(certain, certain[1:], strict=False)], runs[certain[-1] + 1 :]


def _equal_joined(runs: list[Run], max_gap_ms: int | None) -> list[Run]:
    """Cues with the same key as the one before joined to it, as agglomeration does first."""
    out: list[Run] = []
    for run in runs:
        if out and out[-1].forms == run.forms and runs_similarity(out[-1], run, max_gap_ms) == SAME:
            out[-1].join(run)
        else:
            out.append(run)
    return out


def _in_block(limit: float, max_gap_ms: int | None, smallest: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for (file_id, blk), cues in groups(batches, 2):
                runs: list[Run] = []
                seen = None
                for _, _, index, content, start, end in cues:
                    if index == seen:
                        continue
                    seen = index
                    key = cue_key(content)
                    if key is not None:
                        runs.append(Run(index, index, 1, start, end, content, [key]))
                if not runs:
                    continue
                head, inner, tail = _parts(runs)
                for edge, part in ((1 if tail is not None else 3, head), (2, tail or [])):
                    for run in _equal_joined(part, max_gap_ms):
                        yield file_id, file_id, blk, run.first, run.last, run.count, run.start, run.end, run.content, run.forms, edge
                for part in inner:
                    for run in agglomerate(part, limit, max_gap_ms) if len(part) > 1 else part:
                        if run.count >= smallest:
                            yield file_id ^ (blk << 40), file_id, blk, run.first, run.last, run.count, run.start, run.end, run.content, [], 0

        yield from to_batches(rows(), _ARROW)

    return work


def _across_blocks(limit: float, max_gap_ms: int | None, smallest: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            waiting: list[Run] = []
            place = None

            def done(file_id: int) -> Iterator[tuple]:
                for run in agglomerate(waiting, limit, max_gap_ms):
                    if run.count >= smallest:
                        yield file_id, run.first, run.last, run.count, run.start, run.end, run.content

            for batch in batches:
                for _, file_id, blk, first, last, count, start, end, content, forms, edge in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if not edge:
                        yield file_id, first, last, count, start, end, content
                        continue
                    if waiting and (place[0] != file_id or (edge == 2 and place != (file_id, blk, 2))):
                        yield from done(place[0])
                        waiting = []
                    waiting.append(Run(first, last, count, start, end, content, forms))
                    place = (file_id, blk, edge)
            if waiting:
                yield from done(place[0])

        yield from to_batches(rows(), _RUNS_ARROW)

    return work


def start_ms(timestamps: str) -> F.Column:
    """Milliseconds of the first clock time in a cue's timestamps; null if there is none."""
    return _clock(timestamps, 1)


def _clock(timestamps: str, which: int) -> F.Column:
    times = F.regexp_extract_all(F.col(timestamps), F.lit(r"(?:(\d+):)?(\d{1,2}):(\d{1,2})(?:[.,](\d{1,3}))?"), F.lit(0))
    text = F.try_element_at(times, F.lit(which))
    parts = F.split(F.regexp_replace(text, r"[.,]\d*$", ""), ":")
    seconds = F.aggregate(parts, F.lit(0).cast("bigint"), lambda total, part: total * 60 + F.coalesce(part.try_cast("bigint"), F.lit(0)))
    fraction = F.rpad(F.regexp_extract(text, r"[.,](\d{1,3})$", 1), 3, "0").try_cast("bigint")
    return F.when(text.isNotNull(), seconds * 1000 + F.coalesce(fraction, F.lit(0)))


def repeated_runs(cues: DataFrame, *, smallest: int = 1, limit: float = TWO_SLIPS, max_gap_ms: int | None = None, block: int = BLOCK) -> DataFrame:
    """Runs of consecutive cues with the same words: one row per run of at least ``smallest`` cues.

    Columns: file_id, first_cue, last_cue, n_cues, start_ms, end_ms, duration_ms, content (of the
    first cue). Cues that say the same differ at most in case, width, spacing, punctuation, markup,
    label, fillers, annotations and one small slip each; never in a number or a thing named. Blank
    cues (null, white or invisible) belong to no run and end none. Cues without words form a run if
    they have the same annotations. A cue delivered twice counts once. Rows without file_id or
    cue_index have no place and are left out. Missing or damaged timestamps give null times, or
    those of the run's other cues. An empty table gives no rows; other columns are ignored.
    """
    placed = cues.select(
        F.col("file_id").cast("bigint").alias("file_id"),
        F.floor(F.col("cue_index") / block).cast("bigint").alias("blk"),
        F.col("cue_index").cast("bigint").alias("cue_index"),
        F.col("content").cast("string").alias("content"),
        start_ms("timestamps").alias("start_ms"),
        _clock("timestamps", 2).alias("end_ms"),
    ).where("file_id is not null and cue_index is not null")
    sorted_cues = placed.repartition("file_id", "blk").sortWithinPartitions("file_id", "blk", "cue_index", "content")
    parts = sorted_cues.mapInArrow(_in_block(limit, max_gap_ms, smallest), _SCHEMA)
    ends = parts.repartition("skey").sortWithinPartitions("skey", "file_id", "blk", "first_cue")
    return ends.mapInArrow(_across_blocks(limit, max_gap_ms, smallest), _RUNS).withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))
