"""Differences of texts line by line: the fewest removed and added lines, in linear space.

The middle of a shortest edit path is looked for from both ends at once; what lies before and after it is compared in the
same way. Time is in proportion to the lines times the number of changes.
"""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql.functions import arrow_udf

#: Rows of texts in an Arrow batch: a task holds one batch's texts and what differs in them.
BATCH_ROWS = 128
HUNKS = "array<struct<old_start:int,new_start:int,removed:array<string>,added:array<string>>>"


def _middle(a: list[int], b: list[int]) -> tuple[int, int]:
    """A place (x, y) that a shortest edit path of a and b goes through, neither its start nor its end; a and b differ at both ends."""
    n, m = len(a), len(b)
    forth, back = {1: 0}, {1: 0}
    odd = (n - m) % 2 == 1
    for d in range((n + m + 1) // 2 + 1):
        for k in range(-d, d + 1, 2):
            x = forth[k + 1] if k == -d or k != d and forth.get(k - 1, -1) < forth.get(k + 1, -1) else forth[k - 1] + 1
            y = x - k
            while x < n and y < m and a[x] == b[y]:
                x, y = x + 1, y + 1
            forth[k] = x
            other = n - m - k
            if odd and -d < other < d and x + back.get(other, -1) >= n:
                return x, y
        for k in range(-d, d + 1, 2):
            x = back[k + 1] if k == -d or k != d and back.get(k - 1, -1) < back.get(k + 1, -1) else back[k - 1] + 1
            y = x - k
            while x < n and y < m and a[n - 1 - x] == b[m - 1 - y]:
                x, y = x + 1, y + 1
            back[k] = x
            other = n - m - k
            if not odd and -d <= other <= d and x + forth.get(other, -1) >= n:
                return n - x, m - y
    raise AssertionError("an edit path has a middle")


def changes(old: list[str], new: list[str]) -> list[tuple[int, int, int, int]]:
    """(old_from, old_to, new_from, new_to) of what differs, in order, each as long as it goes."""
    number: dict[str, int] = {}
    a, b = ([number.setdefault(x, len(number)) for x in lines] for lines in (old, new))
    out: list[list[int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        i, j, k, m = work.pop()
        while i < j and k < m and a[i] == b[k]:
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
        if i == j and k == m:
            continue
        if i == j or k == m:
            if out and out[-1][1] == i and out[-1][3] == k:
                out[-1][1], out[-1][3] = j, m
            else:
                out.append([i, j, k, m])
            continue
        x, y = _middle(a[i:j], b[k:m])
        if (x, y) in ((0, 0), (j - i, m - k)):  # no line in common: all of it is changed
            work += [(j, j, k, m), (i, j, k, k)]
            continue
        work += [(i + x, j, k + y, m), (i, i + x, k, k + y)]
    return [tuple(c) for c in out]


def hunks_of(old: str | None, new: str | None) -> list[dict]:
    a, b = (old or "").split("\n"), (new or "").split("\n")
    return [{"old_start": i + 1, "new_start": k + 1, "removed": a[i:j], "added": b[k:m]} for i, j, k, m in changes(a, b)]


def _hunks(old: pa.Array, new: pa.Array) -> pa.Array:
    """``hunks_of`` of each row as one array, without a Python object for each hunk."""
    per_row, old_start, new_start, sizes, lines = [], [], [], ([], []), ([], [])
    for x, y in zip(old, new, strict=True):
        a, b = (x.as_py() or "").split("\n"), (y.as_py() or "").split("\n")
        found = changes(a, b)
        per_row.append(len(found))
        for i, j, k, m in found:
            old_start.append(i + 1)
            new_start.append(k + 1)
            for side, part in enumerate((a[i:j], b[k:m])):
                sizes[side].append(len(part))
                lines[side].extend(part)
    offsets = lambda counts: pa.array(accumulate(counts, initial=0), pa.int32())
    removed, added = (pa.ListArray.from_arrays(offsets(n), pa.array(x, pa.string())) for n, x in zip(sizes, lines, strict=True))
    each = pa.StructArray.from_arrays([pa.array(old_start, pa.int32()), pa.array(new_start, pa.int32()), removed, added], ["old_start", "new_start", "removed", "added"])
    return pa.ListArray.from_arrays(offsets(per_row), each)


def line_hunks(old: Column, new: Column) -> Column:
    """The hunks that turn ``old`` into ``new``, lines from 1: what each removes and adds. Equal texts have none; null counts as empty.

    The session's Arrow batches are left at BATCH_ROWS rows at most, as rows hold whole texts.
    """
    key, spark = "spark.sql.execution.arrow.maxRecordsPerBatch", SparkSession.getActiveSession()
    if spark and not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))

    @arrow_udf(HUNKS)
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        out = _hunks(a, b)
        pa.default_memory_pool().release_unused()
        return out

    return run(old, new)


def applied(old: str, hunks: list[dict]) -> str:
    """``old`` with its hunks applied: the new text."""
    lines, out, at = old.split("\n"), [], 0
    for h in hunks:
        out += [*lines[at : h["old_start"] - 1], *h["added"]]
        at = h["old_start"] - 1 + len(h["removed"])
    return "\n".join([*out, *lines[at:]])
