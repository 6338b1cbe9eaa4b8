"""Positions, references, call hierarchies and bindings."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from codeloom.operators import extract, structure
from codeloom.operators.staging import stage

REFERENCE_KINDS = ("calls", "uses", "references")
# Kinds of symbols and how near they are as the container of a place; others are 5.
NEARNESS = {"function": 1, "method": 1, "constructor": 1, "class": 2, "interface": 2, "namespace": 3, "variable": 10, "constant": 10, "property": 10}


def bins(first: Column, last: Column) -> Column:
    """The whole numbers from ``first`` to ``last`` (not negative) as an array of dyadic bins (level, bin).

    A bin of level k holds 2^k numbers; an interval of n numbers takes fewer than 2 log n bins, and a number is in
    exactly one bin of each level, so that it meets an interval's bins once if the interval holds it, and else never.
    """
    size = last - first + 1
    levels = F.sequence(F.lit(0), F.floor(F.log2(size.cast("double"))).cast("int"))

    def at(k: Column) -> Column:
        width = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        low, past = F.floor((first + width - 1) / width), F.floor((last + 1) / width)  # doubles hold places below 2^53
        some = low < past
        left = F.when(some & (low % 2 == 1), F.struct(k.alias("level"), low.alias("bin")))
        right = F.when(some & (past % 2 == 1), F.struct(k.alias("level"), (past - 1).alias("bin")))
        return F.array(left, right)

    return F.when(size > 0, F.filter(F.flatten(F.transform(levels, at)), lambda x: x.isNotNull()))


def span_index(spans: DataFrame, file: str) -> DataFrame:
    """Spans (id, file, start_line, end_line) -> (file, level, bin, best): for each bin of lines its smallest span (size, id)."""
    best = F.struct((F.col("end_line") - F.col("start_line")).alias("size"), "id")
    each = spans.select(file, best.alias("best"), F.explode(bins(F.col("start_line").cast("long"), F.col("end_line").cast("long"))).alias("b"))
    return each.groupBy(file, F.col("b.level").alias("level"), F.col("b.bin").alias("bin")).agg(F.min("best").alias("best"))


def _order(x: object) -> tuple:
    """``x`` as Spark orders it: null first, structs by their fields."""
    if x is None:
        return (0,)
    return (1, tuple(map(_order, x.values()))) if isinstance(x, dict) else (1, x)


def _least(heap: list[tuple], line: int, col: int | None) -> tuple | None:
    """The least entry (key, number, end line, end col, ...) that hasn't ended before a place; those on top that have go."""
    while heap and (heap[0][2] < line or heap[0][2] == line and col is not None and heap[0][3] < col):
        heappop(heap)
    best = heap[0] if heap else None
    if col is None and best and best[2] <= line:
        best = min((e for e in heap if e[2] > line), default=None)
    return best


def _swept(probes: DataFrame, spans: DataFrame, unique: bool) -> DataFrame:
    """Probes (probe_id, file, line, col) and spans (file, a, c, b, d, size, id) -> (probe_id, size, id).

    The span of each probe is the least by (size, id) of those with (a, c) <= (line, col) <= (b, d); a probe without
    a col is held by the lines between a and b. Spans and probes meet in one shuffle, by file and in the order of their
    places, and a task keeps the spans of the file it is at whose end it hasn't seen, the best one on top.
    """
    types = {f.name: f.dataType for f in [*probes.schema, *spans.schema]}
    nothing = lambda *names: [F.lit(None).cast(types[n]).alias(n) for n in names]
    place = lambda line, col: [F.col(line).cast("long").alias("line"), F.col(col).cast("long").alias("col")]
    held = spans.where("file is not null and (a < b or a = b and c <= d)").select("file", *place("a", "c"), F.lit(0).alias("turn"), F.col("b").cast("long").alias("b"), F.col("d").cast("long").alias("d"), "size", "id", *nothing("probe_id"))
    asked = probes.where("file is not null and line is not null").select("file", *place("line", "col"), F.lit(1).alias("turn"), *[F.lit(None).cast("long").alias(n) for n in "bd"], *nothing("size", "id"), "probe_id")
    rows = held.unionByName(asked).repartition("file").sortWithinPartitions("file", "line", "col", "turn")
    out = StructType([StructField(n, types[n]) for n in ("probe_id", "size", "id")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, heap, number = None, [], 0
        for batch in batches:
            at, size, found = [], [], []
            columns = [batch.column(n).to_pylist() for n in ("file", "line", "col", "turn", "b", "d", "size", "id")]
            for i, (f, line, col, turn, b, d, s, x) in enumerate(zip(*columns, strict=True)):
                if f != file:
                    file, heap = f, []
                if not turn:
                    number += 1  # no two entries are compared further than that
                    heappush(heap, ((_order(s), _order(x)), number, b, d, s, x))
                    continue
                if best := _least(heap, line, col):
                    at.append(i)
                    size.append(best[4])
                    found.append(best[5])
            if at:
                kinds = [batch.schema.field(n).type for n in ("size", "id")]
                yield pa.RecordBatch.from_arrays([batch.column("probe_id").take(pa.array(at)), pa.array(size, kinds[0]), pa.array(found, kinds[1])], ["probe_id", "size", "id"])

    hits = rows.mapInArrow(run, out)
    if unique:
        return hits
    return hits.groupBy("probe_id").agg(F.min(F.struct("size", "id")).alias("m")).select("probe_id", F.col("m.size").alias("size"), F.col("m.id").alias("id"))


def at_position(probes: DataFrame, spans: DataFrame, file: str, unique: bool = False) -> DataFrame:
    """For each probe (probe_id, file, line) the smallest span (id, file, start_line, end_line) that holds it; ties by id.

    Rows that repeat a probe_id are one probe with several places; ``unique`` says that there are none and saves a shuffle.
    """
    none = F.lit(0)
    asked = probes.select("probe_id", F.col(file).alias("file"), "line", none.alias("col"))
    held = spans.select(F.col(file).alias("file"), F.col("start_line").alias("a"), none.alias("c"), F.col("end_line").alias("b"), none.alias("d"), (F.col("end_line") - F.col("start_line")).alias("size"), "id")
    return _swept(asked, held, unique).select("probe_id", "id", "size")


def located(files: DataFrame, probes: DataFrame, content: Column | str = "content", containers: tuple[str, ...] | None = None, unique: bool = False) -> DataFrame:
    """Files (path, language, and what ``content`` is written from) and probes (probe_id, file_path, line, col) -> (probe_id, name, start_line, size).

    The same as ``at_position`` with the files' symbols and with their start_line and name as id or, with ``containers``,
    as ``containing`` with the symbols of these kinds. Text is read where its file's probes are: a file comes before its probes,
    which come in the order of their places, so neither its symbols are written and shuffled nor its probes held. ``content`` is
    worked out after that shuffle, so that text needn't go through it. ``unique`` is as in ``at_position``.
    """
    spark = files.sparkSession
    none = lambda names, df: [F.lit(None).cast(df.schema[n].dataType).alias(n) for n in names]
    given = [c for c in files.columns if c != "path"]
    asked = probes.where("file_path is not null and line is not null").select(F.col("file_path").alias("path"), *none(given, files), F.lit(1).alias("turn"), F.col("line").cast("long").alias("line"), F.col("col").cast("long").alias("col"), "probe_id")
    told = files.where("path is not null").select("path", *given, F.lit(0).alias("turn"), *[F.lit(None).cast("long").alias(n) for n in ("line", "col")], *none(["probe_id"], probes))
    # text is much larger than what it is written from, so partitions aren't put together
    rows = told.unionByName(asked).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path").sortWithinPartitions("path", "turn", "line", "col")
    text = F.when(F.col("turn") == 0, F.col(content) if isinstance(content, str) else content)
    rows = rows.withColumn("_text", text).select("path", "language", F.col("_text").alias("content"), "turn", "line", "col", "probe_id")
    sized = "near int, size int" if containers else "size int"
    out = StructType([probes.schema["probe_id"], *StructType.fromDDL(f"{sized}, start_line int, name string")])
    keys = out.names[1:]

    def spans(language: str, text: str, heads: dict[str, structure.Heads]) -> Iterator[tuple]:
        """(first line, first col, (key, last line, last col)) of the symbols that may hold a place."""
        for kind, name, a, c, b, d, _, _, _, _, _, parent, around, *_ in structure._nested(structure._rows(language, text, heads[language], None, False)):
            if not containers:
                if a <= b:
                    yield a, 0, ((b - a, a, name), b, 0)
            elif (kind := structure.kind_within(language, kind, name, around, parent)) in containers and (a < b or a == b and c <= d):
                yield a, c, ((NEARNESS.get(kind, 5), (b - a) * 1000 + d - c, a, name), b, d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = structure.heads_of(extract.DECLARATIONS)
        file, heap, held, k, number = None, [], [], 0, 0
        for batch in batches:
            at: list[int] = []
            found: list[tuple] = []
            columns = [batch.column(n).to_pylist() for n in ("path", "language", "content", "turn", "line", "col")]
            for i, (path, language, text, turn, line, col) in enumerate(zip(*columns, strict=True)):
                if path != file:
                    file, heap, held, k = path, [], [], 0
                if not turn:
                    if language in heads:
                        held = sorted([*held, *spans(language, text or "", heads)], key=lambda x: x[:2])
                    continue
                if not containers:
                    col = 0
                column = -1 if col is None else col
                while k < len(held) and (held[k][0] < line or held[k][0] == line and held[k][1] <= column):
                    number += 1
                    key, b, d = held[k][2]
                    heappush(heap, (key, number, b, d))
                    k += 1
                if best := _least(heap, line, col):
                    at.append(i)
                    found.append(best[0])
            if at:
                kinds = [pa.string() if n == "name" else pa.int32() for n in keys]
                yield pa.RecordBatch.from_arrays([batch.column("probe_id").take(pa.array(at)), *[pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)]], out.names)

    hits = structure.batched(rows, run, out, "turn", "line", "col", "probe_id")
    if not unique:
        hits = hits.groupBy("probe_id").agg(F.min(F.struct(*keys)).alias("m")).select("probe_id", "m.*")
    return hits.select("probe_id", "name", "start_line", "size")


def nearness() -> tuple[Column, Column, Column, Column]:
    """Of a symbol: how near its kind is as a container, its size, and the columns it goes from and to, by which ``containing`` looks."""
    near = F.lit(5)
    for kind, n in NEARNESS.items():
        near = F.when(F.col("kind") == kind, n).otherwise(near)
    size = (F.col("end_line") - F.col("start_line")) * 1000 + F.col("end_column") - F.col("start_column")
    first, last = F.greatest("start_column", F.lit(0)), F.coalesce("end_column", F.lit(-1))
    return near, size, first, last


def containing(probes: DataFrame, symbols: DataFrame, file: str = "file_path", unique: bool = False) -> DataFrame:
    """For each probe (probe_id, file, line, col) the symbol that contains it: nearest kind first, then the smallest, then by id.

    Columns count only on a span's first and last line. Rows that repeat a probe_id are one probe with several places;
    ``unique`` says that there are none and saves a shuffle.
    """
    near, size, first, last = nearness()
    held = symbols.select(F.col(file).alias("file"), F.col("start_line").alias("a"), first.alias("c"), F.col("end_line").alias("b"), last.alias("d"), F.struct(near.alias("near"), size.alias("size")).alias("size"), "id")
    asked = probes.select("probe_id", F.col(file).alias("file"), "line", "col")
    return _swept(asked, held, unique).select("probe_id", "id")


def references(edges: DataFrame, symbols: DataFrame, key: int | str | None = None, kinds: tuple[str, ...] = REFERENCE_KINDS) -> DataFrame:
    """Edges that lead to ``key`` (or all), with the symbols that they come from."""
    e = edges.where(F.col("kind").isin(*kinds))
    if key is not None:
        e = e.where(F.col("to_key") == key)
    s = symbols.select(F.col("key").alias("from_key"), "name", "file_path")
    return e.join(s, "from_key")


def calls(edges: DataFrame, symbols: DataFrame, key: int | str, incoming: bool = True, limit: int = 50) -> DataFrame:
    """Distinct callers (or, if not incoming, callees) of a symbol by name."""
    here, there = ("to_key", "from_key") if incoming else ("from_key", "to_key")
    found = edges.where((F.col("kind") == "calls") & (F.col(here) == key)).select(F.col(there).alias("key")).distinct()
    return symbols.join(found, "key").orderBy("name", "id").limit(limit)


def call_tree(edges: DataFrame, roots: DataFrame, depth: int = 5) -> DataFrame:
    """(root, key, level): symbols reached from ``roots`` (key) over calls, each at its first level.

    Breadth first: a round joins the last round's new symbols to the edges and drops those that are known. What a round
    finds is staged, so that plans don't grow with the depth.
    """
    calls_only = edges.where(F.col("kind") == "calls").select(F.col("from_key").alias("key"), F.col("to_key").alias("next")).distinct()
    found = front = roots.select(F.col("key").alias("root"), "key").distinct().withColumn("level", F.lit(0))
    for level in range(1, depth + 1):
        step = front.join(calls_only, "key").select("root", F.col("next").alias("key")).distinct()
        front = stage(step.join(found, ["root", "key"], "left_anti").withColumn("level", F.lit(level)))
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found


def containment_tree(rows: DataFrame, key: list[str], parent: list[str]) -> DataFrame:
    """Rows with depth, from those without a parent (depth 0) down; the columns ``parent`` name the row above by its ``key``.

    Pointers to the row above are doubled, so that a tree of depth n takes log n rounds. Rows below a parent that isn't
    there, or in a circle, have no depth and are left out. Of rows that share a key one without a parent counts as the row above.
    """
    known = F.coalesce(*[F.col(p) for p in parent]).isNotNull()
    up = F.when(known, F.struct(*[F.col(p).alias(k) for k, p in zip(key, parent, strict=True)]))
    at = rows.select(F.struct(*key).alias("key"), up.alias("up")).groupBy("key").agg(F.min_by("up", F.col("up").isNotNull()).alias("up"))
    at = stage(at.select("key", "up", F.when(F.col("up").isNull(), 0).otherwise(1).alias("depth"), F.col("up").isNull().alias("done")))
    longest = max(1, at.count()).bit_length() + 1
    for _ in range(longest):
        over = at.select(F.col("key").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("done").alias("ends"))
        step = at.where("not done").join(over, "up").select("key", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.col("ends").alias("done"))
        step = stage(step.unionByName(at.where("done")))  # without a row above it goes
        open_rows = step.where("not done").isEmpty()
        at = step
        if open_rows:
            break
    depths = at.where("done").select(*[F.col("key")[k].alias(p) for k, p in zip(key, parent, strict=True)], F.col("depth").alias("_above"))
    roots = rows.where(~known).withColumn("depth", F.lit(0))
    return roots.unionByName(rows.where(known).join(depths, parent).select(*rows.columns, (F.col("_above") + 1).alias("depth")))


def last_preceding(rows: DataFrame, group: str, order: str, value: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the last value that isn't null at or before each row of its group, such as the visibility or owner that a line sets for those after it."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def member_access(uses: DataFrame, symbols: DataFrame) -> DataFrame:
    """``uses`` (object_key, member) with target, the smallest key of a symbol of that name whose parent is the object, or null."""
    members = symbols.groupBy(F.col("parent_key").alias("object_key"), F.col("name").alias("member")).agg(F.min("key").alias("target"))
    return uses.join(members, ["object_key", "member"], "left")


def all_references(edges: DataFrame, symbols: DataFrame, key: int | str) -> DataFrame:
    """Edges of any kind that lead to ``key``, with the symbols that they come from, by file and line."""
    s = symbols.select(F.col("key").alias("from_key"), "name", "file_path")
    return edges.where(F.col("to_key") == key).join(s, "from_key").orderBy("file_path", "line")


def by_file(refs: DataFrame, order: str, n: int = 3) -> DataFrame:
    """(file_path, total, usage, then the first ``n`` rows of each file by ``order``)."""
    first = Window.partitionBy("file_path").orderBy("line", order)
    # a file's first rows are picked before the shuffle, and its count is combined before another
    kept = refs.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= n)
    return kept.join(refs.groupBy("file_path").agg(F.count("*").alias("total")), "file_path")


def bindings(links: DataFrame, symbols: DataFrame) -> DataFrame:
    """Bindings with their source's symbol, and their target's if it is known."""
    s = symbols.select(F.col("key").alias("source_key"), F.col("name").alias("source_name"), F.col("file_path").alias("source_file"))
    t = symbols.select(F.col("key").alias("target_key"), F.col("name").alias("target_name"))
    return links.join(s, "source_key").join(t, "target_key", "left")


def hover(positions: DataFrame, symbols: DataFrame, types: DataFrame) -> DataFrame:
    """Positions (probe_id, id) with the symbol's name and signature, and its type if one is known."""
    s = symbols.select("id", "name", "signature")
    return positions.join(s, "id").join(types.select(F.col("symbol_id").alias("id"), "resolved_type"), "id", "left")


def resolve_names(uses: DataFrame, symbols: DataFrame, last: bool = False) -> DataFrame:
    """``uses`` (file_path, name) with target, the first (or last) symbol of that name in their file."""
    pick = F.max_by if last else F.min_by
    targets = symbols.groupBy("file_path", "name").agg(pick("id", "ordinal").alias("target"))
    return uses.join(targets, ["file_path", "name"], "left")
