"""N-gram Jaccard self-join by a token-group matrix, and the components of its links.

Sets of word shingles link when ``100 * |A & B| >= percent * |A | B|``. Steps:

1. every text becomes its sorted distinct shingle hashes; equal sets form one class with a number of its own, and one
   row of it goes on;
2. classes are partitioned into groups of similar sets (equal smallest hash); a group is compared in blocks of about
   BLOCK members, each with its own token union. Where only components are wanted, large groups are first compared
   with a few of their most typical members; what one of these links is a group of its own, whose members needn't meet;
3. the matrix holds, for each group, the union of its members' tokens. Under one order of all tokens, frequent ones
   last, two linked sets share a token of their prefixes, and the position of the first shared one bounds the
   overlap; so the matrix is kept for prefixes, with the best bound and the extreme sizes of each group's members;
4. a set opens a group only if SHARED tokens (or as many as it needs, if fewer) are shared within their bounds:
   prefixes are longer by as many. On opening, the overlap with each block's whole token union bounds it again, then
   members are compared exactly;
5. links are contracted to components.

Sets are compared by BYTES of each hash; links that chance could have made there are compared by all eight. So the
components are exact up to collisions of 64-bit hashes within a pair. Frequent tokens only change the order, never the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm import words as W
from codeloom.llm.common import BROADCAST_ROWS, discard, give_back, join_back, keep_rows, prepare, stage_table
from codeloom.llm.components import connected_components

#: Members of one block of a group, and of the sets that are compared with it in one go, about; the same for their tokens.
BLOCK, TOKENS = 1024, 2_000_000
#: Bytes of each hash that sets are compared by, and how many shared ones chance may add to a pair at most: links that
#: rest on so few are compared again by whole hashes.
BYTES, CHANCE = 6, 1
#: Members that a large group is first compared with, and how often at most.
PIVOTS, ROUNDS = 16, 4
#: Most entries of the table of frequent tokens, which goes to all tasks (16 bytes each). It steers the order only.
FREQUENT = 2_000_000
#: Documents in which a token occurs to count as frequent.
OFTEN = 2
#: Tokens that two sets must share early on to be compared.
SHARED = 4
#: Hashes under this share of their range are counted. Prefixes hold the smallest hashes.
COUNTED = 0.35


def _need(n: np.ndarray | int, percent: int):
    return -(-percent * n // 100)


def _i64(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def frequent_tokens(docs: DataFrame, width: int) -> np.ndarray:
    """Frequent shingle hashes, commonest last: those seen so often that there are FREQUENT at most. Every text is read; tasks report what they saw twice or more."""
    top = np.uint64(int(COUNTED * 2**64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        held, n = [], 0
        kept, freq = np.empty(0, np.uint64), np.empty(0, np.int64)

        def fold(kept, freq):
            new, c = np.unique(np.concatenate(held), return_counts=True)
            both = np.concatenate((kept, new))
            order = np.argsort(both, kind="stable")
            both, f = both[order], np.concatenate((freq, c))[order]
            first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
            kept, freq = both[first], np.add.reduceat(f, first)
            if len(kept) > 2_000_000:
                kept, freq = kept[freq > 1], freq[freq > 1]
            return kept, freq

        for b in batches:
            for w in W.word_hashes([x or b"" for x in b.column(0).to_pylist()]):
                s = W.shingles(w, width)
                s = s[: np.searchsorted(s, top)]
                held.append(s)
                n += len(s)
            if n > 1_000_000:
                kept, freq = fold(kept, freq)
                held, n = [], 0
        if n:
            kept, freq = fold(kept, freq)
        twice = freq > 1
        kept, freq = kept[twice], freq[twice]
        for i in range(0, len(kept), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(_i64(kept[i : i + 50_000])), pa.array(freq[i : i + 50_000])], ["token", "n"])
        del kept, freq, held
        give_back()

    counts = docs.select(F.col("text").cast("binary")).mapInArrow(count, "token long, n long")
    counts = counts.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)
    counts = stage_table(counts, "frequent")
    # counts above 10,000 are rounded down to powers of two; if even the largest ones are too many, none are taken
    bucket = F.when(F.col("n") < 10_000, F.col("n")).otherwise(F.greatest(F.lit(10_000), F.pow(F.lit(2.0), F.floor(F.log2("n"))))).cast("long")
    least, kept = 1 << 62, 0
    for r in counts.groupBy(bucket.alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("n")).collect():
        kept += r["c"]
        if kept > FREQUENT:
            break
        least = r["n"]
    found = counts.where(F.col("n") >= least).toArrow()  # FREQUENT pairs at most
    token, n = found["token"].to_numpy().view(np.uint64), found["n"].to_numpy()
    return token[np.lexsort((token, n))]


def _keyed(docs: DataFrame) -> DataFrame:
    """(k, doc_id, text): k tells rows of one shingle set apart; rows that are alike in doc_id and text share it."""
    return docs.select(F.xxhash64("doc_id", "text").alias("k"), "doc_id", F.col("text").cast("binary").alias("text"))


def _digest(s: np.ndarray) -> int:
    return int(_i64(W.mix(s).sum(dtype=np.uint64)[None])[0])


def signatures(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(k, doc_id, n, s1, s2, low, prefix): size, 128-bit digest, group and prefix of each text's shingle set."""
    spark = docs.sparkSession
    frequent = frequent_tokens(docs, width)
    order = np.argsort(frequent, kind="stable")
    shared = spark.sparkContext.broadcast((frequent[order], order.astype(np.int32)))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        common, rank = shared.value
        for b in batches:
            n, s1, s2, low, prefix, sizes = [], [], [], [], [], [0]
            for w in W.word_hashes([x or b"" for x in b.column(2).to_pylist()]):
                s = W.shingles(w, width)
                n.append(len(s))
                if not len(s):
                    s1.append(0), s2.append(0), low.append(0), sizes.append(0)
                    continue
                s1.append(_digest(s))
                s2.append(_digest(s ^ np.uint64(0x5851F42D4C957F2D)))
                need = _need(len(s), percent)
                p = len(s) - need + min(SHARED, need)
                first = s[0]
                if len(common):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    often = common[at] == s
                    if often.any():  # a changed word of a copy seldom leads it into a group of its own
                        first = s[np.argmax(often)]
                    rare = s[~often]
                    if len(rare) < p:
                        late = s[often]
                        rare = np.concatenate((rare, late[np.argsort(rank[at[often]], kind="stable")]))
                    s = rare
                low.append(int(first) & 0x7FFFFFFF)  # groups that fall together are compared together
                prefix.append(s[:p])
                sizes.append(p)
            flat = _i64(np.concatenate(prefix)) if prefix else np.empty(0, np.int64)
            tokens = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, pa.int64()) for x in (n, s1, s2)), pa.array(low, pa.int32()), tokens], ["k", "doc_id", "n", "s1", "s2", "low", "prefix"])
        give_back()

    return _keyed(docs).mapInArrow(sign, "k long, doc_id long, n long, s1 long, s2 long, low int, prefix array<long>")


def _matrix(prefixes: DataFrame) -> DataFrame:
    """(token, g, g_rest, g_min, g_max, g_blocks, g_only): an entry for each token of a group's prefixes.

    Prefixes are sent to their blocks as arrays and aggregated there; only groups of several blocks need a second,
    already reduced, aggregation. g_only is the one set that has the token, if there is only one.
    """
    best = [F.max("rest").alias("rest"), F.min("least").alias("least"), F.max("most").alias("most"), F.max("blocks").alias("blocks"), F.min("one").alias("one"), F.max("other").alias("other")]

    def blocks(rows: DataFrame) -> DataFrame:
        rows = rows.select("gid", "low", "blocks", "node", "n", "prefix").repartition("gid")
        rows = rows.select("gid", "low", "blocks", F.col("n").alias("least"), F.col("n").alias("most"), F.col("node").alias("one"), F.col("node").alias("other"), "n", F.posexplode("prefix").alias("pos", "token"))
        return rows.withColumn("rest", F.col("n") - F.col("pos")).groupBy("gid", "token", "low").agg(*best)

    single = blocks(prefixes.where("blocks = 1")).drop("gid")
    several = blocks(prefixes.where("blocks > 1")).groupBy("token", "low").agg(*best)
    only = F.when(F.col("one") == F.col("other"), F.col("one")).alias("g_only")
    every = single.unionByName(several)
    return every.select("token", F.col("low").alias("g"), F.col("rest").alias("g_rest"), F.col("least").alias("g_min"), F.col("most").alias("g_max"), F.col("blocks").alias("g_blocks"), only)


def _token_sets(docs: DataFrame, width: int, size: int) -> DataFrame:
    """(k, s1, tokens): the shingle hashes of each keyed row, ``size`` bytes each; equal ones stay."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for b in batches:
            s1, sets = [], []
            for w in W.word_hashes([x or b"" for x in b.column(1).to_pylist()]):
                s = W.shingles(w, width)
                s1.append(_digest(s))
                sets.append(s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s1, pa.int64()), pa.array(sets, pa.binary())], ["k", "s1", "tokens"])
        give_back()

    return docs.select("k", "text").mapInArrow(cut, "k long, s1 long, tokens binary")


def _unpacked(tokens: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(tokens) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(tokens, np.uint8).reshape(-1, size)
    return out.view("<i8").ravel()


def _compare(percent: int, bytes_: int):
    """Rows sorted by (gid, part, node): a block's members (copies isn't null) and the sets that open it (query) -> links and numbers of links.

    Sure links come first; of those that chance could have made, only such as still lead somewhere new are told, as doubtful.
    """
    chance = CHANCE if bytes_ < 8 else 0

    def root(parent: dict, x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def run(members: list, queries: list) -> list[tuple]:
        ids = np.array([m[0] for m in members], np.int64)
        weight = np.array([m[1] for m in members], np.int64)
        size = np.array([len(m[2]) for m in members], np.int64)
        union, where, copies = np.unique(np.concatenate([m[2] for m in members]), return_inverse=True, return_counts=True)
        holders = np.repeat(np.arange(len(members)), size)[np.argsort(where, kind="stable")]
        starts = np.cumsum(copies) - copies
        parent: dict[int, int] = {}
        out, doubtful = [], []

        def joined(a: int, b: int) -> bool:
            a, b = root(parent, parent.setdefault(a, a)), root(parent, parent.setdefault(b, b))
            if a != b:
                parent[max(a, b)] = min(a, b)
            return a != b

        for q, _, tokens in queries:
            at = np.minimum(np.searchsorted(union, tokens), len(union) - 1)
            at = at[union[at] == tokens]
            if 100 * len(at) < percent * len(tokens):
                continue
            # the members that hold each of these tokens lie side by side
            n = copies[at]
            flat = np.arange(n.sum()) + np.repeat(starts[at] - (np.cumsum(n) - n), n)
            common = np.bincount(holders[flat], minlength=len(members))
            near = (100 * common >= percent * (len(tokens) + size - common)) & (ids != q)
            if not near.any():
                continue
            out.append((q, int(weight[near].sum()), None, None, False))
            least = common - chance
            sure = near & (100 * least >= percent * (len(tokens) + size - least))
            for m in ids[sure].tolist():
                joined(q, m)
            doubtful += [(q, m) for m in ids[near & ~sure].tolist()]
        out += [(None, 0, x, root(parent, x), False) for x in parent if root(parent, x) != x]
        out += [(None, 0, q, m, True) for q, m in doubtful if joined(q, m)]
        return out

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        key, members, queries, last, out = None, [], [], None, []
        for b in batches:
            gid, part, query, doc, weight = (b.column(i).to_pylist() for i in range(5))
            tokens = b.column(5)
            for i in range(b.num_rows):
                if (gid[i], part[i]) != key:
                    if queries and members:
                        out += run(members, queries)
                    key, members, queries, last = (gid[i], part[i]), [], [], None
                if doc[i] == last:  # a row that repeats
                    continue
                last, row = doc[i], (doc[i], weight[i], _unpacked(tokens[i].as_py(), bytes_))
                if weight[i] is not None:
                    members.append(row)
                if query[i]:
                    queries.append(row)
            if out:
                yield _links(out)
                out = []
        if queries and members:
            out += run(members, queries)
        if out:
            yield _links(out)
        members, queries, out = [], [], []
        give_back()

    return stream


def _links(rows: list[tuple]) -> pa.RecordBatch:
    *numbers, doubtful = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in numbers), pa.array(doubtful)], ["node", "links", "a", "b", "doubtful"])


def _compared(docs: DataFrame, places: DataFrame, twins: DataFrame | None, width: int, percent: int, size: int = BYTES) -> DataFrame:
    """Links found where the sets of ``places`` (gid, part, node, k, s1, copies, query) meet: (node, links, a, b), staged."""
    wanted = stage_table(places.select("k").distinct(), "wanted")
    sets = _token_sets(keep_rows(_keyed(docs), wanted, "k"), width, size)
    if twins is not None:  # rows that are alike in doc_id and text: one of them goes on
        once = keep_rows(sets, twins, "k", "left_anti")
        sets = once.unionByName(keep_rows(sets, twins, "k").dropDuplicates(["k", "s1"]))
    rows = sets.join(F.broadcast(places) if places.count() <= BROADCAST_ROWS else places, ["k", "s1"])
    rows = rows.select("gid", "part", "query", "node", "copies", "tokens").repartition("gid", "part").sortWithinPartitions("gid", "part", "node")
    links = stage_table(rows.mapInArrow(_compare(percent, size), "node long, links long, a long, b long, doubtful boolean"), "links")
    discard(wanted)
    pairs = stage_table(links.where("doubtful").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    n = pairs.count()
    if n:
        gid, sides = F.xxhash64("a", "b").alias("gid"), {"a": F.lit(0), "b": F.lit(None)}
        keys = places.select("node", "k", "s1").distinct()
        ends = [pairs.select(gid, F.col(c).alias("node"), copies.cast("long").alias("copies"), copies.isNull().alias("query")) for c, copies in sides.items()]
        again = ends[0].unionByName(ends[1]).join(keys, "node").withColumn("part", F.lit(0))
        again = stage_table(again.select("gid", "part", "node", "k", "s1", "copies", "query"), "again")
        held = _compared(docs, again, twins, width, percent, 8).where("a is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if held.count() < n:  # chance made a link: what rested on it may hang together otherwise
            return _compared(docs, places, twins, width, percent, 8)
        discard(again)
    discard(pairs)
    return links


def _blocks(members: str, size: str) -> Column:
    return F.ceil(F.greatest(F.col(members) / BLOCK, F.col(size) / TOKENS))


def _with_size(reps: DataFrame, total: int) -> DataFrame:
    """reps with the number of blocks of their group."""
    groups = reps.groupBy("low").agg(F.sum("n").alias("size"), F.count("*").alias("c")).withColumn("blocks", _blocks("c", "size"))
    return join_back(reps, groups, ["low"], ["blocks"], "c", total, F.col("node"))


def _contracted(docs: DataFrame, reps: DataFrame, prefixes: DataFrame, twins: DataFrame | None, total: int, width: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """Members of large groups (reps) with home, the smallest node that one is linked to by now (or null), and the links found.

    A round compares each member of a large group that has no home yet with PIVOTS of these, those with the fewest
    prefix tokens that no other member had at first: members that are linked to one another through a common original
    find it there. Its cost is in proportion to the group; the tokens are counted once.
    """
    reps, found, alone = reps.withColumn("home", F.lit(None).cast("long")), [], None
    for i in range(ROUNDS):
        large = reps if i == 0 else _with_size(reps.where("home is null").drop("blocks"), total).where("blocks > 1")
        large = stage_table(large.select("node", "low", "k", "s1", "n", "blocks"), "large")
        if large.isEmpty():
            break
        if alone is None:
            tokens = prefixes.join(large.select("k", "s1", "node", "low"), ["k", "s1"])
            tokens = tokens.select("node", "low", F.explode("prefix").alias("token"))
            often = tokens.groupBy("token", "low").agg(F.count("*").alias("c"), F.min("node").alias("one")).where("c = 1")
            alone = stage_table(often.groupBy(F.col("one").alias("node")).agg(F.count("*").alias("alone")), "alone")
        order = F.row_number().over(Window.partitionBy("low").orderBy("alone", F.xxhash64("node")))
        pivots = large.join(alone, "node", "left").withColumn("alone", F.coalesce("alone", F.lit(0))).withColumn("r", order).where(F.col("r") <= PIVOTS)
        gid = F.xxhash64(F.lit("pivots"), "low").alias("gid")
        parts = F.col("blocks").cast("int")
        asked = large.select(gid, F.pmod(F.xxhash64("node"), parts).alias("part"), "node", "k", "s1", F.lit(None).cast("long").alias("copies"), F.lit(True).alias("query"))
        held = pivots.select(gid, F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "node", "k", "s1", F.lit(0).cast("long").alias("copies"), F.lit(False).alias("query"))
        places = asked.unionByName(held).groupBy("gid", "part", "node", "k", "s1").agg(F.max("copies").alias("copies"), F.max("query").alias("query"))
        places = stage_table(places, "places")
        links = _compared(docs, places, twins, width, percent).where("a is not null").select("a", "b")
        discard(large, places)
        if links.isEmpty():
            break
        found.append(links)
        homes = connected_components(found[-1]).select("node", F.col("component").alias("new"))
        reps = stage_table(reps.join(homes, "node", "left").withColumn("home", F.coalesce("home", "new")).drop("new"), "reps")
    return reps, found


def _classes(docs: DataFrame, width: int, percent: int, count_links: bool) -> tuple[DataFrame, DataFrame]:
    """(k, doc_id, n, s1, s2) of each row, and of each class (s1, s2, copies, component, in_component, component_id, n_links); both staged.

    n_links is 0 unless ``count_links``.
    """
    prepare(docs.sparkSession)
    sig = stage_table(signatures(docs, width, percent), "signatures")
    full = sig.where("n > 0")
    classes = full.groupBy("s1", "s2").agg(F.min("doc_id").alias("first_id"), F.min("k").alias("k"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("low").cast("long").alias("low"))
    classes = stage_table(classes.select(F.monotonically_increasing_id().alias("node"), "*"), "classes")
    twins = stage_table(full.groupBy("k").count().where("count > 1").select("k"), "twins")
    twins = None if twins.isEmpty() else twins
    total = max(1, classes.count())
    reps = stage_table(_with_size(classes.select("node", "low", "k", "s1", "n", "copies"), total), "sized")
    prefixes = full.select("k", "s1", "prefix").dropDuplicates(["k", "s1"])
    found: list[DataFrame] = []
    if not count_links and not reps.where("blocks > 1").isEmpty():
        # only large groups are looked at again: the others' sizes don't change
        large, found = _contracted(docs, reps.where("blocks > 1"), prefixes, twins, total, width, percent)
        if found:  # what is linked by now is a group of its own, apart from the rest of its group
            own = F.when(F.col("home").isNotNull(), F.xxhash64("low", "home")).otherwise(F.col("low"))
            small = reps.where("blocks = 1").withColumn("home", F.lit(None).cast("long"))
            large = _with_size(large.drop("blocks").withColumn("low", own), total)
            reps = small.unionByName(large.select(*small.columns))
    if "home" not in reps.columns:
        reps = reps.withColumn("home", F.lit(None).cast("long"))
    gid = F.xxhash64("low", F.pmod(F.xxhash64("node"), F.col("blocks")))
    reps = stage_table(reps.select("node", "k", "s1", "n", "copies", "low", "home", "blocks", gid.alias("gid")), "reps")
    prefixes = prefixes.join(reps.select("k", "s1", "node", "n", "low", "home", "blocks", "gid"), ["k", "s1"])

    postings = prefixes.select("node", "n", "low", "home", F.posexplode("prefix").alias("pos", "token")).withColumn("rest", F.col("n") - F.col("pos"))
    need = F.ceil(F.col("n") * percent / 100)
    bound = (F.least("rest", "g_rest") + (SHARED - 1)) * (100 + percent) >= percent * (F.col("n") + F.greatest("g_min", need))
    sizes = (F.col("g_max") * 100 >= F.col("n") * percent) & (F.col("g_min") * percent <= F.col("n") * 100)
    apart = F.col("home").isNull() | (F.col("g") != F.col("low"))
    hits = postings.join(_matrix(prefixes), "token").where(bound & sizes & apart & ~F.col("g_only").eqNullSafe(F.col("node")))
    hits = hits.groupBy("node", "g").agg(F.count("*").alias("hits"), F.max("n").alias("n"), F.max("g_blocks").alias("g_blocks"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("g_blocks") - 1)).alias("block")
    opened = hits.where(F.col("hits") >= F.least(need, F.lit(SHARED))).select("node", "n", "g", every)
    opened = stage_table(opened.select("node", "n", F.xxhash64("g", "block").alias("gid")), "opened")

    per_group = opened.groupBy("gid").agg(F.sum("n").alias("q"), F.count("*").alias("c")).withColumn("parts", _blocks("c", "q"))
    members = reps.select("gid", "node", "copies").join(per_group, "gid")
    parts = F.col("parts").cast("int")
    left = members.select("gid", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "node", "copies", F.lit(False).alias("query"))
    asked = join_back(opened, per_group, ["gid"], ["parts"], "c", max(1, opened.count()), F.col("node"))
    right = asked.select("gid", F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"), "node", F.lit(None).cast("long").alias("copies"), F.lit(True).alias("query"))
    # a member that opens its own block goes there once; copies is null for those that aren't members
    places = left.unionByName(right).groupBy("node", "gid", "part").agg(F.max("copies").alias("copies"), F.max("query").alias("query"))
    places = stage_table(places.join(reps.select("node", "k", "s1"), "node"), "places")
    links = _compared(docs, places, twins, width, percent)

    edges = links.where("a is not null").select("a", "b")
    for more in found:
        edges = edges.unionByName(more)
    comps = stage_table(connected_components(edges), "components")
    inside = classes.select("node", "first_id").join(comps, "node")
    ids = inside.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("c"))
    inside = join_back(inside, ids, ["component"], ["component_id"], "c", max(1, comps.count()), F.col("node")).select("node", "component", "component_id", F.lit(True).alias("inside"))
    degree = links.where("node is not null").groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.join(inside, "node", "left").join(degree, "node", "left")
    within = F.coalesce("inside", F.lit(False))
    named = named.select(
        "s1", "s2", "copies", F.coalesce("component", "node").alias("component"), within.alias("in_component"),
        F.when(within, F.col("component_id")).otherwise(F.col("first_id")).alias("component_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1 if count_links else F.lit(0).cast("long")).alias("n_links"),
    )
    named = stage_table(named, "named")
    discard(classes, reps, opened, places, links, comps)
    return sig, named


def jaccard_components(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Rows of ``docs`` (doc_id long, text string) -> (doc_id, n_shingles, component_id, n_links), one for each.

    Words are runs of other bytes than ASCII white space, A-Z in lower case. n_links counts the other rows linked
    directly; as each link counts, all members of a group of near copies are compared. Null and wordless texts have an
    empty set, no links and their own doc_id as component. Every row is compared by its own text, whether or not its
    doc_id repeats or is null; component_id is the smallest doc_id of the component's rows, null if none has one.
    Empty input: no rows.
    """
    sig, named = _classes(docs.select("doc_id", "text"), width, percent, True)
    total = max(1, sig.count())
    out = join_back(sig.select("k", "doc_id", "n", "s1", "s2"), named, ["s1", "s2"], ["component_id", "n_links"], "copies", total, F.struct("k", "doc_id"))
    empty = F.col("n") == 0
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(empty, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"))


def keep_one_per_component(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without near duplicates: of each component one row stays, with all columns, whatever their names.

    It is that with the smallest doc_id (null only if no row of the component has one); of several with that id, one.
    Rows with empty texts all stay.
    """
    sig, named = _classes(docs.select("doc_id", "text"), width, percent, False)
    several = named.where("in_component or copies > 1")
    rows = join_back(sig.where("n > 0").select("k", "doc_id", "s1", "s2"), several, ["s1", "s2"], ["component", "component_id"], "copies", max(1, sig.count()), F.struct("k", "doc_id"))
    rows = stage_table(rows.where("component is not null").select("k", "doc_id", "component", "component_id"), "rows")
    first = rows.where("doc_id <=> component_id")
    chosen = stage_table(first.groupBy("component").agg(F.min("k").alias("k"), F.count("*").alias("c")), "chosen")
    doubtful = keep_rows(first, chosen.where("c > 1").select("component"), "component")
    others = doubtful.join(chosen.select("component", F.col("k").alias("best")), "component").where("k <> best")
    gone = stage_table(rows.where("not (doc_id <=> component_id)").select("k").unionByName(others.select("k")).distinct(), "gone")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("doc_id", "text").alias("k"))
    kept = keep_rows(keyed, gone, "k", "left_anti")
    # rows that are alike in doc_id and text share their key
    twins = stage_table(sig.where("n > 0").groupBy("k").count().where("count > 1").select("k"), "twins")
    if not twins.isEmpty():
        kept = keep_rows(kept, twins, "k", "left_anti").unionByName(keep_rows(kept, twins, "k").dropDuplicates(["k"]))
    return kept.select("row.*")
