"""Exact document fingerprints from DataFrame functions alone.

The canonical text is NFKC-normalised, case-folded (both by the ICU library that Spark ships, called as SQL functions)
and has each run of white space turned into one space, ends trimmed. Its fingerprint is a wide hash: two xxhash64
values of the text under different salts and its length. Texts whose wide hashes are equal are compared by their
bytes; should two different ones meet, their places in byte order are appended, so that equal fingerprints always
mean equal canonical texts.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import BROADCAST_ROWS, stage_table, text_of

#: Texts in one range of ids, about.
RANGE_ROWS = 2000
#: Most ranges; their edges go to all tasks.
RANGES = 20_000


def canonical(text: Column) -> Column:
    """NFKC, case folding, NFKC again, white space folded."""
    composed = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    folded = F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed, F.lit(True))
    again = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), folded, F.lit(True))
    # single spaces aren't matched: most white space stays as it is
    plain = F.regexp_replace(F.lower(text), r"[\t-\r]\s*| \s+", " ")
    return F.trim(F.when(text.rlike(r"[^\x00-\x7F]"), F.regexp_replace(again, r"(?U)[\s&&[^ ]]\s*| \s+", " ")).otherwise(plain))


def wide_hash(canon: Column) -> Column:
    """Hexadecimal digits of two hashes and the length, 40 characters."""
    parts = [F.lpad(F.lower(F.hex(h)), 16, "0") for h in (F.xxhash64(canon), F.xxhash64(F.lit("codeloom"), canon))]
    return F.concat(*parts, F.lpad(F.lower(F.hex(F.octet_length(canon))), 8, "0"))


def fingerprints(df: DataFrame, texts: dict[str, str]) -> DataFrame:
    """``df`` with a fingerprint column for each of ``texts`` (text column -> name of its fingerprint), texts dropped.

    Null texts count as empty; empty texts share one fingerprint. Equal canonical texts have equal fingerprints in all
    of the columns and rows, others have different ones. The hashes of all texts are written once; only texts in
    buckets of several rows are read again and compared.
    """
    names = list(texts.values())
    canon = {name: canonical(text_of(df, column)) for column, name in texts.items()}
    hashed = stage_table(df.select(*[c for c in df.columns if c not in texts], *[wide_hash(c).alias(n) for n, c in canon.items()]), "hashes")
    one = F.explode(F.array(*[F.col(n) for n in names])).alias("_h")
    buckets = stage_table(hashed.select(one).groupBy("_h").agg(F.count("*").alias("_c")).where("_c > 1").select("_h"), "buckets")
    each = F.explode(F.array(*[F.struct(wide_hash(c).alias("_h"), c.alias("_t")) for c in canon.values()])).alias("_p")
    members = df.select(each).select("_p._h", "_p._t")
    small = buckets.count() <= BROADCAST_ROWS
    members = members.join(F.broadcast(buckets) if small else buckets, "_h", "left_semi")
    # a text goes on once for each task and bucket; different texts of one bucket are told apart by their bytes
    variants = members.groupBy("_h").agg(F.min("_t").alias("_a"), F.max("_t").alias("_z"))
    clash = variants.where(F.col("_a").cast("binary") != F.col("_z").cast("binary")).select("_h")
    clash = stage_table(clash, "clashes")
    if clash.isEmpty():
        return hashed
    return _told_apart(df, texts, canon, clash)


def _told_apart(df: DataFrame, texts: dict[str, str], canon: dict[str, Column], clash: DataFrame) -> DataFrame:
    """The rare case of different texts with one wide hash: their rank in byte order is appended."""
    each = F.explode(F.array(*[F.struct(wide_hash(c).alias("_h"), c.alias("_t")) for c in canon.values()])).alias("_p")
    several = df.select(each).select("_p._h", "_p._t").join(clash, "_h", "left_semi").distinct()
    ranked = several.withColumn("_r", F.row_number().over(Window.partitionBy("_h").orderBy(F.col("_t").cast("binary"))))
    out = df.select(*[c for c in df.columns if c not in texts], *[F.struct(wide_hash(c).alias("_h"), c.alias("_t")).alias(n) for n, c in canon.items()])
    for n in texts.values():
        r = ranked.select(F.col("_h").alias("_rh"), F.col("_t").alias("_rt"), "_r")
        out = out.join(r, (F.col(f"{n}._h") == F.col("_rh")) & (F.col(f"{n}._t") == F.col("_rt")), "left")
        out = out.withColumn(n, F.concat_ws("-", F.col(f"{n}._h"), F.col("_r").cast("string"))).drop("_rh", "_rt", "_r")
    return out


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints (or canonical texts), else 0: an exact digest knows no degrees."""
    return F.when(a == b, F.lit(1.0)).otherwise(F.lit(0.0))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_id, next_text) of each row: the next row by descending doc_id, after the last the first.

    Rows of one doc_id follow each other by the hash of their text; those with a null doc_id stand last. Rows are dealt
    into ranges of doc_id, whose edges come from quantiles of the ids; ids that fill several ranges, and null, are
    dealt on by ranges of the hash. Within a range a window finds the next row; the last row of each range gets the
    first row of the next range that has rows, sent there as well. One row is its own next.
    """
    docs = docs.select("doc_id", text_of(docs).alias("text")).withColumn("h", F.xxhash64("text"))
    n, known = docs.agg(F.count("*"), F.count("doc_id")).first()
    parts = max(1, min(RANGES, known // RANGE_ROWS))
    found = docs.agg(F.percentile_approx("doc_id", F.lit([i / parts for i in range(1, parts)] or [0.5]), F.lit(max(10_000, 20 * parts)))).first()[0] or []
    often = Counter(found) if parts > 1 else Counter()
    edges = sorted(often)
    hot = {e: c for e, c in often.items() if c > 1}
    # ranges are numbered in descending order of ids, and within them by hash; nulls stand after all
    share = lambda k: F.least(F.floor((F.col("h") / 2.0**64 + 0.5) * k), k - 1).cast("int")
    dealt = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for e, c in hot.items() for x in (e, c)]).cast("map<bigint,int>"), F.col("doc_id")), F.lit(0)) if hot else F.lit(0)
    nulls = max(1, min(RANGES, (n - known) // RANGE_ROWS))
    place = (F.lit(len(edges)) - _below(edges)) * (RANGES + 1) + F.when(dealt > 0, share(dealt)).otherwise(F.lit(RANGES))
    docs = docs.withColumn("part", F.when(F.col("doc_id").isNull(), F.lit((len(edges) + 1) * (RANGES + 1)) + share(F.lit(nulls))).otherwise(place).cast("long"))
    heads = docs.groupBy("part").agg(F.min(F.struct((-F.col("doc_id")).alias("id"), "h")).alias("head")).orderBy("part").collect()
    if not heads:
        return docs.select("doc_id", "text", F.col("doc_id").alias("next_id"), F.col("text").alias("next_text"))
    by = [(r["part"], None if r["head"]["id"] is None else -r["head"]["id"], r["head"]["h"]) for r in heads]
    # the first row of each range is also needed at the end of the range before it
    goes = docs.sparkSession.createDataFrame([(*by[i], by[i - 1][0]) for i in range(len(by))], "part long, head long, head_h long, to long")
    heads_of = docs.join(F.broadcast(goes), "part").where(F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("h") == F.col("head_h")))
    guests = heads_of.groupBy("to", "doc_id", "h").agg(F.first("text").alias("text")).select("doc_id", "text", "h", F.col("to").alias("part"), F.lit(True).alias("guest"))
    rows = docs.select("doc_id", "text", "h", "part", F.lit(False).alias("guest")).unionByName(guests)
    w = Window.partitionBy("part").orderBy("guest", F.desc_nulls_last("doc_id"), "h")
    rows = rows.withColumn("next_id", F.lead("doc_id").over(w)).withColumn("next_text", F.lead("text").over(w))
    return rows.where("not guest").select("doc_id", "text", "next_id", "next_text")


def _below(edges: list[int]) -> Column:
    """Number of the sorted edges that are less than doc_id, by bisection."""
    if not edges:
        return F.lit(0)
    held = F.array(*[F.lit(e).cast("long") for e in edges]) if len(edges) < 2 else F.lit(edges).cast("array<bigint>")
    steps = F.lit([1 << i for i in reversed(range(len(edges).bit_length()))])
    fits = lambda at: F.when(at <= len(edges), F.element_at(held, F.least(at, F.lit(len(edges)))) < F.col("doc_id")).otherwise(False)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(fits(at + step), at + step).otherwise(at))


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last floor(n/3) characters replaced by the first as many of ``following``."""
    n = F.char_length(text)
    k = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - k), F.substring(following, F.lit(1), k))


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited forms, and how like they are (see likeness)."""
    rows = with_next(docs)
    rows = rows.withColumn("e", edited(F.col("text"), F.col("next_text")))
    # the next text is the text of another row, so it needs no fingerprint of its own: both are at hand to be compared
    near_next = likeness(canonical(F.col("text")), canonical(F.col("next_text"))).alias("near_next")
    wanted = rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("e").cast("binary"), 256).alias("edited_sha256"), "text", "e", near_next)
    out = fingerprints(wanted, {"text": "fingerprint", "e": "edited_fingerprint"})
    near_edited = likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near_edited, "near_next")
