"""A stored full-text index that is maintained: exact, prefix, fuzzy, stemmed and phrase search read a part of it.

The index is a folder of generations. Each holds the postings of the documents that were indexed with it, in buckets by
the hash of their term and sorted, with positions; its vocabulary, in buckets by the terms' beginnings and by their stems;
the deletion neighbourhood of its vocabulary, in buckets by the hash of the neighbour; its documents' lengths and the
keys that it removes; and the counts that hold after it. A generation counts once its counts are written. What a later
generation has indexed or removed no longer counts in earlier ones: searches leave these keys' postings out, and
``compact`` writes a generation that stands alone. Updates and searches never rewrite what is there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.stem import porter, stems
from codeloom.operators.search import B, EXACT, FUZZY, K1, PREFIX, _query_terms, counted, repeats, term_bucket
from codeloom.operators.staging import stage

BUCKETS = 32
#: Documents of an index for which each bucket gets another file.
SPLIT_DOCUMENTS = 250_000
#: Terms of this length at most are in the deletion neighbourhood, with up to EDITS letters deleted.
NEIGHBOUR_LENGTH, EDITS = 24, 2
#: Letters that a term's beginning is known by.
LEAD = 2


#: Columns of a generation's tables, which may be empty; postings also have the key.
_COLUMNS = {
    "postings": "term string, tf bigint, length int, places array<int>, bucket int",
    "terms": "term string, df bigint, tf bigint, stem string, lead int",
    "stems": "term string, stem string, bucket int",
    "neighbours": "term string, neighbour bigint, bucket int",
}


def _table(spark: SparkSession, path: str, generation: int, name: str) -> DataFrame:
    here = f"{path}/generation={generation}"
    columns = _COLUMNS[name]
    if name == "postings":
        key = spark.read.parquet(f"{here}/documents").schema[0]
        columns = f"`{key.name}` {key.dataType.simpleString()}, {columns}"
    return spark.read.schema(columns).parquet(f"{here}/{name}")


def edits_of(term: str, fuzzy: float = 0.2) -> int:
    return int(fuzzy * len(term) + 0.5)


def neighbours(term: Column) -> Column:
    """A term and what is left of it when one or two letters are deleted, each once."""
    without = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))
    one = without(term)
    return F.array_distinct(F.concat(F.array(term), one, F.flatten(F.transform(one, without))))


def _lead(term: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(term, 1, LEAD)), F.lit(BUCKETS)).cast("int")


def _paths(spark: SparkSession, path: str) -> list[tuple[int, bool, int, float]]:
    """(generation, stands alone, documents, sum of lengths) of the generations that count, oldest first."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = fs.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(fs):
        return []
    names = [s.getPath().getName() for s in system.listStatus(fs)]
    done = [n for n in names if n.startswith("generation=") and system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/counts/_SUCCESS"))]
    if not done:
        return []
    rows = spark.read.parquet(*[f"{path}/{n}/counts" for n in done]).orderBy("generation").collect()  # one for each generation
    rows = [(r["generation"], r["alone"], r["documents"], r["total"]) for r in rows]
    first = max((i for i, r in enumerate(rows) if r[1]), default=0)
    return rows[first:]


def _terms_of(docs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, terms): all terms of the fields in order; a gap of one place between fields keeps phrases inside them."""
    split = lambda f: F.filter(F.split(F.lower(F.coalesce(F.col(f), F.lit(""))), r"[\s\W]+"), lambda t: F.length(t) > 1)
    return docs.select(key, F.flatten(F.array(*[F.concat(split(f), F.array(F.lit(""))) for f in fields])).alias("terms"))


def _write(spark: SparkSession, path: str, number: int, alone: bool, postings: DataFrame, lengths: DataFrame, gone: DataFrame | None, key: str, counts: tuple[int, float]) -> None:
    here, split = f"{path}/generation={number}", F.lit(1 + counts[0] // SPLIT_DOCUMENTS)
    known = lengths.select(key, "length").withColumn("alive", F.lit(True))
    if gone is not None:
        known = known.unionByName(gone.select(key, F.lit(None).cast("int").alias("length"), F.lit(False).alias("alive")))
    known.write.parquet(f"{here}/documents")
    rows = postings.withColumn("bucket", term_bucket("term", BUCKETS))
    rows.repartition("bucket", F.pmod(F.xxhash64(key), split)).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{here}/postings")
    vocabulary = _table(spark, path, number, "postings").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))
    vocabulary.withColumn("stem", stems(F.col("term"))).withColumn("lead", _lead(F.col("term"))).repartition("lead").sortWithinPartitions("lead", "term").write.partitionBy("lead").parquet(f"{here}/terms")
    terms = _table(spark, path, number, "terms").select("term", "stem")
    by_stem = terms.withColumn("bucket", term_bucket("stem", BUCKETS))
    by_stem.repartition("bucket").sortWithinPartitions("bucket", "stem").write.partitionBy("bucket").parquet(f"{here}/stems")
    near = terms.where(F.length("term") <= NEIGHBOUR_LENGTH).select("term", F.explode(neighbours(F.col("term"))).alias("neighbour"))
    near = near.select("term", F.xxhash64("neighbour").alias("neighbour"), term_bucket("neighbour", BUCKETS).alias("bucket"))
    near.repartition("bucket", F.pmod("neighbour", split)).sortWithinPartitions("bucket", "neighbour").write.partitionBy("bucket").parquet(f"{here}/neighbours")
    spark.createDataFrame([(number, alone, counts[0], float(counts[1]))], "generation int, alone boolean, documents long, total double").coalesce(1).write.parquet(f"{here}/counts")


def _postings(docs: DataFrame, key: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """Postings, counted where their document is, and the staged lengths of all documents."""
    terms = _terms_of(docs, key, fields)
    rows = counted(terms, [key])
    if repeats(docs, key):
        rows = rows.groupBy(key, "term").agg(F.sum("tf").alias("tf"), F.first("length").alias("length"), F.sort_array(F.flatten(F.collect_list("places"))).alias("places"))
    return rows, stage(terms.select(key, F.size(F.filter("terms", lambda t: t != "")).alias("length")))


def create(docs: DataFrame, key: str, fields: list[str], path: str) -> None:
    """Index ``docs``, one row for each key, under the new folder ``path``. Null fields are empty; rows without a key are left out."""
    spark, docs = docs.sparkSession, docs.where(F.col(key).isNotNull())
    postings, lengths = _postings(docs, key, fields)
    n, total = lengths.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    _write(spark, path, 0, True, postings, lengths, None, key, (n, total))


def current_lengths(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key, length) of the documents that count now."""
    each = [spark.read.parquet(f"{path}/generation={g}/documents").withColumn("g", F.lit(g)) for g, *_ in _paths(spark, path)]
    rows = each[0]
    for e in each[1:]:
        rows = rows.unionByName(e)
    last = rows.groupBy(key).agg(F.max_by(F.struct("length", "alive"), "g").alias("d"))
    return last.where("d.alive").select(key, F.col("d.length").alias("length"))


def update(spark: SparkSession, path: str, docs: DataFrame | None, key: str, fields: list[str], gone: DataFrame | None = None) -> None:
    """A generation that indexes ``docs`` anew and removes the keys in ``gone``; keys in both are indexed."""
    generations = _paths(spark, path)
    number, _, n, total = generations[-1]
    docs = docs if docs is not None else spark.createDataFrame([], current_lengths(spark, path, key).select(key).schema).select(key, *[F.lit("").alias(f) for f in fields])
    docs = docs.where(F.col(key).isNotNull())
    postings, lengths = _postings(docs, key, fields)
    if gone is not None:
        gone = stage(gone.select(key).distinct().join(lengths.select(key), key, "left_anti"))
    touched = lengths.select(key) if gone is None else lengths.select(key).unionByName(gone)
    was = current_lengths(spark, path, key).join(touched, key, "left_semi").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    now = lengths.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    _write(spark, path, number + 1, False, postings, lengths, gone, key, (n - was[0] + now[0], total - was[1] + now[1]))


def compact(spark: SparkSession, path: str, key: str) -> None:
    """A generation that stands alone: all postings that count, without those that don't."""
    generations = _paths(spark, path)
    number, _, n, total = generations[-1]
    postings = _live(spark, path, key, generations, lambda r: r).drop("generation", "bucket")
    _write(spark, path, number + 1, True, postings, current_lengths(spark, path, key), None, key, (n, total))


def vacuum(spark: SparkSession, path: str) -> None:
    """Delete the generations before the last one that stands alone."""
    kept = _paths(spark, path)[0][0]
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = fs.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in system.listStatus(fs):
        name = status.getPath().getName()
        if name.startswith("generation=") and int(name.partition("=")[2]) < kept:
            system.delete(status.getPath(), True)


def _live(spark: SparkSession, path: str, key: str, generations: list, keep) -> DataFrame:
    """The postings that ``keep`` keeps, without those of keys that a later generation has. Later generations are small beside the first."""
    out, later = None, None
    for g, *_ in reversed(generations):
        rows = keep(_table(spark, path, g, "postings")).withColumn("generation", F.lit(g))
        if later is not None:
            rows = rows.join(later, key, "left_anti")
        out = rows if out is None else out.unionByName(rows)
        keys = spark.read.parquet(f"{path}/generation={g}/documents").select(key)
        later = keys if later is None else later.unionByName(keys)
    return out


def _vocabulary(spark: SparkSession, path: str, generations: list, table: str) -> DataFrame:
    out = None
    for g, *_ in generations:
        rows = _table(spark, path, g, table)
        out = rows if out is None else out.unionByName(rows)
    return out


def expand(spark: SparkSession, path: str, terms: list[str], prefix: bool = False, fuzzy: float = 0.0, stem: bool = False) -> DataFrame:
    """(query_term, term, weight): the terms of the index that each query term stands for.

    Exact terms; with ``prefix`` those that begin with it, read from the bucket of its beginning; with ``fuzzy`` those
    within round(fuzzy * length) edits, read from the buckets of its neighbours and then verified; with ``stem`` those
    of the same stem. Terms with more than EDITS edits, or beginnings shorter than LEAD, are looked for in the whole
    vocabulary: a rule that loses none.
    """
    generations = _paths(spark, path)
    words, near, by_stem = (_vocabulary(spark, path, generations, t) for t in ("terms", "neighbours", "stems"))
    found = [spark.createDataFrame([(t, t, EXACT) for t in terms], "query_term string, term string, weight double")]
    where = lambda column, table: [r[0] for r in table.select(column).distinct().collect()]  # of one query's terms
    for t in terms:
        if prefix:
            begins = F.startswith("term", F.lit(t))
            if len(t) >= LEAD:
                begins = begins & F.col("lead").isin(where(_lead(F.lit(t)), spark.range(1)))
            found.append(words.where(begins).select(F.lit(t).alias("query_term"), "term", (PREFIX * len(t) / F.length("term")).alias("weight")))
        edits = edits_of(t, fuzzy)
        if edits:
            close = F.levenshtein(F.col("term"), F.lit(t), edits) >= 0
            options = words.where(F.abs(F.length("term") - len(t)) <= edits).select("term")
            if edits <= EDITS and len(t) + edits <= NEIGHBOUR_LENGTH:
                asked = stage(spark.range(1).select(F.explode(neighbours(F.lit(t))).alias("n")).select(F.xxhash64("n").alias("neighbour"), term_bucket("n", BUCKETS).alias("bucket")))
                options = near.where(F.col("bucket").isin(where("bucket", asked))).join(F.broadcast(asked.select("neighbour")), "neighbour", "left_semi").select("term")
            found.append(options.where(close).select(F.lit(t).alias("query_term"), "term", F.lit(FUZZY).alias("weight")))
        if stem:
            s = porter(t)
            same = by_stem.where(F.col("bucket").isin(where(term_bucket(F.lit(s), BUCKETS), spark.range(1))) & (F.col("stem") == s))
            found.append(same.select(F.lit(t).alias("query_term"), "term", F.lit(EXACT).alias("weight")))
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    return rows.groupBy("query_term", "term").agg(F.max("weight").alias("weight"))


def search(spark: SparkSession, path: str, key: str, query: str, all_terms: bool = False, prefix: bool = False, fuzzy: float = 0.0, stem: bool = False) -> DataFrame:
    """(key, score, matched) by BM25. Only the buckets of the terms that the query stands for are read; counts are kept ones.

    With ``stem``, terms of one stem count as one: their frequencies in a document, and the documents that hold any, are taken together.
    """
    terms = sorted(set(_query_terms(query)))
    wanted = stage(expand(spark, path, terms, prefix, fuzzy, stem))
    generations = _paths(spark, path)
    _, _, n, total = generations[-1]
    average = total / n if n and total else 1.0
    folders = [r[0] for r in wanted.select(term_bucket("term", BUCKETS)).distinct().collect()]  # BUCKETS at most
    asked = F.broadcast(wanted.select("term").distinct()) if wanted.count() <= 500_000 else wanted.select("term").distinct()
    hits = _live(spark, path, key, generations, lambda r: r.where(F.col("bucket").isin(folders)).join(asked, "term", "left_semi"))
    unit = "query_term" if stem else "term"
    hits = hits.join(wanted, "term").groupBy(key, "query_term", F.col(unit).alias("unit")).agg(F.sum("tf").alias("tf"), F.first("length").alias("length"), F.max("weight").alias("weight"))
    hits = stage(hits)
    df = hits.groupBy("unit").agg(F.countDistinct(key).alias("df"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("weight") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(average)))
    out = hits.join(df, "unit").groupBy(key).agg(F.sum(part).alias("score"), F.countDistinct("query_term").alias("matched"))
    return out.where(F.col("matched") == len(terms)) if all_terms else out


def phrase(spark: SparkSession, path: str, key: str, words: str) -> DataFrame:
    """(key, n): documents that hold the phrase's terms one after the other, and how often. Terms of one character are no terms and leave no place."""
    terms = _query_terms(words)
    if not terms:
        return current_lengths(spark, path, key).select(key, F.lit(0).cast("long").alias("n")).where(F.lit(False))
    folders = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(term_bucket("t", BUCKETS)).distinct().collect()]
    rows = _live(spark, path, key, _paths(spark, path), lambda r: r.where(F.col("bucket").isin(folders) & F.col("term").isin(terms)))
    # each place is moved back by its term's place in the phrase: a start counts if all terms agree on it
    offsets = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(i).alias("i")) for i, t in enumerate(terms)]))
    starts = rows.select(key, "term", "places", offsets.alias("o")).where("term = o.t").select(key, F.explode("places").alias("p"), F.col("o.i").alias("i"))
    starts = starts.groupBy(key, (F.col("p") - F.col("i")).alias("start")).agg(F.count("*").alias("c")).where(F.col("c") == len(terms))
    return starts.groupBy(key).agg(F.count("*").alias("n"))


def suggest(spark: SparkSession, path: str, word: str, limit: int = 10, fuzzy: float = 0.2) -> DataFrame:
    """(term, score): completions of a word of LEAD characters or more: terms that begin with it and terms within a few edits, by weight times the logarithm of their uses.

    Counts of documents that were indexed anew or removed stay in the vocabulary until the index is compacted.
    """
    word = word.lower()
    generations = _paths(spark, path)
    if len(word) < LEAD:
        return spark.createDataFrame([], "term string, score double")
    options = expand(spark, path, [word], prefix=True, fuzzy=fuzzy)
    uses = _vocabulary(spark, path, generations, "terms").join(F.broadcast(options), "term").groupBy("term").agg(F.sum("tf").alias("tf"), F.max("weight").alias("weight"))
    return uses.select("term", (F.col("weight") * F.log(1.0 + F.col("tf"))).alias("score")).orderBy(F.desc("score"), "term").limit(limit)
