"""Name, type and full-text search over symbols and documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from codeloom.functions.text import contains_ignoring_case, match_rank, simple_tokens

# Weights of the fields of a symbol, and of how a term was matched.
BOOSTS = {"name": 3.0, "signature": 2.0, "doc_comment": 1.5, "content": 1.0}
EXACT, PREFIX, FUZZY = 1.0, 0.75, 0.45
K1, B = 1.2, 0.75
#: Folders of a stored index.
BUCKETS = 64


def filtered(symbols: DataFrame, language: str | None = None, kinds: list[str] | None = None, path: str | None = None) -> DataFrame:
    """Symbols of a language, of some kinds, below a path. Filters on plain columns reach the scan."""
    out = symbols
    if language:
        out = out.where(F.col("language") == language)
    if kinds:
        out = out.where(F.col("kind").isin(kinds))
    if path:
        out = out.where(F.startswith("file_path", F.lit(path.replace("\\", "/"))))
    return out


def by_name(symbols: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Symbols whose name holds the query in any case, by name."""
    return symbols.where(contains_ignoring_case(F.col("name"), query)).orderBy("name", "id").limit(limit)


def ranked(symbols: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Symbols whose name or signature holds the query: exact names first, then beginnings, then the rest."""
    hits = symbols.where(contains_ignoring_case(F.col("name"), query) | F.coalesce(contains_ignoring_case(F.col("signature"), query), F.lit(False)))
    return hits.withColumn("match_rank", match_rank(F.col("name"), query)).orderBy("match_rank", "name", "id").limit(limit)


def by_type(symbols: DataFrame, types: DataFrame, query: str, limit: int = 100) -> DataFrame:
    """Symbols whose resolved type (types: symbol_id, resolved_type) holds the query, ranked like names."""
    hits = types.where(contains_ignoring_case(F.col("resolved_type"), query))
    out = symbols.join(hits, symbols["id"] == hits["symbol_id"]).drop("symbol_id")
    return out.withColumn("match_rank", match_rank(F.col("resolved_type"), query)).orderBy("match_rank", "name", "id").limit(limit)


#: Documents whose terms are counted in one go.
COUNTED = 256


def counted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with ``terms`` (array of strings) -> (keys, term, tf, length, places), a row for each different term of each.

    Empty strings are no terms but take a place; length counts the terms. A row is whole in its task, so nothing is
    shuffled, and terms are told apart by their number in the batch.
    """
    spark, name = rows.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > COUNTED:
        spark.conf.set(name, str(COUNTED))
    schema = StructType([rows.schema[k] for k in keys]).add("term", StringType()).add("tf", LongType()).add("length", IntegerType()).add("places", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(len(keys))
            ends = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())))
            flat = lists.flatten().dictionary_encode()
            code = flat.indices.to_numpy().astype(np.int64)
            row = np.repeat(np.arange(b.num_rows), np.diff(ends))
            place = np.arange(len(code)) - ends[row]
            empty = flat.dictionary.index(pa.scalar("", flat.dictionary.type)).as_py()
            some = np.flatnonzero(code != empty) if len(code) else np.empty(0, np.int64)
            row, code, place = row[some], code[some], place[some]
            both = row * max(1, len(flat.dictionary)) + code
            order = np.argsort(both, kind="stable")
            row, code, place, both = row[order], code[order], place[order], both[order]
            first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1]))) if len(both) else np.empty(0, np.int64)
            if not len(first):
                continue
            starts = np.append(first, len(both))
            length = np.bincount(row, minlength=b.num_rows)[row[first]]
            at = pa.array(row[first])
            places = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(place, pa.int32()))
            columns = [*(b.column(i).take(at) for i in range(len(keys))), flat.dictionary.take(pa.array(code[first])), pa.array(np.diff(starts), pa.int64()), pa.array(length, pa.int32()), places]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.select(*keys, "terms").mapInArrow(run, schema)


def repeats(docs: DataFrame, key: str) -> bool:
    """Whether rows repeat a key. Only the keys are read and shuffled."""
    return not docs.groupBy(key).agg(F.count("*").alias("c")).where("c > 1").isEmpty()


def postings(docs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, term, tf, length): an inverted index. Terms are counted without a shuffle; only if keys repeat their counts are added up in one."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), simple_tokens(F.coalesce(F.col(f), F.lit(""))).alias("terms")) for f in fields]))
    rows = counted(docs.select(key, each.alias("f")).select(key, "f.field", "f.terms"), [key, "field"]).drop("places")
    return rows.groupBy(key, "field", "term").agg(F.sum("tf").alias("tf"), F.first("length").alias("length")) if repeats(docs, key) else rows


def expand_terms(vocabulary: DataFrame, query: str, prefix: bool = True, fuzzy: float = 0.2) -> DataFrame:
    """(query_term, term, weight): terms equal to, beginning with, or within round(fuzzy * length) edits of each query term.

    The query's terms are literals, so the vocabulary is scanned once and nothing is joined.
    """
    terms = sorted({t for t in _query_terms(query)})
    if not terms:
        return vocabulary.select(F.lit("").alias("query_term"), "term", F.lit(0.0).alias("weight")).where(F.lit(False))
    options = []
    for t in terms:
        edits = int(fuzzy * len(t) + 0.5)
        w = F.when(F.col("term") == t, EXACT)
        if prefix:
            w = w.when(F.startswith("term", F.lit(t)), PREFIX * len(t) / F.length("term"))
        if edits:
            w = w.when(F.levenshtein(F.col("term"), F.lit(t), edits) >= 0, FUZZY)
        options.append(F.struct(F.lit(t).alias("query_term"), w.alias("weight")))
    out = vocabulary.select("term").distinct().select("term", F.explode(F.array(*options)).alias("o"))
    return out.select("o.query_term", "term", "o.weight").where("weight is not null")


def _query_terms(query: str) -> list[str]:
    import re

    return [t for t in re.split(r"[\s\W]+", query.lower(), flags=re.ASCII) if len(t) > 1]


def bm25(index: DataFrame, key: str, n_docs: int, average: float, query: str, all_terms: bool = False, prefix: bool = False, fuzzy: float = 0.0) -> DataFrame:
    """(key, score, matched) of the documents in ``index`` (key, term, tf, length, boost if any).

    Only postings of the query's terms are read past the filter; scores are summed before the shuffle.
    """
    wanted = expand_terms(index, query, prefix, fuzzy)
    df = index.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.countDistinct(key).alias("df"))
    idf = F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    hits = index.join(wanted, "term").join(df, "term")
    boost = F.col("boost") if "boost" in index.columns else F.lit(1.0)
    part = boost * F.col("weight") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(average)))
    out = hits.groupBy(key).agg(F.sum(part).alias("score"), F.countDistinct("query_term").alias("matched"))
    return out.where(F.col("matched") == len(set(_query_terms(query)))) if all_terms else out


def term_bucket(term: Column | str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def write_index(docs: DataFrame, key: str, fields: list[str], path: str, buckets: int = BUCKETS) -> None:
    """Store an inverted index under ``path``: postings in folders by the hash of their term, sorted by term, and the lengths of all documents.

    Searches read the folders of their terms only, and of these the row groups that hold them.
    """
    rows = postings(docs, key, fields).withColumn("bucket", term_bucket("term", buckets))
    rows.repartition("bucket", F.pmod(F.xxhash64(key), F.lit(4))).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/postings")
    size = sum((F.size(simple_tokens(F.coalesce(F.col(f), F.lit("")))) for f in fields), F.lit(0))
    docs.select(key, size.alias("length")).write.parquet(f"{path}/lengths")


def search_index(spark: SparkSession, path: str, key: str, query: str, all_terms: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """(key, score, matched) by BM25 from a stored index. Only the postings of the query's terms are read."""
    n, average = spark.read.parquet(f"{path}/lengths").agg(F.count("*"), F.avg("length")).first()
    terms = sorted(set(_query_terms(query)))
    asked = spark.range(1).select(F.explode(F.array(*[F.lit(t) for t in terms])).alias("t")).select(term_bucket("t", buckets)).distinct() if terms else None
    folders = [r[0] for r in asked.collect()] if asked is not None else []
    index = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(folders) & F.col("term").isin(terms))
    return bm25(index, key, n, average or 1.0, query, all_terms)


def updated_index(index: DataFrame, docs: DataFrame, key: str, fields: list[str], gone: DataFrame | None = None) -> DataFrame:
    """Postings after ``docs`` were indexed anew and the keys in ``gone`` removed; other documents' postings are kept as they are."""
    keys = docs.select(key) if gone is None else docs.select(key).unionByName(gone.select(key))
    return index.join(keys.distinct(), key, "left_anti").unionByName(postings(docs, key, fields))


def index_statistics(index: DataFrame, key: str) -> DataFrame:
    """One row (documents, terms, postings) of an index."""
    return index.agg(F.countDistinct(key).alias("documents"), F.countDistinct("term").alias("terms"), F.count("*").alias("postings"))


def fuzzy_symbols(symbols: DataFrame, query: str, limit: int = 50, **filters: object) -> DataFrame:
    """Symbols for which every term of the query matches exactly, by prefix or by edits, best BM25 score first.

    An empty query finds nothing.
    """
    rows = filtered(symbols, **filters)  # type: ignore[arg-type]
    for f in BOOSTS:
        if f not in rows.columns:
            rows = rows.withColumn(f, F.lit(None).cast("string"))
    index = postings(rows, "id", list(BOOSTS))
    boost = F.lit(1.0)
    for f, w in BOOSTS.items():
        boost = F.when(F.col("field") == f, w).otherwise(boost)
    n, average = index.agg(F.countDistinct("id"), F.avg("length")).first()
    scores = bm25(index.withColumn("boost", boost), "id", n or 1, average or 1.0, query, all_terms=True, prefix=True, fuzzy=0.2)
    return rows.join(scores, "id").orderBy(F.desc("score"), "id").limit(limit)


def suggest(terms: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    """(term, n) of the commonest terms with a beginning of two characters or more; ``terms`` has one row for each use."""
    found = terms.where(F.startswith("term", F.lit(prefix.lower())) & F.lit(len(prefix) >= 2))
    return found.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(limit)


def spread(index: DataFrame, key: str, term: Column | str = "term") -> DataFrame:
    """(term, df, tf): in how many documents, and how often, each term occurs."""
    return index.groupBy(term).agg(F.countDistinct(key).alias("df"), F.sum("tf").alias("tf"))
