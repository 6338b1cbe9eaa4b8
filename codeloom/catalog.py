"""All queries of the library over the shared tables, with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.functions import vectors as V
from codeloom.operators import context, extract, facade, hybrid, navigation, search, store, vector_search
from codeloom.operators.staging import folder, stage
from codeloom.plans import canonical as C
from codeloom.sources import workspace
from codeloom.streaming import changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

SYM, EDGE, FILE = f"({C.SYMBOLS_SQL}) s", f"({C.RELATIONSHIPS_SQL}) r", f"({C.FILES_SQL}) f"
QUERY_TERMS = ["the", "and", "eau", "ou"]
WORD = "ring"


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Tokens and text vectors

_TERMS_SQL = r"""
    plain AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)/\*.*?\*/', ' ', 'g'),
        '//[^\n]*', ' ', 'g'), '''[^''\\]*(?:\\.[^''\\]*)*''', ' ', 'g'), '"[^"\\]*(?:\\.[^"\\]*)*"', ' ', 'g'), '`[^`\\]*(?:\\.[^`\\]*)*`', ' ', 'g') AS t
        FROM documents WHERE text IS NOT NULL),
    listed AS (SELECT doc_id, list_distinct(list_filter(list_transform(list_concat(list_concat(regexp_extract_all(t, '\b[a-zA-Z][a-zA-Z0-9]*\b'),
        regexp_extract_all(t, '\b[a-z]+(?:_[a-z]+)+\b')), list_concat(regexp_extract_all(t, '\b[a-z]+(?:-[a-z]+)+\b'), regexp_extract_all(t, '[+\-*/=<>!&|]+'))),
        lambda x: lower(x)), lambda x: length(x) >= 2 AND x NOT IN ('var', 'let', 'const'))) AS terms FROM plain),
    doc_terms AS (SELECT doc_id, unnest(terms) AS term, 1.0::DOUBLE / len(terms) AS tf FROM listed),
    n AS (SELECT count(*) AS n FROM documents),
    vocab AS (SELECT term, count(*) AS df, ln(max(n.n)::DOUBLE / count(*)) AS idf FROM doc_terms, n GROUP BY term
        HAVING count(*) <= floor(max(n.n) * 0.9) ORDER BY df DESC, term LIMIT 1000)"""


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return C.table(spark, d, "documents")


def _doc_terms(spark: SparkSession, d: str) -> DataFrame:
    return vector_search.doc_terms(_documents(spark, d).where("text is not null"), "doc_id", "text")


def _vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return vector_search.vocabulary(_doc_terms(spark, d), _documents(spark, d).count())


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Sparse vectors and the vocabulary; the terms of the texts are worked out once."""
    terms = stage(_doc_terms(spark, d))
    vocab = stage(vector_search.vocabulary(terms, _documents(spark, d).count()))
    return vector_search.weights(terms, vocab, "doc_id"), vocab


@query(r"""SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, CAST(len(list_distinct(t)) AS INTEGER) AS n_distinct FROM (
    SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\s\W]+'), lambda x: length(x) > 1) AS t FROM documents) x""")
def tokenize_simple(spark: SparkSession, d: str) -> DataFrame:
    rows = _documents(spark, d).select("doc_id", T.simple_tokens(F.coalesce("text", F.lit(""))).alias("t"))
    return rows.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


@query(f"WITH {_TERMS_SQL} SELECT term, count(*) AS df FROM doc_terms GROUP BY term")
def term_df(spark: SparkSession, d: str) -> DataFrame:
    return _doc_terms(spark, d).groupBy("term").agg(F.count("*").alias("df"))


@query(f"WITH {_TERMS_SQL} SELECT term, df, round(idf, 6) AS idf FROM vocab")
def tfidf_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return _vocabulary(spark, d).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_TERMS_SQL} SELECT doc_id, term, round(tf * idf, 6) AS w FROM doc_terms JOIN vocab USING (term)")
def tfidf_weights(spark: SparkSession, d: str) -> DataFrame:
    vectors, _ = _vectors(spark, d)
    return vectors.select("doc_id", "term", F.round("w", 6).alias("w"))


@query(f"""WITH {_TERMS_SQL}, w AS (SELECT doc_id, term, tf * idf AS w FROM doc_terms JOIN vocab USING (term)),
    q AS (SELECT term, idf * {1 / len(QUERY_TERMS)} AS q FROM vocab WHERE term IN ({", ".join(f"'{t}'" for t in QUERY_TERMS)})),
    s AS (SELECT doc_id, sum(w * coalesce(q, 0)) AS dot, sqrt(sum(w * w)) AS norm FROM w LEFT JOIN q USING (term) GROUP BY doc_id)
    SELECT doc_id, round(dot / (norm * (SELECT sqrt(sum(q * q)) FROM q)), 6) AS score FROM s WHERE dot > 0 ORDER BY dot / (norm * (SELECT sqrt(sum(q * q)) FROM q)) DESC, doc_id LIMIT 10""")
def tfidf_search_topk(spark: SparkSession, d: str) -> DataFrame:
    vectors, vocab = _vectors(spark, d)
    found = vector_search.tfidf_search(vectors, vocab, "doc_id", QUERY_TERMS)
    return found.select("doc_id", F.round("score", 6).alias("score"))


@query("""
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS INTEGER) AS chunk, md5(substring(text, first + 1, 2048)) AS digest FROM (
        SELECT doc_id, text, CAST(unnest(CASE WHEN length(text) <= 2048 THEN [0] ELSE range(0, length(text), 1848) END) AS INTEGER) AS first FROM documents WHERE text IS NOT NULL) x""")
def text_chunks(spark: SparkSession, d: str) -> DataFrame:
    return vector_search.chunks(_documents(spark, d).where("text is not null"), "doc_id", "text").select("doc_id", "chunk", F.md5("content").alias("digest"))


# Dense vectors


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return [float(x) for x in C.table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]]


_COSINE = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


@query(f"SELECT vec_id, round(score, 6) AS score FROM (SELECT e.vec_id, {_COSINE} AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY score DESC, e.vec_id LIMIT 10) x WHERE score >= 0.2")
def knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    found = vector_search.nearest(C.table(spark, d, "embeddings"), "vec_id", "embedding", _query_vector(spark, d))
    return found.select("vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT label, count(*) AS n, round(avg(s), 6) AS mean, round(max(s), 6) AS best FROM (SELECT e.label, greatest(0, {_COSINE}) AS s FROM embeddings e, embeddings q WHERE q.vec_id = 0) x GROUP BY label")
def embedding_confidence(spark: SparkSession, d: str) -> DataFrame:
    q = F.lit(_query_vector(spark, d)).cast("array<double>")
    rows = C.table(spark, d, "embeddings").select("label", V.confidence(V.cosine(V.as_doubles(F.col("embedding")), q)).alias("s"))
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("s"), 6).alias("mean"), F.round(F.max("s"), 6).alias("best"))


@query("""WITH x AS (SELECT label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
    m AS (SELECT label, i, avg(x) AS m FROM x GROUP BY label, i), l AS (SELECT label, sqrt(sum(m * m)) AS norm FROM m GROUP BY label)
    SELECT label, CAST(i AS INTEGER) AS i, round(m / norm, 6) + 0.0 AS x FROM m JOIN l USING (label)""")
def vector_mean_by_label(spark: SparkSession, d: str) -> DataFrame:
    means = vector_search.mean_vectors(C.table(spark, d, "embeddings"), "label", "embedding")
    return means.select("label", F.posexplode("mean").alias("i", "x")).select("label", "i", (F.round("x", 6) + F.lit(0.0)).alias("x"))


@query(f"""WITH h AS (SELECT vec_id, score FROM (SELECT e.vec_id, {_COSINE} AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY score DESC, e.vec_id LIMIT 40) x WHERE score >= 0.3),
    j AS (SELECT s.id, h.score, CASE kind WHEN 'SMALL' THEN 'frontend' WHEN 'LARGE' THEN 'api' ELSE 'domain' END AS layer FROM h JOIN {SYM} ON s.key = h.vec_id)
    SELECT count(*) AS n, count(DISTINCT layer) AS n_layers, round(coalesce(avg(score), 0), 6) AS confidence FROM j""")
def cross_layer_entity(spark: SparkSession, d: str) -> DataFrame:
    hits = vector_search.nearest(C.table(spark, d, "embeddings"), "vec_id", "embedding", _query_vector(spark, d), 40, 0.3)
    kind = F.when(F.col("kind") == "SMALL", "frontend").when(F.col("kind") == "LARGE", "api").otherwise("domain")
    symbols = C.symbols(spark, d).select(F.col("key").alias("vec_id"), F.col("id").alias("symbol"), kind.alias("layer"))
    found = vector_search.entity_mapping(hits.join(symbols, "vec_id").select(F.col("symbol").alias("id"), "score"), symbols.select(F.col("symbol").alias("id"), "layer"))
    return found.select(F.size("symbols").cast("long").alias("n"), F.size("layers").cast("long").alias("n_layers"), F.round("confidence", 6).alias("confidence"))


# Search

_RANK = f"CASE WHEN name = 'small {WORD}' THEN 1 WHEN lower(name) LIKE 'small {WORD}%' THEN 2 ELSE 3 END"


@query(f"SELECT id, name FROM {SYM} WHERE name ILIKE '%{WORD}%' ORDER BY name, id LIMIT 50")
def name_like(spark: SparkSession, d: str) -> DataFrame:
    return search.by_name(C.symbols(spark, d), WORD).select("id", "name")


@query(f"SELECT id, name, match_rank FROM (SELECT *, {_RANK} AS match_rank FROM {SYM} WHERE name ILIKE '%small {WORD}%' OR signature ILIKE '%small {WORD}%') x ORDER BY match_rank, name, id LIMIT 50")
def ranked_like(spark: SparkSession, d: str) -> DataFrame:
    return search.ranked(C.symbols(spark, d), f"small {WORD}").select("id", "name", "match_rank")


@query(f"SELECT id, resolved_type, match_rank FROM (SELECT id, name, kind AS resolved_type, CASE WHEN kind = 'small' THEN 1 WHEN kind ILIKE 'small%' THEN 2 ELSE 3 END AS match_rank FROM {SYM} WHERE kind ILIKE '%small%') x ORDER BY match_rank, name, id LIMIT 100")
def type_search(spark: SparkSession, d: str) -> DataFrame:
    symbols = C.symbols(spark, d)
    types = symbols.select(F.col("id").alias("symbol_id"), F.col("kind").alias("resolved_type"))
    return search.by_type(symbols, types, "small").select("id", "resolved_type", "match_rank")


@query(f"SELECT id, file_path FROM {SYM} WHERE starts_with(file_path, 'src/promo/') AND kind IN ('PROMO', 'SMALL') AND language = 'Brand#2'")
def filter_path_kind_language(spark: SparkSession, d: str) -> DataFrame:
    return search.filtered(C.symbols(spark, d), "Brand#2", ["PROMO", "SMALL"], "src\\promo\\").select("id", "file_path")


_POSTINGS = r"""t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\s\W]+'), lambda x: length(x) > 1) AS t FROM documents),
    p AS (SELECT doc_id, len(t) AS length, unnest(t) AS term FROM t), i AS (SELECT doc_id, term, count(*) AS tf, any_value(length) AS length FROM p GROUP BY doc_id, term),
    df AS (SELECT term, count(*) AS df FROM i GROUP BY term)"""


def _bm25_sql(where: str, having: str) -> str:
    score = f"sum(ln(1 + (n.n - df + 0.5) / (df + 0.5)) * tf * {search.K1 + 1} / (tf + {search.K1} * (1 - {search.B} + {search.B} * length / n.a)))"
    return f"WITH {_POSTINGS}, n AS (SELECT count(*) AS n, avg(len(t)) AS a FROM t) SELECT doc_id, round({score}, 6) AS score FROM i JOIN df USING (term), n WHERE {where} GROUP BY doc_id {having}"


def _bm25(spark: SparkSession, d: str, terms: str, all_terms: bool = False) -> DataFrame:
    path = folder(spark)
    search.write_index(_documents(spark, d), "doc_id", ["text"], path)
    return search.search_index(spark, path, "doc_id", terms, all_terms).select("doc_id", F.round("score", 6).alias("score"))


@query(_bm25_sql("term IN ('the', 'and', 'eau', 'ou')", ""))
def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d, " ".join(QUERY_TERMS))


@query(_bm25_sql("term IN ('the', 'and')", "HAVING count(*) = 2"))
def bm25_and(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d, "the and", all_terms=True)


@query(r"""SELECT term, CAST(CASE WHEN term = 'ring' THEN 1.0 WHEN starts_with(term, 'ring') THEN 0.75 * 4 / length(term) WHEN levenshtein(term, 'ring') <= 1 THEN 0.45 END AS DOUBLE) AS weight FROM (
    SELECT DISTINCT unnest(string_split(p_name, ' ')) AS term FROM part) x WHERE starts_with(term, 'ring') OR levenshtein(term, 'ring') <= 1""")
def fuzzy_terms(spark: SparkSession, d: str) -> DataFrame:
    words = C.table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("term"))
    return search.expand_terms(words, WORD).select("term", "weight")


@query(r"WITH t AS (SELECT unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\s\W]+'), lambda x: length(x) > 1)) AS term FROM documents) SELECT term, count(*) AS n FROM t WHERE starts_with(term, 'th') GROUP BY term ORDER BY n DESC, term LIMIT 10")
def suggest(spark: SparkSession, d: str) -> DataFrame:
    words = _documents(spark, d).select(F.explode(T.simple_tokens(F.coalesce("text", F.lit("")))).alias("term"))
    return search.suggest(words, "th")


@query(f"""SELECT id, round(CASE WHEN lower(name) = 'small {WORD}' THEN 1.0 WHEN contains(lower(name), 'small {WORD}') OR contains('small {WORD}', lower(name)) THEN 0.8
    ELSE 1 - levenshtein(lower(name), 'small {WORD}')::DOUBLE / greatest(length(name), {6 + len(WORD)}) END, 6) AS similarity FROM {SYM}""")
def name_similarity(spark: SparkSession, d: str) -> DataFrame:
    return C.symbols(spark, d).select("id", F.round(T.name_similarity(F.col("name"), F.lit(f"small {WORD}")), 6).alias("similarity"))


_MERGED = f"""WITH a AS (SELECT id FROM {SYM} WHERE name ILIKE '%{WORD}%' ORDER BY name, id LIMIT 50),
    b AS (SELECT s.id, x.score FROM (SELECT e.vec_id, {_COSINE} AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY score DESC, e.vec_id LIMIT 20) x JOIN {SYM} ON s.key = x.vec_id WHERE x.score >= 0.2),
    j AS (SELECT s.*, a.id IS NOT NULL AS f, b.score AS sem FROM {SYM} LEFT JOIN a ON a.id = s.id LEFT JOIN b ON b.id = s.id WHERE a.id IS NOT NULL OR b.id IS NOT NULL),
    k AS (SELECT id, f, sem, CASE WHEN lower(name) = '{WORD}' THEN 1.0 WHEN contains(lower(name), '{WORD}') OR contains('{WORD}', lower(name)) THEN 0.8
        ELSE 1 - levenshtein(lower(name), '{WORD}')::DOUBLE / greatest(length(name), {len(WORD)}) END AS ns,
        CASE WHEN f THEN least(1.0, 0.5 + CASE WHEN contains('{WORD}', lower(kind)) THEN 0.2 ELSE 0 END + CASE WHEN contains(lower(file_path), '{WORD}') THEN 0.15 ELSE 0 END
        + CASE WHEN contains('{WORD}', lower(language)) THEN 0.1 ELSE 0 END + least(0.05, (end_line - start_line) / 100.0)) ELSE 0.2 END AS ss FROM j),
    m AS (SELECT id, CASE WHEN f AND sem IS NOT NULL THEN 'hybrid' WHEN f THEN 'structural' ELSE 'semantic' END AS method, CAST(0.3 * ns + 0.3 * ss + 0.4 * coalesce(sem, 0) AS DOUBLE) AS score FROM k)"""


def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    symbols = C.symbols(spark, d)
    near = vector_search.nearest(C.table(spark, d, "embeddings"), "vec_id", "embedding", _query_vector(spark, d), 20)
    semantic = near.join(symbols.select(F.col("key").alias("vec_id"), "id"), "vec_id").select("id", "score")
    return hybrid.merge(search.by_name(symbols, WORD), semantic, symbols, WORD, limit=1000)


@query(f"{_MERGED} SELECT id, method, round(score, 6) AS score FROM m WHERE score >= 0.3")
def hybrid_merge(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d).select("id", "method", F.round("score", 6).alias("score"))


@query(f"{_MERGED} SELECT method, count(*) AS n FROM m WHERE score >= 0.3 GROUP BY method")
def method_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d).groupBy("method").agg(F.count("*").alias("n"))


# Navigation


def _spans(spark: SparkSession, d: str) -> DataFrame:
    li = C.table(spark, d, "lineitem")
    kind = F.when(F.col("l_returnflag") == "R", "function").when(F.col("l_returnflag") == "A", "class").otherwise("variable")
    return li.select(
        F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("start_line"), (F.col("l_linenumber") + F.floor(F.col("l_quantity") / 10)).cast("int").alias("end_line"),
        (F.col("l_suppkey") % 10).alias("start_column"), (10 + F.col("l_partkey") % 20).alias("end_column"), kind.alias("kind"), F.col("l_partkey").alias("id"),
    )


def _probes(spark: SparkSession, d: str) -> DataFrame:
    o = C.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("probe_id"), F.col("o_orderkey").alias("file"), (1 + F.col("o_custkey") % 9).alias("line"), (F.col("o_custkey") % 25).alias("col"))


_SPANS_SQL = """spans AS (SELECT l_orderkey AS file, l_linenumber AS a, CAST(l_linenumber + floor(l_quantity / 10) AS INTEGER) AS b, l_suppkey % 10 AS c, 10 + l_partkey % 20 AS e,
    CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 10 END AS near, l_partkey AS id FROM lineitem),
    probes AS (SELECT o_orderkey AS file, 1 + o_custkey % 9 AS line, o_custkey % 25 AS col FROM orders)"""


@query(f"WITH {_SPANS_SQL}, r AS (SELECT file AS probe_id, id, b - a AS size, row_number() OVER (PARTITION BY file ORDER BY b - a, id) AS n FROM probes JOIN spans USING (file) WHERE line BETWEEN a AND b) SELECT probe_id, id, size FROM r WHERE n = 1")
def position_lookup(spark: SparkSession, d: str) -> DataFrame:
    return navigation.at_position(_probes(spark, d), _spans(spark, d), "file")


@query(f"""WITH {_SPANS_SQL}, r AS (SELECT file AS probe_id, id, row_number() OVER (PARTITION BY file ORDER BY near, (b - a) * 1000 + e - c, id) AS n FROM probes JOIN spans USING (file)
    WHERE line BETWEEN a AND b AND (line > a OR col >= c) AND (line < b OR col <= e)) SELECT probe_id, id FROM r WHERE n = 1""")
def containing_symbol(spark: SparkSession, d: str) -> DataFrame:
    return navigation.containing(_probes(spark, d), _spans(spark, d), "file")


@query(f"SELECT file_path, name, arg_min(id, key) AS first_target, arg_max(id, key) AS last_target FROM {SYM} GROUP BY file_path, name")
def first_last_name_resolution(spark: SparkSession, d: str) -> DataFrame:
    symbols = C.symbols(spark, d).withColumn("ordinal", F.col("key"))
    uses = symbols.select("file_path", "name").distinct()
    first = navigation.resolve_names(uses, symbols).withColumnRenamed("target", "first_target")
    return navigation.resolve_names(first, symbols, last=True).withColumnRenamed("target", "last_target")


@query(f"SELECT r.from_key, r.kind, r.line, s.name, s.file_path FROM {EDGE} JOIN {SYM} ON s.key = r.from_key WHERE r.to_key = 1 AND r.kind IN ('calls', 'uses', 'references')")
def references(spark: SparkSession, d: str) -> DataFrame:
    return navigation.references(C.relationships(spark, d), C.symbols(spark, d), 1).select("from_key", "kind", "line", "name", "file_path")


@query(f"SELECT id, name FROM {SYM} WHERE key IN (SELECT from_key FROM {EDGE} WHERE kind = 'calls' AND to_key = 1) ORDER BY name, id LIMIT 50")
def callers(spark: SparkSession, d: str) -> DataFrame:
    return navigation.calls(C.relationships(spark, d), C.symbols(spark, d), 1).select("id", "name")


@query(f"SELECT id, name FROM {SYM} WHERE key IN (SELECT to_key FROM {EDGE} WHERE kind = 'calls' AND from_key = 1) ORDER BY name, id LIMIT 50")
def callees(spark: SparkSession, d: str) -> DataFrame:
    return navigation.calls(C.relationships(spark, d), C.symbols(spark, d), 1, incoming=False).select("id", "name")


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT from_key, to_key FROM {EDGE} WHERE kind = 'calls'), t AS (SELECT 1::BIGINT AS key, 0 AS level
    UNION SELECT e.to_key, t.level + 1 FROM t JOIN e ON e.from_key = t.key WHERE t.level < 5) SELECT 1::BIGINT AS root, key, CAST(min(level) AS INTEGER) AS level FROM t GROUP BY key""")
def call_tree(spark: SparkSession, d: str) -> DataFrame:
    roots = spark.createDataFrame([(1,)], "key long")
    return navigation.call_tree(C.relationships(spark, d), roots, 5)


@query("""WITH RECURSIVE t AS (SELECT conv_id, turn, 0 AS depth FROM conversations WHERE turn = 0 UNION ALL
    SELECT c.conv_id, c.turn, t.depth + 1 FROM t JOIN conversations c ON c.conv_id = t.conv_id AND c.turn = t.turn + 1) SELECT conv_id, turn, CAST(depth AS INTEGER) AS depth FROM t""")
def containment_tree(spark: SparkSession, d: str) -> DataFrame:
    rows = C.table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") > 0, F.col("conv_id")).alias("up_conv"), F.when(F.col("turn") > 0, F.col("turn") - 1).alias("up_turn"))
    return navigation.containment_tree(rows, ["conv_id", "turn"], ["up_conv", "up_turn"]).select("conv_id", "turn", "depth")


@query(f"""SELECT b.source_key, s.name AS source_name, s.file_path AS source_file, b.target_key, t.name AS target_name FROM (SELECT s_suppkey AS source_key,
    CASE WHEN s_nationkey % 3 <> 0 THEN s_suppkey * 7 END AS target_key FROM supplier) b JOIN {SYM} ON s.key = b.source_key LEFT JOIN ({C.SYMBOLS_SQL}) t ON t.key = b.target_key""")
def bindings_left_join(spark: SparkSession, d: str) -> DataFrame:
    s = C.table(spark, d, "supplier")
    links = s.select(F.col("s_suppkey").alias("source_key"), F.when(F.col("s_nationkey") % 3 != 0, F.col("s_suppkey") * 7).alias("target_key"))
    return navigation.bindings(links, C.symbols(spark, d)).select("source_key", "source_name", "source_file", "target_key", "target_name")


@query(f"""SELECT r.to_key, count(*) AS n, count(DISTINCT s.file_path) AS n_files FROM {EDGE} JOIN {SYM} ON s.key = r.from_key JOIN ({C.SYMBOLS_SQL}) d ON d.key = r.to_key
    WHERE r.kind IN ('calls', 'uses', 'references') AND s.file_path <> d.file_path GROUP BY r.to_key""")
def implementations(spark: SparkSession, d: str) -> DataFrame:
    symbols = C.symbols(spark, d)
    refs = navigation.references(C.relationships(spark, d), symbols)
    here = symbols.select(F.col("key").alias("to_key"), F.col("file_path").alias("own"))
    return refs.join(here, "to_key").where("file_path <> own").groupBy("to_key").agg(F.count("*").alias("n"), F.countDistinct("file_path").alias("n_files"))


@query(f"WITH {_SPANS_SQL}, r AS (SELECT file AS probe_id, id, row_number() OVER (PARTITION BY file ORDER BY b - a, id) AS n FROM probes JOIN spans USING (file) WHERE line BETWEEN a AND b) SELECT probe_id, s.name, CASE WHEN s.key % 2 = 0 THEN s.kind END AS resolved_type FROM r JOIN {SYM} ON s.key = r.id WHERE n = 1")
def hover(spark: SparkSession, d: str) -> DataFrame:
    symbols = C.symbols(spark, d)
    types = symbols.where("key % 2 = 0").select(F.col("key").alias("symbol_id"), F.col("kind").alias("resolved_type"))
    found = navigation.at_position(_probes(spark, d), _spans(spark, d), "file")
    return navigation.hover(found, symbols.withColumn("id", F.col("key")), types).select("probe_id", "name", "resolved_type")


@query(f"""SELECT file_path, from_key, line, CAST(rank AS INTEGER) AS rank, total, CASE WHEN total > 15 THEN 'heavy' WHEN total > 5 THEN 'moderate' ELSE 'light' END AS usage FROM (
    SELECT s.file_path, r.from_key, r.line, row_number() OVER (PARTITION BY s.file_path ORDER BY r.line, r.from_key, r.to_key, r.order_key) AS rank, count(*) OVER (PARTITION BY s.file_path) AS total
    FROM {EDGE} JOIN {SYM} ON s.key = r.from_key) x WHERE rank <= 3""")
def refs_by_file_top3(spark: SparkSession, d: str) -> DataFrame:
    refs = navigation.references(C.relationships(spark, d), C.symbols(spark, d)).withColumn("place", F.struct("from_key", "to_key", "order_key"))
    return navigation.by_file(refs, "place").select("file_path", "from_key", "line", "rank", "total", T.usage_label(F.col("total")).alias("usage"))


@query("SELECT l_partkey AS key, arg_min(l_orderkey, (l_linenumber, l_orderkey, l_suppkey)) AS first_order FROM lineitem GROUP BY l_partkey")
def dedup_first_wins(spark: SparkSession, d: str) -> DataFrame:
    li = C.table(spark, d, "lineitem").select(F.col("l_partkey").alias("key"), "l_linenumber", "l_orderkey", "l_suppkey")
    return vector_search.first_of_each(li, "key", "l_linenumber", "l_orderkey", "l_suppkey").select("key", F.col("l_orderkey").alias("first_order"))


@query("SELECT l_partkey AS key FROM lineitem UNION SELECT l_suppkey FROM lineitem")
def distinct_union(spark: SparkSession, d: str) -> DataFrame:
    li = C.table(spark, d, "lineitem")
    return store.distinct_keys(li.select(F.col("l_partkey").alias("key")), li.select("l_suppkey"))


# Statistics and architecture


@query("SELECT (SELECT count(*) FROM part) AS symbols, (SELECT count(*) FROM documents) AS files, (SELECT count(*) FROM lineitem) AS relationships")
def stats_counts(spark: SparkSession, d: str) -> DataFrame:
    return store.statistics(C.symbols(spark, d), _documents(spark, d), C.relationships(spark, d))


@query(f"SELECT count(*) AS symbols, count(DISTINCT file_path) AS files FROM {SYM} WHERE starts_with(file_path, 'src/promo/')")
def workspace_stats(spark: SparkSession, d: str) -> DataFrame:
    return store.workspace_statistics(C.symbols(spark, d), "src/promo")


@query(f"SELECT kind, count(*) AS n FROM {SYM} GROUP BY kind")
def symbols_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return store.by(C.symbols(spark, d), "kind")


_LAYER_SQL = "CASE " + " ".join(f"WHEN {' OR '.join(f'''contains(lower(url), '{p}')''' for p in parts)} THEN '{name}'" for name, parts in T.LAYERS) + " ELSE 'unknown' END"


@query(f"SELECT layer, count(*) AS n FROM (SELECT {_LAYER_SQL} AS layer FROM pages WHERE url IS NOT NULL) x GROUP BY layer")
def layer_histogram(spark: SparkSession, d: str) -> DataFrame:
    rows = C.table(spark, d, "pages").where("url is not null").select(T.layer(F.col("url")).alias("layer"))
    return rows.groupBy("layer").agg(F.count("*").alias("n"))


@query(f"SELECT CASE WHEN list_has_all(l, ['frontend', 'api', 'domain']) THEN 'Clean Architecture' WHEN list_has_all(l, ['controller', 'service', 'repository']) THEN 'MVC Pattern' WHEN list_has_all(l, ['api', 'domain', 'data']) THEN 'Layered Architecture' ELSE 'Custom Architecture' END AS style, CAST(len(l) AS INTEGER) AS n_layers FROM (SELECT list(DISTINCT {_LAYER_SQL}) AS l FROM pages WHERE url IS NOT NULL) x")
def architecture_pattern(spark: SparkSession, d: str) -> DataFrame:
    layers = C.table(spark, d, "pages").where("url is not null").agg(F.collect_set(T.layer(F.col("url"))).alias("l"))
    return layers.select(T.architecture(F.col("l")).alias("style"), F.size("l").alias("n_layers"))


@query("SELECT page_id, CASE WHEN contains(lower(url), '/api/') OR contains(lower(url), '/routes/') OR contains(lower(url), '/controllers/') THEN 'api' WHEN contains(lower(url), '/db/') OR contains(lower(url), '/database/') OR contains(lower(url), '/models/') THEN 'data' WHEN contains(lower(url), '/ui/') OR contains(lower(url), '/components/') OR contains(lower(url), '/views/') THEN 'frontend' WHEN contains(lower(url), '/service/') OR contains(lower(url), '/business/') OR contains(lower(url), '/domain/') THEN 'domain' ELSE 'infrastructure' END AS layer FROM pages WHERE url IS NOT NULL")
def directory_layers(spark: SparkSession, d: str) -> DataFrame:
    return C.table(spark, d, "pages").where("url is not null").select("page_id", T.directory_layer(F.col("url")).alias("layer"))


# Lines and edits


@query(r"SELECT doc_id, i AS line, trim(raw, ' ') AS text FROM (SELECT doc_id, unnest(l) AS raw, CAST(generate_subscripts(l, 1) AS INTEGER) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL) x) y WHERE regexp_matches(raw, 'th[aeiou]+ [a-z]+ing')")
def grep_lines(spark: SparkSession, d: str) -> DataFrame:
    files = _documents(spark, d).select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    return workspace.grep(files, "th[aeiou]+ [a-z]+ing").select(F.col("path").alias("doc_id"), "line", "text")


@query("SELECT doc_id, md5(array_to_string(list_slice(l, greatest(1, 8 - 5), least(len(l), 8 + 5)), chr(10))) AS digest FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL) x")
def context_window(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).where("text is not null").select("doc_id", F.md5(context.window(F.col("text"), 8)).alias("digest"))


@query("""SELECT page_id, CAST(line AS INTEGER) AS line, CAST(sum(d) OVER (PARTITION BY page_id ORDER BY line) AS INTEGER) AS depth FROM (SELECT page_id, generate_subscripts(l, 1) AS line,
    unnest(list_transform(l, lambda x: (length(x) - length(replace(x, '{', ''))) - (length(x) - length(replace(x, '}', ''))))) AS d FROM (SELECT page_id, string_split(html, chr(10)) AS l FROM pages WHERE html IS NOT NULL) x) y""")
def scope_balance(spark: SparkSession, d: str) -> DataFrame:
    return context.scope_depth(C.table(spark, d, "pages").where("html is not null"), "page_id", "html")


@query("SELECT doc_id, md5(CASE WHEN len(l) < 2 THEN text ELSE array_to_string(list_concat(list_concat(list_slice(l, 1, 1), ['added', 'lines']), list_slice(l, 4, len(l))), chr(10)) END) AS digest FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL) x")
def line_edit(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).where("text is not null").select("doc_id", F.md5(context.replace_lines(F.col("text"), 2, 3, "added\nlines")).alias("digest"))


@query("SELECT doc_id, CAST((length(text) - length(replace(text, 'the ', ''))) / 4 AS INTEGER) AS n_replaced, md5(replace(text, 'the ', '$1 ')) AS digest FROM documents WHERE text IS NOT NULL")
def search_replace(spark: SparkSession, d: str) -> DataFrame:
    out = context.search_replace(_documents(spark, d).where("text is not null"), "text", "the ", "$1 ")
    return out.select("doc_id", "n_replaced", F.md5("text").alias("digest"))


# Pages as source files

_TAGS_SQL = r"tags AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9-]*[^>]*)>', 1)) AS raw, unnest(range(len(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9-]*[^>]*)>', 1)))) AS pos FROM pages WHERE html IS NOT NULL), named AS (SELECT page_id, CAST(pos AS INTEGER) AS pos, lower(regexp_extract(raw, '^([a-zA-Z][a-zA-Z0-9-]*)', 1)) AS tag, trim(regexp_replace(raw, '^[a-zA-Z][a-zA-Z0-9-]*', ''), ' ') AS attributes FROM tags)"


def _tags(spark: SparkSession, d: str) -> DataFrame:
    return extract.html_tags(C.table(spark, d, "pages").where("html is not null"), "page_id", "html")


@query(f"""WITH {_TAGS_SQL} SELECT page_id, pos, tag, CASE WHEN tag = 'meta' THEN 'property' WHEN tag = 'link' AND contains(lower(attributes), 'stylesheet') THEN 'import' WHEN tag IN ('script', 'style') THEN 'variable'
    WHEN tag IN {extract.FORM_FIELDS} THEN 'field' WHEN tag IN {extract.MEDIA} THEN 'variable' ELSE 'class' END AS kind FROM named""")
def html_symbols(spark: SparkSession, d: str) -> DataFrame:
    return _tags(spark, d).select("page_id", "pos", "tag", "kind")


@query(f"WITH {_TAGS_SQL} SELECT page_id, pos, tag, kind, target FROM (" + " UNION ALL ".join(f"""SELECT page_id, pos, tag, '{k}' AS kind, regexp_extract(attributes, '(?:^|\\s){a}="([^"]*)"', 1) AS target FROM named""" for a, k in extract.HTML_EDGES.items()) + ") x WHERE target <> ''")
def html_links(spark: SparkSession, d: str) -> DataFrame:
    return extract.html_links(_tags(spark, d), "page_id").select("page_id", "pos", "tag", "kind", "target")


@query(f"""WITH {_TAGS_SQL}, a AS (SELECT tag, unnest(regexp_extract_all(attributes, '([a-zA-Z][a-zA-Z0-9-]*)="[^"]*"', 1)) AS name FROM named) SELECT tag, name, count(*) AS n FROM a GROUP BY tag, name""")
def html_attributes(spark: SparkSession, d: str) -> DataFrame:
    return extract.html_attributes(_tags(spark, d), "page_id").groupBy("tag", "name").agg(F.count("*").alias("n"))


# The index over time


@query(f"SELECT doc_id, path, hash, md5(concat(path, ':', doc_id, ':0:0')) AS id FROM {FILE}")
def hash_ids(spark: SparkSession, d: str) -> DataFrame:
    return C.files(spark, d).select("doc_id", "path", "hash", F.md5(F.concat("path", F.lit(":"), F.col("doc_id").cast("string"), F.lit(":0:0"))).alias("id"))


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """An older state of the index: some files aren't there, some have other contents."""
    old = F.when(F.col("size") % 5 == 0, F.md5("hash")).otherwise(F.col("hash"))
    return C.files(spark, d).where("size % 7 <> 0").select("path", "language", "size", old.alias("hash"))


_STORED_SQL = f"stored AS (SELECT path, language, size, CASE WHEN size % 5 = 0 THEN md5(hash) ELSE hash END AS hash FROM {FILE} WHERE size % 7 <> 0)"


@query(f"WITH {_STORED_SQL} SELECT f.path, CASE WHEN s.path IS NULL THEN 'new' WHEN f.hash IS DISTINCT FROM s.hash THEN 'changed' ELSE 'same' END AS status FROM {FILE} LEFT JOIN stored s ON s.path = f.path")
def delta_index(spark: SparkSession, d: str) -> DataFrame:
    return workspace.changed(C.files(spark, d), _stored(spark, d)).select("path", "status")


@query(f"WITH {_STORED_SQL} SELECT f.path, f.hash FROM {FILE} WHERE f.size % 11 <> 0")
def upsert_files(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("size") % 11 == 0, "delete").otherwise("change")
    events = C.files(spark, d).select("path", "language", "size", "hash", kind.alias("type"))
    return changes.apply_changes(_stored(spark, d), events).select("path", "hash")


@query(f"SELECT key, file_path FROM {SYM} WHERE file_path NOT IN (SELECT DISTINCT file_path FROM {SYM} WHERE kind = 'PROMO')")
def clear_files(spark: SparkSession, d: str) -> DataFrame:
    symbols = C.symbols(spark, d).select("key", "file_path", "kind")
    gone = symbols.where("kind = 'PROMO'").select(F.col("file_path").alias("path"))
    return store.replace_files(symbols, symbols.limit(0), gone, "file_path").select("key", "file_path")


@query(f"SELECT key, file_path FROM {SYM} WHERE NOT starts_with(file_path, 'src/promo/')")
def remove_workspace(spark: SparkSession, d: str) -> DataFrame:
    return store.remove_workspace(C.symbols(spark, d), "src/promo", "file_path").select("key", "file_path")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events) x WHERE next IS NULL OR next >= ts + INTERVAL 45 MINUTE")
def debounce_events(spark: SparkSession, d: str) -> DataFrame:
    return changes.debounce(C.table(spark, d, "events"), "user_id", "ts", "45 minutes", "event_id").select("event_id", "user_id", "event_type")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def inflight_dedup(spark: SparkSession, d: str) -> DataFrame:
    events = C.table(spark, d, "events").select("user_id", "ts", "event_id")
    return changes.last_of_each(events, "user_id", "ts").select("user_id", "event_id")


@query(f"SELECT kind, count(*) AS n, CAST(sum(CASE WHEN line > 3 THEN 1 ELSE 0 END) AS BIGINT) AS late, round(avg(confidence), 6) AS mean, max(confidence) AS best FROM {EDGE} GROUP BY kind")
def edge_statistics(spark: SparkSession, d: str) -> DataFrame:
    return store.edge_statistics(C.relationships(spark, d), 3).withColumn("mean", F.round("mean", 6))


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS owner FROM conversations""")
def last_preceding(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("role") == "user", F.col("turn"))
    return navigation.last_preceding(C.table(spark, d, "conversations"), "conv_id", "turn", said, "owner").select("conv_id", "turn", "owner")


@query("SELECT user_id, count(*) AS n_bursts, CAST(sum(n) AS BIGINT) AS n FROM (SELECT user_id, burst, count(*) AS n FROM (SELECT user_id, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 45 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) x) y GROUP BY user_id, burst) z GROUP BY user_id")
def session_bursts(spark: SparkSession, d: str) -> DataFrame:
    """The streaming form of debouncing, on a table: session windows."""
    events = C.table(spark, d, "events").select("user_id", "ts", "event_id")
    found = changes.debounce_stream(events, "user_id", "ts", "45 minutes", "1 hour")
    return found.groupBy("user_id").agg(F.count("*").alias("n_bursts"), F.sum("n").alias("n"))


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """Pages as HTML files; only their tags are declarations."""
    p = C.table(spark, d, "pages").where("html is not null")
    return p.select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.lit("html").alias("language"), F.col("html").alias("content"))


@query(r"""SELECT concat('pages/', page_id, '.html') AS file_path, CAST(line AS INTEGER) AS start_line, regexp_extract(raw, '<([a-zA-Z][a-zA-Z0-9-]*)', 1) AS name FROM (
    SELECT page_id, unnest(l) AS raw, generate_subscripts(l, 1) AS line FROM (SELECT page_id, regexp_split_to_array(html, '\r?\n') AS l FROM pages WHERE html IS NOT NULL) x) y WHERE regexp_extract(raw, '<([a-zA-Z][a-zA-Z0-9-]*)', 1) <> ''""")
def line_symbols(spark: SparkSession, d: str) -> DataFrame:
    return extract.symbols(_sources(spark, d)).select("file_path", "start_line", "name")


# One call each


def _bindings(spark: SparkSession, d: str) -> DataFrame:
    s = C.table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("source_key"), F.when(F.col("s_nationkey") % 3 != 0, F.col("s_suppkey") * 7).alias("target_key"))


_HITS = f"(SELECT *, {_RANK} AS match_rank FROM {SYM} WHERE name ILIKE '%small {WORD}%' OR signature ILIKE '%small {WORD}%') x"
_WORD_RANK = f"CASE WHEN name = '{WORD}' THEN 1 WHEN lower(name) LIKE '{WORD}%' THEN 2 ELSE 3 END"
_FIRST = f"hit AS (SELECT * FROM (SELECT *, {_WORD_RANK} AS match_rank FROM {SYM} WHERE name ILIKE '%{WORD}%' OR signature ILIKE '%{WORD}%') x ORDER BY match_rank, name, id LIMIT 1)"
_PATH_LAYER_SQL = _LAYER_SQL.replace("lower(url)", "lower(file_path)")


@query(f"""WITH s AS (SELECT * FROM {SYM}) SELECT 'total' AS section, 'symbols' AS name, count(*) AS n FROM part UNION ALL SELECT 'total', 'files', count(*) FROM documents UNION ALL SELECT 'total', 'relationships', count(*) FROM lineitem
    UNION ALL SELECT * FROM (SELECT 'kind', kind, count(*) AS n FROM s GROUP BY kind ORDER BY n DESC, kind LIMIT 10) a UNION ALL SELECT * FROM (SELECT 'language', language, count(*) AS n FROM s GROUP BY language ORDER BY n DESC, language LIMIT 10) b
    UNION ALL SELECT 'layer', {_PATH_LAYER_SQL}, count(*) FROM s GROUP BY 2""")
def explore_overview(spark: SparkSession, d: str) -> DataFrame:
    return facade.overview(C.symbols(spark, d), _documents(spark, d), C.relationships(spark, d))


@query(f"SELECT x.id, x.name, match_rank, (SELECT count(*) FROM lineitem WHERE l_suppkey = x.key) AS n_references FROM (SELECT * FROM {_HITS} ORDER BY match_rank, name, id LIMIT 10) x")
def explore_find(spark: SparkSession, d: str) -> DataFrame:
    return facade.find(C.symbols(spark, d), C.relationships(spark, d), f"small {WORD}").select("id", "name", "match_rank", "n_references")


@query(f"""WITH {_FIRST}, e AS (SELECT * FROM {EDGE} WHERE kind = 'calls') SELECT 'in' AS direction, * FROM (SELECT id, name FROM {SYM} WHERE key IN (SELECT from_key FROM e WHERE to_key = (SELECT key FROM hit)) ORDER BY name, id LIMIT 8) a
    UNION ALL SELECT 'out', * FROM (SELECT id, name FROM {SYM} WHERE key IN (SELECT to_key FROM e WHERE from_key = (SELECT key FROM hit)) ORDER BY name, id LIMIT 8) b""")
def explore_trace(spark: SparkSession, d: str) -> DataFrame:
    return facade.trace(C.symbols(spark, d), C.relationships(spark, d), WORD)


@query(f"WITH {_FIRST} SELECT id, name, signature, CASE WHEN key % 2 = 0 THEN kind END AS resolved_type, {_PATH_LAYER_SQL} AS layer FROM hit")
def explore_understand(spark: SparkSession, d: str) -> DataFrame:
    symbols = C.symbols(spark, d)
    types = symbols.where("key % 2 = 0").select(F.col("id").alias("symbol_id"), F.col("kind").alias("resolved_type"))
    return facade.understand(symbols, types, WORD).select("id", "name", "signature", "resolved_type", "layer")


_LINKS_SQL = "SELECT s_suppkey AS source_key, CASE WHEN s_nationkey % 3 <> 0 THEN s_suppkey * 7 END AS target_key FROM supplier"


@query(f"""WITH {_FIRST} SELECT 'reference' AS relation, * FROM (SELECT key, name, file_path FROM {SYM} WHERE key IN (SELECT from_key FROM {EDGE} WHERE to_key = (SELECT key FROM hit)) ORDER BY name, id LIMIT 12) a
    UNION ALL SELECT 'binding', * FROM (SELECT key, name, file_path FROM {SYM} WHERE key IN (SELECT target_key FROM ({_LINKS_SQL}) l WHERE source_key = (SELECT key FROM hit)) ORDER BY name, id LIMIT 5) b""")
def explore_related(spark: SparkSession, d: str) -> DataFrame:
    return facade.related(C.symbols(spark, d), C.relationships(spark, d), _bindings(spark, d), WORD)


@query(f"WITH {_FIRST} SELECT key, id, name, kind, file_path, start_line, end_line FROM hit")
def navigate_definition(spark: SparkSession, d: str) -> DataFrame:
    return facade.definition(C.symbols(spark, d), WORD)


@query(f"SELECT id, name FROM (SELECT *, {_RANK} AS match_rank FROM {SYM} WHERE (name ILIKE '%small {WORD}%' OR signature ILIKE '%small {WORD}%') AND language = 'Brand#2' AND starts_with(file_path, 'src/')) x ORDER BY match_rank, name, id LIMIT 50")
def search_code_filtered(spark: SparkSession, d: str) -> DataFrame:
    return facade.search_code(C.symbols(spark, d), f"small {WORD}", language="Brand#2", path="src/").select("id", "name")


@query(f"""WITH x AS (SELECT * FROM {_HITS} ORDER BY match_rank, name, id LIMIT 15) SELECT count(*) AS n, array_to_string(list_sort(list(DISTINCT {_PATH_LAYER_SQL})), ',') AS layers,
    (SELECT count(*) FROM lineitem WHERE l_partkey IN (SELECT key FROM x) AND l_suppkey IN (SELECT key FROM x)) AS n_relationships FROM x""")
def explore_code(spark: SparkSession, d: str) -> DataFrame:
    found = facade.explore_code(C.symbols(spark, d), C.relationships(spark, d), f"small {WORD}")
    return found.select("n", F.array_join("layers", ",").alias("layers"), "n_relationships")


@query(f"SELECT id, kind, concat_ws(' ', name, signature) AS content FROM {SYM} WHERE starts_with(file_path, 'src/') AND (signature IS NOT NULL OR kind IN {facade.EMBEDDED_KINDS})")
def embeddable_symbols(spark: SparkSession, d: str) -> DataFrame:
    return facade.embeddable(C.symbols(spark, d), "src/").select("id", "kind", "content")


_SYMBOL_TERMS_SQL = _TERMS_SQL.replace("SELECT doc_id, regexp_replace(", "SELECT id AS doc_id, regexp_replace(", 1).replace("(text, '(?s)", "(concat_ws(' ', name, signature), '(?s)", 1).replace("FROM documents WHERE text IS NOT NULL", f"FROM {SYM}", 1).replace("FROM documents", "FROM part")


@query(f"WITH {_SYMBOL_TERMS_SQL} SELECT doc_id AS id, term, round(tf * idf, 6) AS w FROM doc_terms JOIN vocab USING (term)")
def semantic_index(spark: SparkSession, d: str) -> DataFrame:
    _, vectors = facade.semantic_index(C.symbols(spark, d))
    return vectors.select("id", "term", F.round("w", 6).alias("w"))


@query(f"SELECT v.vec_id, s.name, s.kind, s.file_path FROM embeddings v LEFT JOIN {SYM} ON s.key = v.vec_id")
def vector_metadata(spark: SparkSession, d: str) -> DataFrame:
    symbols = C.symbols(spark, d).withColumn("id", F.col("key"))
    return facade.with_metadata_of(C.table(spark, d, "embeddings").select(F.col("vec_id").alias("id")), symbols).withColumnRenamed("id", "vec_id")


@query(f"SELECT s.language, count(*) AS total, count(v.vec_id) AS embedded, CAST(floor(count(v.vec_id) * 100 / count(*) + 0.5) AS INTEGER) AS percent FROM {SYM} LEFT JOIN (SELECT vec_id FROM embeddings WHERE vec_id % 3 = 0) v ON v.vec_id = s.key GROUP BY s.language")
def embedding_progress(spark: SparkSession, d: str) -> DataFrame:
    vectors = C.table(spark, d, "embeddings").where("vec_id % 3 = 0").select(F.col("vec_id").alias("id"))
    return facade.embedding_progress(C.symbols(spark, d).withColumn("id", F.col("key")), vectors)


@query("SELECT label AS model, count(*) AS n FROM embeddings GROUP BY label")
def vector_models(spark: SparkSession, d: str) -> DataFrame:
    return facade.models(C.table(spark, d, "embeddings").withColumnRenamed("label", "model"))


@query(f"SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT key FROM {SYM} WHERE starts_with(file_path, 'src/promo/'))")
def clear_vectors(spark: SparkSession, d: str) -> DataFrame:
    vectors = C.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    return facade.clear_vectors(vectors, C.symbols(spark, d).withColumn("id", F.col("key")), "src/promo").withColumnRenamed("id", "vec_id")


@query(f"""WITH a AS (SELECT id FROM {SYM} WHERE name ILIKE '%{WORD}%' ORDER BY name, id LIMIT 50),
    b AS (SELECT s.id, x.score FROM (SELECT e.vec_id, {_COSINE} AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY score DESC, e.vec_id LIMIT 20) x JOIN {SYM} ON s.key = x.vec_id WHERE x.score >= 0.2)
    SELECT s.id, round(0.3 * CASE WHEN lower(name) = '{WORD}' THEN 1.0 WHEN contains(lower(name), '{WORD}') OR contains('{WORD}', lower(name)) THEN 0.8 ELSE 1 - levenshtein(lower(name), '{WORD}')::DOUBLE / greatest(length(name), {len(WORD)}) END
    + 0.3 * CASE WHEN a.id IS NOT NULL THEN 0.7 ELSE 0.2 END + 0.4 * coalesce(b.score, 0), 6)::DOUBLE AS score FROM {SYM} LEFT JOIN a ON a.id = s.id LEFT JOIN b ON b.id = s.id WHERE a.id IS NOT NULL OR b.id IS NOT NULL""")
def hybrid_plain(spark: SparkSession, d: str) -> DataFrame:
    symbols = C.symbols(spark, d)
    near = vector_search.nearest(C.table(spark, d, "embeddings"), "vec_id", "embedding", _query_vector(spark, d), 20)
    semantic = near.join(symbols.select(F.col("key").alias("vec_id"), "id"), "vec_id").select("id", "score")
    return hybrid.merge_plain(search.by_name(symbols, WORD), semantic, symbols, WORD, limit=1000).select("id", F.round("score", 6).alias("score"))


@query(f"SELECT r.from_key, r.kind, r.line, s.name, s.file_path FROM {EDGE} JOIN {SYM} ON s.key = r.from_key WHERE r.to_key = 2")
def references_ordered(spark: SparkSession, d: str) -> DataFrame:
    return navigation.all_references(C.relationships(spark, d), C.symbols(spark, d), 2).select("from_key", "kind", "line", "name", "file_path")


@query(f"SELECT object_key, member, min(t.key) AS target FROM (SELECT DISTINCT l_suppkey AS object_key, split_part(p_name, ' ', 1) AS member FROM lineitem JOIN part ON p_partkey = l_partkey) u LEFT JOIN (SELECT key, key // 20 AS parent_key, split_part(name, ' ', 1) AS name FROM {SYM}) t ON t.parent_key = object_key AND t.name = member GROUP BY object_key, member")
def member_access(spark: SparkSession, d: str) -> DataFrame:
    first = lambda c: F.split_part(F.col(c), F.lit(" "), F.lit(1))
    uses = C.table(spark, d, "lineitem").join(C.table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_suppkey").alias("object_key"), first("p_name").alias("member")).distinct()
    symbols = C.symbols(spark, d).select("key", F.floor(F.col("key") / 20).alias("parent_key"), first("name").alias("name"))
    return navigation.member_access(uses, symbols)


@query("SELECT doc_id, md5(array_to_string(list_slice(l, greatest(1, a - 3), least(len(l), a + 4)), chr(10))) AS digest FROM (SELECT doc_id, string_split(text, chr(10)) AS l, CAST(1 + doc_id % 5 AS INTEGER) AS a FROM documents WHERE text IS NOT NULL) x")
def symbol_context(spark: SparkSession, d: str) -> DataFrame:
    start = (1 + F.col("doc_id") % 5).cast("int")
    rows = _documents(spark, d).where("text is not null")
    return rows.select("doc_id", F.md5(context.symbol_context(F.col("text"), start, start + 2)).alias("digest"))


@query("SELECT user_id AS path, max(ts) AS last_indexed, count(*) AS n FROM events GROUP BY user_id ORDER BY last_indexed DESC, path LIMIT 50")
def workspace_list(spark: SparkSession, d: str) -> DataFrame:
    new = C.table(spark, d, "events").groupBy(F.col("user_id").alias("path")).agg(F.max("ts").alias("last_indexed"), F.count("*").alias("n"))
    old = new.withColumn("last_indexed", F.col("last_indexed") - F.expr("interval 1 day")).withColumn("n", F.lit(-1).cast("long"))
    return store.list_workspaces(store.record_workspaces(old, new))


@query(f"SELECT key, kind, start_line, concat('{{\"kind\":\"', kind, '\",\"start_line\":', start_line, '}}') AS metadata FROM {SYM}")
def json_metadata(spark: SparkSession, d: str) -> DataFrame:
    rows = store.with_metadata(C.symbols(spark, d).select("key", "kind", "start_line"), "kind", "start_line")
    again = store.metadata_of(rows.select("key", "metadata"), "kind string, start_line int")
    return again.join(rows.select("key", "metadata"), "key")


@query(r"SELECT doc_id, CAST(length(regexp_extract(text, '^([ \t]*)', 1)) AS INTEGER) AS indent, md5(regexp_replace(substring(text, 1, 80), '([.*+?^${}()|\[\]\\])', '\\\1', 'g')) AS escaped FROM documents WHERE text IS NOT NULL")
def text_helpers(spark: SparkSession, d: str) -> DataFrame:
    rows = _documents(spark, d).where("text is not null")
    return rows.select("doc_id", F.length(T.indentation(F.col("text"))).alias("indent"), F.md5(T.escaped_pattern(F.substring("text", 1, 80))).alias("escaped"))


@query("SELECT doc_id, md5(CASE WHEN text = replace(text, 'the ', 'a ') THEN '' ELSE concat('--- Original', chr(10), text, chr(10), '+++ Modified', chr(10), replace(text, 'the ', 'a ')) END) AS digest FROM documents WHERE text IS NOT NULL")
def diff_preview(spark: SparkSession, d: str) -> DataFrame:
    rows = _documents(spark, d).where("text is not null")
    return rows.select("doc_id", F.md5(context.diff_preview(F.col("text"), F.replace("text", F.lit("the "), F.lit("a ")))).alias("digest"))


@query(f"SELECT path, CASE WHEN starts_with(path, '/') THEN path ELSE concat('/work/', path) END AS resolved, sha256(concat_ws(chr(10), 'model', content)) AS cache_key FROM {FILE}")
def resolved_paths(spark: SparkSession, d: str) -> DataFrame:
    return C.files(spark, d).select("path", T.absolute_path(F.col("path"), "/work").alias("resolved"), T.cache_key(F.lit("model"), F.col("content")).alias("cache_key"))


@query(f"WITH {_STORED_SQL} SELECT f.path, md5(f.hash) AS hash FROM {FILE} WHERE f.size % 11 <> 0 UNION SELECT s.path, s.hash FROM stored s WHERE false")
def upsert_repeated_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every path changes twice, and some are deleted between or after: the last event counts."""
    f = C.files(spark, d)
    event = lambda seq, kind, value: f.select("path", "language", "size", value.alias("hash"), F.lit(seq).alias("seq"), kind.alias("type"))
    gone = F.when(F.col("size") % 11 == 0, "delete").otherwise("change")
    events = event(1, F.lit("change"), F.col("hash")).unionByName(event(2, F.lit("delete"), F.lit(""))).unionByName(event(3, gone, F.md5("hash")))
    return changes.apply_changes(_stored(spark, d), events, order="seq").select("path", "hash")


@query("SELECT event_id FROM (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS next FROM (SELECT event_id, user_id, time_bucket(INTERVAL 45 MINUTE, ts) AS t FROM events) y) x WHERE next IS NULL OR next >= t + INTERVAL 45 MINUTE")
def debounce_boundary(spark: SparkSession, d: str) -> DataFrame:
    """Times are rounded down to the gap, so that many events are exactly a gap apart."""
    events = C.table(spark, d, "events").select("event_id", "user_id", F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / 2700) * 2700).alias("t"))
    return changes.debounce(events, "user_id", "t", "45 minutes", "event_id").select("event_id")


@query(r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(CASE WHEN doc_id % 3 = 0 THEN 'new words words' ELSE coalesce(text, '') END), '[\s\W]+'), lambda x: length(x) > 1) AS t FROM documents WHERE doc_id % 5 <> 0),
    p AS (SELECT doc_id, unnest(t) AS term FROM t) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM p GROUP BY term""")
def index_update(spark: SparkSession, d: str) -> DataFrame:
    """A stored index after some documents changed and some were removed."""
    docs, path = _documents(spark, d), folder(spark)
    search.write_index(docs, "doc_id", ["text"], path)
    changed = docs.where("doc_id % 3 = 0 and doc_id % 5 <> 0").withColumn("text", F.lit("new words words"))
    index = spark.read.parquet(f"{path}/postings").drop("bucket")
    index = search.updated_index(index, changed, "doc_id", ["text"], docs.where("doc_id % 5 = 0"))
    return search.spread(index, "doc_id").select("term", "df", F.col("tf").cast("long").alias("tf"))


@query(rf"WITH {_POSTINGS} SELECT count(DISTINCT doc_id) AS documents, count(DISTINCT term) AS terms, count(*) AS postings FROM i")
def index_statistics(spark: SparkSession, d: str) -> DataFrame:
    return search.index_statistics(search.postings(_documents(spark, d), "doc_id", ["text"]), "doc_id")


@query("SELECT count(*) FILTER (l_returnflag <> 'R') AS succeeded, count(*) FILTER (l_returnflag = 'R') AS failed, CAST(floor(count(*) FILTER (l_returnflag <> 'R') * 100 / count(*) + 0.5) AS INTEGER) AS percent FROM lineitem")
def batch_outcome(spark: SparkSession, d: str) -> DataFrame:
    return store.batch_outcome(C.table(spark, d, "lineitem").select((F.col("l_returnflag") != "R").alias("ok")))
