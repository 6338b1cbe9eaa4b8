"""Source files that are written from orders and their items, to read structure from, and what they hold as SQL.

Each customer with items is a file: Java, Python or Ruby by its key. Its orders are classes in the order of their keys,
their items methods. Comments and strings hold what looks like declarations, heads of methods take two lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.plans.canonical import table

LANGUAGES = ("java", "python", "ruby")
#: First line of a file, lines of a class before its methods, of a method, and after them.
_FIRST = {"java": "package c{c};", "python": "import base{c}", "ruby": 'require "base{c}"'}
_CLASS = {
    "java": "public class Order{o} extends Base{b} {\n    private double total = 1;",
    "python": "class Order{o}(Base{b}):\n    total = 1",
    "ruby": "class Order{o} < Base{b}\n  TOTAL = 1",
}
_METHOD = {
    "java": '    /* item {l}: class Hidden{l} { */\n    public double line{l}(int quantity,\n            String note) {\n        String s = "class Fake{l} { ";\n        if (quantity > {q}) {\n            return part{s}(note);\n        }\n        return 0;\n    }',
    "python": '    def line{l}(self, quantity,\n            note):\n        """item {l}: class Hidden{l}:"""\n        s = "class Fake{l}:"\n        if quantity > {q}:\n            return part{s}(note)\n        return 0\n    # end',
    "ruby": '  # item {l}: class Hidden{l}\n  def line{l}(quantity,\n              note)\n    s = "class Fake{l}"\n    return part{s}(note) if quantity > {q}\n    [1].each do |x|\n      x\n    end\n  end',
}
_LAST = {"java": "}", "python": "# end", "ruby": "end"}


def _filled(templates: dict[str, str], **values: Column) -> Column:
    """The language's template with its {names} replaced by columns."""
    out = F.element_at(F.create_map(*[F.lit(x) for pair in templates.items() for x in pair]), F.col("language"))
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


def source_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, language, o_custkey, classes): what ``source_text`` writes each file from."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_suppkey", F.col("l_quantity").cast("int").alias("q")).alias("i"))
    language = F.element_at(F.array(*map(F.lit, LANGUAGES)), (F.col("o_custkey") % 3 + 1).cast("int"))
    rows = orders.join(items, orders["o_orderkey"] == items["l_orderkey"]).groupBy("o_custkey", "o_orderkey").agg(F.sort_array(F.collect_list("i")).alias("items")).withColumn("language", language)
    # items are shuffled to their file, not the text that is written from them; that is some twenty times as large, so partitions aren't put together
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_custkey")
    files = rows.groupBy("o_custkey", "language").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "items"))).alias("classes"))
    return files.select(F.concat(F.lit("src/c"), "o_custkey", F.lit("."), "language").alias("path"), "language", "o_custkey", "classes")


def source_text() -> Column:
    """The text of a file of ``source_parts``."""
    methods = lambda c: F.array_join(F.transform(c["items"], lambda i: _filled(_METHOD, l=i["l_linenumber"], q=i["q"], s=i["l_suppkey"])), "\n")
    one = lambda c: F.concat_ws("\n", _filled(_CLASS, o=c["o_orderkey"], b=c["o_orderkey"] % 5), methods(c), _filled(_LAST))
    return F.concat_ws("\n", _filled(_FIRST, c=F.col("o_custkey")), F.array_join(F.transform("classes", one), "\n"))


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, language, content)."""
    return source_parts(spark, sf_dir).select("path", "language", source_text().alias("content"))


def _case(values: dict[str, object]) -> str:
    return "CASE language " + " ".join(f"WHEN '{n}' THEN {v!r}" for n, v in values.items()) + " END"


_HEIGHT, _OPENING = _case({n: m.count("\n") + 1 for n, m in _METHOD.items()}), 2
#: Common table expressions: code_items, one row for each method with the lines of its class and itself, and code_symbols.
SOURCES_SQL = f"""code_orders AS (
        SELECT o_custkey AS c, o_orderkey AS o, {{'java': 'x'}}.java AS x, ['java', 'python', 'ruby'][CAST(o_custkey % 3 + 1 AS INTEGER)] AS language, count(*) AS n
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, o_orderkey
    ), code_classes AS (
        SELECT *, concat('src/c', c, '.', language) AS file_path, {_OPENING} + n * {_HEIGHT} + 1 AS height,
               2 + coalesce(sum({_OPENING} + n * {_HEIGHT} + 1) OVER (PARTITION BY c ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM code_orders
    ), code_items AS (
        SELECT k.*, l_linenumber AS l, l_suppkey AS s, row_number() OVER (PARTITION BY o ORDER BY l_linenumber, l_suppkey, CAST(trunc(l_quantity) AS INTEGER)) AS r
        FROM code_classes k JOIN lineitem ON l_orderkey = o
    ), code_methods AS (
        SELECT *, CAST(line + {_OPENING} + (r - 1) * {_HEIGHT} + {_case({"java": 1, "python": 0, "ruby": 1})} AS INTEGER) AS start_line FROM code_items
    ), code_symbols AS (
        SELECT file_path, language, concat('line', l) AS name, 'method' AS kind, start_line, {_case({"java": 4, "python": 4, "ruby": 2})} AS start_column,
               start_line + {_case({"java": 7, "python": 6, "ruby": 7})} AS end_line, concat('Order', o) AS parent, 'public' AS visibility,
               CASE language WHEN 'java' THEN concat('/* item ', l, ': class Hidden', l, ' {{ */') WHEN 'python' THEN concat('item ', l, ': class Hidden', l, ':') ELSE concat('# item ', l, ': class Hidden', l) END AS doc_comment
        FROM code_methods
        UNION ALL
        SELECT file_path, language, concat('Order', o), 'class', CAST(line AS INTEGER), 0, CAST(line + height - 1 - {_case({"java": 0, "python": 2, "ruby": 0})} AS INTEGER), NULL, 'public', NULL FROM code_classes
        UNION ALL
        SELECT file_path, language, CASE language WHEN 'java' THEN 'total' ELSE 'TOTAL' END, CASE language WHEN 'java' THEN 'property' ELSE 'constant' END, CAST(line + 1 AS INTEGER),
               {_case({"java": 4, "ruby": 2})}, CAST(line + 1 AS INTEGER), concat('Order', o), CASE language WHEN 'java' THEN 'private' ELSE 'public' END, NULL FROM code_classes WHERE language <> 'python'
        UNION ALL
        SELECT DISTINCT file_path, language, CASE language WHEN 'java' THEN concat('c', c) ELSE concat('base', c) END, CASE language WHEN 'java' THEN 'namespace' ELSE 'import' END, 1, 0, 1, NULL, 'public', NULL FROM code_classes
    )""".replace("{'java': 'x'}.java AS x, ", "")


def linked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, language, content) of TypeScript files that import each other.

    Each supplier is a file with a function and a class; each nation a folder whose index exports its suppliers' files
    again; lib/index.ts exports all nations. Each customer's file imports what its items' suppliers give from the file,
    the nation or lib, calls their functions from one function for each order, and extends a class.
    """
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s"), F.col("s_nationkey").alias("n"))
    text = lambda template, **values: _filled({"typescript": template}, **values)
    typed = suppliers.withColumn("language", F.lit("typescript"))
    one = text("export function part{s}(a: number) {\n  return a;\n}\nexport class Base{s} {\n}", s=F.col("s"))
    files = typed.select(F.concat(F.lit("lib/s"), "s", F.lit(".ts")).alias("path"), "language", one.alias("content"))
    again = lambda rows, key, path, line: rows.groupBy(*key, "language").agg(F.array_join(F.sort_array(F.collect_set(line)), "\n").alias("content")).select(path.alias("path"), "language", "content")
    nations = again(typed, ["n"], F.concat(F.lit("lib/group"), "n", F.lit("/index.ts")), text("export * from '../s{s}';", s=F.col("s")))
    whole = again(typed, [], F.lit("lib/index.ts"), text("export * from './group{n}';", n=F.col("n")))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("s"), "l_linenumber").join(suppliers, "s")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c")).where("c is not null")
    # keys of items are shuffled to their file, once for its head and its functions, and not the text that is written from them
    used = items.join(orders, "l_orderkey").groupBy("c", "l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "s", "n")).alias("items"))
    used = used.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c").groupBy("c").agg(F.collect_list(F.struct("l_orderkey", "items")).alias("orders")).withColumn("language", F.lit("typescript"))
    where = lambda s, n: F.when(s % 3 == 0, text("s{s}", s=s)).when(s % 3 == 1, text("group{n}", n=n)).otherwise("index")
    line = lambda s, n: F.replace(text("import { part{s} as p{s},\n  Base{s} } from '../lib/{w}';", s=s), F.lit("{w}"), where(s, n))
    every = F.flatten(F.transform("orders", lambda o: o["items"]))
    head = F.array_join(F.sort_array(F.array_distinct(F.transform(every, lambda i: line(i["s"], i["n"])))), "\n")
    calls = lambda o: F.array_join(F.transform(F.sort_array(F.transform(o["items"], lambda i: F.struct(i["l_linenumber"], text("  p{s}(1);", s=i["s"]).alias("t")))), lambda x: x["t"]), "\n")
    body = F.array_join(F.sort_array(F.transform("orders", lambda o: F.concat_ws("\n", text("export function order{o}() {", o=o["l_orderkey"]), calls(o), F.lit("}")))), "\n")
    last = text("export class C{c} extends Base{s} {\n}", c=F.col("c"), s=F.array_min(F.transform(every, lambda i: i["s"])))
    apps = used.select(F.concat(F.lit("app/c"), "c", F.lit(".ts")).alias("path"), "language", F.concat_ws("\n", head, body, last).alias("content"))
    return files.unionByName(nations).unionByName(whole).unionByName(apps)


#: The relations of linked_files: (from_name, to_name, kind, confidence, n), n the number of lines.
LINKS_SQL = """code_used AS (SELECT o_custkey AS c, o_orderkey AS o, s_suppkey AS s, s_nationkey AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey),
    code_links AS (
        SELECT concat('order', o) AS from_name, concat('part', s) AS to_name, 'calls' AS kind, 0.9::DOUBLE AS confidence, count(*) AS n FROM code_used GROUP BY o, s
        UNION ALL SELECT concat('C', c), concat('Base', min(s)), 'extends', 0.95::DOUBLE, 1 FROM code_used GROUP BY c
        UNION ALL SELECT DISTINCT concat('app/c', c, '.ts'), concat('lib/', CASE s % 3 WHEN 0 THEN concat('s', s, '.ts') WHEN 1 THEN concat('group', n, '/index.ts') ELSE 'index.ts' END), 'imports', 1.0::DOUBLE,
            count(DISTINCT s) OVER (PARTITION BY c, CASE s % 3 WHEN 0 THEN concat('s', s) WHEN 1 THEN concat('group', n) END) FROM (SELECT DISTINCT c, s, n FROM code_used)
        UNION ALL SELECT concat('lib/group', s_nationkey, '/index.ts'), concat('lib/s', s_suppkey, '.ts'), 'imports', 1.0::DOUBLE, 1 FROM supplier
        UNION ALL SELECT DISTINCT 'lib/index.ts', concat('lib/group', s_nationkey, '/index.ts'), 'imports', 1.0::DOUBLE, 1 FROM supplier
    )"""
