"""The driver's tables seen as catalogs, locks, strings and graphs; each adapter as a DataFrame and as SQL text for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import scanning

LANGUAGES = ["en", "de", "fr", "es"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source(spark: SparkSession, sf: str) -> DataFrame:
    """A1: all documents as the source catalog, the language as locale."""
    return table(spark, sf, "documents").select(F.col("lang").alias("locale"), F.concat("source", F.lit(".d"), "doc_id").alias("key"), F.col("text").alias("value"), F.col("doc_id").alias("seq"))


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")


def target(spark: SparkSession, sf: str) -> DataFrame:
    """A2: labelled documents are translated already; benchmark items have left the source."""
    done = _labelled(spark, sf).select(F.col("lang").alias("locale"), F.concat("source", F.lit(".d"), "doc_id").alias("key"), F.upper("source").alias("value"), F.col("doc_id").alias("seq"))
    gone = table(spark, sf, "benchmark").select(F.lit("en").alias("locale"), F.concat(F.lit("bench.b"), "item_id").alias("key"), F.col("text").alias("value"), F.col("item_id").alias("seq"))
    return done.unionByName(gone)


def lock(spark: SparkSession, sf: str) -> DataFrame:
    """A3: good documents are locked, toxic ones with a stale hash."""
    rows = _labelled(spark, sf).where("quality = 1 OR toxic = 1")
    return rows.select(F.col("lang").alias("locale"), F.concat("source", F.lit(".d"), "doc_id").alias("key"), F.when(F.col("toxic") == 1, "stale").otherwise(T.source_hash("text")).alias("hash"))


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """A4: pages, and the same with bold marks lost and breaks turned to italics."""
    broken = F.replace(F.replace("html", F.lit("<b>"), F.lit("")), F.lit("<br>"), F.lit("<i>"))
    return table(spark, sf, "pages").select("page_id", F.col("html").alias("source"), broken.alias("translated"))


def strings(spark: SparkSession, sf: str) -> DataFrame:
    """A5: text nodes of pages as extracted strings: links as t calls with an id, headings as T components with one, the rest bare; the tag as component."""
    nodes = scanning.text_nodes(table(spark, sf, "pages"))
    kind = F.when(F.col("tag") == "a", "t-call").when(F.col("tag").isin("h1", "h2"), "T-component").otherwise("jsx-text")
    return nodes.select(
        F.concat(F.lit("src/app/p"), "page_id", F.lit("/page.tsx")).alias("file"), (F.col("page_id") * 100000 + F.col("pos")).alias("seq"), "text", "tag", kind.alias("type"),
        F.when(kind != "jsx-text", F.concat("tag", F.lit(".k"), F.length("text"))).alias("id"), F.when(~F.startswith("tag", F.lit("/")), F.col("tag")).alias("component"),
    )


def text_map(spark: SparkSession, sf: str, found: DataFrame | None = None) -> DataFrame:
    """A map text -> key of the texts of bare strings' paragraphs, first occurrence first. found: strings(), if they are at hand."""
    s = (strings(spark, sf) if found is None else found).where("tag = 'p'")
    return s.groupBy("text").agg(F.min("seq").alias("seq")).select("text", F.concat(F.lit("p.m"), F.length("text")).alias("key"), "seq")


def sources(spark: SparkSession, sf: str) -> DataFrame:
    """A16: pages as source files that import each other: page n loads pages 2n and 3n, and takes types of page n + 1; every tenth runs in the browser."""
    n = F.col("page_id")
    page = lambda x: F.concat(F.lit("p"), x.cast("string"), F.lit("/page"))
    head = F.when(n % 10 == 1, F.lit('"use client";\n')).otherwise("")
    code = F.concat(head, F.lit('import a, { type B } from "../'), page(2 * n), F.lit('";\nimport type { C } from "@/app/'), page(n + 1), F.lit('";\nimport z from "zod";\nexport const D = () => import("#app/'), page(3 * n), F.lit('.js");\n'))
    return table(spark, sf, "pages").select(F.concat(F.lit("src/app/"), page(n), F.lit(".tsx")).alias("path"), code.alias("content"))


#: Aliases of the project that sources() makes.
ALIASES = [("#app/", False, ["src/none/", "src/app/"])]


def content_files(spark: SparkSession, sf: str) -> DataFrame:
    """A17: pages as two files each, a module with a constant that holds a text, and its importer: in a component, at the top level, as a whole, or in a component of a file that may not be rewritten, by page_id mod 4."""
    n = F.col("page_id").cast("string")
    shown = F.lit("export function Page() {\n  return <ul>{items.map(i => <li key={i.title}>{i.title}</li>)}</ul>;\n}\n")
    rest = F.when(F.col("page_id") % 2 == 1, F.when(F.col("page_id") % 4 == 1, "export const first = items[0];\n").otherwise(shown)).when(F.col("page_id") % 4 == 2, "export const all = items;\n").otherwise(shown)
    clause = F.when(F.col("page_id") % 4 == 2, "* as items").otherwise("{ ITEMS as items }")
    lib = F.struct(F.concat(F.lit("src/lib/p"), n, F.lit(".ts")).alias("path"), F.concat(F.lit('export const ITEMS = [{ title: "Title of page '), n, F.lit('" }];\n')).alias("content"), F.lit(True).alias("included"))
    app = F.struct(F.concat(F.lit("src/app/p"), n, F.lit(".tsx")).alias("path"), F.concat(F.lit("import "), clause, F.lit(' from "../lib/p'), n, F.lit('";\n'), rest).alias("content"), (F.col("page_id") % 4 != 3).alias("included"))
    return table(spark, sf, "pages").select(F.explode(F.array(lib, app)).alias("f")).select("f.*")


def content_map(spark: SparkSession, sf: str) -> DataFrame:
    """A17: keys of the texts in content_files' modules, but every fifth."""
    n = F.col("page_id").cast("string")
    return table(spark, sf, "pages").where("page_id % 5 <> 0").select(F.concat(F.lit("Title of page "), n).alias("text"), F.concat(F.lit("lib.p"), n).alias("key"))


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """A6: conversations as files, roles as components, turns as order."""
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("file"), F.col("role").alias("component"), F.col("turn").alias("seq"), "text")


def proposals(spark: SparkSession, sf: str) -> DataFrame:
    """A7: keys proposed for parts; many collide."""
    return table(spark, sf, "part").select(F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit("."), F.replace("p_name", F.lit(" "), F.lit(""))).alias("key"), F.col("p_partkey").alias("seq"))


def layered_keys(spark: SparkSession, sf: str) -> DataFrame:
    """A7b: keys at three depths below each document source, by language; leaves that are branches too."""
    key = F.when(F.col("lang") == "de", F.col("source")).when(F.col("lang") == "fr", F.concat("source", F.lit(".a"))).otherwise(F.concat("source", F.lit(".a.x"), "doc_id"))
    return table(spark, sf, "documents").select(key.alias("key"), F.col("doc_id").alias("seq"))


def imports(spark: SparkSession, sf: str) -> DataFrame:
    """A8: a cyclic graph over the star schema: region, nation, customer, order, part, supplier and back to nation."""
    node = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    edge = lambda name, a, x, b, y: table(spark, sf, name).select(node(a, x).alias("src"), node(b, y).alias("dst"))
    e = edge("nation", "r", "n_regionkey", "n", "n_nationkey").union(edge("customer", "n", "c_nationkey", "c", "c_custkey"))
    e = e.union(edge("orders", "c", "o_custkey", "o", "o_orderkey")).union(edge("lineitem", "o", "l_orderkey", "p", "l_partkey"))
    return e.union(edge("lineitem", "p", "l_partkey", "s", "l_suppkey")).union(edge("supplier", "s", "s_suppkey", "n", "s_nationkey"))


def paths(spark: SparkSession, sf: str) -> DataFrame:
    """A14: documents as source files of five forms."""
    n = F.col("doc_id") % 5
    path = (
        F.when(n == 0, F.concat(F.lit("src/app/"), "lang", F.lit("/"), "source", F.lit("/page.tsx"))).when(n == 1, F.concat(F.lit("pages/"), "lang", F.lit("/index.tsx")))
        .when(n == 2, F.concat(F.lit("src/components/"), "source", F.lit("/Card.tsx"))).when(n == 3, F.concat(F.lit("pages/"), "source", F.lit(".js"))).otherwise(F.concat(F.lit("lib/"), "source", F.lit(".ts")))
    )
    return table(spark, sf, "documents").select("doc_id", path.alias("path"))


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """A15: texts of every class that the filter knows."""
    t = lambda name, c: table(spark, sf, name).select(F.expr(c).cast("string").alias("text"))
    parts = [t("nation", "n_name"), t("region", "r_name"), t("pages", "url"), t("part", "p_size"), t("part", "p_brand"), t("part", "replace(p_name, ' ', '-')"), t("part", "replace(p_name, ' ', '-') || '-x'"), t("orders", "o_orderpriority"), t("documents", "'!!! ' || doc_id"), t("documents", "lang"), t("documents", "' ' || lang || ' '")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


SQL = {
    "src": "SELECT lang AS locale, source || '.d' || doc_id AS key, text AS value, doc_id AS seq FROM documents",
    "tgt": "SELECT lang AS locale, source || '.d' || doc_id AS key, upper(source) AS value, doc_id AS seq FROM documents JOIN labels USING (doc_id) UNION ALL SELECT 'en', 'bench.b' || item_id, text, item_id FROM benchmark",
    "lck": "SELECT lang AS locale, source || '.d' || doc_id AS key, CASE WHEN toxic = 1 THEN 'stale' ELSE substr(sha256(text), 1, 16) END AS hash FROM documents JOIN labels USING (doc_id) WHERE quality = 1 OR toxic = 1",
    "dif": """SELECT coalesce(s.locale, t.locale) AS locale, coalesce(s.key, t.key) AS key,
      CASE WHEN t.key IS NULL THEN 'added' WHEN s.key IS NULL THEN 'removed' WHEN l.hash = substr(sha256(s.value), 1, 16) THEN 'unchanged' ELSE 'modified' END AS status,
      CASE WHEN t.key IS NULL THEN s.value WHEN s.key IS NULL THEN NULL WHEN l.hash = substr(sha256(s.value), 1, 16) THEN t.value ELSE s.value END AS value, s.seq AS seq
      FROM src s FULL JOIN tgt t ON s.locale = t.locale AND s.key = t.key LEFT JOIN lck l ON l.locale = coalesce(s.locale, t.locale) AND l.key = coalesce(s.key, t.key)""",
    "prs": "SELECT page_id, html AS source, replace(replace(html, '<b>', ''), '<br>', '<i>') AS translated FROM pages",
    "raw": r"""SELECT page_id, unnest(range(1, len(a) + 1)) AS pos, lower(unnest(a)) AS tag, unnest(b) AS text0 FROM (
      SELECT page_id, regexp_extract_all(html, '<(/?[\w-]+)[^<>]*>([^<>]*)', 1) AS a, regexp_extract_all(html, '<(/?[\w-]+)[^<>]*>([^<>]*)', 2) AS b FROM pages)""",
    "nod": r"""SELECT page_id, pos, tag, text FROM (SELECT page_id, pos, tag, regexp_replace(text0, '^[\s\x0b]+|[\s\x0b]+$', '', 'g') AS text FROM raw)
      WHERE tag NOT IN ('script', 'style', 'code', 'pre', 'svg', 'path', 'circle', 'rect', 'line', 'polyline', 'polygon') AND NOT ("""
    + r"""text = '' OR regexp_matches(text, '^[a-z0-9]+(?:-[a-z0-9]+){2,}$') OR (regexp_matches(text, '^[A-Z0-9_]+$') AND regexp_matches(text, '[_0-9]')) OR regexp_matches(text, '^https?://') OR regexp_matches(text, '^[0-9.,%$€£¥]+$') OR NOT regexp_matches(text, '\p{L}'))""",
    "str": """SELECT 'src/app/p' || page_id || '/page.tsx' AS file, page_id * 100000 + pos AS seq, text, tag, CASE WHEN tag = 'a' THEN 't-call' WHEN tag IN ('h1', 'h2') THEN 'T-component' ELSE 'jsx-text' END AS type,
      CASE WHEN tag IN ('a', 'h1', 'h2') THEN tag || '.k' || length(text) END AS id, CASE WHEN NOT starts_with(tag, '/') THEN tag END AS component FROM nod""",
    "map": "SELECT text, 'p.m' || length(text) AS key, min(seq) AS seq FROM str WHERE tag = 'p' GROUP BY text",
    "trn": "SELECT conv_id AS file, role AS component, turn AS seq, text FROM conversations",
    "pro": "SELECT lower(replace(p_brand, '#', '')) || '.' || replace(p_name, ' ', '') AS key, p_partkey AS seq FROM part",
    "lay": "SELECT CASE lang WHEN 'de' THEN source WHEN 'fr' THEN source || '.a' ELSE source || '.a.x' || doc_id END AS key, doc_id AS seq FROM documents",
    "imp": """SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders
      UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier""",
    "pth": "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'src/app/' || lang || '/' || source || '/page.tsx' WHEN 1 THEN 'pages/' || lang || '/index.tsx' WHEN 2 THEN 'src/components/' || source || '/Card.tsx' WHEN 3 THEN 'pages/' || source || '.js' ELSE 'lib/' || source || '.ts' END AS path FROM documents",
    "cnd": """SELECT n_name AS text FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT url FROM pages UNION ALL SELECT CAST(p_size AS VARCHAR) FROM part UNION ALL SELECT p_brand FROM part UNION ALL SELECT replace(p_name, ' ', '-') FROM part
      UNION ALL SELECT replace(p_name, ' ', '-') || '-x' FROM part UNION ALL SELECT o_orderpriority FROM orders UNION ALL SELECT '!!! ' || doc_id FROM documents UNION ALL SELECT lang FROM documents UNION ALL SELECT ' ' || lang || ' ' FROM documents""",
    "rte": r"""SELECT doc_id, path, CASE WHEN regexp_extract(path, 'app/(.+?)/page\.[jt]sx?$', 1) <> '' THEN replace(regexp_extract(path, 'app/(.+?)/page\.[jt]sx?$', 1), '/', '.')
      WHEN regexp_extract(path, 'pages/(.+?)\.[jt]sx?$', 1) <> '' THEN nullif(replace(regexp_replace(regexp_extract(path, 'pages/(.+?)\.[jt]sx?$', 1), '/index$', ''), '/', '.'), '')
      ELSE nullif(regexp_extract(path, 'components/(.+?)/', 1), '') END AS route FROM pth""",
    "tok": "SELECT *, greatest(1, CAST(ceil(length(key) / 4.0) AS BIGINT)) + greatest(1, CAST(ceil(length(value) / 4.0) AS BIGINT)) AS tokens FROM src",
}
NEEDS = {"dif": ["src", "tgt", "lck"], "nod": ["raw"], "str": ["nod"], "map": ["str"], "rte": ["pth"], "tok": ["src"]}


def with_views(names: str, body: str, recursive: bool = False) -> str:
    """The body after WITH and the named adapters, and what they need."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names.split():
        add(n)
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(f"{n} AS ({SQL[n]})" for n in order) + "\n" + body if order else body
