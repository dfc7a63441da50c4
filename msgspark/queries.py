"""Registered queries: each operator of the library over whole tables, and its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adapters as A
from .functions import text as T
from .operators import catalogs, factories, graph, jsx_strings, keys, planning, scanning, validation
from .plans import keygen
from .plans import translate as plan
from .sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, views: str = "", recursive: bool = False) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = A.with_views(views, sql, recursive)
        return f

    return register


HASHED = "substr(sha256(coalesce(value, '')), 1, 16) AS value_hash"


def hashed(df: DataFrame) -> DataFrame:
    return df.withColumn("value_hash", T.source_hash(F.coalesce("value", F.lit("")))).drop("value")


def diff_of(s: SparkSession, d: str) -> DataFrame:
    return catalogs.catalog_diff(A.source(s, d), A.target(s, d), A.lock(s, d))


# Catalogs: diff, merge, lock, partitions, nesting


@query(f"SELECT locale, key, status, seq, {HASHED} FROM dif", "dif")
def catalog_diff(s, d):
    return hashed(diff_of(s, d))


@query(f"SELECT locale, key, seq, {HASHED} FROM dif WHERE status = 'added'", "dif")
def diff_added(s, d):
    return hashed(A.source(s, d).join(A.target(s, d), ["locale", "key"], "left_anti"))


@query("SELECT locale, key FROM dif WHERE status = 'removed'", "dif")
def diff_removed(s, d):
    return A.target(s, d).join(A.source(s, d), ["locale", "key"], "left_anti").select("locale", "key")


@query("SELECT locale, sum((status = 'added')::BIGINT)::BIGINT AS added, sum((status = 'modified')::BIGINT)::BIGINT AS modified, sum((status = 'unchanged')::BIGINT)::BIGINT AS unchanged, sum((status = 'removed')::BIGINT)::BIGINT AS removed FROM dif GROUP BY 1", "dif")
def diff_counts(s, d):
    return catalogs.diff_counts(diff_of(s, d))


@query(f"SELECT locale, key, seq, (status = 'modified')::INT AS rank, {HASHED} FROM dif WHERE status IN ('added', 'modified')", "dif")
def translate_set(s, d):
    return hashed(catalogs.to_translate(diff_of(s, d)))


@query("SELECT locale, key, CASE status WHEN 'unchanged' THEN value ELSE 'translated_' || key END AS value FROM dif WHERE status <> 'removed'", "dif")
def catalog_merge(s, d):
    diff = diff_of(s, d)
    return catalogs.merge(diff.where("status = 'unchanged'"), catalogs.to_translate(diff).withColumn("value", F.concat(F.lit("translated_"), "key")))


@query("SELECT locale, key, substr(sha256(s.value), 1, 16) AS hash FROM src s JOIN dif USING (locale, key) WHERE status IN ('added', 'modified') UNION ALL SELECT locale, key, hash FROM lck JOIN dif USING (locale, key) WHERE status = 'unchanged'", "dif")
def lock_upsert(s, d):
    return catalogs.lock_upsert(A.source(s, d), A.lock(s, d), catalogs.to_translate(diff_of(s, d)))


@query("SELECT locale, key, hash FROM lck", "lck")
def lock_snapshot(s, d):
    """Locks written as one file for each locale and read again."""
    documents = catalogs.flat_documents(A.lock(s, d).select("locale", "key", F.col("hash").alias("value"), F.col("key").alias("seq")), "locale")
    folder = graph.saved_path(documents.limit(0))
    names = files.write_documents(documents.select(F.concat("locale", F.lit(".json")).alias("name"), "document"), folder)
    read = [files.read_string_map(s, f"{folder}/{n}", strict=True).select(F.lit(n.removesuffix(".json")).alias("locale"), "key", "hash") for n in names]
    return reduce(DataFrame.unionAll, read)


@query("SELECT locale, split_part(key, '.', 1) AS ns, count(*) AS entries, min(substr(key, instr(key, '.') + 1)) AS first_rest, max(substr(key, instr(key, '.') + 1)) AS last_rest FROM src GROUP BY ALL", "src")
def split_partitions(s, d):
    return catalogs.split(A.source(s, d)).groupBy("locale", "ns").agg(F.count("*").alias("entries"), F.min("rest").alias("first_rest"), F.max("rest").alias("last_rest"))


@query("SELECT DISTINCT locale, split_part(key, '.', 1) AS ns FROM tgt WHERE (locale, split_part(key, '.', 1)) NOT IN (SELECT (locale, split_part(key, '.', 1)) FROM src)", "src tgt")
def stale_namespaces(s, d):
    return catalogs.stale_partitions(catalogs.split(A.target(s, d)), catalogs.split(A.source(s, d)))


@query(f"SELECT locale, key, seq, {HASHED} FROM src", "src")
def split_reassemble(s, d):
    return hashed(catalogs.rejoin(catalogs.split(A.source(s, d))))


@query("SELECT lang || '.' || source AS key, substr(sha256(arg_max(text, doc_id)), 1, 16) AS value_hash FROM documents GROUP BY 1")
def invert_map(s, d):
    mapping = A.table(s, d, "documents").select("text", F.concat_ws(".", "lang", "source").alias("key"), F.col("doc_id").alias("seq"))
    return hashed(catalogs.invert_map(mapping))


@query("SELECT locale, ns, '{' || chr(10) || string_agg('  ' || to_json(rest)::VARCHAR || ': ' || to_json(value)::VARCHAR, ',' || chr(10) ORDER BY seq) || chr(10) || '}' || chr(10) AS document FROM (SELECT locale, split_part(key, '.', 1) AS ns, substr(key, instr(key, '.') + 1) AS rest, value, seq FROM src) GROUP BY 1, 2", "src")
def catalog_document(s, d):
    parts = catalogs.split(A.source(s, d)).select("locale", "ns", F.col("rest").alias("key"), "value", "seq")
    return catalogs.unflatten_documents(parts, "locale", "ns")


@query("""SELECT locale, count(*) AS lines, sum(strlen(line))::BIGINT AS bytes, min(md5(line)) AS least, max(md5(line)) AS most FROM (SELECT locale, unnest(string_split('{' || chr(10) || string_agg('  ' || to_json(ns)::VARCHAR || ': {' || chr(10) || body || chr(10) || '  }', ',' || chr(10) ORDER BY first) || chr(10) || '}', chr(10))) AS line
FROM (SELECT locale, ns, min(seq) AS first, string_agg('    ' || to_json(rest)::VARCHAR || ': ' || to_json(value)::VARCHAR, ',' || chr(10) ORDER BY seq) AS body FROM (SELECT locale, split_part(key, '.', 1) AS ns, substr(key, instr(key, '.') + 1) AS rest, value, seq FROM src) GROUP BY 1, 2) GROUP BY 1) GROUP BY 1""", "src")
def catalog_files(s, d):
    """A nested file for each locale, written in parts; its lines are read again."""
    folder = f"{graph.shared_folder(s)}/catalogs-{uuid.uuid4().hex}"
    files.write_catalogs(A.source(s, d), folder)
    lines = s.read.text(folder).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1).alias("locale"), "value")
    return lines.groupBy("locale").agg(F.count("*").alias("lines"), F.sum(F.octet_length("value")).alias("bytes"), F.min(F.md5("value")).alias("least"), F.max(F.md5("value")).alias("most"))


@query("SELECT text, key, row_number() OVER (ORDER BY seq) - 1 AS seq FROM map", "map")
def map_file(s, d):
    """The map as a file, and read again in its order."""
    folder = f"{graph.shared_folder(s)}/map-{uuid.uuid4().hex}"
    files.write_map(A.text_map(s, d), folder)
    return files.read_entries(s, f"{folder}/map.json", strict=True).select(F.col("key").alias("text"), F.col("value").alias("key"), "seq")


@query("SELECT 'en' AS locale, key, value, row_number() OVER (ORDER BY first) - 1 AS seq FROM (SELECT 'p.m' || length(text) AS key, arg_max(text, seq) AS value, min(seq) AS first FROM map GROUP BY 1)", "map")
def source_locale_file(s, d):
    """The source locale's messages written from the map and read again in their order; of several texts of a key the last."""
    from .config import Config

    folder, config = f"{graph.shared_folder(s)}/source-{uuid.uuid4().hex}", Config("en", ("de",))
    files.write_source_locale(A.text_map(s, d), config, folder)
    return files.read_source_catalog(s, config, folder)


@query("SELECT DISTINCT name, regexp_matches(name, '^[A-Z]') OR name = '__default__' AS pascal FROM (SELECT p_brand AS name FROM part UNION ALL SELECT lower(p_brand) FROM part UNION ALL SELECT CASE p_size WHEN 1 THEN '__default__' ELSE '_' || p_name END FROM part)")
def pascal_case(s, d):
    names = A.table(s, d, "part").select(F.explode(F.array("p_brand", F.lower("p_brand"), F.when(F.col("p_size") == 1, "__default__").otherwise(F.concat(F.lit("_"), "p_name")))).alias("name")).distinct()
    return names.select("name", T.is_pascal_case("name").alias("pascal"))


@query("SELECT doc_id, chr(10) || '{' || chr(10) || chr(10) || ' \"a\": \"' || lang || '//' || source || '\" ' || chr(10) || '}' AS document FROM documents")
def json_comments(s, d):
    """Comments on lines of their own and between stars go, slashes in strings stay."""
    text = F.concat(F.lit("// "), "source", F.lit("\n{\n  // a \"b\"\n \"a\": \""), "lang", F.lit("//"), "source", F.lit("\" /* "), "lang", F.lit("\n */\n}"))
    return A.table(s, d, "documents").select("doc_id", T.strip_json_comments(text).alias("document"))


@query("SELECT locale, split_part(key, '.', 1) AS ns, count(*) AS entries FROM src GROUP BY ALL", "src")
def namespace_sizes(s, d):
    return A.source(s, d).groupBy("locale", T.partition_of("key").alias("ns")).agg(F.count("*").alias("entries"))


@query("SELECT locale, string_agg('import ' || ns || ' from \"./' || ns || '.json\";', chr(10) ORDER BY ns) || chr(10) || 'type Messages = {' || chr(10) || string_agg('  ' || ns || ': typeof ' || ns || ';', chr(10) ORDER BY ns) || chr(10) || '};' AS declaration FROM (SELECT DISTINCT locale, split_part(key, '.', 1) AS ns FROM src) GROUP BY locale", "src")
def typegen_split(s, d):
    return catalogs.type_declarations(A.source(s, d))


@query("""SELECT locale, CASE WHEN n IS NULL THEN 'type Messages = Record<string, never>;' || chr(10) || chr(10) ELSE imports || chr(10) || chr(10) || 'type Messages = {' || chr(10) || members || chr(10) || '};' || chr(10) || chr(10) END
  || 'declare module "next-intl" {' || chr(10) || '  interface AppConfig {' || chr(10) || '    Messages: Messages;' || chr(10) || '  }' || chr(10) || '}' || chr(10) AS document
FROM (SELECT DISTINCT locale FROM src UNION SELECT DISTINCT 'x-' || locale FROM src) LEFT JOIN (SELECT locale, count(*) AS n, string_agg('import ' || ns || ' from "./' || locale || '/' || ns || '.json";', chr(10) ORDER BY ns) AS imports, string_agg('  ' || ns || ': typeof ' || ns || ';', chr(10) ORDER BY ns) AS members
  FROM (SELECT DISTINCT locale, split_part(key, '.', 1) AS ns FROM src) GROUP BY 1) USING (locale)""", "src")
def typegen_module(s, d):
    """Half of the locales have no entries."""
    catalog = A.source(s, d)
    locales = catalog.select("locale").distinct()
    return catalogs.module_declarations(catalog, locales.union(locales.select(F.concat(F.lit("x-"), "locale"))))


@query("SELECT doc_id, source || '.lang' AS key, lang AS value FROM documents UNION ALL SELECT doc_id, source || '.deep.inner.name' AS key, source || '/' || lang FROM documents")
def flatten_json(s, d):
    nested = F.concat(F.lit('{"'), "source", F.lit('": {"lang": "'), "lang", F.lit('", "n": '), "n_chars", F.lit(', "tags": ["x"], "none": null, "on": true, "deep": {"inner": {"name": "'), "source", F.lit("/"), "lang", F.lit('"}, "empty": {}}}}'))
    return catalogs.flatten_json(A.table(s, d, "documents").select("doc_id", nested.alias("j")), "j", "doc_id")


@query("SELECT doc_id, unnest([source, 'zz.lang', 'zz.a.b', 'b']) AS key, unnest(['d' || doc_id, lang, source, lang]) AS value, unnest([0, 1, 2, 3]) AS seq FROM documents")
def flatten_ordered(s, d):
    """Leaves in the order of their documents, which no sort by key gives; the first member, an object with a string, is replaced by the last one."""
    nested = F.concat(F.lit('{"'), "source", F.lit('": {"gone": "x"}, "zz": {"lang": "'), "lang", F.lit('", "a": {"b": "'), "source", F.lit('"}}, "b": "'), "lang", F.lit('", "'), "source", F.lit('": "d'), "doc_id", F.lit('"}'))
    return catalogs.flatten_json(A.table(s, d, "documents").select("doc_id", nested.alias("j")), "j", "doc_id", place="seq")


@query("SELECT event_id, 'of.kind' AS key, event_type AS value FROM events")
def flatten_numbers_only(s, d):
    """Numbers vanish beside the strings."""
    both = F.concat(F.lit('{"props": '), F.coalesce("props", F.lit("null")), F.lit(', "of": {"kind": "'), "event_type", F.lit('"}}'))
    return catalogs.flatten_json(A.table(s, d, "events").select("event_id", both.alias("j")), "j", "event_id")


@query("SELECT s.locale, s.key, s.seq FROM src s WHERE split_part(s.key, '.', 1) IN (SELECT source FROM documents GROUP BY source HAVING count(DISTINCT lang) = 4) OR s.key IN (SELECT source || '.d' || doc_id FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)", "src")
def selective_payload(s, d):
    docs = A.table(s, d, "documents")
    spaces = docs.groupBy("source").agg(F.countDistinct("lang").alias("n")).where("n = 4").select(F.col("source").alias("ns"))
    single = docs.join(A.table(s, d, "labels").where("toxic = 1"), "doc_id").select(F.concat("source", F.lit(".d"), "doc_id").alias("ns"))
    return catalogs.pick_messages(A.source(s, d), spaces.union(single)).select("locale", "key", "seq")


@query("SELECT s.page_id, s.pos, coalesce(m.value, s.text) AS text FROM nod s LEFT JOIN (SELECT 'p' || page_id || '.' || tag AS id, max(text) AS value FROM nod WHERE tag IN ('h1', 'p') GROUP BY 1) m ON m.id = 'p' || s.page_id || '.' || s.tag", "nod")
def runtime_lookup(s, d):
    nodes = scanning.text_nodes(A.table(s, d, "pages")).withColumn("id", F.concat(F.lit("p"), "page_id", F.lit("."), "tag"))
    messages = nodes.where(F.col("tag").isin("h1", "p")).groupBy(F.col("id").alias("key")).agg(F.max("text").alias("value"))
    return catalogs.runtime_lookup(nodes.withColumnRenamed("text", "children"), messages).select("page_id", "pos", "text")


@query("SELECT key, coalesce(n, v) AS value FROM (SELECT source || '.' || lang AS key, max(text) AS v0, substr(sha256(max(text)), 1, 16) AS v FROM documents GROUP BY 1) FULL JOIN (SELECT source || '.' || lang AS key, 'new' || count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY 1) USING (key)")
def map_merge(s, d):
    docs = A.table(s, d, "documents")
    key = F.concat_ws(".", "source", "lang").alias("key")
    old = docs.groupBy(key).agg(T.source_hash(F.max("text")).alias("value"))
    new = docs.join(A.table(s, d, "labels").where("toxic = 1"), "doc_id").groupBy(key).agg(F.concat(F.lit("new"), F.count("*")).alias("value"))
    return catalogs.overlay(old, new, "key", "value")


# Scalars and filters


@query(r"""SELECT DISTINCT text, NOT (t = '' OR regexp_matches(t, '^[a-z0-9]+(?:-[a-z0-9]+){2,}$') OR (regexp_matches(t, '^[A-Z0-9_]+$') AND regexp_matches(t, '[_0-9]')) OR regexp_matches(t, '^https?://') OR regexp_matches(t, '^[0-9.,%$€£¥]+$') OR NOT regexp_matches(t, '\p{L}')) AS kept
FROM (SELECT text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM cnd)""", "cnd")
def translatable_filter(s, d):
    return A.candidates(s, d).distinct().select("text", (~T.is_ignored_text("text")).alias("kept"))


@query("SELECT name, n, name IN ('placeholder', 'title', 'alt', 'aria-label', 'aria-description', 'aria-placeholder', 'label') AS kept, name = 'lang' AS kept_by_custom FROM (SELECT name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '\\s([a-zA-Z-]+)=\"', 1)) AS name FROM pages) GROUP BY 1)".replace("\\\\", "\\"))
def translatable_attrs(s, d):
    names = A.table(s, d, "pages").select(F.explode(F.regexp_extract_all("html", F.lit(r'\s([a-zA-Z-]+)="'), 1)).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    return names.select("name", "n", T.is_translatable_prop("name").alias("kept"), T.is_translatable_prop("name", ["lang", "class"]).alias("kept_by_custom"))


@query("SELECT tag, count(*) AS n, tag IN ('script', 'style', 'code', 'pre', 'svg', 'path', 'circle', 'rect', 'line', 'polyline', 'polygon') AS ignored FROM raw GROUP BY ALL", "raw")
def ignored_tags(s, d):
    tags = A.table(s, d, "pages").select(F.explode(F.regexp_extract_all("html", F.lit(scanning.TAG_AND_TEXT), 1)).alias("tag"))
    return tags.groupBy(F.lower("tag").alias("tag")).agg(F.count("*").alias("n")).withColumn("ignored", T.is_ignored_tag("tag"))


@query("SELECT tag, count(*) AS n, tag IN ('title', 'description', 'label', 'text', 'content', 'heading', 'subtitle', 'caption', 'summary', 'message', 'placeholder', 'alt') AS content FROM raw GROUP BY ALL", "raw")
def content_props(s, d):
    tags = A.table(s, d, "pages").select(F.explode(F.regexp_extract_all("html", F.lit(scanning.TAG_AND_TEXT), 1)).alias("tag"))
    return tags.groupBy(F.lower("tag").alias("tag")).agg(F.count("*").alias("n")).withColumn("content", T.is_content_prop("tag"))


@query("SELECT DISTINCT locale, regexp_matches(locale, '^[a-zA-Z0-9_-]+$') AS valid FROM (SELECT lang AS locale FROM documents UNION ALL SELECT lang || '/' || source FROM documents UNION ALL SELECT lang || '-' || upper(source) FROM documents)")
def valid_locales(s, d):
    docs = A.table(s, d, "documents")
    forms = docs.select(F.explode(F.array("lang", F.concat_ws("/", "lang", "source"), F.concat_ws("-", "lang", F.upper("source")))).alias("locale")).distinct()
    return forms.select("locale", T.is_valid_locale("locale").alias("valid"))


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS hash FROM documents")
def source_hash(s, d):
    return A.table(s, d, "documents").select("doc_id", T.source_hash("text").alias("hash"))


@query("SELECT doc_id, greatest(1, CAST(ceil(length(text) / 4.0) AS BIGINT)) AS tokens FROM documents")
def token_estimates(s, d):
    return A.table(s, d, "documents").select("doc_id", T.estimate_tokens("text").alias("tokens"))


@query("SELECT locale, sum(tokens)::BIGINT AS tokens FROM tok GROUP BY 1", "tok")
def token_totals(s, d):
    return A.source(s, d).groupBy("locale").agg(F.sum(T.entry_tokens("key", "value")).alias("tokens"))


PLACEHOLDER_SQL = r"list_sort(regexp_extract_all({0}, '\{{\{{[\w.]+\}}\}}|\{{[\w.]+\}}|%[sd@]|%\.[0-9]+f|</?[\w-]+(?:\s[^>]*)?\s*/?>'))"


@query(f"SELECT page_id, len(p)::INT AS n, md5(array_to_string(p, chr(10))) AS digest FROM (SELECT page_id, {PLACEHOLDER_SQL.format('html')} AS p FROM pages)")
def placeholders(s, d):
    p = T.placeholders("html")
    return A.table(s, d, "pages").select("page_id", F.size(p).alias("n"), F.md5(F.array_join(p, "\n")).alias("digest"))


@query("SELECT doc_id, route FROM rte", "rte")
def route_path(s, d):
    return A.paths(s, d).select("doc_id", T.route_path("path").alias("route"))


@query(r"""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'heroCard' WHEN last <> '' THEN lower(last) WHEN stem NOT IN ('index', 'page', 'layout') THEN lower(stem[1]) || stem[2:] ELSE lower(folder[1]) || folder[2:] END AS ns FROM (
  SELECT doc_id, coalesce(string_split(route, '.')[-1], '') AS last, string_split(regexp_replace(path, '\.\w+$', ''), '/')[-1] AS stem, string_split(regexp_replace(path, '\.\w+$', ''), '/')[-2] AS folder FROM rte)""", "rte")
def infer_namespace(s, d):
    rows = A.paths(s, d).select("doc_id", "path", T.route_path("path").alias("route"), F.when(F.col("doc_id") % 7 == 0, "HeroCard").alias("component"))
    return rows.select("doc_id", T.infer_namespace("component", "route", "path", split_on=".").alias("ns"))


@query("SELECT doc_id, CASE WHEN instr(k, '.') = 0 THEN lang || '.' || k ELSE k END AS key FROM (SELECT doc_id, lang, CASE source WHEN 'src0' THEN source ELSE source || '.d' || doc_id END AS k FROM documents)")
def auto_prefix(s, d):
    key = F.when(F.col("source") == "src0", F.col("source")).otherwise(F.concat("source", F.lit(".d"), "doc_id"))
    return A.table(s, d, "documents").select("doc_id", T.auto_prefix(key, "lang").alias("key"))


@query("SELECT doc_id, CASE WHEN source = 'src1' THEN 'd' || doc_id ELSE source || '.d' || doc_id END AS key FROM documents")
def strip_namespace(s, d):
    return A.table(s, d, "documents").select("doc_id", T.strip_namespace(F.concat("source", F.lit(".d"), "doc_id"), F.lit("src1")).alias("key"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'fr' WHEN 2 THEN 'es' ELSE 'en' END AS lang FROM events")
def accept_language(s, d):
    n = F.col("event_id") % 4
    header = F.when(n == 0, "en;q=0.5, de-AT, fr;q=0.9").when(n == 1, "pt,FR-ca;q=0.7,it;q=0.9").when(n == 2, "es;q=0.8,de;q=0.8").otherwise("ja,zh;q=0.1")
    return A.table(s, d, "events").select("event_id", T.accept_language(header, A.LANGUAGES, "en").alias("lang"))


@query("SELECT doc_id, 'Hi ' || lang || ', {b} from ' || source || ' {missing} {b}!' AS text FROM documents")
def interpolate(s, d):
    values = F.create_map(F.lit("a"), "lang", F.lit("c"), F.concat(F.lit("{b} from "), "source"))
    return A.table(s, d, "documents").select("doc_id", T.interpolate(F.lit("Hi {a}, {c} {missing} {b}!"), values).alias("text"))


@query("SELECT conv_id, turn, concat_ws(', ', CASE WHEN role = 'user' THEN 'part of: \"' || role || '\"' END, 'HTML: <p>', 'component: ' || role, CASE WHEN turn > 0 THEN 'route: t' || turn END) AS hint FROM conversations")
def entry_hints(s, d):
    t = A.table(s, d, "conversations")
    return t.select("conv_id", "turn", T.context_hint(F.when(F.col("role") == "user", F.col("role")), F.lit("p"), "role", F.lit(None).cast("string"), F.when(F.col("turn") > 0, F.concat(F.lit("t"), "turn"))).alias("hint"))


@query("SELECT c_custkey, CASE WHEN usd < 0.01 THEN printf('~$%.4f', usd) ELSE printf('~$%.2f', usd) END AS cost FROM (SELECT c_custkey, c_custkey / 7777.0 AS usd FROM customer)")
def format_cost(s, d):
    return A.table(s, d, "customer").select("c_custkey", T.format_cost(F.col("c_custkey") / 7777).alias("cost"))


@query(r"SELECT page_id, path, regexp_matches(path, '^/(?:en|de)/.*\.html$') AS included FROM (SELECT page_id, regexp_extract(url, '^[^:]+://[^/?#]+([^?#]*)', 1) AS path FROM pages) WHERE regexp_matches(path, '^/(?:.*/)?[^/]*$') AND NOT regexp_matches(path, '^/(?:fr|es)/.*$')")
def scan_page_inventory(s, d):
    from .sources.files import glob_pattern, inventory

    files = A.table(s, d, "pages").select("page_id", F.regexp_extract("url", r"^[^:]+://[^/?#]+([^?#]*)", 1).alias("path"))
    return inventory(files, ["/**/*"], ["/{fr,es}/**"]).withColumn("included", F.col("path").rlike(glob_pattern("/{en,de}/**.html")))


# Validation


@query(f"""SELECT page_id, placeholder, greatest(0, d) AS missing, greatest(0, -d) AS extra FROM (
  SELECT page_id, placeholder, sum(n)::BIGINT AS d FROM (SELECT page_id, unnest({PLACEHOLDER_SQL.format('source')}) AS placeholder, 1 AS n FROM prs UNION ALL SELECT page_id, unnest({PLACEHOLDER_SQL.format('translated')}), -1 FROM prs) GROUP BY 1, 2) WHERE d <> 0""", "prs")
def placeholder_diff(s, d):
    return validation.placeholder_diff(A.pairs(s, d), "page_id")


@query(f"""SELECT lang, count(*) FILTER (WHERE a <> b) AS failures, count(*) FILTER (WHERE a <> b) = 0 AS valid FROM (
  SELECT regexp_extract(html, 'lang="(\\w+)"', 1) AS lang, {PLACEHOLDER_SQL.format('html')} AS a, {PLACEHOLDER_SQL.format("replace(replace(html, '<b>', ''), '<br>', '<i>')")} AS b FROM pages) GROUP BY 1""")
def batch_validation(s, d):
    return validation.batch_validation(A.pairs(s, d).withColumn("lang", F.regexp_extract("source", r'lang="(\w+)"', 1)), "lang")


# Planning


BATCH_SQL = """, o AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY seq) AS rn FROM e),
b AS (SELECT {by}, seq, rn, tokens AS total, 1 AS n, 0::BIGINT AS batch_id FROM o WHERE rn = 1
  UNION ALL SELECT {o_by}, o.seq, o.rn, CASE WHEN b.total + o.tokens > 2000 OR b.n >= 50 THEN o.tokens ELSE b.total + o.tokens END, CASE WHEN b.total + o.tokens > 2000 OR b.n >= 50 THEN 1 ELSE b.n + 1 END,
    b.batch_id + (b.total + o.tokens > 2000 OR b.n >= 50)::BIGINT FROM b JOIN o ON {on} AND o.rn = b.rn + 1)
"""


def documents_batched(s, d):
    entries = A.source(s, d).select("locale", "key", "value", "seq", T.entry_tokens("key", "value").alias("tokens"))
    return planning.token_batches(entries.select("locale", "seq", "tokens"), "locale")


@query(", e AS (SELECT locale, seq, tokens FROM tok)" + BATCH_SQL.format(by="locale", o_by="o.locale", on="o.locale = b.locale") + "SELECT locale, batch_id, count(*) AS entries, min(seq) AS first_seq, max(seq) AS last_seq FROM b GROUP BY ALL", "tok", True)
def token_batches(s, d):
    return documents_batched(s, d).groupBy("locale", "batch_id").agg(F.count("*").alias("entries"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query("e AS (SELECT p_type, p_partkey AS seq, CASE WHEN p_size = 1 THEN 1500 ELSE greatest(1, ceil(length(p_name) / 4.0)::BIGINT) + greatest(1, ceil(length(p_brand) / 4.0)::BIGINT) END::BIGINT AS tokens FROM part)" + BATCH_SQL.format(by="p_type", o_by="o.p_type", on="o.p_type = b.p_type") + "SELECT p_type, batch_id, count(*) AS entries, sum(tokens)::BIGINT AS tokens FROM b JOIN e USING (p_type, seq) GROUP BY ALL")
def token_batches_short(s, d):
    entries = A.table(s, d, "part").select("p_type", F.col("p_partkey").alias("seq"), F.when(F.col("p_size") == 1, F.lit(1500)).otherwise(T.entry_tokens("p_brand", "p_name")).cast("long").alias("tokens"))
    return planning.token_batches(entries, "p_type").groupBy("p_type", "batch_id").agg(F.count("*").alias("entries"), F.sum("tokens").alias("tokens"))


ORACLE_SQL["token_batches_short"] = "WITH RECURSIVE " + ORACLE_SQL["token_batches_short"]


@query("SELECT locale, seq, (row_number() OVER (PARTITION BY locale ORDER BY seq) - 1) // 50 AS batch_id FROM src", "src")
def fixed_batches(s, d):
    return planning.fixed_batches(A.source(s, d).select("locale", "seq"), ["locale"], 50)


@query("SELECT locale, wave_id, count(DISTINCT batch_id) AS batches, count(*) AS entries FROM (SELECT locale, (row_number() OVER (PARTITION BY locale ORDER BY seq) - 1) // 50 AS batch_id, (row_number() OVER (PARTITION BY locale ORDER BY seq) - 1) // 150 AS wave_id FROM src) GROUP BY ALL", "src")
def wave_assignment(s, d):
    rows = planning.fixed_batches(A.source(s, d).select("locale", "seq"), ["locale"], 50).withColumn("wave_id", planning.wave_of("batch_id", 3))
    return rows.groupBy("locale", "wave_id").agg(F.countDistinct("batch_id").alias("batches"), F.count("*").alias("entries"))


WAVE_SQL = """SELECT locale, wave_id, key, rank FROM (
  SELECT locale, wave_id, key, value, row_number() OVER (PARTITION BY locale, wave_id ORDER BY same DESC, from_wave, seq) AS rank FROM (
    SELECT w.locale, w.wave_id, e.key, e.value, e.seq, e.wave_id AS from_wave, EXISTS (SELECT 1 FROM sp WHERE sp.locale = w.locale AND sp.wave_id = w.wave_id AND sp.ns = split_part(e.key, '.', 1))::INT AS same
    FROM (SELECT DISTINCT locale, wave_id FROM e) w JOIN e ON e.locale = w.locale AND e.wave_id < w.wave_id)) WHERE rank <= 15 AND value <> ''"""


@query(", e AS (SELECT locale, key, CASE WHEN toxic = 1 THEN '' ELSE value END AS value, seq, (row_number() OVER (PARTITION BY locale ORDER BY seq) - 1) // 150 AS wave_id FROM src LEFT JOIN labels ON doc_id = seq), sp AS (SELECT DISTINCT locale, wave_id, split_part(key, '.', 1) AS ns FROM e) " + WAVE_SQL, "src")
def wave_context(s, d):
    toxic = A.table(s, d, "labels").select(F.col("doc_id").alias("seq"), "toxic")
    rows = A.source(s, d).join(toxic, "seq", "left").withColumn("value", F.when(F.col("toxic") == 1, "").otherwise(F.col("value")))
    return planning.wave_context(planning.fixed_batches(rows, ["locale"], 150).withColumnRenamed("batch_id", "wave_id"), "locale")


@query("SELECT locale, (3 * (sum(tokens) + 200 * greatest(1, ceil(count(*) / 50.0))))::BIGINT AS input_tokens, (3 * sum(tokens))::BIGINT AS output_tokens, greatest(1, ceil(count(*) / 50.0))::BIGINT AS batches FROM tok GROUP BY 1", "tok")
def cost_estimate(s, d):
    return planning.cost_estimate(A.source(s, d), "locale", locales=3)


@query("SELECT conv_id, sum(CASE role WHEN 'user' THEN t ELSE 0 END)::BIGINT AS tokens_in, sum(CASE role WHEN 'assistant' THEN t ELSE 0 END)::BIGINT AS tokens_out, sum(CASE WHEN role IN ('user', 'assistant') THEN t ELSE 0 END)::BIGINT AS total FROM (SELECT conv_id, role, greatest(1, ceil(length(text) / 4.0)::BIGINT) AS t FROM conversations) GROUP BY 1")
def usage_totals(s, d):
    t = A.table(s, d, "conversations").withColumn("t", T.estimate_tokens("text"))
    of = lambda role: F.when(F.col("role") == role, F.col("t"))
    return planning.usage_totals(t.select("conv_id", of("user").alias("tokens_in"), of("assistant").alias("tokens_out")), "conv_id")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN o_custkey * 0.5 / 1000000 WHEN 'O' THEN o_custkey * 2.0 / 1000000 END::DOUBLE AS usd FROM orders")
def usage_cost(s, d):
    prices = s.createDataFrame([("F", 0.5, 0.0), ("O", 2.0, 0.0)], "model string, usd_in double, usd_out double")
    usage = A.table(s, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("model"), F.col("o_custkey").alias("tokens_in"), F.lit(0).alias("tokens_out"))
    return planning.usage_cost(usage, prices).select("o_orderkey", "usd")


@query("SELECT sum((status IN ('added', 'modified'))::BIGINT)::BIGINT AS translated, sum((status = 'unchanged')::BIGINT)::BIGINT AS cached, count(DISTINCT locale) AS locales FROM dif", "dif")
def run_summary(s, d):
    return catalogs.run_summary(diff_of(s, d))


# Keys


@query("SELECT substr(sha256(text), 1, 16) AS text_hash, min(doc_id) AS seq FROM documents GROUP BY text")
def dedupe_first(s, d):
    rows = A.table(s, d, "documents").select("text", F.col("doc_id").alias("seq"), "lang")
    return keys.dedupe_first(rows).select(T.source_hash("text").alias("text_hash"), "seq")


@query("SELECT m.text, m.key FROM map m WHERE text IN (SELECT text FROM str WHERE component = 'li' OR component = 'p')", "map str")
def active_map(s, d):
    found = graph.saved(A.strings(s, d))
    return keys.active_entries(A.text_map(s, d, found), found.where("component IN ('li', 'p')")).select("text", "key")


@query("SELECT text, min(seq) AS seq FROM str WHERE text NOT IN (SELECT text FROM map) GROUP BY text", "map str")
def new_strings(s, d):
    found = graph.saved(A.strings(s, d))
    return keys.new_strings(found, A.text_map(s, d, found)).select("text", "seq")


@query("SELECT text FROM str UNION SELECT text FROM map", "map str")
def all_texts(s, d):
    found = graph.saved(A.strings(s, d))
    return found.select("text").union(A.text_map(s, d, found).select("text")).distinct()


@query("SELECT file, seq, text FROM str WHERE type <> 't-call' AND NOT (type = 'T-component' AND id IS NOT NULL)", "str")
def bare_strings(s, d):
    return keys.bare_strings(A.strings(s, d)).select("file", "seq", "text")


@query("SELECT text, key FROM map UNION ALL SELECT text, arg_min(id, (type = 't-call', seq)) AS key FROM str WHERE type IN ('t-call', 'T-component') AND text NOT IN (SELECT text FROM map) GROUP BY text", "map str")
def map_supplement(s, d):
    found = graph.saved(A.strings(s, d))
    return keys.supplement_map(A.text_map(s, d, found), found)


@query("SELECT file, seq, key FROM str JOIN map USING (text)".replace("seq", "str.seq"), "map str")
def replacement_sites(s, d):
    found = graph.saved(A.strings(s, d))
    return keys.replacement_sites(found, A.text_map(s, d, found)).select("file", "seq", "key")


@query("SELECT seq, key, CASE n WHEN 1 THEN key ELSE key || n END AS final_key FROM (SELECT seq, key, row_number() OVER (PARTITION BY key ORDER BY seq) + (key IN (SELECT lower(replace(p_brand, '#', '')) || '.' || replace(p_name, ' ', '') FROM part WHERE p_size = 1))::INT AS n FROM pro)", "pro")
def key_collisions(s, d):
    """Keys of parts of size 1 are taken already."""
    rows = A.proposals(s, d)
    taken = rows.join(A.table(s, d, "part").where("p_size = 1").select(F.col("p_partkey").alias("seq")), "seq", "left_semi").select("key")
    return keys.resolve_collisions(rows, taken).select("seq", "key", "final_key")


@query("SELECT DISTINCT key FROM lay a WHERE key IN (SELECT split_part(key, '.', 1) FROM lay WHERE instr(key, '.') > 0) OR key IN (SELECT split_part(key, '.', 1) || '.' || split_part(key, '.', 2) FROM lay WHERE length(key) - length(replace(key, '.', '')) >= 2)", "lay")
def leaf_branch_conflicts(s, d):
    return keys.leaf_branch_conflicts(A.layered_keys(s, d))


@query("SELECT DISTINCT key, CASE WHEN key IN (SELECT split_part(key, '.', 1) FROM lay WHERE instr(key, '.') > 0) OR key IN (SELECT split_part(key, '.', 1) || '.' || split_part(key, '.', 2) FROM lay WHERE length(key) - length(replace(key, '.', '')) >= 2) THEN key || 'Label' ELSE key END AS final_key FROM lay", "lay")
def renamed_conflicts(s, d):
    once = A.layered_keys(s, d).groupBy("key").agg(F.min("seq").alias("seq"))
    return keys.rename_conflicts(once).select("key", "final_key")


@query("SELECT lang, CASE WHEN count(*) = count(ns) AND min(ns) = max(ns) THEN min(ns) END AS ns FROM (SELECT lang || source AS lang, CASE WHEN lang = 'de' AND source = 'src3' THEN NULL WHEN lang = 'fr' THEN lang || (doc_id % 2) ELSE lang END AS ns FROM documents) GROUP BY 1")
def unanimous_namespace(s, d):
    ns = F.when((F.col("lang") == "de") & (F.col("source") == "src3"), F.lit("")).when(F.col("lang") == "fr", F.concat("lang", (F.col("doc_id") % 2).cast("string"))).otherwise(F.col("lang"))
    rows = A.table(s, d, "documents").select(F.concat("lang", "source").alias("lang"), F.concat(ns, F.lit(".k")).alias("key"))
    return keys.unanimous_namespace(rows, "lang")


@query("SELECT component, md5(string_agg(key, ',' ORDER BY key)) AS digest, count(*)::INT AS n FROM (SELECT DISTINCT component, key FROM str JOIN map USING (text)) GROUP BY 1", "map str")
def component_keys(s, d):
    sites = keys.replacement_sites(A.strings(s, d), A.text_map(s, d))
    return keys.component_keys(sites).select("component", F.md5(F.array_join("keys", ",")).alias("digest"), F.size("keys").alias("n"))


@query("SELECT string_agg(ns, ',' ORDER BY ns) AS namespaces FROM (SELECT DISTINCT split_part(key, '.', 1) AS ns FROM str JOIN map USING (text) WHERE type <> 'T-component')", "map str")
def client_namespaces(s, d):
    sites = keys.replacement_sites(A.strings(s, d), A.text_map(s, d)).where("type <> 'T-component'")
    return sites.agg(F.array_join(F.array_sort(F.collect_set(T.namespace("key"))), ",").alias("namespaces"))


@query("SELECT text, key, seq FROM map ORDER BY seq LIMIT 30", "map")
def map_head(s, d):
    return keys.map_head(A.text_map(s, d))


@query(", t(id) AS (SELECT page_id FROM pages WHERE page_id % 10 = 1 UNION SELECT page_id FROM t JOIN pages ON page_id = 2 * id OR page_id = 3 * id) SELECT namespace, count(*) AS files FROM (SELECT DISTINCT file, 'n' || length(text) % 7 AS namespace FROM str WHERE tag = 'p' AND file IN (SELECT 'src/app/p' || id || '/page.tsx' FROM t)) GROUP BY 1", "str", True)
def client_namespaces_of_files(s, d):
    """Namespaces of all files that reach the browser, over imports at any depth."""
    found = graph.saved(A.strings(s, d))
    mapping = found.where("tag = 'p'").select("text", F.concat(F.lit("n"), (F.length("text") % 7).cast("string"), F.lit(".k")).alias("key"))
    return keys.client_namespaces(keys.replacement_sites(found.where("tag = 'p'"), mapping), graph.client_files(A.sources(s, d), A.ALIASES))


@query("SELECT file, component, seq, row_number() OVER (PARTITION BY file ORDER BY component, seq) AS rank FROM trn", "trn")
def keygen_order(s, d):
    return keys.keygen_order(A.turns(s, d)).select("file", "component", "seq", F.col("rank").cast("long").alias("rank"))


NAMES = ["b", "B", "\u00e9", "e", "\u00c9", "Zebra", "_x", "a-b", "ab", "\u00c4pfel", "apfel"]


@query(f"SELECT file, component, seq, row_number() OVER (PARTITION BY file ORDER BY component COLLATE en, seq) AS rank FROM (SELECT conv_id % 10 AS file, {NAMES}[1 + (conv_id + turn) % {len(NAMES)}] || (turn % 2) AS component, conv_id * 1000 + turn AS seq FROM conversations)")
def keygen_order_of_names(s, d):
    """Components with accents and in both cases, as people sort them."""
    n = (F.col("conv_id") + F.col("turn")) % len(NAMES)
    names = F.element_at(F.array(*map(F.lit, NAMES)), (n + 1).cast("int"))
    rows = A.table(s, d, "conversations").select((F.col("conv_id") % 10).alias("file"), F.concat(names, (F.col("turn") % 2).cast("string")).alias("component"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"))
    return keys.keygen_order(rows).select("file", "component", "seq", F.col("rank").cast("long").alias("rank"))


# Scanning


@query("SELECT page_id, pos, tag, text FROM nod", "nod")
def extract_text_nodes(s, d):
    return scanning.text_nodes(A.table(s, d, "pages"))


@query(r"""SELECT page_id, pos, name, value FROM (SELECT page_id, unnest(range(1, len(a) + 1)) AS pos, unnest(a) AS name, unnest(b) AS value FROM (SELECT page_id, regexp_extract_all(html, '\s([a-zA-Z-]+)="([^"<>]*)"', 1) AS a, regexp_extract_all(html, '\s([a-zA-Z-]+)="([^"<>]*)"', 2) AS b FROM pages))
WHERE name = 'lang' AND value <> ''""")
def extract_attributes(s, d):
    return scanning.attributes(A.table(s, d, "pages"), custom=["lang", "href"])


SIBLINGS_SQL = "SELECT a.file, a.seq, (SELECT string_agg(text, '|' ORDER BY seq) FROM (SELECT b.text, b.seq FROM {0} b WHERE b.file = a.file AND b.component IS NOT DISTINCT FROM a.component AND b.seq <> a.seq ORDER BY b.seq LIMIT 5)) AS siblings FROM {0} a"


@query(SIBLINGS_SQL.format("trn"), "trn")
def sibling_texts(s, d):
    return scanning.sibling_texts(A.turns(s, d)).select("file", "seq", F.array_join("siblings", "|").alias("siblings"))


@query("SELECT s.file, s.seq, CASE WHEN h.text <> s.text THEN h.text END AS heading FROM str s LEFT JOIN (SELECT file, arg_min(text, seq) AS text FROM str WHERE regexp_matches(tag, '^h[1-3]$') GROUP BY 1) h ON h.file = s.file", "str")
def section_heading(s, d):
    return scanning.section_headings(A.strings(s, d)).select("file", "seq", "heading")


@query("SELECT a.file, a.seq, s.siblings, h.heading, 'p' || (a.seq // 100000) AS route FROM str a JOIN (" + SIBLINGS_SQL.format("str") + ") s USING (file, seq) JOIN (SELECT s.file, s.seq, CASE WHEN h.text <> s.text THEN h.text END AS heading FROM str s LEFT JOIN (SELECT file, arg_min(text, seq) AS text FROM str WHERE regexp_matches(tag, '^h[1-3]$') GROUP BY 1) h ON h.file = s.file) h USING (file, seq)", "str")
def enriched_strings(s, d):
    return scanning.enrich(A.strings(s, d)).select("file", "seq", F.array_join("siblings", "|").alias("siblings"), "heading", "route")


@query("SELECT m.key, m.text, f.tag, f.type FROM map m JOIN (SELECT text, arg_min(tag, seq) AS tag, arg_min(type, seq) AS type FROM str GROUP BY 1) f USING (text)", "map str")
def context_entries(s, d):
    found = graph.saved(A.strings(s, d))
    with_text = A.text_map(s, d, found).select("text", F.concat_ws("\n", "key", "text").alias("key"))
    out = scanning.context_entries(with_text, found).withColumn("c", F.from_json("context", "type string, tag string"))
    return out.select(F.substring_index("key", "\n", 1).alias("key"), F.regexp_replace("key", "^[^\n]*\n", "").alias("text"), "c.tag", "c.type")


@query("SELECT file, count(*) AS n, string_agg('  \"' || text || '\"' || coalesce(', component: ' || component, '') || ', tag: ' || tag, chr(10) ORDER BY seq) AS block FROM str GROUP BY 1", "str")
def prompt_groups(s, d):
    return scanning.prompt_groups(A.strings(s, d))


@query("SELECT importer, base, file FROM (SELECT importer, base, arg_min(file, pos) AS file FROM (SELECT i.importer, i.base, f.path AS file, list_position(['', '.tsx', '/index.tsx', '.ts', '/index.ts', '.jsx', '/index.jsx', '.js', '/index.js'], substr(f.path, length(i.base) + 1)) AS pos FROM (SELECT doc_id AS importer, regexp_replace(path, '(/index)?\\.[a-z]+$', '') AS base FROM pth) i JOIN (SELECT DISTINCT path FROM pth) f ON starts_with(f.path, i.base)) WHERE pos IS NOT NULL GROUP BY ALL)", "pth")
def resolve_links(s, d):
    paths = A.paths(s, d)
    asked = paths.select(F.col("doc_id").alias("importer"), F.regexp_replace("path", r"(/index)?\.[a-z]+$", "").alias("base"))
    return graph.resolve_links(asked, paths.select(F.col("path").alias("file")))


@query(", t(node) AS (SELECT 'r0' UNION SELECT dst FROM imp JOIN t ON src = node) SELECT node FROM t", "imp", True)
def graph_reachability(s, d):
    return graph.reachable(s.createDataFrame([("r0",)], "node string"), A.imports(s, d))


# Model operators, with the deterministic stub


@query("SELECT locale, key, 'translated_' || key AS value FROM dif WHERE status IN ('added', 'modified')", "dif")
def translate_stub(s, d):
    options = plan.Options(concurrency=256, wait=lambda seconds: None)
    return plan.translate(catalogs.to_translate(diff_of(s, d)), plan.StubTranslator(), options=options).select("locale", "key", "value")


@query("SELECT locale, key, least(15, ((row_number() OVER (PARTITION BY locale ORDER BY status = 'modified', seq, key) - 1) // 160) * 160) || '_' || key AS value FROM dif WHERE status IN ('added', 'modified')", "dif")
def translate_waves(s, d):
    """Many waves: each answer tells how many earlier translations its batch was shown."""
    options = plan.Options(target_tokens=10**9, max_entries=20, concurrency=8)
    return plan.translate(catalogs.to_translate(diff_of(s, d)), plan.CountingTranslator(), options=options).select("locale", "key", "value")


@query("SELECT locale, key, CASE locale WHEN 'de' THEN 'again_' ELSE 'translated_' END || key AS value FROM dif WHERE status IN ('added', 'modified')", "dif")
def translate_fallback(s, d):
    """A model that never answers for one locale; another one does."""
    options = plan.Options(concurrency=256, retries=1, wait=lambda seconds: None)
    return plan.translate(catalogs.to_translate(diff_of(s, d)), plan.Refusing("de"), plan.Renaming("again_"), options).select("locale", "key", "value")


@query("SELECT locale, key, CASE status WHEN 'unchanged' THEN value ELSE 'translated_' || key END AS value FROM dif WHERE status <> 'removed' AND locale <> 'fr' UNION ALL SELECT locale, key, value FROM tgt WHERE locale = 'fr'", "dif")
def published_catalog(s, d):
    """What a run publishes: a locale with a failed batch keeps its catalog, removed keys too."""
    options = plan.Options(concurrency=256, retries=0, wait=lambda seconds: None)
    return plan.run(A.source(s, d), A.target(s, d), A.lock(s, d), plan.Refusing("fr"), options=options).catalog.select("locale", "key", "value")


@query("SELECT locale, key, hash FROM lck JOIN dif USING (locale, key) WHERE status = 'unchanged' OR locale = 'fr' AND status <> 'added' UNION ALL SELECT locale, key, substr(sha256(value), 1, 16) FROM dif WHERE status IN ('added', 'modified') AND locale <> 'fr' AND value IS NOT NULL", "dif")
def published_lock(s, d):
    """The lock after that run: no hash of the failed locale changes."""
    options = plan.Options(concurrency=256, retries=0, wait=lambda seconds: None)
    return plan.run(A.source(s, d), A.target(s, d), A.lock(s, d), plan.Refusing("fr"), options=options).lock.select("locale", "key", "hash")


@query("SELECT text, seq, 'gen.k' || substr(sha256(text), 1, 8) AS key FROM (SELECT text, min(seq) AS seq FROM str WHERE text NOT IN (SELECT text FROM map) GROUP BY text) UNION ALL SELECT text, seq, key FROM map", "map str")
def keygen_stub(s, d):
    found = graph.saved(A.strings(s, d))
    return keygen.generate_keys(found, A.text_map(s, d, found), keygen.StubKeys(), options=plan.Options(concurrency=8)).select("text", "seq", "key")


@query("SELECT p_type, batch_id, 'Translate to ' || p_type || ':' || chr(10) || 'Tone: formal' || chr(10) || 'Terms:' || chr(10) || '  \"a\" is \"b\"' || chr(10) || string_agg('  \"' || p_brand || '\": \"' || p_name || '\" (size ' || p_size || ')', chr(10) ORDER BY p_partkey) AS prompt FROM (SELECT *, (row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1) // 50 AS batch_id FROM part) GROUP BY p_type, batch_id")
def translate_prompt(s, d):
    rows = planning.fixed_batches(A.table(s, d, "part"), ["p_type"], 50, "p_partkey").withColumn("hint", F.concat(F.lit("size "), F.col("p_size").cast("string")))
    return scanning.translation_prompts(rows, "p_type", "p_brand", "p_name", "p_partkey", ("p_type", "batch_id"), tone="formal", glossary={"a": "b"}, hint="hint")


# JSX sources: pages turned into components


ESCAPED = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("{", "&#123;"), ("}", "&#125;")]
ESCAPED_SQL = "text"
for _from, _to in ESCAPED:
    ESCAPED_SQL = f"replace({ESCAPED_SQL}, '{_from}', '{_to}')"


def components(s, d, found=None):
    """Each page's text nodes as paragraphs of a React component's source."""
    own = (A.strings(s, d) if found is None else found).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("all"))
    escaped = lambda c: reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ESCAPED, c)
    lines = F.array_join(F.transform("all", lambda x: F.concat(F.lit("<p>"), escaped(x["text"]), F.lit("</p>"))), "\n")
    return own.select(F.col("file").alias("path"), F.concat(F.lit("export default function Page() {\n return <main>\n"), lines, F.lit("\n</main>;\n}\n")).alias("content"))


@query("SELECT file, row_number() OVER (PARTITION BY file ORDER BY seq) - 1 AS seq, text, 'jsx-text' AS type, 'Page' AS component, 'p' AS tag FROM str", "str")
def extract_jsx(s, d):
    return jsx_strings.extract_strings(components(s, d)).select("file", "seq", "text", "type", "component", "tag")


@query("SELECT (SELECT count(*) FROM pages) AS files, (SELECT count(*) FROM pages WHERE page_id % 7 = 3) AS unreadable, count(*) AS strings, min(text) AS first, max(text) AS last FROM (SELECT 'Page ' || page_id AS text FROM pages WHERE page_id % 7 <> 3)")
def scan_report(s, d):
    """Every seventh file cannot be read, half of these having no content; the counts come from the scan that writes the strings."""
    n = F.col("page_id")
    code = F.when(n % 14 != 3, F.concat(F.lit("export default () => <p>Page "), n.cast("string"), F.when(n % 7 != 3, F.lit("</p>;\n")).otherwise("{</p>;\n")))
    strings, seen = jsx_strings.scan(A.table(s, d, "pages").select(F.concat(F.lit("p"), n.cast("string")).alias("path"), code.alias("content")))
    written = graph.saved(strings)
    counts = [F.lit(seen.get[c]).alias(c) for c in ("files", "unreadable", "strings")]
    return written.agg(F.min("text").alias("first"), F.max("text").alias("last")).select(*counts, "first", "last")


@query(f"""SELECT file AS path, count(key)::INT AS replaced, sha256('import {{ useTranslations }} from "next-intl";' || chr(10) || 'export default function Page() {{' || chr(10) || chr(9) || 'const t = useTranslations("p");' || chr(10) || ' return <main>' || chr(10)
  || string_agg('<p>' || CASE WHEN key IS NULL THEN {ESCAPED_SQL} ELSE '{{t("' || substr(key, 3) || '")}}' END || '</p>', chr(10) ORDER BY str.seq) || chr(10) || '</main>;' || chr(10) || '}}' || chr(10)) AS code FROM str LEFT JOIN map USING (text) GROUP BY 1 HAVING count(key) > 0""", "map str")
def rewrite_jsx(s, d):
    """The whole code is compared."""
    found = graph.saved(A.strings(s, d))
    done = jsx_strings.rewrite_sources(components(s, d, found), A.text_map(s, d, found))
    return done.where("replaced > 0").select("path", "replaced", F.sha2("content", 256).alias("code"))


@query("""SELECT 'p' || page_id || '.tsx' AS path, (page_id % 3 <> 0)::INT AS replaced, page_id % 2 = 1 AS client, CASE WHEN page_id % 2 = 1 THEN '"use client";' || chr(10) ELSE '' END || CASE WHEN page_id % 3 = 0 THEN 'export const Page = () => <p>Page ' || page_id || '</p>;'
  WHEN page_id % 2 = 1 THEN 'import { useTranslations } from "next-intl";' || chr(10) || 'export const Page = () => {' || chr(10) || chr(9) || 'const t = useTranslations("pages");' || chr(10) || chr(9) || 'return <p>{t("p' || page_id || '")}</p>;' || chr(10) || '};'
  ELSE 'import { getTranslations } from "next-intl/server";' || chr(10) || 'export const Page = async () => {' || chr(10) || chr(9) || 'const t = await getTranslations("pages");' || chr(10) || chr(9) || 'return <p>{t("p' || page_id || '")}</p>;' || chr(10) || '};' END || chr(10) AS content FROM pages""")
def rewrite_expressions(s, d):
    """Components whose body is an expression, on both sides; every third text has no key."""
    n = F.col("page_id")
    text, path = F.concat(F.lit("Page "), n.cast("string")), F.concat(F.lit("p"), n.cast("string"), F.lit(".tsx"))
    code = F.concat(F.when(n % 2 == 1, F.lit('"use client";\n')).otherwise(""), F.lit("export const Page = () => <p>"), text, F.lit("</p>;\n"))
    pages = A.table(s, d, "pages")
    mapping = pages.where(n % 3 != 0).select(text.alias("text"), F.concat(F.lit("pages.p"), n.cast("string")).alias("key"))
    return jsx_strings.rewrite_sources(pages.select(path.alias("path"), code.alias("content")), mapping, waiting=True).select("path", "replaced", "client", "content")


@query("""SELECT 'p' || page_id || '.tsx' AS path, '"use client";' || chr(10) || 'import { useTranslations } from "next-intl";' || chr(10) || 'export function Page() {' || chr(10) || ' const t = useTranslations(' || CASE page_id % 3 WHEN 0 THEN '"old"' WHEN 1 THEN '' ELSE '"pages"' END || ');' || chr(10)
  || ' return <p title={' || CASE page_id % 3 WHEN 0 THEN 't("k' WHEN 1 THEN 't("old.k' ELSE 't("k' END || page_id || '")} lang={list.map(t => t("x"))}>{t("' || CASE page_id % 3 WHEN 1 THEN 'pages.' ELSE '' END || 'p' || page_id || '")}</p>;' || chr(10) || '}' || chr(10) AS content FROM pages""")
def rewrite_retargeted(s, d):
    """Translators that are there: their namespace fits, is given up with their calls rewritten, or is given to one that has none."""
    n = F.col("page_id")
    number, third = n.cast("string"), n % 3
    path = F.concat(F.lit("p"), number, F.lit(".tsx"))
    head = F.lit('"use client";\nimport { useTranslations } from "next-intl";\nexport function Page() {\n const t = useTranslations(')
    code = F.concat(head, F.when(third == 2, F.lit("")).otherwise(F.lit('"old"')), F.lit(");\n return <p title={t("), F.lit('"'), F.when(third == 2, F.lit("pages.")).otherwise(F.lit("")), F.lit("k"), number, F.lit('")} lang={list.map(t => t("x"))}>Page '), number, F.lit("</p>;\n}\n"))
    pages = A.table(s, d, "pages")
    mapping = pages.select(F.concat(F.lit("Page "), number).alias("text"), F.concat(F.when(third == 0, F.lit("old.p")).otherwise(F.lit("pages.p")), number).alias("key"))
    return jsx_strings.rewrite_sources(pages.select(path.alias("path"), code.alias("content")), mapping, retarget=True).select("path", "content")


#: Source lines of a component with a string in every place that counts, by what stands before and after the page's number; and what the strings are.
PLACES = [
    ('const LABELS = { title: "Const {n}", href: "/x" };', []),
    ("export default function Page({ ok, name }) {", []),
    (' const items = [{ label: "Item {n}", id: "a" }];', [("Item {n}", "object-property", "label", None, None)]),
    (" return <main>", []),
    ('  <input placeholder="Type {n}" className="c" title={ok ? "Yes {n}" : "No {n}"} />', [("Type {n}", "jsx-attribute", "placeholder", "input", None), ("Yes {n}", "jsx-attribute", "title", "input", None), ("No {n}", "jsx-attribute", "title", "input", None)]),
    ('  <p>{ok ? "Open {n}" : `Closed ${name} {n}`}</p>', [("Open {n}", "jsx-expression", None, "p", None), ("Closed {name} {n}", "jsx-expression", None, "p", None)]),
    ('  <p>{"Plain {n}"}</p>', [("Plain {n}", "jsx-expression", None, "p", None)]),
    ('  <T id="a.b">Wrapped {n}</T>', [("Wrapped {n}", "T-component", None, "main", "a.b")]),
    ('  <i>{t("Called {n}", "a.c")}</i>', [("Called {n}", "t-call", None, "i", "a.c")]),
    ("  <code>Ignored {n}</code>", []),
    (" </main>;", []),
    ("}", []),
]
PLACED = [("Const {n}", "module-object-property", "title", None, None), *[x for _, found in PLACES for x in found]]


def numbered(s, d, text):
    """For each page: page_id, and the text with its number for {n}."""
    return A.table(s, d, "pages").select("page_id", F.replace(F.lit(text), F.lit("{n}"), F.col("page_id").cast("string")).alias("content"))


def quoted(x):
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


@query("SELECT 'p' || page_id AS file, i AS seq, replace(text, '{n}', page_id::VARCHAR) AS text, type, prop, tag, id, CASE WHEN i = 0 THEN NULL ELSE 'Page' END AS component, CASE WHEN i = 0 THEN 'LABELS' END AS const FROM pages, (VALUES " + ", ".join(f"({i}, {quoted(t)}, {quoted(k)}, {quoted(p)}, {quoted(g)}, {quoted(x)})" for i, (t, k, p, g, x) in enumerate(PLACED)) + ") AS v(i, text, type, prop, tag, id)")
def extract_places(s, d):
    """Strings in attributes, branches, templates, properties, constants and calls."""
    files = numbered(s, d, "\n".join(line for line, _ in PLACES)).select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("path"), "content")
    return jsx_strings.extract_strings(files).select("file", F.col("seq"), "text", "type", "prop", "tag", "id", "component", "const")


INLINE = [
    ("export default function Page({ ok, name }) {", 'import { T, useT } from "@/components/t";\nexport default function Page({ ok, name }) {\n\tconst t = useT();'),
    (" return <main>", " return <main>"),
    ('  <input placeholder="Type {n}" className="c" />', '  <input placeholder={t("Type {n}", "p.k{n}")} className="c" />'),
    ('  <b>{ok ? "Open {n}" : `Closed ${name} {n}`}</b>', '  <b>{ok ? t("Open {n}", "p.o{n}") : t("Closed {name} {n}", "p.c{n}", { name })}</b>'),
    ("  <p>Page {n}</p>", '  <p><T id="p.t{n}">Page {n}</T></p>'),
    (" </main>;", " </main>;"),
    ("}", "}"),
]


@query("SELECT 'p' || page_id || '.tsx' AS path, 4 AS replaced, replace(" + quoted("\n".join(["'use client'", *[x for _, x in INLINE]])) + ", '{n}', page_id::VARCHAR) AS content FROM pages")
def rewrite_inline(s, d):
    """Client components in inline mode, which keeps the source texts."""
    files = numbered(s, d, "\n".join(["'use client'", *[x for x, _ in INLINE]])).select(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".tsx")).alias("path"), "content")
    forms = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in (("Type ", "p.k"), ("Open ", "p.o"), ("Closed {name} ", "p.c"), ("Page ", "p.t"))])).alias("x")
    n = F.col("page_id").cast("string")
    mapping = A.table(s, d, "pages").select("page_id", forms).select(F.concat("x.a", n).alias("text"), F.concat("x.b", n).alias("key"))
    return jsx_strings.rewrite_sources(files, mapping, mode="inline").select("path", "replaced", "content")


@query("SELECT count(*) AS files, count(*) FILTER (WHERE n > 0) AS files_modified, sum(n)::BIGINT AS strings_wrapped, count(*) FILTER (WHERE n = 0) AS files_skipped, 0::BIGINT AS client_files FROM (SELECT file, count(key) AS n FROM str LEFT JOIN map USING (text) GROUP BY 1)", "map str")
def codegen_totals(s, d):
    found = graph.saved(A.strings(s, d))
    return jsx_strings.totals(jsx_strings.rewrite_sources(components(s, d, found), A.text_map(s, d, found)))


@query("SELECT 'src/app/p' || a.page_id || '/page.tsx' AS src, 'src/app/p' || b.page_id || '/page.tsx' AS dst FROM pages a JOIN pages b ON b.page_id = 2 * a.page_id UNION SELECT 'src/app/p' || a.page_id || '/page.tsx', 'src/app/p' || b.page_id || '/page.tsx' FROM pages a JOIN pages b ON b.page_id = 3 * a.page_id")
def import_edges(s, d):
    return graph.import_edges(graph.saved(graph.file_facts(A.sources(s, d))), A.ALIASES)


@query(", t(id) AS (SELECT page_id FROM pages WHERE page_id % 10 = 1 UNION SELECT page_id FROM t JOIN pages ON page_id = 2 * id OR page_id = 3 * id) SELECT 'src/app/p' || id || '/page.tsx' AS path FROM t", "src", True)
def client_files(s, d):
    return graph.client_files(A.sources(s, d), A.ALIASES)


@query("SELECT p AS path, CASE WHEN role = 'constant' THEN 'ITEMS' ELSE 'items' END AS name, role, CASE page_id % 4 WHEN 1 THEN 'used outside a component' WHEN 2 THEN 'imported as a whole' WHEN 3 THEN 'imported by a file that stays as it is' END AS reason FROM (SELECT page_id, 'constant' AS role, 'src/lib/p' || page_id || '.ts' AS p FROM pages UNION ALL SELECT page_id, 'import', 'src/app/p' || page_id || '.tsx' FROM pages) WHERE page_id % 5 <> 0")
def factory_plan(s, d):
    return factories.factory_plan(A.content_files(s, d), A.content_map(s, d))


@query("SELECT 'src/lib/p' || page_id || '.ts' AS path, 1 AS replaced, sha256('export const ITEMS = (t: any) => ([{ title: t(\"lib.p' || page_id || '\") }]);' || chr(10)) AS code FROM pages WHERE page_id % 4 = 0 AND page_id % 5 <> 0 UNION ALL SELECT 'src/app/p' || page_id || '.tsx', 0, sha256('import { useTranslations } from \"next-intl\";' || chr(10) || 'import { ITEMS as items } from \"../lib/p' || page_id || '\";' || chr(10) || 'export function Page() {' || chr(10) || chr(9) || 'const t = useTranslations();' || chr(10) || '  return <ul>{items(t).map(i => <li key={i.title}>{i.title}</li>)}</ul>;' || chr(10) || '}' || chr(10)) FROM pages WHERE page_id % 4 = 0 AND page_id % 5 <> 0")
def rewrite_factories(s, d):
    files, mapping = A.content_files(s, d), A.content_map(s, d)
    done = jsx_strings.rewrite_sources(files.where("included"), mapping, factories=factories.factory_plan(files, mapping))
    return done.where("modified").select("path", "replaced", F.sha2("content", 256).alias("code"))


@query("SELECT file, row_number() OVER (PARTITION BY file ORDER BY seq) - 1 AS seq, text || ' <b>{1}</b> {n}' AS composite FROM str", "str")
def composite_context(s, d):
    files = components(s, d).withColumn("content", F.replace("content", F.lit("</p>"), F.lit(" <b></b>{n}</p>")))
    return jsx_strings.extract_strings(files).select("file", "seq", "composite")


@query("SELECT file, 'Known keys:' || chr(10) || (SELECT string_agg('  ' || key || ' <- \"' || text || '\"', chr(10) ORDER BY seq) FROM (SELECT * FROM map ORDER BY seq LIMIT 30)) || chr(10) || 'Strings of ' || file || ':' || chr(10) || string_agg('  \"' || text || '\"' || coalesce(', component: ' || component, '') || ', tag: ' || tag, chr(10) ORDER BY seq) AS prompt FROM str GROUP BY file", "map str")
def keygen_prompt(s, d):
    found = graph.saved(A.strings(s, d))
    return scanning.key_prompts(found, A.text_map(s, d, found))
