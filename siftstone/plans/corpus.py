"""Queries on text, chunks and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.config import EngineConfig
from siftstone.functions import text as T
from siftstone.operators import chunk, prepare
from siftstone.plans.registry import query, sql_clean, sql_strip, table
from siftstone.sources.tables import ranked


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sections of pseudo files: five documents to a file, pages 0 to 4, titles for some."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.concat("source", F.lit("/"), F.floor(F.col("doc_id") / 5).cast("string"), F.lit(".md")).alias("source"),
        (F.col("doc_id") % 5).cast("int").alias("page"),
        F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("Title "), F.col("lang"))).alias("title"),
        F.col("text"),
    )


SECTIONS = """
  SELECT source || '/' || (doc_id // 5)::VARCHAR || '.md' AS source, (doc_id % 5)::INT AS page,
         CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'Title ' || lang END AS title, text FROM documents
"""


def chunks_sql(size: int, overlap: int, least: int = 80) -> str:
    step = size - overlap
    return rf"""
  SELECT *, substr(sha1(source || ':' || chunk_index || ':' || substr(text, 1, 200)), 1, 16) AS chunk_id, length(text) AS char_count,
         CASE WHEN page <> 0 THEN '[' || coalesce(nullif(title, ''), source) || ' - p.' || page || ']' ELSE '[' || coalesce(nullif(title, ''), source) || ']' END || chr(10) || text AS content
  FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY page, pos) - 1 AS chunk_index FROM (
    SELECT source, page, title, i AS pos, {sql_strip(f"substr(text, (i * {step} + 1)::INT, {size})")} AS text FROM (
      SELECT *, unnest(range(0, greatest(1, ceil((length(text) - {overlap}) / {step}::DOUBLE)::INT))) AS i FROM ({SECTIONS})
    )) WHERE length(text) >= {least})
"""


def naive(spark: SparkSession, sf_dir: str, size: int = 1000, overlap: int = 0) -> DataFrame:
    return chunk.build_chunks(sections(spark, sf_dir), EngineConfig(chunk_size=size, chunk_overlap=overlap), "naive")


@query(f"SELECT doc_id, {sql_clean('text')} AS text FROM documents")
def q01_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_text(F.col("text")).alias("text"))


@query(r"""
SELECT page_id, p AS path, CASE WHEN starts_with(p, '/corpus/') THEN substr(p, 9) ELSE p END AS source,
       trim(regexp_replace(regexp_replace(regexp_extract(p, '([^/]*)$', 1), '(.)\.[^.]*$', '\1'), '[_-]', ' ', 'g')) AS title,
       regexp_replace('../../' || substr(p, 2), '^(\.\./)+', '') AS include_path
FROM (SELECT page_id, '/corpus/' || regexp_replace(split_part(split_part(regexp_replace(url, '^https?://', ''), '?', 1), '#', 1), '/$', '') || '_part-' || page_id || '.md' AS p FROM pages)
""")
def q02_path_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", ""), "/$", "")
    paths = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/corpus/"), bare, F.lit("_part-"), F.col("page_id").cast("string"), F.lit(".md")).alias("path"))
    path = F.col("path")
    return paths.select("page_id", "path", T.relative_path(path, "/corpus").alias("source"), T.title_from_path(path).alias("title"), T.include_path(F.concat(F.lit("../../"), F.substring("path", 2, 1 << 20))).alias("include_path"))


@query("SELECT sha1(text) AS k, count(*) AS copies, min(doc_id) AS first_doc, count(DISTINCT source) AS sources FROM documents GROUP BY 1")
def q03_content_key_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(T.content_key(F.col("text")).alias("k")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"), F.countDistinct("source").alias("sources"))


@query(f"SELECT source, page, chunk_index, chunk_id, char_count, text FROM ({chunks_sql(1000, 0)})")
def q04_naive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naive(spark, sf_dir).select("source", "page", "chunk_index", "chunk_id", "char_count", "text")


@query(f"SELECT source, page, chunk_index, chunk_id, char_count FROM ({chunks_sql(1000, 150)})")
def q05_naive_chunks_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naive(spark, sf_dir, 1000, 150).select("source", "page", "chunk_index", "chunk_id", "char_count")


@query(f"SELECT source, chunk_index, sha1(content) AS k, substr(content, 1, 40) AS head FROM ({chunks_sql(800, 0)})")
def q06_header_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naive(spark, sf_dir, 800).select("source", "chunk_index", T.content_key(F.col("content")).alias("k"), F.substring("content", 1, 40).alias("head"))


_STATS = """SELECT count(*) AS count, count(DISTINCT source) AS sources, min(char_count) AS min_chars, list_sort(list(char_count))[(count(*) // 2 + 1)::INT] AS median_chars,
 max(char_count) AS max_chars, round_even(avg(char_count), 0)::BIGINT AS mean_chars FROM"""


@query(f"{_STATS} ({chunks_sql(1000, 0)})")
def q07_chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.chunk_stats(naive(spark, sf_dir))


def _entities(x: str) -> str:
    for name, character in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{character}')"
    return x


def _no_blocks(x: str) -> str:
    for tag in ("script", "style", "nav", "footer", "head"):
        x = rf"regexp_replace({x}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', chr(10), 'g')"
    return x


@query(
    "SELECT page_id, "
    + sql_clean("regexp_replace(" + _entities(rf"regexp_replace({_no_blocks('html')}, '(?s)<!--.*?-->|<[^>]+>', chr(10), 'g')") + r", '[ \t]*\n[ \t\n]*', chr(10), 'g')")
    + " AS text FROM pages"
)
def q08_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


@query("SELECT page_id, coalesce(nullif(trim(" + _entities(r"regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')") + "), ''), url) AS title FROM pages")
def q09_html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.html_title(F.col("html"), F.col("url")).alias("title"))


@query("SELECT coalesce(source, 'unknown') AS source, count(*) AS chunks FROM documents GROUP BY 1")
def q10_source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.source_counts(table(spark, sf_dir, "documents"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN source || ', page ' || doc_id % 4 ELSE source END AS location,
       CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '...' ELSE text END AS snippet FROM documents
""")
def q11_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.location(F.col("source"), F.col("doc_id") % 4).alias("location"), T.snippet(F.col("text")).alias("snippet"))


_SWEEP = " UNION ALL ".join(f"SELECT {size} AS size, {overlap} AS overlap, * FROM ({_STATS} ({chunks_sql(size, overlap)}))" for size, overlap in ((500, 75), (800, 120), (1000, 150), (1500, 225)))


@query(_SWEEP)
def q30_sweep_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftstone.operators.evaluate import SWEEP

    rows = [chunk.chunk_stats(naive(spark, sf_dir, s, o)).select(F.lit(s).alias("size"), F.lit(o).alias("overlap"), "*") for s, o in SWEEP]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS batch FROM documents")
def q43_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive batches of 64 by rank, without a window over all rows."""
    numbered = ranked(table(spark, sf_dir, "documents").select("doc_id"), [F.asc("doc_id")], "batches", "place")
    return numbered.select("doc_id", F.expr("place div 64").alias("batch"))


_PAGES = [
    ("guide/intro.md", "Start here.\n\n{* ../../code/app.py hl[2] *}\n\nThen:\n\n{* ../../code/sub/run.sh title[\"bin/run.sh\"] *}\nEnd { #end }\n"),
    ("guide/missing.md", "Before\n\n{* ../code/nowhere.py *}\n\nAfter"),
    ("img/skip.md", "never"),
    ("release-notes.md", "never"),
    ("plain.md", "/// note | Read this\nInside.\n///\n\n//// warning\nNested\n/// TIP\nx\n///\n////\n\n## Title { #title }\n\n\n\nText " + "word " * 60),
]
_CODE = [("code/app.py", "print('a')\nprint('b')\n"), ("code/sub/run.sh", "\nrun --now\n")]


def _values(rows: list[tuple[str, ...]]) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


@query(rf"""
WITH page(rel_path, text) AS (VALUES {_values(_PAGES)}), code(path, body) AS (VALUES {_values(_CODE)}),
found AS (SELECT rel_path, unnest(regexp_extract_all(text, '(?m)^\{{\*\s*\S+?\s*(?:\w+\[[^\]]*\]\s*)*\*\}}')) AS d FROM page),
parsed AS (SELECT rel_path, regexp_replace(regexp_extract(d, '^\{{\*\s*(\S+)', 1), '^(\.\./)+', '') AS path, regexp_extract(d, 'title\["?([^"\]]+)"?\]', 1) AS title FROM found)
SELECT rel_path, path, coalesce(nullif(title, ''), regexp_extract(path, '([^/]*)$', 1)) AS caption,
       CASE WHEN path LIKE '%.py' THEN 'python' ELSE regexp_extract(path, '\.([^./]*)$', 1) END AS language, code.path IS NULL AS missing,
       coalesce({sql_strip('body')}, '') AS code
FROM parsed LEFT JOIN code USING (path)
""")
def q46_include_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, code = spark.createDataFrame(_PAGES, "rel_path string, text string"), spark.createDataFrame(_CODE, "path string, body string")
    found = prepare.directives(pages).join(code.withColumn("there", F.lit(True)), "path", "left")
    return found.select("rel_path", "path", "caption", T.code_language(F.col("path")).alias("language"), F.col("there").isNull().alias("missing"), F.coalesce(T.strip(F.col("body")), F.lit("")).alias("code"))


_OPENER = r"^/{3,}\s+(\w+)(?:\s*\|\s*(.*))?$"
_INCLUDE_LINE = r"^\{\*\s*(\S+?)\s*((?:\w+\[[^\]]*\]\s*)*)\*\}\s*$"


@query(rf"""
WITH page(rel_path, text) AS (VALUES {_values(_PAGES)}), code(path, body) AS (VALUES {_values(_CODE)}),
kept AS (SELECT * FROM page WHERE rel_path LIKE '%.md' AND rel_path NOT LIKE 'img/%' AND rel_path <> 'release-notes.md'),
line AS (SELECT rel_path, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM kept),
named AS (SELECT *, regexp_matches(l, '{_INCLUDE_LINE}') AS include, regexp_replace(regexp_extract(l, '{_INCLUDE_LINE}', 1), '^(\.\./)+', '') AS path,
  coalesce(nullif(regexp_extract(l, 'title\["?([^"\]]+)"?\]', 1), ''), regexp_extract(regexp_extract(l, '{_INCLUDE_LINE}', 1), '([^/]*)$', 1)) AS caption FROM line),
woven AS (SELECT rel_path, n, include, body, CASE WHEN NOT include THEN l WHEN body IS NULL THEN '' ELSE 'Example (`' || caption || '`):' || chr(10) || chr(10) || '```' ||
  CASE WHEN path LIKE '%.py' THEN 'python' ELSE regexp_extract(path, '\.([^./]*)$', 1) END || chr(10) || {sql_strip('body')} || chr(10) || '```' END AS l FROM named LEFT JOIN code USING (path)),
flat AS (SELECT rel_path, n, include, body, CASE WHEN regexp_matches(l, '{_OPENER}') THEN '**' || upper(substr(regexp_extract(l, '{_OPENER}', 1), 1, 1)) || lower(substr(regexp_extract(l, '{_OPENER}', 1), 2)) || ':' ||
  CASE WHEN trim(regexp_extract(l, '{_OPENER}', 2)) = '' THEN '' ELSE ' ' || trim(regexp_extract(l, '{_OPENER}', 2)) END || '**' WHEN regexp_matches(l, '^/{{3,}}\s*$') THEN '' ELSE regexp_replace(l, '\s*\{{\s*#[\w-]+\s*\}}\s*$', '') END AS l FROM woven),
seen AS (SELECT f.*, last_value(CASE WHEN trim(o.l) <> '' THEN o.include OR regexp_matches(o.l, '^/{{3,}}\s*$|\{{\s*#[\w-]+\s*\}}\s*$') END IGNORE NULLS) OVER (PARTITION BY rel_path ORDER BY n ROWS UNBOUNDED PRECEDING) AND trim(o.l) = '' AS eaten FROM flat f JOIN named o USING (rel_path, n)),
whole AS (SELECT rel_path, {sql_strip("regexp_replace(string_agg(l, chr(10) ORDER BY n), '\\n{3,}', chr(10) || chr(10), 'g')")} || chr(10) AS text, count(body) AS inlined, count(*) FILTER (include AND body IS NULL) AS missing FROM seen WHERE NOT eaten OR eaten IS NULL GROUP BY rel_path)
SELECT replace(rel_path, '/', '__') AS name, rel_path, text, inlined, missing, length(text) >= 200 AS kept FROM whole
""")
def q47_prepared_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, code = spark.createDataFrame(_PAGES, "rel_path string, text string"), spark.createDataFrame(_CODE, "path string, text string")
    return prepare.prepare(pages, code)


@query()
def q48_structured_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.build_chunks(sections(spark, sf_dir)).select("source", "page", "chunk_index", "chunk_id", "char_count", "text")


_SKIPPED = ", ".join(f"'{x}'" for x in prepare.SKIPPED_DIRS)


@query(rf"""
WITH paths AS (SELECT doc_id, length(text) AS n, CASE doc_id % 5 WHEN 0 THEN 'docs/img/' WHEN 1 THEN 'docs/' WHEN 2 THEN 'js/x/' ELSE '' END || source || '/' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.MD' WHEN 1 THEN '.md' WHEN 2 THEN '.pdf' ELSE '.csv' END AS path FROM documents)
SELECT doc_id, path, lower(regexp_extract(path, '(\.[^./]*)$', 1)) AS suffix,
       lower(regexp_extract(path, '(\.[^./]*)$', 1)) IN ('.pdf', '.md', '.markdown', '.txt', '.rst', '.html', '.htm', '.docx') AS supported,
       path LIKE '%.md' AND len(list_intersect(string_split(path, '/')[:-2], [{_SKIPPED}])) = 0 AS is_page,
       n >= 200 AS long_enough, replace(path, '/', '__') AS name
FROM paths
""")
def q51_path_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    top = F.when(n % 5 == 0, "docs/img/").when(n % 5 == 1, "docs/").when(n % 5 == 2, "js/x/").otherwise("")
    end = F.when(n % 4 == 0, ".MD").when(n % 4 == 1, ".md").when(n % 4 == 2, ".pdf").otherwise(".csv")
    paths = table(spark, sf_dir, "documents").select("doc_id", F.concat(top, "source", F.lit("/"), n.cast("string"), end).alias("path"), F.length("text").alias("n"))
    path = F.col("path")
    return paths.select("doc_id", "path", T.suffix(path).alias("suffix"), T.suffix(path).isin(*T.SUFFIXES).alias("supported"), prepare.is_page(path).alias("is_page"), (F.col("n") >= 200).alias("long_enough"), prepare.flat_name(path).alias("name"))


@query(r"""
SELECT source, count(*) AS sections, sum(length(text))::BIGINT AS chars FROM (
  SELECT source, text FROM documents UNION ALL
  SELECT regexp_extract(url, '^https?://([^/]+)', 1), regexp_replace(html, '<[^>]+>', ' ', 'g') FROM pages) GROUP BY source
""")
def q52_section_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("source"), F.regexp_replace("html", "<[^>]+>", " ").alias("text"))
    both = table(spark, sf_dir, "documents").select("source", "text").unionByName(pages)
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("sections"), F.sum(F.length("text")).alias("chars"))


@query("SELECT doc_id, text, replace('org/model-' || lang, '/', '_') AS slug, sha1(text) AS k FROM documents")
def q53_sidecar_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON lines in the shared folder and back."""
    from siftstone.sources.tables import read_json_lines, scratch

    path = scratch(spark, "sidecar")
    table(spark, sf_dir, "documents").select("doc_id", "text", "lang").write.json(path)
    back = read_json_lines(spark, path, "doc_id bigint, text string, lang string")
    return back.select("doc_id", "text", T.model_slug(F.concat(F.lit("org/model-"), "lang")).alias("slug"), T.content_key(F.col("text")).alias("k"))
