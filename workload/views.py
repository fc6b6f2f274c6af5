"""Input tables of the mirror jobs, derived from the test tables.

Each view is one SQL text that Spark and DuckDB both run; ``{S}`` is the string
type of the engine and ``{documents}`` and the like name the source tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TERM_ID = "cast(CASE lang WHEN 'de' THEN 1 WHEN 'en' THEN 2 WHEN 'es' THEN 3 ELSE 4 END AS int)"
HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1))"
# Characters of the test texts, and how they look after a wrong reading.
ACCENTED = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"


def _misread(char: str) -> str:
    return "".join(
        bytes([b]).decode("cp1250", "ignore") or chr(b) for b in char.encode("utf-8")
    )


def _broken(column: str) -> str:
    for char in ACCENTED:
        column = f"replace({column}, '{char}', '{_misread(char)}')"
    return column


VIEWS = {
    "posts": """
SELECT doc_id AS post_id,
       concat('https://', source, '.example.com/', lang, '/', cast(doc_id AS {S}), '/') AS permalink,
       substr(split_part(text, chr(10), 1), 1, 60) AS title,
       CASE WHEN doc_id % 5 = 0 THEN 'page' WHEN doc_id % 11 = 0 THEN 'product' ELSE 'post' END AS post_type,
       CASE WHEN doc_id % 7 = 3 THEN 'draft' ELSE 'publish' END AS post_status,
       cast(substr(source, 4) AS int) AS author_id,
       cast(doc_id % 10 AS int) AS menu_order,
       CASE WHEN doc_id % 10 = 5 THEN doc_id - 5 ELSE 0 END AS parent_id,
       concat('2024-', lpad(cast(1 + doc_id % 12 AS {S}), 2, '0'), '-', lpad(cast(1 + doc_id % 28 AS {S}), 2, '0')) AS published_on,
       concat('2025-01-', lpad(cast(1 + doc_id % 28 AS {S}), 2, '0')) AS modified_on,
       CASE WHEN doc_id % 6 = 1 THEN concat('Own "summary" <i>of</i> ', cast(doc_id AS {S})) ELSE '' END AS excerpt,
       lang, text AS body
FROM {documents}""",
    "authors": """
SELECT DISTINCT cast(substr(source, 4) AS int) AS author_id, concat('Author ', source) AS display_name,
       concat('Writes as ', source) AS bio,
       concat('https://', source, '.example.com/author/', source, '/') AS url FROM {documents}""",
    "terms": f"""
SELECT DISTINCT {TERM_ID} AS term_id, 'language' AS taxonomy, lang AS name,
       concat('Texts in <b>', lang, '</b>') AS description,
       concat('https://www.example.com/language/', lang, '/') AS url FROM {{documents}}""",
    "post_terms": f"SELECT doc_id AS post_id, {TERM_ID} AS term_id FROM {{documents}}",
    # categories and tags: one term per language and per quality label
    "topics": f"""
SELECT DISTINCT {TERM_ID} AS term_id, 'category' AS taxonomy, concat('In ', lang) AS name FROM {{documents}}
UNION ALL SELECT DISTINCT cast(10 + quality AS int), 'post_tag', concat('quality "', cast(quality AS {{S}}), '"') FROM {{labels}}
UNION ALL SELECT DISTINCT cast(20 + toxic AS int), 'post_tag', concat('toxic ', cast(toxic AS {{S}})) FROM {{labels}}""",
    "post_topics": f"""
SELECT doc_id AS post_id, {TERM_ID} AS term_id FROM {{documents}} WHERE doc_id % 4 <> 2
UNION ALL SELECT doc_id, cast(10 + quality AS int) FROM {{labels}}
UNION ALL SELECT doc_id, cast(20 + toxic AS int) FROM {{labels}}""",
    "media": """
SELECT doc_id AS post_id, concat('https://', source, '.example.com/img/', cast(doc_id AS {S}), '.png') AS image_url
FROM {documents} WHERE doc_id % 9 = 4""",
    "sites": f"""
SELECT DISTINCT {HOST} AS site, concat('https://', {HOST}, '/') AS home_url, concat('Site ', {HOST}) AS name,
       concat('Pages of ', {HOST}) AS description, 'en-US' AS language FROM {{pages}}""",
    "post_sites": """
SELECT DISTINCT concat(source, '.example.com') AS site, concat('https://', source, '.example.com/') AS home_url,
       concat('Site ', source) AS name, concat('Posts of ', source) AS description, 'en-US' AS language
FROM {documents}""",
    "changes": """
SELECT event_id AS change_id, ts, user_id AS post_id,
       CASE WHEN event_type = 'error' THEN 'delete' ELSE 'save' END AS op,
       event_type = 'view' AS is_revision, event_type = 'signup' AND event_id % 2 = 0 AS is_autosave
FROM {events}""",
    "requests": """
SELECT page_id AS request_id,
       CASE WHEN page_id % 8 <> 5 THEN url WHEN contains(url, '#') THEN replace(url, '#', '?format=markdown#')
            WHEN contains(url, '?') THEN concat(url, '&format=markdown') ELSE concat(url, '?format=markdown') END AS uri,
       CASE page_id % 4 WHEN 0 THEN 'Text/Markdown, */*' WHEN 1 THEN 'text/html'
            WHEN 2 THEN 'application/markdown;q=0.9' ELSE '' END AS accept
FROM {pages}""",
    # some pages came back empty or without text
    "fetched": """
SELECT page_id, url,
       CASE page_id % 10 WHEN 7 THEN '' WHEN 8 THEN '<html><body> <script>x()</script><p> </p></body></html>'
            ELSE html END AS html
FROM {pages}""",
    # odd addresses made out of the page URLs
    "odd_urls": """
SELECT page_id,
       CASE page_id % 10 WHEN 0 THEN url WHEN 1 THEN concat(url, '/a/../b/./c')
            WHEN 2 THEN replace(url, '/en/', '/%2e%2E/%2E/') WHEN 3 THEN concat('http://H.example/a%2Fb/x%5cy/', cast(page_id AS {S}), '.PHP')
            WHEN 4 THEN concat('https://h.example//a///', cast(page_id AS {S}), '//') WHEN 5 THEN concat('/rel/', cast(page_id AS {S}), '.htm?x=/y.html')
            WHEN 6 THEN concat('https://u:p@h.example:8080/%zz/+/a b/', cast(page_id AS {S})) WHEN 7 THEN 'https://h.example?q=1'
            WHEN 8 THEN concat('https://h.example/my-long_page-', cast(page_id AS {S}), '/.html')
            ELSE concat('https://h.example/a', chr(9), 'b/', chr(1), '/', cast(page_id AS {S})) END AS url
FROM {pages}""",
    # fetched pages for the posts whose stored body is a shortcode or markup only
    "stored_posts": """
SELECT post_id, permalink, CASE post_id % 3 WHEN 0 THEN body WHEN 1 THEN '' ELSE '<p> <br></p>' END AS body FROM posts""",
    "post_pages": """
SELECT post_id AS page_id, permalink AS url,
       concat('<html><head><title>', cast(post_id AS {S}), '</title></head><body><p>Page ', cast(post_id AS {S}), '</p></body></html>') AS html
FROM posts WHERE post_id % 4 <> 0""",
    # one page per document that uses most elements
    "rich_pages": """
SELECT doc_id AS page_id, concat('https://', source, '.example.com/rich/', cast(doc_id AS {S})) AS url,
       concat('<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><BODY class="x"><nav><a href="/">home</a></nav>',
              '<header>top</header><h2>No. <em>', cast(doc_id AS {S}), '</em></h2>', chr(13), chr(10),
              '<p>By  <strong>', source, '</strong> in <a href="/l/', lang, '">', lang, '</a><br>', cast(n_chars AS {S}), ' characters',
              '<ul><li>one <b>bold</b><li>two<ol start="4"><li>', lang, '</li><li>', source, '</ol></li></ul>',
              '<table><thead><tr><th>id<th>lang</thead><tbody><tr><td>', cast(doc_id AS {S}), '<tr><td>', lang, '</td><td>x</td></tr></table>',
              '<blockquote><p>a</p><p>', source, '</p></blockquote><hr>',
              '<pre><code class="hl language-sql">SELECT  ', cast(doc_id AS {S}), ' &lt; 1</code></pre>',
              '<p>use <code>f(', cast(doc_id AS {S}), ')</code> <img src="/i/', cast(doc_id AS {S}), '.png" alt="pic"> end',
              '<script>var t="</p>";</script><!-- gone --><section><div> 0 </div></section><footer>f</footer></BODY></html>') AS html
FROM {documents}""",
    # structured data in front of the page body
    "linked_pages": """
SELECT page_id, url, replace(html, '</head>', concat(
       CASE page_id % 4
         WHEN 0 THEN concat('<script type="application/ld+json">{{"@context":"https://schema.org","@graph":[{{"@type":"BreadcrumbList","n":1}},{{"@type":["WebPage","Article"],"url":"', url, '","n":', cast(page_id AS {S}), '}}]}}</script>')
         WHEN 1 THEN '<script type="application/ld+json">{{"@type":"BreadcrumbList"}}</script>'
         WHEN 2 THEN concat('<script type=''application/ld+json''> [{{"@type":"Article","tags":[],"url":"', url, '"}},{{"@type":"BreadcrumbList"}}] </script><script type="application/ld+json">[{{"@type":"Article","tags":[],"url":"', url, '"}}]</script>')
         ELSE '<script type="application/ld+json">{{"@type": oops&#33;}}</script>' END, '</head>')) AS html
FROM {pages}""",
    # texts that were read in the wrong code page
    "misread": f"SELECT doc_id, text, {_broken('text')} AS broken FROM {{documents}}",
}
# Views that read other views.
DEPENDS = {"stored_posts": ["posts"], "post_pages": ["posts"]}
TABLES = ("pages", "documents", "events", "labels")


def duckdb_with(names: list[str], *more: str) -> str:
    """WITH clause of the named views and of further CTE texts."""
    wanted: list[str] = []
    for name in names:
        for view in [*DEPENDS.get(name, []), name]:
            if view not in wanted:
                wanted.append(view)
    own = [
        f"{v} AS ({VIEWS[v].format(S='varchar', **{t: t for t in TABLES})})" for v in wanted
    ]
    return "WITH " + ",\n".join([*own, *more]) + "\n"


# Schemas of the source tables; without them each read starts with a footer job.
SCHEMAS = {
    "pages": "page_id bigint, url string, html string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    needed = DEPENDS.get(name, [])
    text = f"{' '.join(VIEWS[v] for v in needed)} {VIEWS[name]}"
    tables = {t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in text}
    marks = {t: f"{{{t}}}" for t in TABLES}
    sql = VIEWS[name].format(S="string", **marks)
    for other in needed:
        sql = f"WITH {other} AS ({VIEWS[other].format(S='string', **marks)})" + sql
    # the braces that are left in a view are no marks: double them for the formatter
    sql = sql.replace("{", "{{").replace("}", "}}")
    for t in tables:
        sql = sql.replace("{{" + t + "}}", "{" + t + "}")
    return spark.sql(sql, **tables)
