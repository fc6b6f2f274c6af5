"""DuckDB expressions that state independently what the jobs compute."""

from __future__ import annotations

LOWER = "abcdefghijklmnopqrstuvwxyz"
NL = "chr(10)"
Q = "chr(34)"
NL_CLASS = "\\n"
TRIM_SET = "' ' || chr(9) || chr(10) || chr(11) || chr(13)"
TRUE_HOST = r"'^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)'"
TRUE_PATH = r"'^(?:(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*)?([^?#]*)'"


def host(url: str) -> str:
    return f"lower(regexp_extract({url}, {TRUE_HOST}, 1))"


def path(url: str) -> str:
    return f"regexp_extract({url}, {TRUE_PATH}, 1)"


def home(url: str) -> str:
    return f"regexp_extract({url}, '^((?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*)', 1)"


def path_key(url: str) -> str:
    pieces = f"string_split(replace({path(url)}, '\\', '/'), '/')"
    safe = f"list_filter({pieces}, lambda s: NOT regexp_matches(s, '(?i)^((\\.|%2e){{1,2}})?$|%2f|%5c'))"
    clean = f"list_transform({safe}, lambda s: regexp_replace(s, '[\\x00-\\x1F\\x7F]', '', 'g'))"
    joined = f"array_to_string(list_filter({clean}, lambda s: s <> ''), '/')"
    return f"ltrim(regexp_replace({joined}, '(?i)\\.(html?|php)$', '') || '/index.md', '/')"


def trimmed(text: str) -> str:
    return f"trim({text}, {TRIM_SET})"


def capitalized(text: str) -> str:
    first = f"translate(left(w, 1), '{LOWER}', '{LOWER.upper()}')"
    return f"array_to_string(list_transform(string_split({text}, ' '), lambda w: {first} || substr(w, 2)), ' ')"


def slug_a(url: str) -> str:
    return capitalized(f"replace(regexp_extract(trim({url}, '/'), '([^/]*)$', 1), '-', ' ')")


def slug_b(url: str, fallback: str) -> str:
    slug = f"coalesce(nullif(regexp_extract(trim({path(url)}, '/'), '([^/]*)$', 1), ''), {fallback})"
    return trimmed(f"replace({capitalized(f'translate({slug}, {chr(39)}-_{chr(39)}, {chr(39)}  {chr(39)})')}, {Q}, '\\' || {Q})")


def plain(html: str) -> str:
    text = f"regexp_replace({html}, '(?si)<script[^>]*?>.*?</script>|<style[^>]*?>.*?</style>', '', 'g')"
    return trimmed(f"regexp_replace({text}, '(?s)<!--.*?-->|<[^\\s>][^>]*>', '', 'g')")


def yaml(text: str) -> str:
    return trimmed(f"replace(replace(replace({plain(text)}, {Q}, '\\' || {Q}), {NL}, ' '), chr(13), '')")


def excerpt(own: str, body: str, words: int, tail: str = "") -> str:
    pieces = f"regexp_split_to_array({plain(body)}, '\\s+')"
    cut = f"array_to_string(list_slice({pieces}, 1, {words}), ' ')"
    made = f"CASE WHEN len({pieces}) > {words} THEN {cut} || '{tail}' ELSE {cut} END"
    return f"coalesce(nullif({own}, ''), {made})"


def squeezed(text: str) -> str:
    return trimmed(f"regexp_replace({text}, '\\n{{3,}}', {NL} || {NL}, 'g')")


def text_markdown(body: str) -> str:
    """Markdown of a body that holds no tags."""
    return squeezed(f"regexp_replace({body}, '[ \\t]+', ' ', 'g')")


def page_markdown(html: str) -> str:
    """Markdown of a test page: an ad, a heading, bold openings and paragraphs."""
    ad = f"regexp_extract({html}, '(?s)<div class=\"ad\">([^<]*)</div>', 1)"
    title = f"regexp_extract({html}, '(?s)<h1>([^<]*)</h1>', 1)"
    rest = f"regexp_extract({html}, '(?s)</h1>(.*)</article>', 1)"
    bold = f"regexp_replace({rest}, '<p><b>([^<]*?)\\s*<br>', '**\\1  ' || {NL} || '**' || {NL} || {NL}, 'g')"
    paragraphs = f"regexp_replace({bold}, '<p>\\s*([^<]*?)\\s*</p>', '\\1' || {NL} || {NL}, 'g')"
    joined = f"{trimmed(ad)} || {NL} || {NL} || '# ' || {trimmed(title)} || {NL} || {NL} || {paragraphs}"
    # the two spaces of a line break survive, other runs become one space
    spaced = f"regexp_replace(regexp_replace({joined}, '[ \\t]+', ' ', 'g'), '(\\*\\*[^*]*?) ?\\n\\*\\*\\n', '\\1  ' || {NL} || '**' || {NL}, 'g')"
    return squeezed(f"replace(replace({spaced}, '&quot;', {Q}), '&amp;', '&')")


def lines(*parts: str) -> str:
    """Text lines out of SQL expressions, each ended by a line break."""
    return " || ".join(f"{part} || {NL}" for part in parts)


def field(key: str, value: str) -> str:
    return f"'{key}: ' || {Q} || {value} || {Q}"


def generic_front_matter(title: str, url: str, kind: str) -> str:
    return lines("'---'", field("title", title), field("url", url), field("type", f"'{kind}'"), "'---'", "''")


# Documents of the test pages, one row per page and one per (site, path).
PAGE_DOCS = f"""page_docs AS (
  SELECT page_id, {host('url')} AS site, {path_key('url')} AS path, url,
         {slug_b('url', host('url'))} AS title,
         {generic_front_matter(slug_b('url', host('url')), 'url', 'sitemap_page')} AS front_matter,
         {page_markdown('html')} AS markdown
  FROM pages)"""
MIRROR = """mirror AS (
  SELECT * FROM page_docs QUALIFY row_number() OVER (PARTITION BY site, path ORDER BY page_id DESC) = 1)"""

NAMES = """names AS (
  SELECT post_id,
         list(name ORDER BY name, term_id) FILTER (taxonomy = 'category') AS categories,
         list(name ORDER BY name, term_id) FILTER (taxonomy = 'post_tag') AS tags
  FROM post_topics JOIN topics USING (term_id) GROUP BY post_id)"""
ENRICHED = """enriched AS (
  SELECT posts.*, display_name AS author, categories, tags, image_url AS featured_image
  FROM posts LEFT JOIN authors USING (author_id) LEFT JOIN names USING (post_id) LEFT JOIN media USING (post_id))"""


def _list_line(key: str) -> str:
    quoted = f"array_to_string(list_transform({key}, lambda v: {Q} || {yaml('v')} || {Q}), ', ')"
    return f"CASE WHEN len({key}) > 0 THEN '{key}: [' || {quoted} || ']' || {NL} ELSE '' END"


POST_FRONT_MATTER = (
    lines(
        "'---'", field("title", yaml("title")), field("url", "permalink"), field("type", "post_type"),
        field("date", "published_on"), field("modified", "modified_on"), field("author", yaml("author")),
        field("excerpt", yaml(excerpt("excerpt", "body", 30))),
    )
    + f" || {_list_line('categories')} || {_list_line('tags')}"
    + f" || CASE WHEN featured_image IS NOT NULL THEN {field('featured_image', 'featured_image')} || {NL} ELSE '' END || "
    + lines("'---'", "''")
)
POST_DOCS = f"""post_docs AS (
  SELECT post_id, {host('permalink')} AS site, {path_key('permalink')} AS path, permalink AS url, post_type,
         {POST_FRONT_MATTER} AS front_matter, {text_markdown('body')} AS markdown,
         CASE WHEN post_status <> 'publish' THEN 'Post not found or not published.'
              WHEN post_type NOT IN ('post', 'page') THEN 'Post type ' || chr(39) || post_type || chr(39) || ' is not allowed in settings.'
              WHEN contains(permalink, '/es/') THEN 'URL is excluded by rules.' END AS reason
  FROM enriched)"""
# The same without an exclusion rule.
POST_DOCS_ALL = POST_DOCS.replace("""
              WHEN contains(permalink, '/es/') THEN 'URL is excluded by rules.'""", "").replace("permalink AS url, post_type,", "permalink AS url, post_type, post_status,")
POST_VIEWS = ["posts", "authors", "topics", "post_topics", "media"]
