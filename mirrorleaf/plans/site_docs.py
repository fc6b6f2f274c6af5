"""Documents derived from a whole site: index, full export, summary.

They are tables of lines or chunks with an order, never one string per site, so
a site may hold any share of the corpus. The sinks below write them as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mirrorleaf.config import BUILT_IN_TYPES, SUMMARY_POSTS, SUMMARY_WORDS, MirrorConfig
from mirrorleaf.functions.encoding import repair_text
from mirrorleaf.functions.text import excerpt, list_date, plain_text
from mirrorleaf.functions.urls import home_of, markdown_url, url_host, with_slash
from mirrorleaf.operators.entities import union_all
from mirrorleaf.operators.filters import published
from mirrorleaf.operators.ordered import running_total
from mirrorleaf.operators.ranking import main_sections, newest_first, top_per_group
from mirrorleaf.operators.render import to_markdown
from mirrorleaf.operators.stats import type_counts
from mirrorleaf.session import remove_folder, small_batches, store_table
from mirrorleaf.sources.store import document, site_bucket

# ---- fixed values -----------------------------------------------------------
# Shortcodes that excerpts of a summary leave out.
SHORTCODES = ("audio", "caption", "embed", "gallery", "playlist", "video", "wp_caption")
ACCESS = (
    "## Access",
    "",
    "Any page on this site can be retrieved as Markdown by:",
    "1. Adding `?format=markdown` to any URL",
    "2. Sending `Accept: text/markdown` in the HTTP request headers",
)
INDEX_TITLE, EXPORT_TITLE, POSTS_TITLE = "# Sitemap — ", "# Complete Content — ", " — Full Content"
ABOUT_HEAD, SECTIONS_HEAD, RECENT_HEAD, TYPES_HEAD = "About", "Main Sections", "Recent Posts", "Content Types"
RESOURCES_HEAD = "Resources"
# Links of a summary: title, address below the home address, description.
RESOURCE_LINKS = (
    ("Full Markdown Content", "llms-full.txt", "Complete site content in markdown"),
    ("Sitemap", "?format=markdown", "Homepage / sitemap in markdown format"),
    ("XML Sitemap", "wp-sitemap.xml", "Standard XML sitemap"),
)
ABOUT, SECTIONS, RECENT, TYPES, RESOURCES, ACCESS_RANK = range(1, 7)
# -----------------------------------------------------------------------------
SHARD_BYTES = 64 * 1024 * 1024


def _stamp(run_ts) -> Column:
    return F.date_format(F.lit(run_ts).cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss")


def _text(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _fixed_lines(sites: DataFrame, lines: list, rank: int | None = None) -> DataFrame:
    """The same few lines for every site; strings are literals."""
    rows = F.posexplode(F.array(*[_text(line) for line in lines])).alias("seq", "line")
    keys = ["site"] if rank is None else ["site", F.lit(rank).alias("section_rank")]
    return sites.select(*keys, rows).withColumn("seq", F.col("seq").cast("bigint"))


def site_index(mirror: DataFrame, sites: DataFrame, run_ts, parts: int | None = None) -> DataFrame:
    """(site, seq, path, line): header, then one line per document in path order.

    Reads four narrow columns of the mirror, no document text.
    """
    narrow = mirror.select("site", "path", "title", "url")
    return index_lines(running_total(narrow, "site", "path", F.lit(1), "n", parts), sites, run_ts)


def index_lines(numbered: DataFrame, sites: DataFrame, run_ts) -> DataFrame:
    """The lines of ``site_index`` from documents (site, path, title, url) with their number ``n`` from 1."""
    header = _fixed_lines(
        sites,
        [
            F.concat(F.lit(INDEX_TITLE), "name"),
            "",
            F.concat(F.lit("Generated: "), _stamp(run_ts)),
            "",
        ],
    ).withColumn("path", F.lit(""))
    line = F.concat(
        F.lit("- ["), "title", F.lit("]("), "url", F.lit(") — `"), "path", F.lit("`")
    )
    entries = numbered.select("site", (F.col("n") + 3).alias("seq"), repair_text(line).alias("line"), "path")
    return header.unionByName(entries).select("site", "seq", "path", "line")


def shards(summed: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(site, path, shard) of documents with ``upto``, the bytes of their site up to and with them."""
    return summed.select("site", "path", F.floor(F.col("upto") / F.lit(shard_bytes)).cast("bigint").alias("shard"))


def full_export(
    mirror: DataFrame,
    sites: DataFrame,
    run_ts,
    shard_bytes: int = SHARD_BYTES,
    parts: int | None = None,
) -> DataFrame:
    """(site, shard, path, chunk): header, then every document in path order.

    A shard ends after ``shard_bytes`` of document text. Shards are found on
    narrow rows; document text is shuffled once, by (site, path).
    """
    counts = mirror.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    header = sites.join(counts, "site", "left").select(
        "site",
        F.lit(0).cast("bigint").alias("shard"),
        F.lit("").alias("path"),
        F.concat(
            F.lit(EXPORT_TITLE), "name",
            F.lit("\n\nGenerated: "), _stamp(run_ts),
            F.lit("\nTotal pages: "), F.coalesce("pages", F.lit(0)).cast("string"),
            F.lit("\n\n---\n\n"),
        ).alias("chunk"),
    )
    sizes = mirror.select("site", "path", "bytes")
    placed = shards(running_total(sizes, "site", "path", F.col("bytes"), "upto", parts), shard_bytes)
    chunk = F.concat(F.lit("<!-- Source: "), "path", F.lit(" -->\n\n"), document(), F.lit("\n\n---\n\n"))
    chunks = mirror.select("site", "path", chunk.alias("chunk")).join(placed, ["site", "path"])
    return header.unionByName(chunks).select("site", "shard", "path", "chunk")


def export_from_posts(posts: DataFrame, sites: DataFrame, run_ts, cfg: MirrorConfig) -> DataFrame:
    """(site, menu_order, title, post_id, chunk): full export straight from published posts.

    Sort by the leading columns; the header has no post.
    """
    small_batches(posts.sparkSession)
    header = sites.select(
        "site",
        F.lit(None).cast("int").alias("menu_order"),
        F.lit(None).cast("string").alias("title"),
        F.lit(None).cast("bigint").alias("post_id"),
        F.concat(
            F.lit("# "), "name", F.lit(f"{POSTS_TITLE}\n\nGenerated: "), _stamp(run_ts), F.lit("\n\n---\n\n")
        ).alias("chunk"),
    )
    public = published(posts).where(F.col("post_type").isin(*cfg.public_types))
    chunk = F.concat(
        F.lit("## "), "title", F.lit("\n\nURL: "), "permalink", F.lit("\nType: "), "post_type",
        F.lit("\n\n"), to_markdown("body", home_of("permalink")), F.lit("\n\n---\n\n"),
    )
    chunks = public.select(
        url_host("permalink").alias("site"), F.col("menu_order").cast("int").alias("menu_order"),
        "title", "post_id", chunk.alias("chunk"),
    )
    return header.unionByName(chunks)


def _strip_shortcodes(text: Column) -> Column:
    names = "|".join(SHORTCODES)
    return F.regexp_replace(text, rf"(?s)\[({names})\b[^\]]*\](?:(?:(?!\[\1\b).)*?\[/\1\])?", "")


def _section(rank: int, title: str, lines: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """Heading, numbered lines (site, n, line) and a blank line, where there are lines.

    ``counted`` may pass as many rows of each site that are cheaper to count.
    """
    size = (lines if counted is None else counted).groupBy("site").agg(F.count(F.lit(1)).alias("size"))
    frame = size.select(
        "site",
        F.explode(
            F.array(
                F.struct(F.lit(0).cast("bigint").alias("seq"), F.lit(f"## {title}").alias("line")),
                F.struct(F.lit(1).cast("bigint").alias("seq"), F.lit("").alias("line")),
                F.struct((F.col("size") + 2).alias("seq"), F.lit("").alias("line")),
            )
        ).alias("row"),
    ).select("site", F.lit(rank).alias("section_rank"), "row.seq", "row.line")
    body = lines.select(
        "site", F.lit(rank).alias("section_rank"), (F.col("n") + 1).cast("bigint").alias("seq"), "line"
    )
    return frame.unionByName(body)


def site_summary(
    posts: DataFrame,
    sites: DataFrame,
    cfg: MirrorConfig,
    types: DataFrame | None = None,
    parts: int | None = None,
) -> DataFrame:
    """(site, section_rank, seq, line) of each site's summary document.

    ``types`` may name custom types: (post_type, label, archive_path).
    """
    here = posts.withColumn("site", url_host("permalink"))
    home = with_slash("home_url")
    intro = _fixed_lines(
        sites, [F.concat(F.lit("# "), "name"), "", F.concat(F.lit("> "), "description"), ""], 0
    )
    about = _fixed_lines(
        sites,
        [
            f"## {ABOUT_HEAD}", "",
            F.concat(F.lit("Website: "), home), F.concat(F.lit("Language: "), "language"), "",
        ],
        ABOUT,
    )
    shown = ["site", "permalink", "title"]

    own = F.col("excerpt") if "excerpt" in posts.columns else None
    words = excerpt(own, _strip_shortcodes(F.col("body")), SUMMARY_WORDS, "...")
    tops = main_sections(here)
    place = F.struct("menu_order", "title", "post_id").alias("place")
    numbered = running_total(tops.select("site", "post_id", place), "site", "place", F.lit(1), "n", parts)
    # texts are cut once, where they are read, and meet their numbers by the unique post
    texts = tops.select("post_id", "permalink", "title", plain_text(words).alias("words"))
    sections = numbered.select("site", "post_id", "n").join(texts, "post_id").select(
        "site",
        "n",
        F.concat(
            F.lit("- ["), "title", F.lit("]("), markdown_url("permalink"), F.lit("): "), "words"
        ).alias("line"),
    )
    blog = published(here).where(F.col("post_type") == "post")
    newest = top_per_group(
        blog.select(*shown, "post_id", "published_on"), ["site"], newest_first(), SUMMARY_POSTS
    )
    recent = newest.select(
        "site",
        F.col("rank").alias("n"),
        F.concat(
            F.lit("- ["), "title", F.lit("]("), markdown_url("permalink"), F.lit(") ("),
            list_date("published_on"), F.lit(")"),
        ).alias("line"),
    )
    sections_ = [
        intro, about,
        _section(SECTIONS, SECTIONS_HEAD, sections, numbered),
        _section(RECENT, RECENT_HEAD, recent),
    ]
    custom = [t for t in cfg.public_types if t not in BUILT_IN_TYPES]
    if custom:
        sections_.append(_content_types(here, sites, custom, types))
    resources = [
        F.concat(F.lit(f"- [{title}]("), home, F.lit(f"{rest}): {text}")) for title, rest, text in RESOURCE_LINKS
    ]
    sections_.append(_fixed_lines(sites, [f"## {RESOURCES_HEAD}", "", *resources, ""], RESOURCES))
    sections_.append(_fixed_lines(sites, list(ACCESS), ACCESS_RANK))
    return union_all(sections_).withColumn("line", repair_text("line"))


def _content_types(
    posts: DataFrame, sites: DataFrame, custom: list[str], types: DataFrame | None
) -> DataFrame:
    """Counts of custom types; the heading stands even if every count is zero."""
    counts = type_counts(posts.where(F.col("post_type").isin(*custom)), ("site",))
    named = counts if types is None else counts.join(types, "post_type", "left")
    label = F.col("post_type") if types is None else F.coalesce("label", "post_type")
    named = named.join(sites.select("site", "home_url"), "site")
    line = F.concat(F.lit("- **"), label, F.lit("** ("), F.col("published").cast("string"), F.lit(" items)"))
    if types is not None:
        url = F.concat(with_slash("home_url"), "archive_path")
        line = F.concat(
            line, F.coalesce(F.concat(F.lit(" — ["), url, F.lit("]("), url, F.lit(")")), F.lit(""))
        )
    by_name = Window.partitionBy("site").orderBy("post_type")  # at most one row per type
    lines = named.select("site", F.row_number().over(by_name).alias("n"), line.alias("line"))
    frame = _fixed_lines(sites, [f"## {TYPES_HEAD}", ""], TYPES)
    body = lines.select("site", F.lit(TYPES).alias("section_rank"), (F.col("n") + 1).cast("bigint").alias("seq"), "line")
    last = sites.join(lines.groupBy("site").agg(F.max("n").alias("size")), "site", "left").select(
        "site",
        F.lit(TYPES).alias("section_rank"),
        (F.coalesce("size", F.lit(0)) + 2).cast("bigint").alias("seq"),
        F.lit("").alias("line"),
    )
    return union_all([frame, body, last])


def write_lines(lines: DataFrame, path: str, order: list[str], text: str = "line") -> None:
    """Write ordered text; part files of a site follow the order.

    A folder holds the sites of one bucket, a folder in it one site. Lines are stored
    before they are dealt into ranges, whose sampling would make every line twice.
    """
    spark = lines.sparkSession
    stored, folder = store_table(spark, lines, "lines")
    (
        stored.repartitionByRange(site_bucket(), "site", *order)
        .sortWithinPartitions(site_bucket(), "site", *order)
        .select(site_bucket().alias("bucket"), "site", _without_break(text).alias("value"))
        .write.mode("overwrite")
        .partitionBy("bucket", "site")
        .text(path)
    )
    remove_folder(spark, folder)


def write_site_documents(
    mirror: DataFrame, sites: DataFrame, posts: DataFrame, cfg: MirrorConfig, run_ts, folder: str
) -> None:
    """Everything that follows a finished run: index, full export, summary.

    Without the export of the mirror, the full document is made from the posts.
    """
    write_lines(site_index(mirror, sites, run_ts), f"{folder}/index", ["seq"])
    if cfg.generate_export:
        write_export(full_export(mirror, sites, run_ts), f"{folder}/full")
    if cfg.generate_summary:
        write_lines(site_summary(posts, sites, cfg), f"{folder}/summary", ["section_rank", "seq"])
        if not cfg.generate_export:
            order = ["menu_order", "title", "post_id"]  # the header has none and comes first
            write_lines(export_from_posts(posts, sites, run_ts, cfg), f"{folder}/full", order, "chunk")


def _without_break(text: str) -> Column:
    """Text without its last line break, which the text sink writes itself."""
    return F.regexp_replace(text, r"\n\z", "")


def write_export(export: DataFrame, path: str) -> None:
    """Write a full export, one folder and one file per site and shard, sites in buckets.

    A shard is bounded, so it fits a task; a large site has many.
    """
    (
        export.repartition("site", "shard")
        .sortWithinPartitions(site_bucket(), "site", "shard", "path")
        .select(site_bucket().alias("bucket"), "site", "shard", _without_break("chunk").alias("value"))
        .write.mode("overwrite")
        .partitionBy("bucket", "site", "shard")
        .text(path)
    )
