"""Chapter content: extraction, sanitizing, frames, and the graph of references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.encodings import decode_text, effective_encoding
from ..functions.markup import attribute_pieces, bound, in_tags, keep_attributes, piece_name, piece_value, tag_of, token_name, tokens_of, without_elements
from ..functions.paths import fragment_of, is_external, is_renderable, is_text, normalize_path, trimmed
from ..functions.text import CLOSED, LITERAL, TAG, WRITE_CALL, attribute, docwrite_html, escaped, is_docwrite, literal_value, plain_to_html, quoted, strip_tags, unquoted
from ..sources.entries import last_per_key
from ..sources.scratch import written

#: Elements that are dropped with what they hold.
DROPPED_TAGS = (
    "script", "object", "embed", "applet", "iframe", "frame", "frameset", "base", "form", "input", "button", "select", "textarea", "link", "meta",
    "noscript", "template", "xml", "audio", "video", "source", "track",
)
#: Presentational attributes.
PRESENTATION = (
    "bgcolor", "text", "link", "vlink", "alink", "background", "color", "face", "size", "align", "valign", "border", "cellpadding", "cellspacing",
    "width", "height", "hspace", "vspace",
)
REFERENCE_ATTRIBUTES = ("src", "href", "background", "poster")

VALUE = r"""(?:"[^"]*"|'[^']*'|[^\s>]+)"""
QUOTED_RUN = r"""(?:"[^"]*"|'[^']*'|[^>"']++)*+"""


def chapter_html(chapters: DataFrame) -> DataFrame:
    """chapters(archive_id, path, text) with `html`: written by a script, plain paragraphs, or the markup itself."""
    text = F.col("text")
    of_text = F.when(is_docwrite(text), docwrite_html(text)).otherwise(plain_to_html(text))
    return chapters.withColumn("html", F.when(is_text(F.col("path")), of_text).otherwise(text))


def _directory_order(rows: DataFrame) -> str:
    """The column that says which of entries that differ in case only counts: their order in the archive, or else their spelling."""
    return "entry_seq" if "entry_seq" in rows.columns else "path"


def matched(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join of two sides that both grow with the archives: sorted and merged, never broadcast on a guess."""
    return left.join(right.hint("merge"), on, how)


def sanitize_tags(html: Column) -> Column:
    """html without the dropped elements and what they hold, by one walk over its tags (markup.without_elements). Null stays null."""
    return without_elements(html, DROPPED_TAGS)


def _is_handler(piece: Column) -> Column:
    return piece_name(piece).startswith("on")


def _is_inline_html(piece: Column) -> Column:
    return piece_name(piece).isin("href", "src", "action") & piece_value(piece).rlike(r"(?i)^\s*data:text/html")


def sanitize_attrs(html: Column) -> Column:
    """html without event handlers in its tags, and without references to inline HTML. Script references stay."""
    return in_tags(html, lambda tag: keep_attributes(tag, lambda p: ~(_is_handler(p) | _is_inline_html(p))))


def _start_tags(html: Column) -> Column:
    """The start tags of a page; what raw elements and comments hold is none."""
    return F.filter(F.transform(F.filter(tokens_of(html), lambda t: t.rlike("^<[a-zA-Z]")), tag_of), lambda t: t != "")


def attribute_flags(html: Column) -> Column:
    """struct(handlers, inline_html, script_links): how many event handlers and references to inline
    HTML sanitize_attrs takes from the tags, and how many script links it keeps."""
    pieces = F.flatten(F.transform(_start_tags(html), attribute_pieces))
    count = lambda holds: F.size(F.filter(pieces, holds))
    is_script = lambda p: piece_name(p).isin("href", "src", "action") & piece_value(p).rlike(r"(?i)^\s*(?:javascript|vbscript):")
    return F.struct(count(_is_handler).alias("handlers"), count(_is_inline_html).alias("inline_html"), count(is_script).alias("script_links"))


def strip_presentation(html: Column) -> Column:
    """html without style and presentational attributes; an image keeps its width and height."""
    image = ("style", *(x for x in PRESENTATION if x not in ("width", "height")))
    return in_tags(html, lambda tag: F.when(tag.rlike(r"(?i)^<img[\s/>]"), without(tag, *image)).otherwise(without(tag, "style", *PRESENTATION)))


#: A frame's tag, an inline one with what it holds up to its end, or else a run of other markup.
FRAME = rf"<frame\b(?:{QUOTED_RUN})>|<iframe\b(?:{QUOTED_RUN})>(?:[^<]*+(?:<(?!/iframe\b)[^<]*+)*+</iframe\s*>)?"
FRAME_PIECE = rf"(?is){FRAME}|[^<]++|<"


def _frame_pieces(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(FRAME_PIECE), F.lit(0))


def _frame_source(piece: Column) -> Column:
    """The source of a piece that is a frame with one inside the archive; null for any other."""
    src = attribute(F.regexp_extract(piece, rf"(?is)^<i?frame\b(?:{QUOTED_RUN})>", 0), "src")
    return F.when(piece.rlike(r"(?is)^<i?frame\b") & (src != "") & ~is_external(src), src)


def frames_to_links(html: Column) -> Column:
    """Frames with an archive page as a paragraph that links to it; framesets as divisions."""

    def change(piece: Column) -> Column:
        src = _frame_source(piece)
        return F.coalesce(F.concat(F.lit("<p><a href="), quoted(src), F.lit(">→ "), escaped(src), F.lit("</a></p>")), piece)

    out = F.array_join(F.transform(_frame_pieces(html), change), "")
    return F.regexp_replace(F.regexp_replace(out, r"(?i)<frameset\b[^>]*>", "<div>"), r"(?i)</frameset\s*>", "</div>")


def _put_in(pages: DataFrame, pieces: Column, wanted: DataFrame, content: DataFrame) -> DataFrame:
    """pages(archive_id, path) with `whole`: its pieces, of which those that wanted(archive_id, path, at,
    target_key) names are replaced by what content(archive_id, target_key, put) has, if anything."""
    found = matched(wanted, content, ["archive_id", "target_key"])
    puts = found.groupBy("archive_id", "path").agg(F.map_from_entries(F.collect_list(F.struct("at", "put"))).alias("puts"))
    filled = F.array_join(F.transform(pieces, lambda x, i: F.coalesce(F.try_element_at("puts", i), x)), "")
    return matched(pages, puts, ["archive_id", "path"], "left").withColumn("whole", F.when(F.col("puts").isNotNull(), filled)).drop("puts")


def inline_frames(pages: DataFrame, levels: int = 2) -> DataFrame:
    """pages(archive_id, path, html) with the content of archive pages put in place of their frames,
    two levels deep; external frames, missing pages and targets that can't be shown stay.

    Each page's frames are resolved against the page that holds them: first every page's
    frames get their targets as they are, then every page's own frames get their targets as
    they have become, so a level is one join. Of targets that differ in case only, the last
    in the archive's order (entry_seq; without it, of their spelling) is taken. Rows of one
    (archive_id, path) are one page."""
    pages = pages.dropDuplicates(["archive_id", "path"])
    frames = pages.select("archive_id", "path", F.posexplode(F.transform(_frame_pieces(F.col("html")), _frame_source)).alias("at", "src")).where(F.col("src").isNotNull())
    frames = frames.withColumn("target", normalize_path(F.col("path"), F.col("src"))).where(is_renderable(F.col("target")))
    wanted = frames.select("archive_id", "path", "at", F.lower("target").alias("target_key"))
    last = last_per_key(pages, [F.col("archive_id"), F.lower("path")], _directory_order(pages)).select("archive_id", "path")
    shown = matched(pages, last, ["archive_id", "path"], "left_semi").select("archive_id", "path", F.col("html").alias("now"))
    for level in range(levels):
        put = shown.select("archive_id", F.lower("path").alias("target_key"), F.concat(F.lit('<div class="frame">'), "now", F.lit("</div>")).alias("put"))
        done = _put_in(pages, _frame_pieces(F.col("html")), wanted, put.where(F.col("put").isNotNull()))
        done = done.select("archive_id", "path", F.coalesce("whole", "html").alias("now"))
        shown = matched(done, last, ["archive_id", "path"], "left_semi") if level < levels - 1 else done
    return matched(pages.drop("html"), shown.withColumnRenamed("now", "html"), ["archive_id", "path"])


def body_of(html: Column) -> Column:
    """What the body holds; without a body tag, all but the head. Tags in scripts, styles, titles and comments don't count."""

    def on(tokens: Column, names: Column) -> Column:
        place = lambda names, name: F.array_position(names, name).cast("int")
        first, size = place(names, "body"), F.size(tokens)
        rest = F.slice(tokens, first + 1, size)
        end = place(F.slice(names, first + 1, size), "/body")
        body = F.when(end > 0, F.slice(rest, F.lit(1), end - 1)).otherwise(rest)
        head, head_end = place(names, "head"), place(names, "/head")
        headless = F.concat(F.slice(tokens, F.lit(1), head - 1), F.slice(tokens, head_end + 1, size))
        return F.array_join(F.when(first > 0, body).when((head > 0) & (head_end > head), headless).otherwise(tokens), "")

    return bound(tokens_of(html), lambda tokens: bound(F.transform(tokens, token_name), lambda names: on(tokens, names)))


def references(pages: DataFrame) -> DataFrame:
    """(archive_id, from_path, at, tag, attr, raw, target_path, fragment) for each reference of pages(archive_id, path, html).

    Empty ones, blobs, external ones and pure fragments have no target."""
    tags = pages.select("archive_id", F.col("path").alias("from_path"), F.posexplode(F.regexp_extract_all("html", F.lit(TAG), F.lit(0))).alias("at", "t"))
    tags = tags.where(F.col("t").rlike(rf"(?i)\b(?:{'|'.join(REFERENCE_ATTRIBUTES)})\s*="))
    kind = F.lower(F.regexp_extract("t", TAG, 2))
    values = F.array(*[F.struct(F.lit(a).alias("attr"), attribute(F.col("t"), a).alias("raw")) for a in REFERENCE_ATTRIBUTES])
    rows = tags.select("archive_id", "from_path", "at", kind.alias("tag"), F.explode(F.filter(values, lambda v: F.coalesce(v["raw"], F.lit("")) != "")).alias("v"))
    raw = F.col("v.raw")
    inner = ~(raw.startswith("blob:") | is_external(raw) | raw.startswith("#"))
    return rows.select(
        "archive_id", "from_path", "at", "tag", "v.attr", raw.alias("raw"), F.when(inner, normalize_path(F.col("from_path"), raw)).alias("target_path"), fragment_of(raw).alias("fragment")
    )


def classify_links(refs: DataFrame) -> DataFrame:
    """refs with `link_class`: script, external, fragment or internal."""
    raw = trimmed(F.col("raw"))
    kind = F.when(raw.rlike("(?i)^javascript:"), "script").when(is_external(raw), "external").when(raw.startswith("#"), "fragment").otherwise("internal")
    return refs.withColumn("link_class", kind)


def without(tag: Column, *names: str) -> Column:
    """A tag without the attributes of these names, with or without a value."""
    return keep_attributes(tag, lambda p: ~piece_name(p).isin(*names))


def with_attributes(tag: Column, *added: Column) -> Column:
    """A tag with more attributes, each with the space before it, at its end."""
    return F.concat(F.regexp_replace(tag, r"\s*/?>$", ""), *added, F.when(tag.rlike(r"/>$"), "/>").otherwise(">"))


def harden_links(html: Column) -> Column:
    """html whose links out of the archive, script links among them, open apart, without access to the
    opener and without a referrer, whatever target they had; links inside it lose their target."""
    href = lambda tag: attribute(tag, "href")
    is_link = lambda tag: tag.rlike(r"(?i)^<\s*a\b") & (href(tag) != "")
    apart = lambda tag: with_attributes(without(tag, "target", "rel"), F.lit(' target="_blank" rel="noopener noreferrer"'))
    change = lambda tag: F.when(is_link(tag), F.when(is_external(href(tag)), apart(tag)).otherwise(without(tag, "target"))).otherwise(tag)
    return in_tags(html, change)


def missing_references(refs: DataFrame, entries: DataFrame) -> DataFrame:
    """References whose target no entry of the archive is, without regard to case."""
    known = entries.select("archive_id", F.lower("path").alias("target_key")).distinct()
    wanted = refs.where(F.col("target_path").isNotNull()).withColumn("target_key", F.lower("target_path"))
    return matched(wanted, known, ["archive_id", "target_key"], "left_anti").drop("target_key")


def orphans(entries: DataFrame, refs: DataFrame) -> DataFrame:
    """Renderable entries that no reference of another page means."""
    other = refs.where(F.lower("target_path") != F.lower("from_path")).select("archive_id", F.lower("target_path").alias("path_key")).distinct()
    own = entries.where(is_renderable(F.col("path"))).withColumn("path_key", F.lower("path"))
    return matched(own, other, ["archive_id", "path_key"], "left_anti").drop("path_key")


def link_degrees(refs: DataFrame) -> DataFrame:
    """Distinct pages that a path refers to, and that refer to it."""
    edges = refs.where(F.col("target_path").isNotNull()).select("archive_id", F.lower("from_path").alias("a"), F.lower("target_path").alias("b")).distinct()
    ends = edges.select("archive_id", F.explode(F.array(F.struct(F.col("a").alias("path_key"), F.lit(1).alias("out")), F.struct(F.col("b").alias("path_key"), F.lit(0).alias("out")))).alias("e"))
    return ends.groupBy("archive_id", "e.path_key").agg(F.sum("e.out").cast("long").alias("out_degree"), F.sum(1 - F.col("e.out")).cast("long").alias("in_degree"))


#: An attribute with its value, or what lies between two of them.
ATTRIBUTE_PIECE = rf"""(?is)[a-z_][\w:-]*\s*=\s*{VALUE}|[\w:-]++|[^\w:-]"""


def url_maps(urls: DataFrame) -> DataFrame:
    """urls(archive_id, path, raw, url) as a map from raw to url for each page; a page's references bound it."""
    one = urls.where(F.col("raw").isNotNull() & F.col("url").isNotNull()).groupBy("archive_id", "path", "raw").agg(F.min("url").alias("url"))
    return one.groupBy("archive_id", "path").agg(F.map_from_entries(F.collect_list(F.struct("raw", "url"))).alias("urls"))


def rewrite_refs(pages: DataFrame, urls: DataFrame) -> DataFrame:
    """pages with each reference that urls(archive_id, path, raw, url) knows replaced, however its
    value is quoted; the others stay."""
    names = "|".join(REFERENCE_ATTRIBUTES)
    lead = rf"(?is)^((?:{names})\s*=\s*).*$"

    def change(piece: Column) -> Column:
        url = F.try_element_at("urls", unquoted(F.regexp_replace(piece, rf"(?is)^(?:{names})\s*=\s*", "")))
        return F.when(piece.rlike(rf"(?is)^(?:{names})\s*=\s*{VALUE}$") & url.isNotNull(), F.concat(F.regexp_replace(piece, lead, "$1"), quoted(url))).otherwise(piece)

    in_tag = lambda tag: F.array_join(F.transform(F.regexp_extract_all(tag, F.lit(ATTRIBUTE_PIECE), F.lit(0)), change), "")
    joined = matched(pages, url_maps(urls), ["archive_id", "path"], "left")
    return joined.withColumn("html", F.when(F.col("urls").isNotNull(), in_tags(F.col("html"), in_tag)).otherwise(F.col("html"))).drop("urls")


def _projected(tag: Column, url: Column) -> Column:
    """A tag with its background as an inline style of this url, beside the style that it has."""
    style = F.regexp_replace(F.coalesce(attribute(tag, "style"), F.lit("")), r"(?i)(?:^|(?<=;))\s*background-image\s*:[^;]*;?", "")
    style = F.regexp_replace(style, r"[\s;]+$", "")
    image = F.concat(F.lit("background-image:url('"), F.replace(url, F.lit("'"), F.lit("%27")), F.lit("')"))
    both = F.when(style == "", image).otherwise(F.concat(style, F.lit(";"), image))
    return with_attributes(without(tag, "background", "style"), F.lit(" style="), quoted(both))


def project_background(html: Column) -> Column:
    """A background attribute with an archive's file as an inline style, beside the style that the tag has."""

    def change(tag: Column) -> Column:
        url = attribute(tag, "background")
        inside = (url != "") & ~is_external(url) & ~url.startswith("blob:")
        return F.when(inside, _projected(tag, url)).otherwise(tag)

    return in_tags(html, change)


def stylesheets(pages: DataFrame) -> DataFrame:
    """(archive_id, path, kind, value): inline style blocks, and targets of linked stylesheets."""
    inline = pages.select("archive_id", "path", F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<style\b[^>]*>(.*?)</style\s*>"), F.lit(1))).alias("value")).withColumn("kind", F.lit("inline"))
    links = pages.select("archive_id", "path", F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<link\b[^>]*>"), F.lit(0))).alias("t"))
    links = links.select("archive_id", "path", attribute(F.col("t"), "rel").alias("rel"), attribute(F.col("t"), "href").alias("href")).where(F.col("rel").rlike("(?i)stylesheet"))
    links = links.select("archive_id", "path", normalize_path(F.col("path"), F.col("href")).alias("value"), F.lit("linked").alias("kind"))
    return inline.unionByName(links.where(F.col("value").isNotNull()))


def page_styles(pages: DataFrame, sheets: DataFrame) -> DataFrame:
    """(archive_id, path, kind, base, css): the styles of each page; base is where their references
    count from. Linked sheets come from sheets(archive_id, path, css), without regard to case;
    those that aren't there have no row."""
    found = stylesheets(pages)
    inline = found.where("kind = 'inline'").select("archive_id", "path", "kind", F.col("path").alias("base"), F.col("value").alias("css"))
    known = last_per_key(sheets, [F.col("archive_id"), F.lower("path")], _directory_order(sheets)).select("archive_id", F.lower("path").alias("target_key"), "css")
    linked = matched(found.where("kind = 'linked'").withColumn("target_key", F.lower("value")), known, ["archive_id", "target_key"])
    return inline.unionByName(linked.select("archive_id", "path", "kind", F.col("value").alias("base"), "css"))


#: An import rule, whatever media it names, or else a run of other text.
IMPORT_RULE = r"""@import\b\s*(?:url\s*\(\s*(?:"[^"]*"|'[^']*'|[^)]*)\s*\)|"[^"]*"|'[^']*')[^;]*;"""
IMPORT_PIECE = rf"(?i){IMPORT_RULE}|[^@]++|@"
URL_REFERENCE = r"""(?i)url\s*\(\s*(?:"[^"]*"|'[^']*'|[^)"']*)\s*\)"""
URL_PIECE = rf"{URL_REFERENCE}|[^uU]++|[uU]"


def _url_value(piece: Column) -> Column:
    """What url(...) names."""
    return trimmed(unquoted(trimmed(F.regexp_replace(F.regexp_replace(piece, r"(?i)^url\s*\(", ""), r"\)$", ""))))


def _imported(piece: Column) -> Column:
    """What an import rule names; null for any other piece."""
    named = F.regexp_replace(F.regexp_replace(piece, r"(?i)^@import\b\s*", ""), r"[^;\"')]*;$", "")
    return F.when(piece.rlike("(?i)^@import"), F.when(named.rlike(r"(?i)^url\s*\("), _url_value(named)).otherwise(unquoted(named)))


def _import_pieces(css: Column) -> Column:
    return F.regexp_extract_all(css, F.lit(IMPORT_PIECE), F.lit(0))


def _imports(sheets: DataFrame) -> DataFrame:
    """(archive_id, path, at, raw) of the import rules of sheets(archive_id, path, css)."""
    rows = sheets.select("archive_id", "path", F.posexplode(F.transform(_import_pieces(F.col("css")), _imported)).alias("at", "raw"))
    return rows.where(F.col("raw").isNotNull())


def css_imports(sheets: DataFrame, depth: int = 4) -> DataFrame:
    """(archive_id, path, imported, steps): sheets(archive_id, path, css) and what they import, up to `depth` steps."""
    inner = _imports(sheets).where(~is_external(F.col("raw")))
    edges = inner.select("archive_id", "path", normalize_path(F.col("path"), F.col("raw")).alias("imported")).where(F.col("imported").isNotNull()).distinct()
    level = edges.withColumn("steps", F.lit(1))
    out = level
    hop = edges.select("archive_id", F.lower("path").alias("k"), F.col("imported").alias("next"))
    for step in range(2, depth + 1):
        level = matched(level.withColumn("k", F.lower("imported")), hop, ["archive_id", "k"]).select("archive_id", "path", F.col("next").alias("imported"), F.lit(step).alias("steps")).distinct()
        out = out.unionByName(level)
    return out.groupBy("archive_id", "path", "imported").agg(F.min("steps").alias("steps"))


def css_urls(sheets: DataFrame) -> DataFrame:
    """(archive_id, path, raw, target) of url(...) in stylesheets, import rules left out; external ones have no row."""
    rest = F.array_join(F.filter(_import_pieces(F.col("css")), lambda x: ~x.rlike(rf"(?i)^{IMPORT_RULE}")), "")
    rows = sheets.select("archive_id", "path", F.explode(F.regexp_extract_all(rest, F.lit(URL_REFERENCE), F.lit(0))).alias("piece")).select("archive_id", "path", _url_value(F.col("piece")).alias("raw"))
    inner = ~is_external(F.col("raw")) & ~F.col("raw").startswith("blob:")
    return rows.where(inner).select("archive_id", "path", "raw", normalize_path(F.col("path"), F.col("raw")).alias("target")).where(F.col("target").isNotNull()).distinct()


def _put_urls(css: Column) -> Column:
    """css with each url(...) that the row's map `urls` knows replaced."""
    put = lambda x: F.coalesce(F.when(x.rlike(rf"^{URL_REFERENCE}$"), F.concat(F.lit('url("'), F.try_element_at("urls", _url_value(x)), F.lit('")'))), x)
    return F.array_join(F.transform(F.regexp_extract_all(css, F.lit(URL_PIECE), F.lit(0)), put), "")


def _first_value(tag: Column, name: str) -> Column:
    """The value of a tag's first attribute of this name; null without it."""
    return piece_value(F.try_element_at(F.filter(attribute_pieces(tag), lambda p: piece_name(p) == name), F.lit(1)))


def _is_asset(raw: Column) -> Column:
    """Whether a reference means a file of the archive."""
    return (raw != "") & ~is_external(raw) & ~F.lower(trimmed(raw)).rlike("^(?:blob|data):")


def _image_source(tag: Column) -> Column:
    """What an image or an image button shows; null for any other tag."""
    name = token_name(tag)
    return F.when((name == "img") | ((name == "input") & (F.lower(_first_value(tag, "type")) == "image")), _first_value(tag, "src"))


def asset_references(pages: DataFrame) -> DataFrame:
    """(archive_id, path, raw, target), distinct: the files of the archive that pages(archive_id, path, html) show, as
    images, image buttons, backgrounds, and by url() in a style attribute."""

    def shown(tag: Column) -> Column:
        style = F.coalesce(_first_value(tag, "style"), F.lit(""))
        urls = F.transform(F.regexp_extract_all(style, F.lit(URL_REFERENCE), F.lit(0)), _url_value)
        return F.concat(F.array(_image_source(tag), _first_value(tag, "background")), urls)

    may = r"(?is)^<(?:img|input)(?=[\s/>])|^<[a-z].*(?:background|url\s*\()"
    tags = F.filter(F.transform(F.filter(tokens_of(F.col("html")), lambda t: t.rlike("^<[a-zA-Z]")), tag_of), lambda t: t.rlike(may))
    raws = pages.select("archive_id", "path", F.explode(F.array_distinct(F.flatten(F.transform(tags, shown)))).alias("raw"))
    return raws.where(_is_asset(F.col("raw"))).withColumn("target", normalize_path(F.col("path"), F.col("raw"))).where("target is not null")


def put_assets(pages: DataFrame, assets: DataFrame) -> DataFrame:
    """pages(archive_id, path, html) with the files that they show replaced by the addresses of
    assets(archive_id, path, url), and what is missing marked.

    Files are found without regard to case; of one path's entries the last of the archive
    wins. Images and image buttons load late; one whose file is missing loses its source,
    and says `[missing: source]` in place of an empty or no alternative text. A background
    becomes an inline style, or goes if its file is missing; url() of a missing file in a
    style stays. References outside, and those that are data already, stay.

    Pages' references are joined by (archive, file), so an image of many pages is a key that
    the adaptive join can split, and come back as one map a page; the page is rewritten in
    one pass. Pages are one row a path; a null page stays null, and an asset without url is
    missing."""
    wanted = asset_references(pages).withColumn("target_key", F.lower("target"))
    # written, as rows from explode have no size to plan a join by
    wanted = written(wanted.select("archive_id", "path", "raw", "target_key"), "shown")
    known = last_per_key(assets, [F.col("archive_id"), F.lower("path")], _directory_order(assets)).where("url is not null")
    known = known.select("archive_id", F.lower("path").alias("target_key"), "url")
    urls = url_maps(matched(wanted, known, ["archive_id", "target_key"]).select("archive_id", "path", "raw", "url"))
    url_of = lambda raw: F.try_element_at("urls", raw)
    inside = lambda raw: _is_asset(raw) & normalize_path(F.col("path"), raw).isNotNull()
    late = F.lit(' loading="lazy"')

    # values that are used more than once are bound: what they are made of is large
    def image(tag: Column, src: Column) -> Column:
        marked = lambda bare: with_attributes(bare, F.lit(" alt="), quoted(F.concat(F.lit("[missing: "), src, F.lit("]"))), late)
        plain = lambda: bound(without(tag, "src", "loading"), lambda bare: with_attributes(bare, late))
        missing = F.when(F.coalesce(_first_value(tag, "alt"), F.lit("")) == "", bound(without(tag, "src", "loading", "alt"), marked)).otherwise(plain())
        found = lambda bare: with_attributes(bare, F.lit(" src="), quoted(url_of(src)), late)
        return F.when(url_of(src).isNotNull(), bound(without(tag, "src", "loading"), found)).otherwise(missing)

    def styled(tag: Column) -> Column:
        def put(style: Column) -> Column:
            own = lambda bare, new: with_attributes(bare, F.lit(" style="), quoted(new))
            change = lambda new: F.when(new != style, bound(without(tag, "style"), lambda bare: own(bare, new))).otherwise(tag)
            return F.when(style.rlike(r"(?i)url\s*\("), bound(_put_urls(style), change)).otherwise(tag)

        return F.when(tag.rlike(r"(?is)\sstyle|/style|[\"']style"), bound(_first_value(tag, "style"), put)).otherwise(tag)

    def grounded(tag: Column) -> Column:
        def put(raw: Column) -> Column:
            return F.when(inside(raw), F.when(url_of(raw).isNotNull(), _projected(tag, url_of(raw))).otherwise(without(tag, "background"))).otherwise(tag)

        return F.when(tag.rlike("(?i)background"), bound(_first_value(tag, "background"), put)).otherwise(tag)

    def change(tag: Column) -> Column:
        shown = lambda: bound(_image_source(tag), lambda src: F.when(inside(src), image(tag, src)).otherwise(tag))
        return bound(bound(F.when(tag.rlike(r"(?i)^<(?:img|input)(?=[\s/>])"), shown()).otherwise(tag), styled), grounded)

    return matched(pages, urls, ["archive_id", "path"], "left").withColumn("html", in_tags(F.col("html"), change)).drop("urls")


def expand_css(sheets: DataFrame, urls: DataFrame, levels: int = 4) -> DataFrame:
    """sheets(archive_id, path, css) with `whole`: the sheet with what it imports in place of its
    import rules, `levels` deep, and each url(...) that urls(archive_id, path, raw, url) knows
    replaced. Imports from outside and of missing sheets go; below the last level they stay.

    Each sheet's references are resolved against the sheet that holds them: first its own
    urls, then a join a level that puts the imported sheets in as they have become."""
    sheets = sheets.dropDuplicates(["archive_id", "path"])
    with_urls = F.array_join(F.transform(_import_pieces(F.col("css")), lambda x: F.when(x.rlike("(?i)^@import"), x).otherwise(_put_urls(x))), "")
    own = matched(sheets, url_maps(urls), ["archive_id", "path"], "left")
    # written, as each level reads it twice
    own = written(own.select("archive_id", "path", F.when(F.col("urls").isNotNull(), with_urls).otherwise(F.col("css")).alias("own")), "sheets")
    rules = _imports(own.select("archive_id", "path", F.col("own").alias("css")))
    rules = rules.withColumn("target_key", F.when(~is_external(F.col("raw")), F.lower(normalize_path(F.col("path"), F.col("raw")))))
    last = last_per_key(sheets, [F.col("archive_id"), F.lower("path")], _directory_order(sheets)).select("archive_id", "path")
    now = own.select("archive_id", "path", F.col("own").alias("now"))
    for _ in range(levels):
        known = matched(now, last, ["archive_id", "path"], "left_semi").select("archive_id", F.lower("path").alias("target_key"), F.col("now").alias("put"))
        puts = matched(rules, known, ["archive_id", "target_key"], "left").groupBy("archive_id", "path")
        puts = puts.agg(F.map_from_entries(F.collect_list(F.struct("at", F.coalesce("put", F.lit("")).alias("put")))).alias("puts"))
        filled = F.array_join(F.transform(_import_pieces(F.col("own")), lambda x, i: F.coalesce(F.try_element_at("puts", i), x)), "")
        now = matched(own.select("archive_id", "path", "own"), puts, ["archive_id", "path"], "left")
        now = now.select("archive_id", "path", F.when(F.col("puts").isNotNull(), filled).otherwise(F.col("own")).alias("now"))
    return matched(sheets, now.withColumnRenamed("now", "whole"), ["archive_id", "path"])


#: The dotted names whose assignment or call navigates.
NAVIGATES = (
    "location", "location.href", "location.assign", "location.replace", "document.location", "document.location.href", "window.location",
    "window.location.href", "this.location", "this.location.href", "top.location", "top.location.href", "self.location", "self.location.href",
)
#: The signs after which a slash begins a regular expression, as a class of a pattern has them.
SIGNS = r"=(,;:!&|?{}\[\]+\-*%~^<>\n"
#: A script's tokens: comments, literals, regular expressions with the sign before them, names
#: that navigate with their sign, members of other objects, other names, and single characters.
SCRIPT_TOKEN = (
    rf"//[^\n]*+|/\*.*?(?:\*/|\z)|{LITERAL}|`(?:[^`\\]|\\.)*+(?:`|\z)"
    rf"|(?:^|[{SIGNS}])[ \t]*+/(?![/*])"
    r"(?:[^\\\[/\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/?[\w$]*+"
    rf"|(?:{'|'.join(x.replace('.', chr(92) + '.') for x in sorted(NAVIGATES, reverse=True))})(?![\w$]|\.[\w$])[ \t]*+(?:=(?!=)|\()"
    r"|\.[ \t]*+[\w$]++(?:\.[\w$]++)*+|[\w$]++(?:\.[\w$]++)*+|."
)
NAV_START = r"^(?:(?:document|window|this|top|self)\.)?location[\w.]*[ \t]*+[=(]$"


def _script_tokens(script: Column) -> Column:
    return F.regexp_extract_all(script, F.lit(f"(?s){SCRIPT_TOKEN}"), F.lit(0))


def _argument_spans(tokens: Column) -> Column:
    """array of struct(first, size): the tokens (from 1) of the argument of each assignment and call that navigates.

    A walk over the tokens with the depth of brackets: an argument ends at a comma, a
    semicolon or a line's end outside brackets, or at the bracket that closes the call."""
    none = F.array().cast("array<struct<first:int,size:int>>")
    state = lambda at, first, depth, spans: F.struct(at.alias("at"), first.alias("first"), depth.alias("depth"), spans.alias("spans"))

    def span(s: Column, end: Column) -> Column:
        return F.concat(s["spans"], F.array(F.struct(s["first"].alias("first"), (end - s["first"]).alias("size"))))

    def step(s: Column, t: Column) -> Column:
        at, inside = s["at"] + 1, s["first"] > 0
        begins = t.rlike(NAV_START)
        mark = F.substring(t, 1, 1)
        single = (F.char_length(t) == 1) | t.rlike(rf"(?s)^[{SIGNS}][ \t]*+/")
        opens = (begins & t.endswith("(")) | (single & mark.isin("(", "[", "{"))
        closes = single & mark.isin(")", "]", "}")
        ends = inside & (s["depth"] == 0) & (closes | (single & mark.isin(",", ";", "\n")))
        return state(
            at,
            F.when(ends, 0).when(~inside & begins, at + 1).otherwise(s["first"]),
            F.when(ends | ~inside, 0).otherwise(s["depth"] + opens.cast("int") - closes.cast("int")),
            F.when(ends, span(s, at)).otherwise(s["spans"]),
        )

    start = state(F.lit(0), F.lit(0), F.lit(0), none)
    return F.aggregate(tokens, start, step, lambda s: F.when(s["first"] > 0, span(s, s["at"] + 1)).otherwise(s["spans"]))


def navigation_arguments(script: Column) -> Column:
    """The argument of each assignment and call of a script that navigates, in order."""
    arguments = lambda tokens: F.transform(_argument_spans(tokens), lambda s: trimmed(F.array_join(F.slice(tokens, s["first"], s["size"]), "")))
    found = lambda: F.filter(bound(_script_tokens(script), arguments), lambda x: x != "")
    return F.when(script.contains("location"), found()).otherwise(F.array().cast("array<string>"))


def rewrite_navigation(script: Column, callee: str) -> Column:
    """script with each assignment and call that navigates as a call of callee with the same argument.

    What is replaced lies between the tokens: a call's name, or an assignment's name and
    sign, and the bracket after its argument; all else stays byte for byte, arguments after
    the first too. A statement without an argument stays as it is."""
    blank = lambda x: x.rlike(r"^[ \t]*$")
    says_nothing = lambda x: blank(x) | x.rlike(r"^/[/*]")  # noqa: E731 - a comment after the argument may hide a bracket

    def puts(tokens: Column, span: Column) -> Column:
        """array of struct(at, put): what stands for some of the span's tokens, and for the one before it."""

        def on(flags: Column) -> Column:
            first = F.array_position(flags, True).cast("int")
            last = F.size(flags) - F.array_position(F.reverse(flags), True).cast("int")  # from 0
            at = lambda i, put: F.struct((span["first"] + i).cast("int").alias("at"), put.alias("put"))
            called = F.element_at(tokens, span["first"] - 1).endswith("(")
            ahead = F.slice(tokens, span["first"], first - 1)
            spaces = F.transform(ahead, lambda x, i: at(i, F.when(blank(x), F.lit("")).otherwise(x)))
            end = at(last, F.concat(F.element_at(tokens, span["first"] + last), F.lit(")")))
            opening = F.array(at(F.lit(-1), F.lit(f"{callee}(")))
            return F.when(first > 0, F.when(called, opening).otherwise(F.concat(opening, spaces, F.array(end)))).otherwise(F.array().cast("array<struct<at:int,put:string>>"))

        return bound(F.transform(F.slice(tokens, span["first"], span["size"]), lambda x: ~says_nothing(x)), on)

    def spliced(tokens: Column) -> Column:
        changes = F.map_from_entries(F.flatten(F.transform(_argument_spans(tokens), lambda s: puts(tokens, s))))
        return bound(changes, lambda m: F.array_join(F.transform(tokens, lambda x, i: F.coalesce(F.try_element_at(m, i + 1), x)), ""))

    return F.when(script.contains("location"), bound(_script_tokens(script), spliced)).otherwise(script)


def rewrite_page_scripts(html: Column, callee: str) -> Column:
    """html whose inline scripts navigate by a call of callee; tags and the rest stay byte for byte."""

    def changed(token: Column) -> Column:
        def on(tag: Column) -> Column:
            end = F.regexp_extract(token, r"(?is)</script(?=[\s/>])[^>]*>$", 0)
            script = F.substr(token, F.char_length(tag) + 1, F.char_length(token) - F.char_length(tag) - F.char_length(end))
            return F.when(tag != "", F.concat(tag, rewrite_navigation(script, callee), end)).otherwise(token)

        return F.when(token_name(token) == "script", bound(tag_of(token), on)).otherwise(token)

    return F.array_join(F.transform(tokens_of(html), changed), "")


def script_nav_edges(scripts: DataFrame) -> DataFrame:
    """(archive_id, path, at, argument, target) of statements of scripts(archive_id, path, text) that navigate.

    Nothing inside comments, literals and regular expressions counts; nor do comparisons and
    members of other objects. target is the value of an argument that is one literal, else null."""
    rows = scripts.select("archive_id", "path", F.posexplode(navigation_arguments(F.col("text"))).alias("at", "argument"))
    return rows.withColumn("target", F.when(F.col("argument").rlike(CLOSED), literal_value(F.col("argument"))))


def script_sources(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """(archive_id, path, at, script_path, text): the scripts of pages that the archive holds, decoded.

    entries(archive_id, entry_seq, path, content, encoding): encoding is the archive's. Of
    entries that differ in case only the last counts. Use it inside lenient_charsets()."""
    tags = pages.select("archive_id", "path", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<script\b[^>]*>"), F.lit(0))).alias("at", "t"))
    named = tags.select("archive_id", "path", "at", attribute(F.col("t"), "src").alias("src")).where(~is_external(F.col("src")))
    wanted = named.select("archive_id", "path", "at", F.lower(normalize_path(F.col("path"), F.col("src"))).alias("target_key")).where(F.col("target_key").isNotNull())
    known = last_per_key(entries, [F.col("archive_id"), F.lower("path")], "entry_seq")
    known = known.withColumn("own", effective_encoding(F.col("content"), F.lit(None).cast("string"), F.col("encoding")))
    known = known.select("archive_id", F.lower("path").alias("target_key"), F.col("path").alias("script_path"), decode_text(F.col("content"), F.col("own")).alias("text"))
    return matched(wanted, known, ["archive_id", "target_key"]).select("archive_id", "path", "at", "script_path", "text")


def implied_refs(items: DataFrame, refs: DataFrame) -> DataFrame:
    """refs and the chapter files that the chapter rows of a page's scripts imply.

    items(archive_id, path, n, file) are rows of pages_items(), path the page's; a file lies
    in the text folder beside the page's own."""
    raw = F.concat(F.lit("../txt/"), F.col("file"), F.lit(".txt"))
    more = items.select(
        "archive_id", F.col("path").alias("from_path"), F.col("n").alias("at"), F.lit("script").alias("tag"), F.lit("pages").alias("attr"), raw.alias("raw"),
        normalize_path(F.col("path"), raw).alias("target_path"), F.lit("").alias("fragment"),
    )
    return refs.unionByName(more)


def dangling_anchors(refs: DataFrame, pages: DataFrame) -> DataFrame:
    """References to a fragment of a page of the archive that has no such id or anchor name."""
    tags = pages.select("archive_id", F.lower("path").alias("target_key"), F.explode(F.regexp_extract_all("html", F.lit(TAG), F.lit(0))).alias("t"))
    tags = tags.where(F.col("t").rlike(r"(?i)\s(?:id|name)\s*="))
    ids = tags.select("archive_id", "target_key", attribute(F.col("t"), "id").alias("fragment"))
    names = tags.where(F.col("t").rlike(r"(?i)^<\s*a\b")).select("archive_id", "target_key", attribute(F.col("t"), "name").alias("fragment"))
    there = ids.unionByName(names).where(F.col("fragment").isNotNull()).distinct()
    target = F.when(F.col("raw").startswith("#"), F.col("from_path")).otherwise(F.col("target_path"))
    wanted = refs.where((F.col("fragment") != "") & (F.col("attr") == "href")).withColumn("target_key", F.lower(target))
    known = pages.select("archive_id", F.lower("path").alias("target_key")).distinct()
    inside = matched(wanted, known, ["archive_id", "target_key"], "left_semi")
    return matched(inside, there, ["archive_id", "target_key", "fragment"], "left_anti").drop("target_key")


def extraction_quality(pages: DataFrame, least: int = 50) -> DataFrame:
    """pages with the visible text's length, and whether it is too short, still holds a write call, or has CJK signs."""
    shown = strip_tags(F.col("html"))
    return pages.select("archive_id", "path", F.char_length(shown).alias("visible"), (F.char_length(shown) < least).alias("too_short"), shown.rlike(WRITE_CALL).alias("script_left"), shown.rlike(r"[\x{4E00}-\x{9FFF}]").alias("has_cjk"))


def sanitize_audit(pages: DataFrame) -> DataFrame:
    """(archive_id, path, what, n): per page, how often each dropped tag opens, how many event handlers
    (`handler`) and references to inline HTML (`inline html`) go, and how many script links stay (`script link`)."""
    names = F.filter(F.transform(tokens_of(F.col("html")), token_name), lambda x: x.isin(*DROPPED_TAGS))
    dropped = pages.select("archive_id", "path", F.explode(names).alias("what")).groupBy("archive_id", "path", "what").agg(F.count(F.lit(1)).alias("n"))
    flags = attribute_flags(F.col("html"))
    kinds = F.array(*[F.struct(F.lit(what).alias("what"), F.col(f"f.{name}").cast("long").alias("n")) for what, name in (("handler", "handlers"), ("inline html", "inline_html"), ("script link", "script_links"))])
    attributes = pages.select("archive_id", "path", flags.alias("f")).select("archive_id", "path", F.explode(F.filter(kinds, lambda k: k["n"] > 0)).alias("k"))
    return dropped.unionByName(attributes.select("archive_id", "path", "k.what", "k.n"))
