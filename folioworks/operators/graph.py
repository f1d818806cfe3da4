"""The whole graph of references of archives, and what is reached in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markup import tag_of, token_name, tokens_of
from ..functions.paths import is_external, normalize_path
from ..sources.scratch import discard, written
from .content import css_imports, css_urls, matched, references, script_nav_edges

#: What a reference of these tags is; of others it is an asset.
TAG_KINDS = {"a": "link", "area": "link", "frame": "frame", "iframe": "frame", "link": "style", "script": "script"}


def inline_scripts(pages: DataFrame) -> DataFrame:
    """(archive_id, path, text) of what the script elements of pages(archive_id, path, html) hold; one row a page that has any."""

    def held(token: Column) -> Column:
        return F.regexp_replace(F.substr(token, F.char_length(tag_of(token)) + 1), r"(?is)</script(?=[\s/>])[^>]*>$", "")

    scripts = F.transform(F.filter(tokens_of(F.col("html")), lambda t: (token_name(t) == "script") & t.rlike("^<[a-zA-Z]")), held)
    return pages.select("archive_id", "path", F.array_join(scripts, "\n").alias("text")).where("text <> ''")


def link_edges(pages: DataFrame, sheets: DataFrame | None = None, scripts: DataFrame | None = None) -> DataFrame:
    """(archive_id, from_key, to_key, kind), distinct: all references inside archives, paths in lower case.

    Links, frames and assets come from pages(archive_id, path, html), styles and their images
    from sheets(archive_id, path, css), navigation to literals from the pages' own scripts and
    scripts(archive_id, path, text). External references and unknown targets have no edge."""
    kinds = F.create_map(*[F.lit(x) for pair in TAG_KINDS.items() for x in pair])
    refs = references(pages).where(F.col("target_path").isNotNull())
    edges = refs.select("archive_id", F.lower("from_path").alias("from_key"), F.lower("target_path").alias("to_key"), F.coalesce(F.try_element_at(kinds, "tag"), F.lit("asset")).alias("kind"))
    own = inline_scripts(pages)
    run = script_nav_edges(own if scripts is None else own.unionByName(scripts.select("archive_id", "path", "text"))).where(~is_external(F.col("target")))
    run = run.select("archive_id", F.lower("path").alias("from_key"), F.lower(normalize_path(F.col("path"), F.col("target"))).alias("to_key"), F.lit("navigation").alias("kind"))
    edges = edges.unionByName(run)
    if sheets is not None:
        imports = css_imports(sheets, depth=1).select("archive_id", F.lower("path").alias("from_key"), F.lower("imported").alias("to_key"), F.lit("import").alias("kind"))
        images = css_urls(sheets).select("archive_id", F.lower("path").alias("from_key"), F.lower("target").alias("to_key"), F.lit("asset").alias("kind"))
        edges = edges.unionByName(imports).unionByName(images)
    return edges.where(F.col("to_key").isNotNull()).distinct()


def edge_degrees(edges: DataFrame) -> DataFrame:
    """(archive_id, path_key, out_degree, in_degree): distinct paths on either side, whatever kinds of edges there are."""
    pairs = edges.select("archive_id", F.col("from_key").alias("a"), F.col("to_key").alias("b")).distinct()
    end = lambda c, out: F.struct(F.col(c).alias("path_key"), F.lit(out).alias("out"))
    ends = pairs.select("archive_id", F.explode(F.array(end("a", 1), end("b", 0))).alias("e"))
    return ends.groupBy("archive_id", "e.path_key").agg(F.sum("e.out").cast("long").alias("out_degree"), F.sum(1 - F.col("e.out")).cast("long").alias("in_degree"))


def reachable(entries: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(archive_id, path_key, steps) of each path of entries(archive_id, path): the least number of edges from
    one of starts(archive_id, path) of its archive to it, null where none leads there.

    A step joins the paths that the last one reached with the edges out of them and leaves
    out those reached before, so each edge is taken once, cycles or not. Each step's paths
    are written, and steps end when one reaches nothing new; there are as many as the
    longest of the shortest ways. Starts that aren't entries and edges to none don't count."""
    nodes = written(entries.select("archive_id", F.lower("path").alias("path_key")).distinct(), "nodes")
    pairs = edges.where(F.col("from_key") != F.col("to_key")).select("archive_id", "from_key", F.col("to_key").alias("path_key")).distinct()
    pairs = written(matched(pairs, nodes, ["archive_id", "path_key"], "left_semi"), "edges")
    hops = pairs.select("archive_id", F.col("from_key").alias("at"), F.col("path_key").alias("next"))
    first = starts.select("archive_id", F.lower("path").alias("path_key")).distinct()
    level = written(matched(first, nodes, ["archive_id", "path_key"], "left_semi"), "reached")
    steps, levels = 0, []
    found = None
    while not level.isEmpty():
        levels.append(level)
        now = level.withColumn("steps", F.lit(steps))
        found = now if found is None else found.unionByName(now)
        out = matched(level.withColumnRenamed("path_key", "at"), hops, ["archive_id", "at"]).select("archive_id", F.col("next").alias("path_key")).distinct()
        steps += 1
        level = written(matched(out, found.select("archive_id", "path_key"), ["archive_id", "path_key"], "left_anti"), "reached")
    discard(level)
    if found is None:
        return nodes.withColumn("steps", F.lit(None).cast("int"))
    out = written(matched(nodes, found, ["archive_id", "path_key"], "left"), "reach")
    discard(nodes, pairs, *levels)
    return out
