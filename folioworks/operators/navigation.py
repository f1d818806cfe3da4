"""Tables of contents, keyword indexes and reading orders, for all archives at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.encodings import decode_text, utf8_class
from ..functions.paths import base_name, directory, doc_name, is_content, is_html, is_text, natural_key, normalize_path, trimmed
from ..functions.text import FIRST_PAGE_ROW, LITERAL, PAGE_ROW, TAG, attribute, is_docwrite, literal_value, strip_tags, tidy_title
from .content import matched
from .numbering import numbered

PLACEHOLDER = "(no title)"
ROOT_LABEL = "(top)"
#: Well-known entry pages in order, with the names of the first two.
ENTRY_PAGES = [("/start.htm", 0, "Start"), ("/index.htm", 1, "Index"), ("/default.htm", 2, None), ("/home.htm", 3, None)]


#: Tags of a contents file that are walked at a time; what a walk carries is copied once for as many.
WALKED = 256
STEP = "array<struct<id:int,name:string>>"
NODE = f"struct<trail:{STEP},depth:int,name:string,local:string,locals:array<string>>"


def sitemap_tokens(text: Column) -> Column:
    """The tags of a contents file that matter, in order: struct(kind, value). Kinds: `open` and
    `close` of a list, `item` and `other` for objects of the contents and others, `end` of an
    object, and `name` and `local` for parameters with their values."""

    def token(tag: Column) -> Column:
        name = F.lower(F.regexp_extract(tag, TAG, 2))
        closing = F.regexp_extract(tag, TAG, 1) == "/"
        is_map = F.coalesce(attribute(tag, "type"), F.lit("")).rlike("(?i)text/sitemap")
        param = F.lower(attribute(tag, "name"))
        kind = (
            F.when(name.isin("ul", "menu", "dir"), F.when(closing, "close").otherwise("open"))
            .when(name == "object", F.when(closing, "end").when(is_map, "item").otherwise("other"))
            .when((name == "param") & ~closing & param.isin("name", "local"), param)
        )
        return F.struct(kind.alias("kind"), F.when(kind.isin("name", "local"), F.coalesce(attribute(tag, "value"), F.lit(""))).alias("value"))

    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(TAG), F.lit(0)), token), lambda t: t["kind"].isNotNull())


def _walk(tokens: Column) -> Column:
    """The nodes of a contents file, from its tokens, in one pass.

    The walk carries the last node of each open list. A node's ancestors are those of the
    lists around its own, which is what its parent rule comes to: a list's parent is the last
    node before it, or else that of the list around it."""
    no_node = F.struct(F.lit(-1).alias("id"), F.lit("").alias("name"))

    def state(**parts: Column) -> Column:
        return F.struct(*[v.alias(k) for k, v in parts.items()])

    def step(s: Column, t: Column) -> Column:
        kind, depth = t["kind"], F.size(s["stack"]) - 1
        first = F.coalesce(F.try_element_at(s["locals"], F.lit(1)), F.lit(""))
        shown = trimmed(F.coalesce(F.nullif(s["name"], F.lit("")), first))
        name = F.coalesce(F.nullif(shown, F.lit("")), F.lit(PLACEHOLDER))
        number = s["before"] + F.size(s["nodes"])
        own = F.struct(number.alias("id"), name.alias("name"))
        around = F.filter(F.slice(s["stack"], F.lit(1), depth), lambda x: x["id"] >= 0)
        node = F.struct(F.concat(around, F.array(own)).alias("trail"), depth.alias("depth"), name.alias("name"), F.nullif(first, F.lit("")).alias("local"), s["locals"].alias("locals")).cast(NODE)
        emits = (kind == "end") & s["inside"] & (s["name"].isNotNull() | (F.size(s["locals"]) > 0))
        object_tag = kind.isin("item", "other", "end")
        stack = (
            F.when(kind == "open", F.concat(s["stack"], F.array(no_node)))
            .when((kind == "close") & (depth > 0), F.slice(s["stack"], F.lit(1), depth))
            .when(emits, F.concat(F.slice(s["stack"], F.lit(1), depth), F.array(own)))
            .otherwise(s["stack"])
        )
        return state(
            stack=stack.cast(STEP),
            inside=F.when(object_tag, kind == "item").otherwise(s["inside"]),
            name=F.when(object_tag, F.lit(None).cast("string")).when((kind == "name") & s["inside"], F.coalesce(s["name"], t["value"])).otherwise(s["name"]),
            locals=F.when(object_tag, F.array().cast("array<string>")).when((kind == "local") & s["inside"], F.concat(s["locals"], F.array(t["value"]))).otherwise(s["locals"]),
            before=s["before"],
            nodes=F.when(emits, F.concat(s["nodes"], F.array(node))).otherwise(s["nodes"]),
        )

    none = F.array().cast(f"array<{NODE}>")
    kept = ("stack", "inside", "name", "locals", "before", "nodes")

    def block(s: Column, number: Column) -> Column:
        some = F.slice(tokens, number * WALKED + 1, F.lit(WALKED))
        start = state(**{k: s[k] for k in kept[:4]}, before=F.size(s["nodes"]), nodes=none)
        done = F.aggregate(some, start, step)
        return F.transform(F.array(done), lambda d: state(**{k: d[k] for k in kept[:5]}, nodes=F.concat(s["nodes"], d["nodes"])))[0]

    empty = state(stack=F.array(no_node).cast(STEP), inside=F.lit(False), name=F.lit(None).cast("string"), locals=F.array().cast("array<string>"), before=F.lit(0), nodes=none)
    numbers = F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.floor((F.size(tokens) - 1) / WALKED).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(numbers, empty, block, lambda s: s["nodes"])


def sitemap_nodes(docs: DataFrame) -> DataFrame:
    """(archive_id, path, node_id, parent_id, depth, name, local, locals, trail): a row for each
    sitemap object with a name or target of docs(archive_id, path, text), numbered in document
    order; parent -1 is the root, trail the node with all above it from the root down.

    A new list's parent is the last entry before it, or that of the list around it; closes
    without an open list are ignored. Each file is one row and parsed in one walk over its
    tags, however deep its lists nest; nothing is shuffled."""
    tokens = docs.select("archive_id", "path", sitemap_tokens(F.col("text")).alias("tokens"))
    rows = tokens.select("archive_id", "path", F.posexplode(_walk(F.col("tokens"))).alias("node_id", "n"))
    parent = F.coalesce(F.try_element_at("n.trail", F.lit(-2))["id"], F.lit(-1))
    return rows.select("archive_id", "path", "node_id", parent.alias("parent_id"), "n.depth", "n.name", "n.local", "n.locals", "n.trail")


def toc_nodes(nodes: DataFrame) -> DataFrame:
    """Sitemap nodes with targets resolved against their own file."""
    return nodes.select("archive_id", "node_id", "parent_id", "depth", "name", normalize_path(F.col("path"), F.col("local")).alias("local"), "trail")


def ancestors(nodes: DataFrame) -> DataFrame:
    """(archive_id, node_id, ancestor_id, steps): each node of nodes(archive_id, node_id, trail) with itself and all above it."""
    steps = F.size("trail") - 1
    rows = nodes.select("archive_id", "node_id", steps.alias("last"), F.posexplode("trail").alias("at", "t"))
    return rows.select("archive_id", "node_id", F.col("t.id").alias("ancestor_id"), (F.col("last") - F.col("at")).alias("steps"))


def ancestor_trail(toc: DataFrame, targets: DataFrame) -> DataFrame:
    """targets(archive_id, path) with `node_id`, the first node of toc that has that target, without
    regard to case, and `trail`, the names from the root to it; null where no node has it."""
    first = toc.where(F.col("local").isNotNull()).groupBy("archive_id", F.lower("local").alias("path_key")).agg(F.min_by(F.struct("node_id", "trail"), "node_id").alias("f"))
    keyed = targets.withColumn("path_key", F.lower("path"))
    found = matched(keyed, first, ["archive_id", "path_key"], "left").drop("path_key")
    return found.select("archive_id", "path", "f.node_id", F.transform("f.trail", lambda t: t["name"]).alias("trail"))


def index_entries(nodes: DataFrame) -> DataFrame:
    """Keyword list: names of a node and those above it joined by a comma, with its targets, in natural order."""
    targets = F.filter(F.transform(F.filter("locals", lambda x: x != ""), lambda x: normalize_path(F.col("path"), x)), lambda x: x.isNotNull())
    label = F.array_join(F.transform("trail", lambda t: t["name"]), ", ")
    found = nodes.where(F.size("locals") > 0).select("archive_id", "node_id", targets.alias("targets"), label.alias("label"))
    place = Window.partitionBy("archive_id").orderBy(natural_key(F.col("label")), "label", "node_id")
    return found.select("archive_id", (F.row_number().over(place) - 1).alias("pos"), "label", "targets")


def find_sitemaps(entries: DataFrame, stated: DataFrame) -> DataFrame:
    """stated(archive_id, toc_path, index_path) if such an entry exists, else the first of its kind in directory order."""
    ext = F.lower("path")
    first = entries.groupBy("archive_id").agg(
        F.min_by(F.when(ext.endswith(".hhc"), F.col("path")), F.when(ext.endswith(".hhc"), F.col("entry_seq"))).alias("first_toc"),
        F.min_by(F.when(ext.endswith(".hhk"), F.col("path")), F.when(ext.endswith(".hhk"), F.col("entry_seq"))).alias("first_index"),
    )
    known = entries.groupBy("archive_id", F.lower("path").alias("path_key")).agg(F.max_by("path", "entry_seq").alias("path"))
    root = F.lit("/")
    keys = stated.select("archive_id", F.lower(normalize_path(root, F.col("toc_path"))).alias("toc_key"), F.lower(normalize_path(root, F.col("index_path"))).alias("index_key"))
    toc = known.select("archive_id", F.col("path_key").alias("toc_key"), F.col("path").alias("stated_toc"))
    index = known.select("archive_id", F.col("path_key").alias("index_key"), F.col("path").alias("stated_index"))
    found = matched(matched(matched(first, keys, ["archive_id"], "left"), toc, ["archive_id", "toc_key"], "left"), index, ["archive_id", "index_key"], "left")
    return found.select("archive_id", F.coalesce("stated_toc", "first_toc").alias("toc_path"), F.coalesce("stated_index", "first_index").alias("index_path"))


def _row_fields(text: Column) -> Column:
    """array of struct(idx, f): the number and the literals of each chapter row of a script."""
    rows = F.regexp_extract_all(text, F.lit(f"(?s){PAGE_ROW}(?:{LITERAL}|[^\\[\\]\"']++)*+"), F.lit(0))
    fields = lambda row: F.transform(F.regexp_extract_all(F.regexp_replace(row, f"^{PAGE_ROW}", ""), F.lit(f"(?s){LITERAL}"), F.lit(0)), literal_value)
    return F.transform(rows, lambda row: F.struct(F.regexp_extract(row, PAGE_ROW, 1).cast("int").alias("idx"), fields(row).alias("f")))


def pages_items(scripts: DataFrame) -> DataFrame:
    """(archive_id, path, idx, file, title, volume) of the chapter rows `pages[n] = [...]` of scripts(archive_id, path, text).

    A row reaches to its closing bracket outside literals; it needs two literals. A fourth
    literal is a volume's name unless it starts with a tag."""
    rows = scripts.select("archive_id", "path", F.posexplode(_row_fields(F.col("text"))).alias("n", "r"))
    items = rows.select("archive_id", "path", "n", "r.idx", "r.f").where(F.size("f") >= 2)
    fourth = F.nullif(F.try_element_at("f", F.lit(4)), F.lit(""))
    volume = F.when(~fourth.rlike(r"^(?U)\s*<"), F.nullif(strip_tags(fourth), F.lit("")))
    title = F.coalesce(F.nullif(tidy_title(strip_tags(F.col("f")[1])), F.lit("")), F.col("f")[0])
    return items.select("archive_id", "path", "n", "idx", trimmed(F.col("f")[0]).alias("file"), title.alias("title"), volume.alias("volume"))


#: Bytes of the largest script that is searched for chapter rows, and the fewest texts and rows that count.
SCRIPT_BYTES, FEWEST = 512 * 1024, 3


def chapter_scripts(entries: DataFrame) -> DataFrame:
    """(archive_id, path, text): the script that holds an archive's chapter rows, one an archive.

    entries(archive_id, entry_seq, path, content, encoding): the first script in directory
    order, neither empty nor over SCRIPT_BYTES, that mentions the row of number 0 and has
    three rows. It is UTF-8 if it has its shape, else in the archive's encoding. Use it
    inside lenient_charsets()."""
    content = F.col("content")
    size = F.octet_length("content")
    scripts = entries.where(F.lower("path").endswith(".js") & (size > 0) & (size <= SCRIPT_BYTES))
    text = decode_text(content, F.when(utf8_class(content) == "multibyte", "utf-8").otherwise(F.col("encoding")))
    read = scripts.select("archive_id", "entry_seq", "path", text.alias("text")).where(F.col("text").rlike(FIRST_PAGE_ROW))
    enough = read.where(F.size(F.filter(_row_fields(F.col("text")), lambda f: F.size(f["f"]) >= 2)) >= FEWEST)
    first = enough.groupBy("archive_id").agg(F.min_by(F.struct("path", "text"), "entry_seq").alias("s"))
    return first.select("archive_id", "s.path", "s.text")


def _texts(entries: DataFrame) -> DataFrame:
    return entries.where(is_text(F.col("path")) & F.col("path").startswith("/"))


def synthetic_toc(items: DataFrame, entries: DataFrame) -> DataFrame:
    """(archive_id, pos, title, local, volume_no, volume): chapter rows whose text exists, in order of
    their index. A row's volume opens a group that lasts until the next. Needs three texts.

    items are rows of pages_items(); where an archive has several scripts, chapter_scripts()
    says which one counts."""
    texts = _texts(entries).where(F.col("length") > 0)
    base = F.lower(base_name(F.col("path")))
    known = texts.groupBy("archive_id", base.alias("base")).agg(F.max_by("path", "entry_seq").alias("local"))
    enough = texts.groupBy("archive_id").agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= FEWEST).select("archive_id")
    found = matched(items.withColumn("base", F.concat(F.lower("file"), F.lit(".txt"))), known, ["archive_id", "base"])
    found = matched(found, enough, ["archive_id"], "left_semi")
    order = Window.partitionBy("archive_id").orderBy("idx", "n")
    placed = found.withColumn("pos", F.row_number().over(order) - 1).withColumn("volume_no", F.sum(F.col("volume").isNotNull().cast("int")).over(order).cast("int"))
    group = Window.partitionBy("archive_id", "volume_no").orderBy("pos")
    return placed.select("archive_id", "pos", "title", "local", "volume_no", F.when(F.col("volume_no") > 0, F.first("volume").over(group)).alias("volume"))


def flat_toc(texts: DataFrame) -> DataFrame:
    """(archive_id, pos, name, local) of texts(archive_id, path, text) in natural order, where there are
    ten or more, or three and the first looks written by a script. Empty texts don't count; a
    null one is a text whose content isn't known."""
    order = Window.partitionBy("archive_id").orderBy(natural_key(F.col("path")), "path")
    own = _texts(texts).where(F.coalesce(F.col("text") != "", F.lit(True)))
    rows = own.select("archive_id", "path", is_docwrite(F.col("text")).alias("script"), (F.row_number().over(order) - 1).alias("pos"))
    gate = rows.groupBy("archive_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("script") & (F.col("pos") == 0)).alias("script_first"))
    gate = gate.where((F.col("n") >= 10) | (F.col("script_first") & (F.col("n") >= FEWEST)))
    name = F.regexp_replace(base_name(F.col("path")), r"(?i)\.txt$", "")
    return matched(rows, gate.select("archive_id"), ["archive_id"], "left_semi").select("archive_id", "pos", name.alias("name"), F.col("path").alias("local"))


def doc_paths(entries: DataFrame) -> DataFrame:
    """(archive_id, pos, path) of the HTML documents in natural order.

    The largest archive is numbered by all tasks: see numbering.numbered()."""
    own = entries.where(is_content(F.col("path")) & is_html(F.col("path"))).select("archive_id", "path", natural_key(F.col("path")).alias("natural"))
    return numbered(own, ["archive_id"], ["natural", "path"], "doc-paths").select("archive_id", F.col("place").cast("int").alias("pos"), "path")


def fallback_toc(docs: DataFrame) -> DataFrame:
    """(archive_id, group_no, folder, pos, name, local): documents by folder in order of first appearance;
    no folder where an archive has one only."""
    folder = F.coalesce(F.nullif(F.regexp_replace(directory(F.col("path")), "/$", ""), F.lit("")), F.lit("/"))
    rows = docs.select("archive_id", "pos", "path", folder.alias("folder"))
    seen = rows.groupBy("archive_id", "folder").agg(F.min("pos").alias("first_pos"))
    order = Window.partitionBy("archive_id").orderBy("first_pos")
    groups = seen.select("archive_id", "folder", (F.row_number().over(order) - 1).alias("group_no"), F.count(F.lit(1)).over(Window.partitionBy("archive_id")).alias("folders"))
    label = F.when(F.col("folder") == "/", ROOT_LABEL).otherwise(F.regexp_replace("folder", "^/", ""))
    many = F.col("folders") > 1
    return matched(rows, groups, ["archive_id", "folder"]).select(
        "archive_id", F.when(many, F.col("group_no")).alias("group_no"), F.when(many, label).alias("folder"), "pos", doc_name(F.col("path")).alias("name"), F.col("path").alias("local")
    )


def choose_nav(*sources: DataFrame) -> DataFrame:
    """Rows of the first of the sources that has any for an archive; all with the same columns. `source` is its number."""
    tagged = None
    for i, s in enumerate(sources):
        one = s.withColumn("source", F.lit(i))
        tagged = one if tagged is None else tagged.unionByName(one)
    best = F.min("source").over(Window.partitionBy("archive_id"))
    return tagged.withColumn("best", best).where("source = best").drop("best")


NODE_COLUMNS = ("archive_id", "node_id", "parent_id", "name", "local")


def synthetic_nodes(toc: DataFrame) -> DataFrame:
    """synthetic_toc() as nodes: a volume before its first chapter, its chapters below it."""
    volume_id = F.min("pos").over(Window.partitionBy("archive_id", "volume_no")) + F.col("volume_no") - 1
    rows = toc.withColumn("parent_id", F.when(F.col("volume_no") > 0, volume_id).otherwise(-1))
    chapters = rows.select("archive_id", (F.col("pos") + F.col("volume_no")).alias("node_id"), "parent_id", F.col("title").alias("name"), "local")
    volumes = rows.where("volume_no > 0").groupBy("archive_id", F.col("parent_id").alias("node_id")).agg(F.min("volume").alias("name"))
    return chapters.unionByName(volumes.select("archive_id", "node_id", F.lit(-1).alias("parent_id"), "name", F.lit(None).cast("string").alias("local")))


def folder_nodes(toc: DataFrame) -> DataFrame:
    """fallback_toc() as nodes: a folder before its documents; documents alone where there is one folder only."""
    first = toc.where(F.col("group_no").isNotNull()).groupBy("archive_id", "group_no").agg(F.min("folder").alias("name"))
    folders = first.select("archive_id", "group_no", F.lit(-1).alias("pos"), "name", F.lit(None).cast("string").alias("local"))
    rows = folders.unionByName(toc.select("archive_id", "group_no", "pos", "name", "local"))
    order = Window.partitionBy("archive_id").orderBy("group_no", "pos")
    lined = rows.withColumn("node_id", F.row_number().over(order) - 1)
    head = F.min("node_id").over(Window.partitionBy("archive_id", "group_no"))
    parent = F.when(F.col("group_no").isNull() | (F.col("pos") < 0), -1).otherwise(head)
    return lined.select("archive_id", "node_id", parent.alias("parent_id"), "name", "local")


def book_navigation(sitemap: DataFrame, synthetic: DataFrame, flat: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An archive's contents and list of documents: (nodes with `source`, documents).

    The first of sitemap (toc_nodes()), synthetic_toc(), flat_toc() and the folders of docs
    (doc_paths()) that has anything for an archive gives its nodes; source is its number,
    from 0. Of an archive whose contents are synthetic or flat the documents are the chapters
    in order, else they are docs. documents(archive_id, pos, path, synthetic)."""
    chapters = flat.select("archive_id", F.col("pos").alias("node_id"), F.lit(-1).alias("parent_id"), "name", "local")
    nodes = choose_nav(sitemap.select(*NODE_COLUMNS), synthetic_nodes(synthetic), chapters, folder_nodes(fallback_toc(docs)))
    order = Window.partitionBy("archive_id").orderBy("node_id")
    made = nodes.where(F.col("source").isin(1, 2) & F.col("local").isNotNull())
    made = made.select("archive_id", (F.row_number().over(order) - 1).alias("pos"), F.col("local").alias("path"), F.lit(True).alias("synthetic"))
    kept = matched(docs.select("archive_id", "pos", "path"), made.select("archive_id").distinct(), ["archive_id"], "left_anti")
    return nodes, made.unionByName(kept.withColumn("synthetic", F.lit(False)))


def reading_order(toc: DataFrame, docs: DataFrame) -> DataFrame:
    """(archive_id, position, path): targets of toc(archive_id, pos, local) in order, then the other
    docs(archive_id, pos, path); each path once without regard to case, its first spelling stays.

    The largest archive is numbered by all tasks: see numbering.numbered()."""
    rows = (
        toc.where(F.col("local").isNotNull())
        .select("archive_id", F.lit(0).alias("part"), "pos", F.col("local").alias("path"))
        .unionByName(docs.select("archive_id", F.lit(1).alias("part"), "pos", "path"))
    )
    first = rows.groupBy("archive_id", F.lower("path").alias("path_key")).agg(F.min(F.struct("part", "pos", "path")).alias("f"))
    lined = numbered(first.select("archive_id", "f.part", "f.pos", "f.path"), ["archive_id"], ["part", "pos", "path"], "reading-order")
    return lined.select("archive_id", F.col("place").cast("int").alias("position"), "path")


def toc_labels(spine: DataFrame, toc: DataFrame) -> DataFrame:
    """spine with the name of the first contents entry of each path, or its base name."""
    names = toc.where(F.col("local").isNotNull()).groupBy("archive_id", F.lower("local").alias("path_key")).agg(F.min_by("name", "pos").alias("name"))
    keyed = matched(spine.withColumn("path_key", F.lower("path")), names, ["archive_id", "path_key"], "left")
    return keyed.select("archive_id", "position", "path", F.coalesce("name", base_name(F.col("path"))).alias("label"))


def promote_entry(spine: DataFrame, entries: DataFrame) -> DataFrame:
    """spine with the first well-known page that exists and isn't in it put in front, as position 0."""
    spark = spine.sparkSession
    candidates = spark.createDataFrame(ENTRY_PAGES, "path_key string, rank int, entry_name string")
    there = entries.groupBy("archive_id", F.lower("path").alias("path_key")).agg(F.max_by("path", "entry_seq").alias("path"))
    # four rows are broadcast
    free = matched(there.join(F.broadcast(candidates), "path_key"), spine.select("archive_id", F.lower("path").alias("path_key")), ["archive_id", "path_key"], "left_anti")
    front = free.groupBy("archive_id").agg(F.min_by(F.struct("path", "entry_name"), "rank").alias("f")).select("archive_id", F.lit(0).alias("position"), F.col("f.path").alias("path"), F.col("f.entry_name").alias("entry_name"))
    moved = matched(spine, front.select("archive_id", F.lit(1).alias("shift")), ["archive_id"], "left")
    rest = moved.select("archive_id", (F.col("position") + F.coalesce("shift", F.lit(0))).alias("position"), "path", F.lit(None).cast("string").alias("entry_name"))
    return front.unionByName(rest)


def filter_toc(nodes: DataFrame, needle: str) -> DataFrame:
    """Nodes whose name holds needle, without regard to case, and all above them."""
    hits = ancestors(nodes.where(F.lower("name").contains(needle.lower()))).select("archive_id", F.col("ancestor_id").alias("node_id")).distinct()
    return matched(nodes, hits, ["archive_id", "node_id"], "left_semi")


def filter_index(index: DataFrame, needle: str, most: int = 400) -> DataFrame:
    """The first `most` keywords that hold needle; the cut is the feature."""
    return index.where(F.lower("label").contains(needle.lower())).orderBy("archive_id", "pos").limit(most)


def spine_nav(labelled: DataFrame) -> DataFrame:
    """Previous and next chapter of each position, and how far through the book it is. Neighbours in the
    largest archive come from all tasks: see numbering.numbered()."""
    lined = numbered(labelled.select("archive_id", "position", "path", "label"), ["archive_id"], ["position"], "spine", beside=("path", "label"))
    n = F.col("group_size")
    return lined.select(
        "archive_id", "position", "path",
        F.col("before_path").alias("prev_path"), F.col("before_label").alias("prev_label"), F.col("after_path").alias("next_path"), F.col("after_label").alias("next_label"),
        F.floor((F.col("position") + 1) * 100 / n + 0.5).cast("int").alias("percent"), n.alias("chapters"),
    )


def book_titles(properties: DataFrame, encodings: DataFrame) -> DataFrame:
    """(archive_id, title): property 3 of properties(archive_id, code, prop_seq, value), its first
    value, cut at its first zero byte and decoded as encodings(archive_id, encoding) says.

    Use it inside lenient_charsets()."""
    first = properties.where("code = 3").groupBy("archive_id").agg(F.min_by("value", "prop_seq").alias("value"))
    end = F.char_length(F.substring_index(F.decode("value", "ISO-8859-1"), "\0", 1))
    cut = matched(first, encodings.select("archive_id", "encoding"), ["archive_id"], "left")
    return cut.select("archive_id", decode_text(F.substring(F.col("value"), F.lit(1), end), F.col("encoding")).alias("title"))


def book_info(entries: DataFrame, toc: DataFrame, docs: DataFrame, encodings: DataFrame, titles: DataFrame) -> DataFrame:
    """One row an archive: title or else its name, encoding, the sizes of its contents, and whether its
    list of documents, docs(archive_id, synthetic), was made from chapters."""
    size = entries.groupBy("archive_id").agg(F.count(F.lit(1)).alias("entry_count"), F.sum("length").alias("file_size"))
    toc_n = toc.groupBy("archive_id").agg(F.count(F.lit(1)).alias("toc_count"))
    doc_n = docs.groupBy("archive_id").agg(F.count(F.lit(1)).alias("doc_count"), F.max("synthetic").alias("synthetic"))
    zero = F.lit(0).cast("long")
    out = size
    for side in (toc_n, doc_n, encodings, titles):
        out = matched(out, side, ["archive_id"], "left")
    return out.select(
        "archive_id", F.coalesce(F.nullif(trimmed(F.col("title")), F.lit("")), doc_name(F.col("archive_id"))).alias("title"), "encoding", "encoding_source",
        "entry_count", "file_size", F.coalesce("toc_count", zero).alias("toc_count"), F.coalesce("doc_count", zero).alias("doc_count"), F.coalesce("synthetic", F.lit(False)).alias("synthetic"),
    )


def nav_coverage(toc: DataFrame, docs: DataFrame) -> DataFrame:
    """Per archive: targets in the contents, documents, those on one side only, and volumes (nodes without a target)."""
    a = toc.where(F.col("local").isNotNull()).select("archive_id", F.lower("local").alias("path_key"), F.lit(1).alias("in_toc"), F.lit(0).alias("volume")).distinct()
    v = toc.where(F.col("local").isNull()).select("archive_id", F.lit(None).cast("string").alias("path_key"), F.lit(None).cast("int").alias("in_toc"), F.lit(1).alias("volume"))
    b = docs.select("archive_id", F.lower("path").alias("path_key"), F.lit(1).alias("in_docs")).distinct()
    sides = a.unionByName(v).withColumn("in_docs", F.lit(None).cast("int")).unionByName(b.select("archive_id", "path_key", F.lit(None).cast("int").alias("in_toc"), F.lit(0).alias("volume"), "in_docs"))
    paths = sides.groupBy("archive_id", "path_key").agg(F.max("in_toc").alias("in_toc"), F.max("in_docs").alias("in_docs"), F.sum("volume").alias("volumes"))
    named = F.col("path_key").isNotNull()
    return paths.groupBy("archive_id").agg(
        F.count("in_toc").alias("toc_targets"), F.count("in_docs").alias("documents"), F.count_if(named & F.col("in_toc").isNull()).alias("unlisted"),
        F.count_if(named & F.col("in_docs").isNull()).alias("dangling"), F.sum("volumes").alias("volumes"),
    )
