"""Markup as tokens, and the elements that a walk over them opens and closes, as column expressions.

Tokens are those of an HTML reader: quotes count only where a value begins, what raw
elements hold is no markup, and a tag that never ends takes the rest of the text. Tokens
joined give the text again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import bound
from .text import unquoted

#: Elements whose content is no markup, and elements without content.
RAW = ("script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes")
VOID = ("area", "base", "basefont", "bgsound", "br", "col", "embed", "frame", "hr", "img", "input", "keygen", "link", "meta", "param", "source", "track", "wbr")
#: Elements whose end tag ends themselves only, whatever else is open in them.
FORMATTING = ("a", "b", "big", "code", "em", "font", "i", "nobr", "s", "small", "strike", "strong", "tt", "u")
#: Elements that an end tag of another kind doesn't reach over, and those that an implied end doesn't besides.
BOUNDARIES = ("applet", "caption", "marquee", "object", "select", "table", "td", "template", "th")
SHIELDS = (*BOUNDARIES, "button", "dl", "ol", "ul")
#: Start tags that end an open paragraph, and those that end others of their kind.
BLOCKS = (
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3",
    "h4", "h5", "h6", "header", "hgroup", "hr", "li", "listing", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "ul",
)
IMPLIED = {
    **{x: ("p",) for x in BLOCKS}, "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "option": ("option",), "optgroup": ("option", "optgroup"),
    "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"), "thead": ("tbody", "thead", "tfoot", "tr", "td", "th"),
    "tfoot": ("tbody", "thead", "tfoot", "tr", "td", "th"), "select": ("select",),
}

VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)"""
#: An attribute with the space or slashes before it; a value may be missing after its sign.
ATTRIBUTE = rf"""[\s/]*+[^\s/>][^\s/>=]*+(?:\s*+=\s*+{VALUE}?+)?+"""
NAME = r"[a-zA-Z][^\s/>]*+"
ELEMENT_TAG = rf"</?{NAME}(?:{ATTRIBUTE})*+[\s/]*+>"
RAW_START = rf"<({'|'.join(RAW)})(?=[\s/>])(?:{ATTRIBUTE})*+[\s/]*+>"
#: Sections: a raw element to its end tag or the text's end; a comment; declarations and their like; a tag; a tag without an end; text.
TOKEN = (
    rf"(?is){RAW_START}.*?(?:</\1(?=[\s/>])[^>]*+>|\z)|<!--(?:-?>|.*?(?:--!?>|\z))|<[!?][^>]*+(?:>|\z)|</[^a-z>][^>]*+(?:>|\z)"
    rf"|{ELEMENT_TAG}|</?[a-z].*+|[^<]++|<"
)


def tokens_of(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))


def token_name(token: Column) -> Column:
    """The element's name in lower case, after a slash for an end tag; empty for what is no tag."""
    return F.lower(F.regexp_extract(token, rf"^<(/?{NAME})", 1))


def tag_of(token: Column) -> Column:
    """A token's tag alone: of a raw element its start tag, of any other tag itself; empty for what is no start tag."""
    return F.regexp_extract(token, rf"(?s)^<{NAME}(?:{ATTRIBUTE})*+[\s/]*+>", 0)


def in_tags(html: Column, change: Callable[[Column], Column]) -> Column:
    """html with change applied to each of its start tags."""

    def changed(token: Column) -> Column:
        rest = lambda tag: F.substr(token, F.char_length(tag) + 1)
        return F.when(token.rlike("^<[a-zA-Z]"), bound(tag_of(token), lambda tag: F.when(tag != "", F.concat(change(tag), rest(tag))).otherwise(token))).otherwise(token)

    return F.array_join(F.transform(tokens_of(html), changed), "")


def attribute_pieces(tag: Column) -> Column:
    """A start tag's attributes as they are written, each with what is before it; of one name all."""
    inner = F.regexp_replace(F.regexp_replace(tag, rf"^<{NAME}", ""), ">$", "")
    return F.regexp_extract_all(inner, F.lit(f"(?s){ATTRIBUTE}"), F.lit(0))


def piece_name(piece: Column) -> Column:
    return F.lower(F.regexp_extract(piece, r"(?s)^[\s/]*+([^\s/>][^\s/>=]*+)", 1))


def piece_value(piece: Column) -> Column:
    """The value of an attribute piece without its quotes, entities decoded; empty without one."""
    return unquoted(F.regexp_extract(piece, rf"(?s)^[\s/]*+[^\s/>][^\s/>=]*+\s*+=\s*+({VALUE})", 1))


def keep_attributes(tag: Column, keeps: Callable[[Column], Column]) -> Column:
    """A start tag with those attribute pieces that keeps(piece) lets stay, the rest byte for byte."""
    head = F.regexp_extract(tag, rf"^<{NAME}", 0)
    foot = F.regexp_extract(tag, rf"(?s)^<{NAME}(?:{ATTRIBUTE})*+([\s/]*+)>", 1)
    end = F.when(foot.contains("/"), F.lit("/>")).otherwise(F.lit(">"))
    return bound(attribute_pieces(tag), lambda all_: F.when(F.forall(all_, keeps), tag).otherwise(F.concat(head, F.array_join(F.filter(all_, keeps), ""), end)))


def _above(stack: Column, name: Column) -> Column:
    """What is open in the last open element of this name, each name with a slash after it; null where none is open."""
    mark = F.concat(F.lit("/"), name, F.lit("/"))
    find = lambda line: F.when(F.contains(line, mark), F.call_function("substring_index", line, mark, F.lit(-1)))
    return bound(F.concat(stack, F.lit("/")), find)


def _free(above: Column, boundaries: tuple[str, ...]) -> Column:
    """Whether none of the boundaries is open above."""
    return ~above.rlike(rf"(?:^|/)(?:{'|'.join(boundaries)})/")


def kept_runs(names: Column, dropped: tuple[str, ...]) -> Column:
    """array of struct(first, size): the runs of tokens (from 1) outside the elements to be dropped.

    names are the tokens' names; a raw element is one token and void elements hold nothing,
    so these are no concern here. The walk keeps the open elements, the innermost last. An
    end tag closes the last open element of its name and all that is open in it, but for
    one beyond a boundary, which it doesn't reach; that of a formatting element closes that one alone.
    A start tag first closes what it implies the end of. An element to be dropped goes to
    where it is closed, or to the text's end."""
    implied = F.create_map(*[x for k, v in IMPLIED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    bare = (*RAW, *VOID)
    # names of one byte a letter, so that the open elements' line is measured without reading it
    walk = F.filter(F.transform(names, lambda n, i: F.struct((i + 1).alias("at"), F.regexp_replace(n, r"[^\x00-\x7f]", "?").alias("name"))), lambda t: t["name"] != "")
    runs = F.array().cast("array<struct<first:int,size:int>>")
    state = lambda stack, drop, first, done: F.struct(stack.alias("stack"), drop.cast("int").alias("drop"), first.cast("int").alias("first"), done.alias("done"))
    size = F.octet_length

    def cut(stack: Column, ends: Column) -> Column:
        """The stack without the open elements of these names that no boundary shields, and what they hold."""
        reached = F.filter(F.transform(ends, lambda n: _above(stack, n)), lambda x: x.isNotNull() & _free(x, SHIELDS))
        held = F.array_max(F.transform(reached, size))
        return bound(held, lambda n: F.when(n.isNull(), stack).otherwise(F.regexp_replace(F.left(stack, size(stack) - n), "/[^/]+$", "")))

    def started(s: Column, t: Column) -> Column:
        name, ends = t["name"], F.try_element_at(implied, t["name"])

        def on(stack: Column) -> Column:
            over = (s["drop"] >= 0) & (size(stack) <= s["drop"])
            first = F.when(over, t["at"]).otherwise(s["first"])
            free = over | (s["drop"] < 0)
            holds = ~name.isin(*bare)
            begins = free & holds & name.isin(*dropped)
            run = F.struct(first.cast("int").alias("first"), (t["at"] - first).cast("int").alias("size"))
            return state(
                F.when(holds, F.concat(stack, F.lit("/"), name)).otherwise(stack),
                F.when(begins, size(stack)).when(free, -1).otherwise(s["drop"]),
                first,
                F.when(begins, F.concat(s["done"], F.array(run))).otherwise(s["done"]),
            )

        return bound(F.when(ends.isNull(), s["stack"]).otherwise(cut(s["stack"], ends)), on)

    def ended(s: Column, t: Column) -> Column:
        name = F.substr(t["name"], F.lit(2))

        def on(above: Column) -> Column:
            before = F.regexp_replace(F.left(s["stack"], size(s["stack"]) - size(above) - size(name)), "/$", "")
            alone = name.isin(*FORMATTING)
            stack = F.when(alone & (above != ""), F.concat(before, F.lit("/"), F.regexp_replace(above, "/$", ""))).otherwise(before)
            drop = F.when(alone & (s["drop"] > size(before)), s["drop"] - size(name) - 1).otherwise(s["drop"])
            over = (s["drop"] >= 0) & (size(stack) <= drop)
            # what ends from outside stays: the tag that ends the dropped element with one around it, or a formatting element's
            own = F.struct(t["at"].cast("int").alias("first"), F.lit(1).alias("size"))
            outer = alone & (s["drop"] > size(before)) & ~over
            return state(stack, F.when(over, -1).otherwise(drop), F.when(over, t["at"]).otherwise(s["first"]), F.when(outer, F.concat(s["done"], F.array(own))).otherwise(s["done"]))

        def reach(above: Column) -> Column:
            return F.when(above.isNull() | ~(name.isin(*BOUNDARIES) | _free(above, BOUNDARIES)), s).otherwise(on(above))

        return bound(_above(s["stack"], name), reach)

    step = lambda s, t: F.when(t["name"].startswith("/"), ended(s, t)).otherwise(started(s, t))
    last = F.size(names)

    def finish(s: Column) -> Column:
        rest = F.struct(s["first"].alias("first"), (last - s["first"] + 1).cast("int").alias("size"))
        return F.when(s["drop"] < 0, F.concat(s["done"], F.array(rest))).otherwise(s["done"])

    return F.aggregate(walk, state(F.lit(""), F.lit(-1), F.lit(1), runs), step, finish)


def without_elements(html: Column, dropped: tuple[str, ...]) -> Column:
    """html without the elements of these names, all that they hold, their stray end tags, and a tag that never ends.

    Each token is looked at once. What isn't dropped stays as it is written, but for a raw
    element without an end, which gets one."""
    holding = [x for x in dropped if x not in RAW and x not in VOID]
    ends = lambda t: t.rlike(rf"(?is)^(?:{ELEMENT_TAG}|{RAW_START}.*</\1(?=[\s/>])[^>]*>)\z")

    def closed(tokens: Column) -> Column:
        """The tokens with the last one, which alone may lack its end, put right."""
        last = F.element_at(tokens, -1)
        open_ = (F.size(tokens) > 0) & last.rlike("^</?[a-zA-Z]") & ~ends(last)
        raw = F.concat(last, F.lit("</"), token_name(last), F.lit(">"))
        fixed = F.when(last.rlike(rf"(?is)^{RAW_START}"), F.concat(F.slice(tokens, 1, F.size(tokens) - 1), F.array(raw))).otherwise(F.slice(tokens, 1, F.size(tokens) - 1))
        return F.when(open_, fixed).otherwise(tokens)

    names_ = [*dropped, *(f"/{x}" for x in dropped)]
    joined = lambda pairs: F.array_join(F.transform(F.filter(pairs, lambda p: ~p["name"].isin(*names_)), lambda p: p["token"]), "")

    def sifted(pairs: Column) -> Column:
        names = F.transform(pairs, lambda p: p["name"])
        runs = lambda: bound(names, lambda n: kept_runs(n, tuple(holding)))
        outside = lambda: F.flatten(F.transform(runs(), lambda r: F.slice(pairs, r["first"], r["size"])))
        return F.when(F.exists(pairs, lambda p: p["name"].isin(*holding)), joined(outside())).otherwise(joined(pairs))

    named = lambda tokens: F.transform(tokens, lambda t: F.struct(t.alias("token"), token_name(t).alias("name")))
    return bound(tokens_of(html), lambda raw: bound(named(closed(raw)), sifted))
