"""HTML pages to blocks, with regular expressions only: one narrow stage, no shuffle."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REGION, BLOCK, CLOSE = "\x03", "\x01", "\x02"

DROPPED = (
    r"(?is)<script[^>]*>.*?</script>",
    r"(?is)<style[^>]*>.*?</style>",
    r"(?is)<head(?:\s[^>]*)?>.*?</head>",
    r"(?s)<!--.*?-->",
)
REGION_TAG = r"(?i)<(/?(?:nav|footer|header))(?:\s[^>]*)?>"
BLOCK_TAG = r"(?i)<(/?(?:h[1-6]|p|li|ul|ol|tr|table|div|article|section|blockquote|pre))(?:\s[^>]*)?>"
ANY_TAG = r"<[^>]*>"
# fixed values: named entities as HTML defines them; & itself comes last
ENTITIES = (
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&lsquo;", "‘"), ("&rsquo;", "’"),
    ("&ldquo;", "“"), ("&rdquo;", "”"), ("&laquo;", "«"), ("&raquo;", "»"), ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"),
    ("&sect;", "§"), ("&para;", "¶"), ("&middot;", "·"), ("&bull;", "•"), ("&copy;", "©"), ("&reg;", "®"), ("&trade;", "™"),
    ("&euro;", "€"), ("&pound;", "£"), ("&times;", "×"), ("&deg;", "°"), ("&amp;", "&"),
)
NUMERIC = r"^(0*[0-9]{1,7}|[xX]0*[0-9a-fA-F]{1,6});"
# all other names, as Python's own table of HTML lists them, in one literal
_OTHERS = "\x1e".join(f"{name[:-1]}\x1f{char}" for name, char in sorted(html5.items()) if name.endswith(";") and f"&{name}" not in dict(ENTITIES))
NAMED = r"^([A-Za-z][A-Za-z0-9]*);"


def _numeric(text: Column) -> Column:
    """Numeric entities as characters; a number that is no character stays as it is written."""

    def decoded(piece: Column) -> Column:
        written = F.regexp_extract(piece, NUMERIC, 1)
        number = F.when(written.rlike("^[xX]"), F.conv(F.substr(written, F.lit(2)), 16, 10)).otherwise(written).cast("long")
        known = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        return F.when(piece.rlike(NUMERIC), F.when(known, F.concat(char, F.substr(piece, F.length(written) + 2))))

    pieces = F.transform(F.split(text, "&#"), lambda p, i: F.when(i == 0, p).otherwise(F.coalesce(decoded(p), F.concat(F.lit("&#"), p))))
    return F.when(F.contains(text, F.lit("&#")), F.array_join(pieces, "")).otherwise(text)


def _named(text: Column) -> Column:
    """Entities by any name that HTML has; what is no such name stays as it is written."""
    known = F.str_to_map(F.lit(_OTHERS), F.lit("\x1e"), F.lit("\x1f"))

    def decoded(piece: Column) -> Column:
        name = F.regexp_extract(piece, NAMED, 1)
        return F.concat(F.try_element_at(known, name), F.substr(piece, F.length(name) + 2))

    pieces = F.transform(F.split(text, "&"), lambda p, i: F.when(i == 0, p).otherwise(F.coalesce(decoded(p), F.concat(F.lit("&"), p))))
    return F.when(text.rlike("&[A-Za-z][A-Za-z0-9]*;"), F.array_join(pieces, "")).otherwise(text)


def _plain(col: Column) -> Column:
    bare = F.regexp_replace(col, ANY_TAG, " ")
    out = _named(_numeric(bare))
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.when(F.contains(bare, F.lit("&")), out).otherwise(bare)
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def _open_regions(tags: Column) -> Column:
    """The innermost region open after each of the tags ("nav", "/nav", ...); an end tag closes what was opened inside
    its region, and one without a beginning nothing."""
    start = F.struct(F.lit("").alias("stack"), F.array().cast("array<string>").alias("seen"))

    def step(acc: Column, tag: Column) -> Column:
        name = F.concat(F.lit("/"), F.ltrim(tag, F.lit("/")))
        opened = F.concat(acc["stack"], F.lit("/"), tag)
        begins = F.length(acc["stack"]) - F.instr(F.reverse(acc["stack"]), F.reverse(name)) - F.length(name) + 1
        closed = F.when(F.contains(acc["stack"], name), F.substr(acc["stack"], F.lit(1), begins)).otherwise(acc["stack"])
        stack = F.when(tag == "", acc["stack"]).when(F.startswith(tag, F.lit("/")), closed).otherwise(opened)
        return F.struct(stack.alias("stack"), F.concat(acc["seen"], F.array(F.substring_index(stack, "/", -1))).alias("seen"))

    return F.aggregate(tags, start, step, lambda acc: acc["seen"])


def _tag(piece: Column) -> Column:
    return F.when(F.instr(piece, CLOSE) > 0, F.lower(F.substring_index(piece, CLOSE, 1))).otherwise("")


def _rest(piece: Column) -> Column:
    return F.substring_index(piece, CLOSE, -1)


def html_to_blocks(pages: DataFrame, doc_id: str = "page_id", html: str = "html") -> DataFrame:
    """Blocks (heading, list_item, table_row, paragraph, nav, footer, header) in page order.

    A page is split at region tags first and at block tags inside each region. Regions may nest: which
    one is open comes from a fold over the page's region tags, inside its row, so no window is needed.
    """
    text = F.col(html)
    for pattern in DROPPED:
        text = F.regexp_replace(text, pattern, " ")
    text = F.regexp_replace(text, REGION_TAG, f"{REGION}$1{CLOSE}")
    parts = F.split(text, REGION)
    regions = F.zip_with(
        parts, _open_regions(F.transform(parts, _tag)),
        lambda piece, region: F.struct(
            region.alias("region"),
            F.split(F.regexp_replace(_rest(piece), BLOCK_TAG, f"{BLOCK}$1{CLOSE}"), BLOCK).alias("pieces"),
        ),
    )
    flat = F.flatten(
        F.transform(
            regions,
            lambda r: F.transform(r["pieces"], lambda p: F.struct(r["region"].alias("region"), p.alias("piece"))),
        )
    )
    exploded = pages.select(F.col(doc_id).cast("string").alias("doc_id"), F.posexplode(flat).alias("pos", "b"))
    named = exploded.select(
        "doc_id", "pos", F.col("b.region").alias("region"), _tag(F.col("b.piece")).alias("tag"),
        _plain(_rest(F.col("b.piece"))).alias("text"),
    ).where(F.col("text") != "")
    kind = (
        F.when(F.col("region").isin("nav", "footer", "header"), F.col("region"))
        .when(F.col("tag").rlike("^h[1-6]$"), "heading")
        .when(F.col("tag") == "li", "list_item")
        .when(F.col("tag") == "tr", "table_row")
        .otherwise("paragraph")
    )
    return named.select(
        "doc_id",
        F.lit(1).alias("page_no"),
        F.col("pos").alias("block_no"),
        kind.alias("block_kind"),
        F.lit(None).cast("string").alias("change_kind"),
        "text",
    )
