"""Text expressions. Everything is a native column expression, so scans stay prunable."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# what stands between words; splitting at it is far cheaper than matching every word
BETWEEN_WORDS = r"[^\p{L}\p{N}]+"

# full-width forms run parallel to ASCII; the ideographic space stands for a blank
_FULL_WIDTH = "".join(chr(0xFF01 + i) for i in range(94)) + "　"
_ASCII = "".join(chr(0x21 + i) for i in range(94)) + " "


def normalize_text(col: Column) -> Column:
    """Key form of a text: full-width ASCII folded, lower case, single blanks."""
    folded = F.lower(F.translate(col, _FULL_WIDTH, _ASCII))
    return F.trim(F.regexp_replace(folded, r"\s+", " "))


def words(col: Column) -> Column:
    """Lower-cased words in order."""
    return F.array_remove(F.split(F.lower(col), BETWEEN_WORDS), "")


def shingles(tokens: Column, n: int) -> Column:
    """All runs of ``n`` neighbouring tokens, joined by a blank.

    Zips shifted copies of the array: linear in its length, where slicing per
    position would copy the array once for every token. ``tokens`` should be a
    plain column, as it is named ``n`` times.
    """
    if n == 1:
        return tokens
    count = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    out = F.slice(tokens, F.lit(1), count)
    for shift in range(1, n):
        out = F.zip_with(
            out, F.slice(tokens, F.lit(shift + 1), count), lambda a, b: F.concat(a, F.lit(" "), b)
        )
    return out


def char_windows(col: Column, width: int) -> Column:
    """Every substring of ``width`` characters, by position; one pass over the text."""
    return F.regexp_extract_all(col, F.lit(f"(?s)(?=(.{{{int(width)}}}))"), F.lit(1))


def heads(col: Column, width: int) -> Column:
    """For every position the text from there on, ``width`` characters at most."""
    return F.regexp_extract_all(col, F.lit(f"(?s)(?=(.{{1,{int(width)}}}))"), F.lit(1))


def pieces(col: Column, size: int, overlap: int) -> Column:
    """A text in pieces of ``size`` characters: (own, ahead), ahead being what follows, up to
    ``overlap`` characters. So no array per position is ever as long as the text."""
    cut = rf"(?s)\G(.{{1,{size}}})(?=(.{{0,{overlap}}}))"
    part = lambda g: F.regexp_extract_all(col, F.lit(cut), F.lit(g))
    return F.zip_with(part(1), part(2), lambda own, ahead: F.struct(own.alias("own"), ahead.alias("ahead")))


def run_lengths(rows: DataFrame, items: str, keep: Sequence[str]) -> DataFrame:
    """(keep, _runs): an array's different items as (term, tf), in order. Counted within the row, by sorting."""
    sorted_ = rows.select(*keep, F.sort_array(items).alias("_s"))
    places = F.when(F.size("_s") > 0, F.sequence(F.lit(0), F.size("_s") - 1)).otherwise(F.array().cast("array<int>"))
    begun = sorted_.select(*keep, "_s", F.filter(places, lambda i: (i == 0) | (F.get("_s", i) != F.get("_s", i - 1))).alias("_at"))
    until = lambda k: F.coalesce(F.get("_at", k + 1), F.size("_s"))
    return begun.select(*keep, F.transform("_at", lambda i, k: F.struct(F.get("_s", i).alias("term"), (until(k) - i).cast("long").alias("tf"))).alias("_runs"))


def counted(rows: DataFrame, items: str, keep: Sequence[str]) -> DataFrame:
    """(keep, term, tf): how often each item stands in a row's array."""
    # outer, as the filter of empty arrays that the optimizer derives otherwise would sort again for each item
    return run_lengths(rows, items, keep).select(*keep, F.inline_outer("_runs")).where("term is not null")


def jaccard(a: Column, b: Column) -> Column:
    """Share of common distinct tokens; 1 for two empty lists."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def count_of(col: Column, pattern: str) -> Column:
    return F.regexp_count(col, F.lit(pattern)).cast("long")


ROMAN = (("i", 1), ("v", 5), ("x", 10), ("l", 50), ("c", 100), ("d", 500), ("m", 1000))


def marker_to_int(col: Column) -> Column:
    """Value of a list marker: digits of any kind, a letter (a = 1), or a roman numeral. The single letters i, v and x
    are taken as roman, c, d, l and m as letters."""
    low = F.lower(col)
    worth = lambda ch: F.coalesce(*[F.when(ch == letter, n) for letter, n in ROMAN], F.lit(0))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("last"))
    roman = F.aggregate(
        F.reverse(F.split(low, "")), start,
        lambda acc, ch: F.struct(
            F.when(worth(ch) < acc["last"], acc["total"] - worth(ch)).otherwise(acc["total"] + worth(ch)).cast("long").alias("total"),
            F.greatest(acc["last"], worth(ch)).cast("long").alias("last"),
        ),
        lambda acc: acc["total"],
    )
    return (
        F.when(low.rlike("^[a-hj-uwyz]$"), (F.ascii(low) - 96).cast("long"))
        .when(low.rlike("^[ivxlcdm]+$"), roman)
        .when(low.rlike("[a-z]"), F.lit(None).cast("long"))
        .otherwise(numeral_to_int(col))
    )


def numeral_to_int(col: Column) -> Column:
    """Value of a number written in ASCII, full-width or Han digits (up to 万)."""
    plain = F.translate(col, "０１２３４５６７８９〇零一二三四五六七八九", "01234567890" + "0123456789")
    unit = lambda ch: (
        F.when(ch == "十", 10).when(ch == "百", 100).when(ch == "千", 1000).otherwise(0)
    )

    def step(acc: Column, ch: Column) -> Column:
        return (
            F.when(
                ch == "万",
                F.struct(((acc["total"] + acc["cur"]) * 10000).alias("total"), F.lit(0).cast("long").alias("cur")),
            )
            .when(
                unit(ch) > 0,
                F.struct(
                    (acc["total"] + F.greatest(acc["cur"], F.lit(1)) * unit(ch)).cast("long").alias("total"),
                    F.lit(0).cast("long").alias("cur"),
                ),
            )
            .otherwise(
                F.struct(
                    acc["total"].alias("total"),
                    (acc["cur"] * 10 + F.coalesce(ch.try_cast("long"), F.lit(0))).cast("long").alias("cur"),
                )
            )
        )

    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("cur"))
    folded = F.aggregate(F.split(plain, ""), start, step, lambda acc: acc["total"] + acc["cur"])
    ascii_only = plain.rlike("^[0-9]+$")
    return F.when(F.coalesce(plain, F.lit("")) == "", F.lit(None).cast("long")).when(
        ascii_only, plain.try_cast("long")
    ).otherwise(folded)


def _letters(tokens: Column, shared: Column, other: int) -> Column:
    """Every token as one character: its place among the shared ones, or `other`. Surrogates are stepped over."""
    place = lambda t: F.array_position(shared, t).cast("int") + 2
    code = lambda n: F.when(n == 2, F.lit(other)).when(n >= 0xD800, n + 0x800).otherwise(n)
    return F.decode(F.unhex(F.array_join(F.transform(tokens, lambda t: F.lpad(F.hex(code(place(t))), 8, "0")), "")), "UTF-32")


def once(value: Column, use) -> Column:
    """``use(value)``, the value worked out once a row, however often it is named there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def token_distance(a: Column, b: Column) -> Column:
    """Least number of tokens to insert, delete or replace to make ``a`` of ``b``, exactly, whatever their length.

    Tokens become characters, so that the distance of strings does the work; it is tried in bands of 8, 64 and 512
    places around the diagonal before it is done in full. Tokens that only one side has are equal to none of the
    other's, so one character a side stands for them all. ``a`` and ``b`` should be plain columns.
    """

    def distance(xy: Column) -> Column:
        x, y = xy["x"], xy["y"]
        within = lambda band, wider: once(F.levenshtein(x, y, band), lambda d: F.when(d >= 0, d).otherwise(wider))
        return within(8, within(64, within(512, F.levenshtein(x, y))))

    letters = once(F.array_intersect(a, b), lambda shared: F.struct(_letters(a, shared, 1).alias("x"), _letters(b, shared, 2).alias("y")))
    return once(letters, distance).cast("long")
