"""Alignment of passes that cut a text into different segments: links 1-1, 2-1, 1-2, 1-0 and 0-1.

Segments that are equal and alone of their kind on both sides, and cross no other such pair, are anchors. What lies between
two anchors is aligned by dynamic programming over tokens and lengths, over all pairs of places, folded inside the row that holds it.
Where no anchor comes for long (`MOST` segments a side), what lies between is worked through in tiles of so many segments, a row
each, from its end to its beginning, and the path is read off from tile to tile: the same path, and no row grows with a document.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitext_engine.functions.blocks import BLOCK, previous_blocked, row_number_blocked, running_blocked
from bitext_engine.functions.text import char_windows, once, words
from bitext_engine.session import cut_lineage

#: What a link costs: its tokens that one side lacks, a unit for every `LENGTH` characters of difference, and for the kind of link.
LENGTH, MERGED, ALONE = 20, 1, 3
MOST = 256
STEPS = {"a": (1, 1), "b": (2, 1), "c": (1, 2), "d": (1, 0), "e": (0, 1)}
_NUMBERED = "".join(str(k) for k in range(len(STEPS)))
_FIRST = -(1 << 62)
_NONE = "array<bigint>"


def _anchors(narrow: DataFrame) -> DataFrame:
    """(doc_id, sa, sb): equal segments, one on each side, that cross no others."""
    on = lambda side, f, x: f(F.when(F.col("side") == side, x))
    found = narrow.where("not blank").groupBy("doc_id", "key").agg(
        on(0, F.count, F.lit(1)).alias("n"), on(1, F.count, F.lit(1)).alias("m"),
        on(0, F.max, F.col("seg_no")).alias("sa"), on(1, F.max, F.col("seg_no")).alias("sb"),
    ).where("n = 1 and m = 1").select("doc_id", "sa", "sb")
    sa, sb = F.col("sa"), F.col("sb")
    found = running_blocked(found, ["doc_id"], sa, F.floor(sa / BLOCK), sb, "before", F.max)
    found = running_blocked(found, ["doc_id"], -sa, -F.floor(sa / BLOCK), sb, "behind", F.min)
    return found.where((F.coalesce(sb > F.col("before"), F.lit(True))) & F.coalesce(sb < F.col("behind"), F.lit(True))).select("doc_id", "sa", "sb")


def _places(narrow: DataFrame, most: int | None) -> DataFrame:
    """(doc_id, side, seg_no, at, piece): the stretch a segment lies in. `at`: the anchor before it; piece -1 holds the anchor
    itself. Stretches are whole (piece 0) unless the caller wants them cut."""
    anchors, seg = _anchors(narrow), F.col("seg_no")
    met = anchors.select("doc_id", F.lit(0).alias("side"), F.col("sa").alias("seg_no"), F.col("sa").alias("anchor")).unionByName(
        anchors.select("doc_id", F.lit(1).alias("side"), F.col("sb").alias("seg_no"), F.col("sa").alias("anchor"))
    )
    rows = narrow.select("doc_id", "side", "seg_no").join(met, ["doc_id", "side", "seg_no"], "left")
    rows = previous_blocked(rows, ["doc_id", "side"], seg, F.floor(seg / BLOCK), F.col("anchor"), "at", include_current=True)
    rows = rows.withColumn("at", F.coalesce("at", F.lit(_FIRST)))
    out = ["doc_id", "side", "seg_no", "at", "piece"]
    if most is None:
        return rows.withColumn("piece", F.when(F.col("anchor").isNull(), 0).otherwise(-1).cast("long")).select(out)
    between = row_number_blocked(rows.where("anchor is null"), ["doc_id", "side", "at"], [seg], [F.floor(seg / BLOCK)], "rank", total="n")
    pieces = between.groupBy("doc_id", "at").agg(F.ceil(F.max("n") / most).alias("pieces"))
    between = between.join(pieces, ["doc_id", "at"]).withColumn("piece", F.floor((F.col("rank") - 1) * F.col("pieces") / F.col("n")))
    return between.select(out).unionByName(rows.where("anchor is not null").withColumn("piece", F.lit(-1).cast("long")).select(out))


def _cost(one: Column, other: Column) -> Column:
    apart = one["s"] + other["s"] - 2 * F.size(F.array_intersect(one["t"], other["t"]))
    return (apart + F.floor(F.abs(one["n"] - other["n"]) / LENGTH)).cast("long")


def _sized(xs: Column) -> Column:
    """(t, s: their number, n, w: the cost of standing alone)."""
    alone = lambda x: (F.size(x["t"]) + F.floor(x["n"] / LENGTH) + ALONE).cast("long")
    return F.transform(xs, lambda x: F.struct(x["t"].alias("t"), F.size(x["t"]).alias("s"), x["n"].alias("n"), alone(x).alias("w")))


def _merged(xs: Column) -> Column:
    """Every element run together with the next."""
    pairs = F.zip_with(F.slice(xs, F.lit(2), F.size(xs)), xs, lambda two, one: F.when(two.isNotNull(), F.struct(F.array_union(one["t"], two["t"]).alias("t"), (one["n"] + two["n"]).alias("n"))))
    return _sized(pairs)


def _sides(a: Column, b: Column) -> Column:
    return F.struct(_sized(a).alias("a"), _sized(b).alias("b"), _merged(a).alias("a2"), _merged(b).alias("b2"))


@dataclass
class _Tile:
    """A part of the table of places (x segments of a, y of b are behind): own places are x < n and y < m, and those at the end of
    a side if the tile is the last one there. Beside others lie two more rows and columns, whose costs these tiles know."""

    n: Column
    m: Column
    last_a: Column | None = None
    last_b: Column | None = None
    below: tuple[Column, Column] | None = None
    right: tuple[Column, Column] | None = None

    def width(self, side: str) -> Column:
        size, last = (self.n, self.last_a) if side == "a" else (self.m, self.last_b)
        return size if last is None else size + F.when(last, 0).otherwise(1)

    def known(self, x: Column, y: Column) -> list[tuple[Column, Column]]:
        """(condition, cost) of places that need no work."""
        if self.last_a is None:
            return [((x == self.n) & (y == self.m), F.lit(0).cast("long"))]
        pick = lambda halo, i, j: F.get(F.when(i == 0, halo[0]).otherwise(halo[1]), j)
        return [
            (~self.last_a & (x >= self.n), pick(self.below, x - self.n, y)), (~self.last_b & (y >= self.m), pick(self.right, y - self.m, x)),
            ((x == self.n) & (y == self.m), F.lit(0).cast("long")),
        ]

    def own(self, x: Column, y: Column) -> Column:
        end = ~((x == self.n) & (y == self.m))
        return end if self.last_a is None else end & (self.last_a | (x < self.n)) & (self.last_b | (y < self.m))


def _table(sides: Column, tile: _Tile, edges: bool = False) -> Column:
    """(steps: the best next step from each place, a string for each diagonal, the last one first), by dynamic programming from
    the end; of equally cheap ways the least. A place holds eight times the cost of the rest and the number of the step; places
    of one diagonal need those of the next three only. ``edges``: and the costs of the first two rows and columns (t0, t1, l0, l1)."""
    a, b, a2, b2 = (sides[k] for k in ("a", "b", "a2", "b2"))
    wide, high = tile.width("a"), tile.width("b")

    def diagonal(acc: Column, s: Column) -> Column:
        low, upto = F.greatest(F.lit(0), s - high), F.least(wide, s)
        rest = lambda k, x: F.shiftright(F.get(acc[f"d{k}"], x - acc[f"x{k}"]), 3)

        def place(x: Column) -> Column:
            y = s - x
            one, other = F.get(a, x), F.get(b, y)
            # what is not there is null, and no cost is worked out for it
            ways = [
                rest(2, x + 1) + _cost(one, other), rest(3, x + 2) + _cost(F.get(a2, x), other) + MERGED,
                rest(3, x + 1) + _cost(one, F.get(b2, y)) + MERGED, rest(1, x + 1) + one["w"], rest(1, x) + other["w"],
            ]
            value = F.least(*[way * 8 + k for k, way in enumerate(ways)])
            for condition, cost in reversed(tile.known(x, y)):
                value = F.when(condition, cost * 8).otherwise(value)
            return value

        def after(v: Column) -> Column:
            steps = F.array_join(F.transform(v, lambda c: c.bitwiseAND(F.lit(7)).cast("string")), "")
            kept = [v.alias("d1"), acc["d1"].alias("d2"), acc["d2"].alias("d3"), low.alias("x1"), acc["x1"].alias("x2"), acc["x2"].alias("x3"), F.concat(acc["steps"], F.array(steps)).alias("steps")]
            if edges:
                at = lambda x, inside: F.when(inside, F.array(F.shiftright(F.get(v, x - low), 3))).otherwise(F.array().cast(_NONE))
                for name, x, inside in (("t0", F.lit(0), s <= high), ("t1", F.lit(1), (s >= 1) & (s <= high + 1)), ("l0", s, s <= wide), ("l1", s - 1, (s >= 1) & (s <= wide + 1))):
                    kept.append(F.concat(at(x, inside), acc[name]).alias(name))
            return F.struct(*kept)

        return once(F.transform(F.sequence(low, upto), place), after)

    none = F.array().cast(_NONE)
    start = [none.alias("d1"), none.alias("d2"), none.alias("d3"), *[F.lit(0).alias(f"x{k}") for k in (1, 2, 3)], F.array().cast("array<string>").alias("steps")]
    names = ["t0", "t1", "l0", "l1"] if edges else []
    return F.aggregate(
        F.sequence(wide + high, F.lit(0), F.lit(-1)), F.struct(*start, *[none.alias(k) for k in names]), diagonal,
        lambda acc: F.struct(acc["steps"].alias("steps"), *[acc[k].alias(k) for k in names]),
    )


def _walk(steps: Column, tile: _Tile, x: Column, y: Column) -> Column:
    """(x, y, path): the steps (letters of `STEPS`) from a place on, as long as the tile's own places last."""
    wide, high = tile.width("a"), tile.width("b")
    moved = lambda step, side: sum((F.when(step == str(k), v[side]).otherwise(0) for k, v in enumerate(STEPS.values())), F.lit(0))

    def go(acc: Column, s: Column) -> Column:
        step = F.substring(F.get(steps, wide + high - s), acc["x"] - F.greatest(F.lit(0), s - high) + 1, F.lit(1))
        further = once(step, lambda k: F.struct((acc["x"] + moved(k, 0)).alias("x"), (acc["y"] + moved(k, 1)).alias("y"), F.concat(acc["path"], k).alias("path")))
        return F.when((acc["x"] + acc["y"] == s) & tile.own(acc["x"], acc["y"]), further).otherwise(acc)

    return F.aggregate(
        F.sequence(F.lit(0), wide + high), F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), F.lit("").alias("path")), go,
        lambda acc: F.struct(acc["x"].alias("x"), acc["y"].alias("y"), F.translate(acc["path"], _NUMBERED, "".join(STEPS)).alias("path")),
    )


def least_path(a: Column, b: Column) -> Column:
    """Steps (letters of `STEPS`) of the cheapest alignment of two arrays of (t: distinct tokens, n: length); of
    equally cheap ones that with the least letters. Exact: all pairs of places are looked at."""
    n, m = F.size(a), F.size(b)
    plain = F.when(n == 0, F.repeat(F.lit("e"), m)).when(m == 0, F.repeat(F.lit("d"), n)).when((n == 1) & (m == 1), "a")
    start = F.lit(0)
    # where a side has nothing there is no choice, and two that are alone always cost less together
    folded = once(_sides(a, b), lambda s: once(_table(s, tile := _Tile(F.size(s["a"]), F.size(s["b"]))), lambda t: _walk(t["steps"], tile, start, start)["path"]))
    return plain.otherwise(folded)


def _links(a: Column, b: Column, path: Column) -> Column:
    """The steps with the segments that they link."""
    count = lambda text, letter: F.length(text) - F.length(F.replace(text, F.lit(letter), F.lit("")))
    size = lambda letter, side: sum((F.when(letter == k, v[side]).otherwise(0) for k, v in STEPS.items()), F.lit(0))

    def link(letter: Column, k: Column) -> Column:
        before = F.substring(path, F.lit(1), k)
        i, j = k + count(before, "b") - count(before, "e"), k + count(before, "c") - count(before, "d")
        some_a, some_b = F.slice(a, i + 1, size(letter, 0)), F.slice(b, j + 1, size(letter, 1))
        text = lambda xs: F.when(F.size(xs) > 0, F.array_join(F.transform(xs, lambda x: x["text"]), " "))
        ends = lambda xs, name: [F.get(xs, F.lit(0))["seg_no"].alias(f"{name}_first"), F.get(xs, F.size(xs) - 1)["seg_no"].alias(f"{name}_last")]
        return F.struct(
            *ends(some_a, "a"), *ends(some_b, "b"),
            F.concat(F.size(some_a).cast("string"), F.lit("-"), F.size(some_b).cast("string")).alias("link"), text(some_a).alias("text_a"), text(some_b).alias("text_b"),
        )

    return F.when(F.length(path) > 0, F.transform(F.split(path, ""), link))


def _tokens(text: Column, spaced: bool) -> Column:
    return F.array_distinct(words(text) if spaced else char_windows(F.lower(text), 2))


def _long(places: DataFrame, tile: int) -> DataFrame:
    """(doc_id, at, both): stretches of more than ``tile`` segments a side, and whether there is a choice."""
    on = lambda side: F.count(F.when(F.col("side") == side, 1))
    sizes = places.where("piece >= 0").groupBy("doc_id", "at").agg(on(0).alias("n"), on(1).alias("m"))
    return sizes.where(F.greatest("n", "m") > tile).select("doc_id", "at", ((F.col("n") > 0) & (F.col("m") > 0)).alias("both"))


def _tiled(rows: DataFrame, spaced: bool, tile: int) -> DataFrame:
    """Links of stretches that are too long for a row. Tiles of ``tile`` segments a side are worked through from the last ones, all
    on a diagonal of tiles at once, and give the costs of their first rows and columns to those before; then
    the path goes from tile to tile. A job a diagonal each way; a task holds a tile."""
    key, seg = ["doc_id", "at"], F.col("seg_no")
    ranked = row_number_blocked(rows, [*key, "side"], [seg, F.col("text")], [F.floor(seg / BLOCK)], "rank", total="total").withColumn("rank", F.col("rank") - 1)
    no = F.floor(F.col("rank") / tile).cast("int")
    # the first segment of a chunk is also behind the one before, whose last may be run together with it
    chunks = ranked.select(
        *key, "side", "total", F.struct("rank", _tokens(F.col("text"), spaced).alias("t"), F.length("text").alias("n")).alias("x"),
        F.explode(F.when((F.col("rank") % tile == 0) & (F.col("rank") > 0), F.array(no, no - 1)).otherwise(F.array(no))).alias("no"),
    ).groupBy(*key, "side", "no").agg(F.sort_array(F.collect_list("x")).alias("xs"), (F.ceil(F.max("total") / tile) - 1).alias("last"))
    chunks = cut_lineage(chunks)
    side = lambda s, no, xs: chunks.where(F.col("side") == s).select(*key, F.col("no").alias(no), F.col("xs").alias(xs), (F.col("no") == F.col("last")).alias(f"last_{xs}"), F.col("last").alias(f"to_{xs}"))
    a, b = side(0, "i", "a"), side(1, "j", "b")
    ends = a.where("last_a").join(b.where("last_b"), key).agg(F.max(F.col("i") + F.col("j"))).first()[0]
    own = lambda xs, last: F.when(last, F.size(xs)).otherwise(F.lit(tile))
    shape = _Tile(F.col("n"), F.col("m"), F.col("last_a"), F.col("last_b"), (F.col("b0"), F.col("b1")), (F.col("r0"), F.col("r1")))
    at, none, tables = [*key, "i", "j"], F.lit(None).cast(_NONE), {}
    for k in range(ends, -1, -1):
        tiles = a.withColumn("j", F.lit(k) - F.col("i")).join(b, [*key, "j"]).withColumns({"n": own(F.col("a"), F.col("last_a")), "m": own(F.col("b"), F.col("last_b"))})
        if k == ends:
            tiles = tiles.withColumns({c: none for c in ("b0", "b1", "r0", "r1")})
        else:
            known = lambda i, j, first, second, names: tables[k + 1].select(*key, (F.col("i") - i).alias("i"), (F.col("j") - j).alias("j"), *[F.col(f"table.{c}").alias(d) for c, d in zip((first, second), names, strict=True)])  # noqa: B023, E731
            tiles = tiles.join(known(1, 0, "t0", "t1", ("b0", "b1")), at, "left").join(known(0, 1, "l0", "l1", ("r0", "r1")), at, "left")
        made = tiles.select(*at, "n", "m", "last_a", "last_b", "b0", "b1", "r0", "r1", once(_sides(F.col("a"), F.col("b")), lambda s: _table(s, shape, True)).alias("table"))
        tables[k] = cut_lineage(made.drop("b0", "b1", "r0", "r1"))
    here = a.where("i = 0").select(*key, "i", F.lit(0).alias("j"), F.lit(0).alias("x"), F.lit(0).alias("y"))
    paths = []
    for k in range(ends + 1):
        walked = here.where(F.col("i") + F.col("j") == k).join(tables[k], at).select(
            *at, F.col("x").alias("x0"), F.col("y").alias("y0"), "n", "m", "last_a", "last_b", _walk(F.col("table.steps"), shape, F.col("x"), F.col("y")).alias("w"))
        walked = cut_lineage(walked)
        paths.append(walked)
        over_a, over_b = ~F.col("last_a") & (F.col("w.x") >= F.col("n")), ~F.col("last_b") & (F.col("w.y") >= F.col("m"))
        to = lambda over, yes, no: F.when(over, yes).otherwise(no).cast("int")
        gone = walked.where(over_a | over_b).select(
            *key, to(over_a, F.col("i") + 1, F.col("i")).alias("i"), to(over_b, F.col("j") + 1, F.col("j")).alias("j"),
            to(over_a, F.col("w.x") - F.col("n"), F.col("w.x")).alias("x"), to(over_b, F.col("w.y") - F.col("m"), F.col("w.y")).alias("y"))
        here = cut_lineage(gone.unionByName(here.where(F.col("i") + F.col("j") > k)))
    count = lambda text, letter: F.length(text) - F.length(F.replace(text, F.lit(letter), F.lit("")))
    size = lambda letter, s: sum((F.when(letter == c, v[s]).otherwise(0) for c, v in STEPS.items()), F.lit(0))
    path = F.col("w.path")

    def link(letter: Column, k: Column) -> Column:
        before = F.substring(path, F.lit(1), k)
        p = F.col("i").cast("long") * tile + F.col("x0") + k + count(before, "b") - count(before, "e")
        q = F.col("j").cast("long") * tile + F.col("y0") + k + count(before, "c") - count(before, "d")
        of = lambda s, first: F.transform(F.sequence(F.lit(1), F.lit(2)), lambda x: F.when(x <= size(letter, s), F.struct(F.lit(s).alias("side"), (first + x - 1).alias("rank"))))
        return F.struct(letter.alias("path"), p.alias("p"), q.alias("q"), F.array_compact(F.concat(of(0, p), of(1, q))).alias("of"))

    stepped = reduce(DataFrame.unionByName, paths).where(F.length(path) > 0).select(*key, F.inline(F.transform(F.split(path, ""), link)))
    held = stepped.select(*key, "path", "p", "q", F.inline("of"))
    return ranked.join(held, [*key, "side", "rank"]).groupBy(*key, "path", "p", "q").agg(_side(0).alias("a"), _side(1).alias("b")).select("doc_id", "a", "b", "path")


def _side(s: int) -> Column:
    return F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct("seg_no", "text"))))


def align_segments(a: DataFrame, b: DataFrame, spaced: bool = True, most: int | None = None, tile: int = MOST) -> DataFrame:
    """(doc_id, a_first, a_last, b_first, b_last, link, text_a, text_b): every segment of both passes in exactly one link.

    ``a``, ``b``: (doc_id, seg_no, text), in the order of seg_no. A link is 1-1, 2-1, 1-2, or 1-0 and 0-1, which have nulls on the
    other side. `pass_divergence` and `drift_of` take the rows as they are. A null text is an empty one. The cheapest alignment
    between anchors is found exactly, however far they are apart; ``tile``: segments a side that a row may hold. Only a caller that
    names ``most`` has what is longer cut in proportion first. Hashes of segments and their places are written down on the
    way, and texts and tokens of stretches that are longer than a tile.
    """
    sides = a.select("doc_id", F.lit(0).alias("side"), F.col("seg_no").cast("long"), F.coalesce("text", F.lit("")).alias("text")).unionByName(
        b.select("doc_id", F.lit(1).alias("side"), F.col("seg_no").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    )
    narrow = cut_lineage(sides.select("doc_id", "side", "seg_no", F.unhex(F.md5("text")).alias("key"), (F.trim("text") == "").alias("blank")))
    places = cut_lineage(_places(narrow, most))
    by, apart = ["doc_id", "side", "seg_no"], []
    if most is None and not (long := cut_lineage(_long(places, tile))).isEmpty():
        # a row for each stretch of more than a tile, so all tasks can know them
        of = F.broadcast(long.select("doc_id").distinct())
        far = cut_lineage(sides.join(of, "doc_id", "left_semi").join(places.where("piece = 0").join(F.broadcast(long), ["doc_id", "at"]), by))
        places = places.join(F.broadcast(long.select("doc_id", "at", F.lit(0).cast("long").alias("piece"))), ["doc_id", "at", "piece"], "left_anti")
        # where one side has nothing every segment stays alone
        lone = lambda s: F.when(F.col("side") == s, F.array(F.struct("seg_no", "text"))).otherwise(F.array().cast("array<struct<seg_no:bigint,text:string>>"))
        apart.append(far.where("not both").select("doc_id", lone(0).alias("a"), lone(1).alias("b"), F.when(F.col("side") == 0, "d").otherwise("e").alias("path")))
        if not long.where("both").isEmpty():
            apart.append(_tiled(far.where("both"), spaced, tile))
    rows = sides.join(places, by)
    # an anchor's second text is its first, so it need not be dealt
    anchor = F.col("piece") == -1
    rows = rows.withColumn("text", F.when(anchor & (F.col("side") == 1), "").otherwise(F.col("text")))
    blocks = rows.groupBy("doc_id", "at", "piece").agg(_side(0).alias("a"), _side(1).alias("b"))
    blocks = blocks.withColumn("b", F.when(anchor, F.transform("b", lambda x, i: F.struct(x["seg_no"].alias("seg_no"), F.get("a", i)["text"].alias("text")))).otherwise(F.col("b")))
    # tokens are looked at only where there is a choice
    choice = (F.size("a") > 0) & (F.size("b") > 0) & (F.size("a") + F.size("b") > 2)
    weighed = lambda xs: F.transform(xs, lambda x: F.struct(F.when(choice, _tokens(x["text"], spaced)).alias("t"), F.length(x["text"]).alias("n")))
    # the arrays of tokens are columns of their own step, so that the fold does not split texts again
    blocks = blocks.select("doc_id", "a", "b", weighed("a").alias("wa"), weighed("b").alias("wb"))
    paths = blocks.select("doc_id", "a", "b", least_path(F.col("wa"), F.col("wb")).alias("path"))
    paths = reduce(DataFrame.unionByName, apart, paths)
    return paths.select("doc_id", F.inline(_links(F.col("a"), F.col("b"), F.col("path"))))
