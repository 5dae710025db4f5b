"""Places within groups from a bit-sliced index: slices of a key's bits and counts of set bits, from the highest bit down.

Lines of a group lie in pieces of about PIECE lines. A piece holds its lines and, for each bit of their keys, a slice: one
bit a line, 64 in a word. To find the key of the last place that is asked for, count the lines whose next bit is 0 among
those still in question: if they are enough the cut-off's bit is 0, else it is 1 and they all come before it. What a piece
counts is the number of set bits in an AND of slices. A group of several pieces adds up their counts for each bit; a group
of one piece needs no other. At the end the bits say which lines lie before the cut-off and which on it, and only those
are fetched from the pieces.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, saved

#: Lines of a piece, about.
PIECE = 4096

#: Bits of a key that one long of a line holds.
PACKED = 62


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _bits(df: DataFrame, first: Sequence[tuple[str, bool]]) -> list[Column]:
    """The bits of the key of ``first`` (whole-number column, larger first), highest first; 0 comes before 1, null after all.

    Bits in which all values agree are left out: what the least and the greatest value share from the top, all share.
    """
    ask = [f(c) for c, _ in first for f in (F.min, F.max, lambda x: F.count(F.when(F.col(x).isNull(), 1)))]
    got = list(df.agg(*[a.alias(f"a{i}") for i, a in enumerate(ask)]).first())
    bits = []
    for i, (c, larger_first) in enumerate(first):
        low, high, nulls = got[3 * i : 3 * i + 3]
        value = F.col(c).cast("long")
        if nulls:
            bits.append(value.isNull())
        width = ((low ^ high) & (1 << 64) - 1).bit_length() if low is not None else 0
        for b in reversed(range(width)):
            one = F.shiftrightunsigned(value, b).bitwiseAND(_long(1)) == 1
            bits.append(F.coalesce(one != F.lit(larger_first != (b == 63)), F.lit(False)))  # the sign bit counts the other way
    return bits


def _packed(bits: Sequence[Column]) -> tuple[list[Column], list[tuple[int, int]]]:
    """Longs that order like the bits, and where each bit lies: (number of the long, its place from the right)."""
    longs, places = [], []
    for k, at in enumerate(range(0, max(len(bits), 1), PACKED)):
        some = bits[at : at + PACKED]
        longs.append(reduce(lambda a, b: a + b, [F.when(b, _long(1 << len(some) - 1 - i)).otherwise(_long(0)) for i, b in enumerate(some)], _long(0)))
        places += [(k, len(some) - 1 - i) for i in range(len(some))]
    return longs, places


def _slices(longs: int, places: Sequence[tuple[int, int]]) -> str:
    """For each bit of the key one bit of each line, 64 lines in a word, the first of them lowest."""
    if not places:
        return "cast(array() as array<array<bigint>>)"
    words = [f"transform(blocks, k -> aggregate(k, 0L, (v, x) -> shiftleft(v, 1) | (shiftright(x{f'.c{c}' if longs > 1 else ''}, {b}) & 1L)))" for c, b in places]
    keys = "transform(lines, x -> " + ("x.c0" if longs == 1 else "named_struct(" + ", ".join(f"'c{i}', x.c{i}" for i in range(longs)) + ")") + ")"
    blocks = "transform(sequence(0L, (n - 1) div 64), w -> reverse(slice(keys, cast(w * 64 + 1 as int), 64)))"
    return f"element_at(transform(array({keys}), keys -> element_at(transform(array({blocks}), blocks -> array({', '.join(words)})), 1)), 1)"


#: A set bit for each of a piece's n lines.
_ALL = "transform(sequence(0L, (n - 1) div 64), w -> if(w < (n - 1) div 64, -1L, shiftrightunsigned(-1L, cast(63 - (n - 1) % 64 as int))))"


def _count(words: str) -> str:
    return f"aggregate({words}, 0L, (a, x) -> a + bit_count(x))"


def _descended(places: int) -> str:
    """The descent over a piece's own slices: eq, the lines on the cut-off, lt, those before it."""
    zeros = "zip_with(s.eq, b, (e, x) -> e & ~x)"
    enough = "named_struct('eq', z, 'lt', s.lt, 'need', s.need)"
    passed = "named_struct('eq', zip_with(s.eq, b, (e, x) -> e & x), 'lt', zip_with(s.lt, z, (a, x) -> a | x), 'need', s.need - c)"
    step = f"element_at(transform(array({zeros}), z -> element_at(transform(array({_count('z')}), c -> if(c >= s.need, {enough}, {passed})), 1)), 1)"
    return f"aggregate(slices, named_struct('eq', {_ALL}, 'lt', transform({_ALL}, x -> 0L), 'need', {places}L), (s, b) -> {step}, s -> named_struct('eq', s.eq, 'lt', s.lt))"


def _followed() -> str:
    """eq and lt of a piece by the bits of its group's cut-off that are known."""
    bits = "zip_with(slice(slices, 1, size(cut)), cut, (b, one) -> named_struct('b', b, 'one', one))"
    go = "named_struct('eq', zip_with(s.eq, x.b, (e, w) -> if(x.one, e & w, e & ~w)), 'lt', if(x.one, zip_with(s.lt, zip_with(s.eq, x.b, (e, w) -> e & ~w), (a, w) -> a | w), s.lt))"
    return f"aggregate({bits}, named_struct('eq', {_ALL}, 'lt', transform({_ALL}, x -> 0L)), (s, x) -> {go})"


def _same(left: str, right: str, names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in names], F.lit(True))


def _joined(pieces: DataFrame, groups: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    """By group, nulls being equal. ``groups`` is a written table: Spark broadcasts it if that is small, and splits skew if not."""
    more = [F.col(f"r.{c}") for c in groups.columns if c not in names]
    return pieces.alias("l").join(groups.alias("r"), _same("l", "r", names), how).select("l.*", *more)


def _cut_offs(pieces: DataFrame, crowds: DataFrame, names: Sequence[str], places: int, bits: int) -> DataFrame:
    """(group, cut: bits of the cut-off, ties: lines on it) of groups in many pieces, one round of sums for each bit."""
    state = crowds.select(*names, _long(places).alias("need"), F.array().cast("array<boolean>").alias("cut"))
    pieces = pieces.select(*names, "n", "slices")
    for j in range(bits + 1):
        at = _joined(pieces, state, names).withColumn("m", F.expr(_followed()))
        if j == bits:
            return saved(at.groupBy(*names).agg(F.first("cut").alias("cut"), F.sum(F.expr(_count("m.eq"))).alias("ties")))
        zeros = F.sum(F.expr(_count(f"zip_with(m.eq, slices[{j}], (e, x) -> e & ~x)"))).alias("zeros")
        sums = at.groupBy(*names).agg(F.first("need").alias("need"), F.first("cut").alias("cut"), zeros)
        enough = F.col("zeros") >= F.col("need")
        state = saved(sums.select(*names, F.when(enough, F.col("need")).otherwise(F.col("need") - F.col("zeros")).alias("need"), F.concat("cut", F.array(~enough)).alias("cut")))
    raise AssertionError


def first_places(df: DataFrame, groups: Sequence[str], first: Sequence[tuple[str, bool]], then: Sequence[str], places: int = 2, carry: Sequence[str] = ()) -> DataFrame:
    """The lines of ``df`` with a place of at most ``places`` in their group: ``groups``, pos long, tied long and the columns named.

    Lines are in order of ``first``, whole numbers of at most 64 bits (name, larger first), then of ``then``, ascending;
    nulls come last in each and tie with one another. pos counts from 1, equal lines one after another in any order. tied
    is how many lines of the group, returned or not, are equal in ``first``. Null groups are groups of their own. Columns
    of ``carry`` must be of kinds that can be ordered. Other columns of ``df`` don't matter, whatever their names; a name
    may be given in several places, but none of pos and tied. An empty table gives an empty result.

    A group of over PIECE lines is dealt out by the places of its lines in the input's partitions; its pieces are counted
    together, and each sends on ``places`` lines at most.
    """
    prepare(df.sparkSession)
    kept = list(dict.fromkeys([*[c for c, _ in first], *then, *carry]))
    if {"pos", "tied"} & {*groups, *kept}:
        raise ValueError("pos and tied are names of results")
    names = [f"g{i}" for i in range(len(groups))]
    lines = df.select(*[F.col(f"`{c}`").alias(g) for c, g in zip(groups, names, strict=True)], *[F.col(f"`{c}`").alias(f"r{i}") for i, c in enumerate(kept)])
    name = {c: f"r{i}" for i, c in enumerate(kept)}
    codes, at = _packed(_bits(lines, [(name[c], d) for c, d in first]))
    line = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(codes)], F.struct(*name.values()).alias("row"))
    order = [f"'c{i}', x.c{i}" for i in range(len(codes))] + [f"'n_{name[c]}', x.row.{name[c]} is null, 'o_{name[c]}', x.row.{name[c]}" for c in then]
    crowds = saved(lines.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PIECE).select(*names, F.ceil(F.col("n") / PIECE).alias("pieces")))
    dealt = _joined(lines.withColumn("at", F.monotonically_increasing_id()), crowds, names, "left")
    dealt = dealt.withColumns({"shared": F.col("pieces").isNotNull(), "piece": F.coalesce(F.pmod("at", "pieces"), _long(0))}).drop("at", "pieces")
    held = dealt.repartition(*names, "piece").groupBy(*names, "piece", "shared").agg(F.collect_list(line).alias("lines")).withColumn("n", F.size("lines").cast("long"))
    index = saved(held.withColumn("slices", F.expr(_slices(len(codes), at))))
    taken = f"transform(filter(lines, (x, i) -> (shiftright(t[cast(i div 64 as int)], i % 64) & 1L) = 1L), x -> named_struct({', '.join(order)}, 'row', x.row))"
    # named once: within a filter's function it would be computed for each line
    fetch = F.expr(f"element_at(transform(array(zip_with(m.lt, m.eq, (a, b) -> a | b)), t -> slice(array_sort({taken}), 1, {places})), 1)")
    own = index.where(~F.col("shared")).withColumn("m", F.expr(_descended(places)))
    own = own.select(*names, F.expr(_count("m.lt")).alias("before"), F.expr(_count("m.eq")).alias("ties"), fetch.alias("best"))
    same = " and ".join(f"y.c{i} = x.c{i}" for i in range(len(codes)))
    told = F.expr(f"transform(best, (x, i) -> named_struct('row', x.row, 'pos', i + 1L, 'tied', if(i < before, cast(size(filter(best, y -> {same})) as bigint), ties)))")
    out = own.select(*names, F.explode(told).alias("x")).select(*names, "x.*")
    if not crowds.isEmpty():
        cuts = _cut_offs(index.where("shared"), crowds, names, places, len(at))
        many = _joined(index.where("shared"), cuts, names).withColumn("m", F.expr(_followed()))
        many = many.select(*names, "ties", F.expr(_count("m.lt")).alias("before"), fetch.alias("best"))
        many = many.select(*names, "ties", "before", F.posexplode("best").alias("i", "x")).select(*names, "ties", (F.col("i") < F.col("before")).alias("early"), "x.*")
        fields = [c for c in many.columns if c not in (*names, "ties", "early")]
        ranked = many.withColumn("pos", F.row_number().over(Window.partitionBy(*names).orderBy(*fields)).cast("long")).where(F.col("pos") <= places)
        alike = F.count(F.lit(1)).over(Window.partitionBy(*names, *[f"c{i}" for i in range(len(codes))]))
        out = out.union(ranked.select(*names, "row", "pos", F.when(F.col("early"), alike).otherwise(F.col("ties")).cast("long").alias("tied")))
    return out.select(*[F.col(g).alias(c) for c, g in zip(groups, names, strict=True)], "pos", "tied", *[F.col(f"row.{name[c]}").alias(c) for c in kept if c not in groups])


def op13_bit_slices(spark, sf_dir: str) -> DataFrame:
    """The first two places of all sale lines by vendor, part and month; lines of a fifth of the sales form one group."""
    lines = spark.read.parquet(f"{sf_dir}/sale_lines.parquet")
    whole = lambda x: F.when(F.abs(x) < 9e18, F.floor(x + 0.5)).cast("long")  # noqa: E731  what no long holds is null
    one_group = F.coalesce(F.crc32(F.col("sale_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    in_group = lambda x: F.when(one_group, _long(-1)).otherwise(x.cast("long"))
    month = 100 * F.year("shipped_at") + F.month("shipped_at")
    rows = lines.select(
        in_group(F.col("vendor_id")).alias("vendor_id"), in_group(F.coalesce(F.col("item_id") % 5, F.lit(-1))).alias("part"), in_group(F.coalesce(month, F.lit(-1))).alias("month"),
        F.col("sale_id").cast("long").alias("sale_id"), F.col("line_no").cast("long").alias("line_no"), F.col("quantity").cast("long").alias("quantity"),
        whole(100 * F.col("discount")).alias("percent"), whole(100 * F.col("amount")).alias("amount_cents"), F.floor(F.col("quantity") / 10).cast("long").alias("tens"),
    )
    out = first_places(rows, ["vendor_id", "part", "month"], [("tens", True), ("percent", False)], ["sale_id", "line_no", "quantity", "amount_cents"])
    return out.select("vendor_id", "part", "month", "pos", F.col("pos").alias("place"), "sale_id", "line_no", "quantity", "percent", "amount_cents", "tied")
