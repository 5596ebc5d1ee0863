"""Document fingerprints by invertible Bloom lookup sketches, in DataFrame functions only.

A text is cut into paragraphs (at line ends, and at white space after . ! ? | ; :;
longer ones every PIECE_CHARS characters). Each becomes a 64-bit digest of its
hash and of the number of its repeat, so that a text is a set of digests. A sketch
deals them to cells, one in each of three sub-tables, and a cell keeps the count,
the xor of its digests and the xor of their check values. The difference of two
versions is the cell-wise difference of their sketches: what they share cancels,
and empty cells vanish. A cell with count 1 or -1 and a fitting check value is pure
and gives a differing digest; taking it out of its other cells makes more cells
pure, until all are empty.

The fingerprint is a sketch in hex: number of digests, places of a sub-table (a
power of two, at least twice the number of digests), a hash of the whole text, and the
cells that are not empty. It is doubled until it peels by itself, so that it can
be listed. As places are powers of two, a sketch can be folded to any smaller size.
Two fingerprints are compared at the larger size of both (the smaller is listed and
put in again; ``compare`` first tries them folded to the smaller size), and where
that does not peel, at twice the size, and so on. Likeness is the Jaccard
similarity of the sets of digests, (a + b - d) / (a + b + d) for sizes a and b and
d differing digests; two empty texts are alike.

Cells are rows: a sketch is an aggregate by (pair, cell), a round of peeling lets
the pure cells of one sub-table emit what they take out of the other two, and
aggregates again. All rounds run on one partitioning by document, so they shuffle
nothing, and no task holds more of a document at once than a row.

Null text counts as empty. Equal texts have equal fingerprints. Repeated rows are
documents of their own, next to each other in order; null ids come last. Rows of
one id that fill more than a range are dealt to several, in an order that also
depends on their place in the table. An empty table gives none. Other columns are
not read. The table is read several times and must not change meanwhile.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm.common import stored, text_or_empty

#: Where one paragraph ends and the next begins, and the characters after which a longer one is cut.
PARAGRAPH_END = r"(?<=[.!?|;:])\s+|\r?\n"
PIECE_CHARS = 256
#: Places of the smallest sub-table.
LEAST_PLACES = 8
#: Rounds of peeling in a try, and tries; a pair that fails all of them fails the job.
ROUNDS = 7
TRIES = 12
#: Digests of a task in peeling, on average.
TASK_DIGESTS = 300_000
#: Quantiles of doc_id that even out the ranges, rows of a range on average, and the most ranges (which then are larger).
QUANTILES = 256
RANGE_ROWS = 2000
MOST_RANGES = 50_000

_FOUND = -1  # the cell number of digests that were recovered
_SUB = 1 << 20  # numbers of a split range
_HEAD, _CELL = 8 + 2 + 16, 8 + 4 + 16 + 8  # hex digits of a fingerprint's head and of a cell


def paragraphs(text: Column) -> Column:
    """The hash of each paragraph that is not blank, repeats included."""
    parts = F.filter(F.transform(F.split(text, PARAGRAPH_END), lambda p: F.trim(p)), lambda p: p != F.lit(""))
    pieces = F.flatten(
        F.transform(
            parts,
            lambda p: F.when(F.length(p) <= PIECE_CHARS, F.array(p)).otherwise(F.regexp_extract_all(p, F.lit(f"(?s).{{1,{PIECE_CHARS}}}"), 0)),
        )
    )
    return F.transform(pieces, lambda p: F.xxhash64(p))


def places_for(n: Column) -> Column:
    """The power of two, LEAST_PLACES at least, that is not below 2 n: then few rounds peel it."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(n * F.lit(2), F.lit(LEAST_PLACES)).cast("double")))).cast("int")


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(-1)).bitwiseAND(F.lit(0xFFFFFFFF))


def _place(digest: Column, table: Column | int, places: Column) -> Column:
    """The cell of a digest in a sub-table of so many places."""
    table = F.lit(table) if isinstance(table, int) else table
    at = F.pmod(F.xxhash64(digest, table), places.cast("long"))
    return (table * places + at.cast("int")).cast("int")


def numbered(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, k): the digests of rows with a paragraph hash ``k`` each, its repeats numbered."""
    counted = rows.groupBy(*key, "k").agg(F.count(F.lit(1)).alias("c"))
    each = counted.select(*key, "k", F.explode(F.sequence(F.lit(1), F.col("c").cast("int"))).alias("nth"))
    return each.select(*key, F.xxhash64("k", "nth").alias("k"))


def sketched(items: DataFrame, key: list[str]) -> DataFrame:
    """(key, places, cell, n, k, h): the non-empty cells of sketches of ``items`` (key, places, n, k).

    n is 1, or -1 for digests that are subtracted.
    """
    each = items.select("*", F.explode(F.array(*[F.lit(j) for j in range(3)])).alias("table"))
    cell = _place(F.col("k"), F.col("table"), F.col("places"))
    cells = each.select(*key, "places", cell.alias("cell"), "n", "k", _check(F.col("k")).alias("h"))
    return _summed(cells, key)


def _summed(cells: DataFrame, key: list[str]) -> DataFrame:
    """Cells with equal numbers (and marks, if they have such) added; empty ones vanish."""
    mark = [c for c in cells.columns if c == "mark"]
    out = cells.groupBy(*key, "places", "cell", *mark).agg(F.sum("n").cast("int").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("h").alias("h"))
    return out.where((F.col("cell") == F.lit(_FOUND)) | (F.col("n") != 0) | (F.col("k") != 0) | (F.col("h") != 0))


def peel_round(cells: DataFrame, table: int, keep: bool) -> DataFrame:
    """Take out what the pure cells of one sub-table hold; a digest lies in one cell of it.

    A recovered digest becomes a row of its own if ``keep``, told apart by its mark,
    else only its count; then cells have no marks.
    """
    n, k, h, places = (F.col(c) for c in ("n", "k", "h", "places"))
    first = places * F.lit(table)
    here = (F.col("cell") >= first) & (F.col("cell") < first + places)
    pure = here & (F.abs(n) == 1) & (h == _check(k)) & (F.col("cell") == _place(k, table, places))
    zero = F.lit(0).cast("long")
    row = lambda cell, mark, n, k, h: F.struct(cell.alias("cell"), *([mark.alias("mark")] if keep else []), n.alias("n"), k.alias("k"), h.alias("h"))
    found = row(F.lit(_FOUND), k, n, k, h) if keep else row(F.lit(_FOUND), zero, F.lit(1), zero, zero)
    others = [row(_place(k, j, places), zero, -n, k, h) for j in range(3) if j != table]
    stays = row(F.col("cell"), F.col("mark") if keep else zero, n, k, h)
    moved = cells.select("rid", "pair", "places", F.explode(F.when(pure, F.array(found, *others)).otherwise(F.array(stays))).alias("c"))
    return _summed(moved.select("rid", "pair", "places", "c.*"), ["rid", "pair"])


def peeled(cells: DataFrame, keep: bool, rounds: int = ROUNDS) -> DataFrame:
    """(rid, pair, places, bad, d) or with ``keep`` (rid, pair, k, n, bad), stored; bad is 1 if cells are left."""
    cells = cells.withColumn("mark", F.lit(0).cast("long")) if keep else cells
    for i in range(rounds):
        cells = peel_round(cells, i % 3, keep)
    left = F.max((F.col("cell") != F.lit(_FOUND)).cast("int"))
    if keep:
        cells = cells.withColumn("bad", left.over(Window.partitionBy("rid", "pair")))
        return stored(cells.select("rid", "pair", "k", "n", "bad"), "peeled")
    found = F.sum(F.when(F.col("cell") == F.lit(_FOUND), F.col("n")).otherwise(F.lit(0))).alias("d")
    return stored(cells.groupBy("rid", "pair").agg(F.max("places").alias("places"), found, left.alias("bad")), "peeled")


def differences(items_of: Callable[[DataFrame | None], DataFrame], keep: bool = False) -> DataFrame:
    """(rid, pair, places, d) of all pairs that differ; with ``keep`` (rid, pair, k, n) of each differing digest.

    ``items_of`` gives items (rid, pair, places, n, k), partitioned by rid: all, or
    those of the pairs (rid, pair) that it is asked for. Pairs that do not peel are
    tried again with twice the places. With ``keep``, n is 1 for digests of the first
    side and -1 for those of the other.
    """
    done, waiting = None, None
    for attempt in range(TRIES):
        items = items_of(waiting).withColumn("places", F.col("places") * F.lit(1 << attempt))
        result = peeled(sketched(items, ["rid", "pair"]), keep, ROUNDS + 2 * attempt)
        good = result.where("bad = 0").drop("bad")
        done = good if done is None else done.unionByName(good)
        waiting = result.where("bad = 1").select("rid", "pair").distinct()
        if waiting.isEmpty():
            return done
    raise RuntimeError(f"some pairs did not peel in {TRIES} tries")


def likeness(a: Column, b: Column, d: Column) -> Column:
    """Jaccard similarity of sets of a and b digests of which d differ."""
    return F.when(a + b == 0, F.lit(1.0)).otherwise((a + b - d) / (a + b + d)).cast("double")


def _digits(x: Column, n: int) -> Column:
    return F.lpad(F.hex(x.cast("long")), n, "0")


def written(cells: DataFrame, key: list[str]) -> DataFrame:
    """(key, body): the cells of each sketch in hex, in order."""
    text = F.concat(_digits(F.col("cell"), 8), _digits(F.col("n"), 4), _digits(F.col("k"), 16), _digits(F.col("h"), 8))
    return cells.select(*key, text.alias("t")).groupBy(*key).agg(F.lower(F.array_join(F.array_sort(F.collect_list("t")), "")).alias("body"))


def head(n: Column, places: Column, text_hash: Column) -> Column:
    return F.lower(F.concat(_digits(n, 8), _digits(F.log2(places.cast("double")).cast("int"), 2), _digits(text_hash, 16)))


def _number(text: Column, at: Column | int, n: int) -> Column:
    """The whole number in up to 8 hex digits from position ``at``."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.substring(text, at, F.lit(n)), 16, 10).cast("long")


def read_head(fingerprint: Column) -> tuple[Column, Column]:
    """Number of digests and places of a fingerprint."""
    return _number(fingerprint, 1, 8).cast("int"), F.pow(F.lit(2.0), _number(fingerprint, 9, 2)).cast("int")


def _read_cells(fingerprint: Column) -> Column:
    def cell(i: Column) -> Column:
        at = i * F.lit(_CELL) + F.lit(_HEAD + 1)
        long = F.shiftleft(_number(fingerprint, at + F.lit(12), 8), 32).bitwiseOR(_number(fingerprint, at + F.lit(20), 8))
        return F.struct(
            _number(fingerprint, at, 8).cast("int").alias("cell"), _number(fingerprint, at + F.lit(8), 4).cast("int").alias("n"), long.alias("k"), _number(fingerprint, at + F.lit(28), 8).alias("h")
        )

    n = F.floor((F.length(fingerprint) - F.lit(_HEAD)) / F.lit(_CELL)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - F.lit(1)), cell)).otherwise(F.array().cast("array<struct<cell:int,n:int,k:bigint,h:bigint>>"))


def _side_cells(pairs: DataFrame, name: str, sign: int, pair: int, places: Column) -> DataFrame:
    """The cells of one fingerprint of each pair, folded to so many places."""
    own = read_head(F.col(name))[1]
    cells = pairs.select("rid", F.lit(pair).alias("pair"), places.alias("places"), own.alias("own"), F.explode(_read_cells(F.col(name))).alias("c"))
    table = F.floor(F.col("c.cell") / F.col("own")).cast("int")
    folded = table * F.col("places") + F.pmod(F.col("c.cell") % F.col("own"), F.col("places"))
    return cells.select("rid", "pair", "places", folded.cast("int").alias("cell"), (F.col("c.n") * F.lit(sign)).alias("n"), "c.k", "c.h")


def compare(pairs: DataFrame, keep: bool = False) -> DataFrame:
    """rid and d, the number of differing digests, of pairs of fingerprints (rid, a, b); pairs without a difference are left out.

    The sketches are folded to the smaller size, subtracted and peeled. Pairs that
    do not peel are listed one by one and put in again at larger sizes. With
    ``keep`` the rows are the differing digests k themselves, with n.
    """
    pairs = stored(pairs.select("rid", "a", "b"), "fingerprint-pairs")
    both = F.least(read_head(F.col("a"))[1], read_head(F.col("b"))[1])
    cells = _side_cells(pairs, "a", 1, 0, both).unionByName(_side_cells(pairs, "b", -1, 0, both))
    first = peeled(_summed(cells, ["rid", "pair"]), keep)
    done = first.where("bad = 0").select("rid", *(("k", "n") if keep else ("d",)))
    waiting = first.where("bad = 1").select("rid").distinct()
    if waiting.isEmpty():
        return done
    left = stored(pairs.join(waiting, "rid", "left_semi"), "fingerprint-pairs")
    listed = stored(
        peeled(_summed(_side_cells(left, "a", 1, 0, read_head(F.col("a"))[1]).unionByName(_side_cells(left, "b", 1, 1, read_head(F.col("b"))[1])), ["rid", "pair"]), True, 3 * ROUNDS)
        .groupBy("rid")
        .agg(F.collect_list(F.when(F.col("pair") == 0, F.col("k"))).alias("a"), F.collect_list(F.when(F.col("pair") == 1, F.col("k"))).alias("b")),
        "fingerprint-digests",
    )

    def items(open_: DataFrame | None) -> DataFrame:
        asked = listed if open_ is None else listed.join(open_.select("rid"), "rid", "left_semi")
        sides = F.array(F.struct(F.lit(1).alias("n"), F.col("a").alias("ks")), F.struct(F.lit(-1).alias("n"), F.col("b").alias("ks")))
        each = asked.select("rid", places_for(F.greatest(F.size("a"), F.size("b"))).alias("places"), F.explode(sides).alias("s"))
        return each.select("rid", F.lit(0).alias("pair"), "places", "s.n", F.explode("s.ks").alias("k")).repartition("rid")

    return done.unionByName(differences(items, keep).select(*done.columns))


def _numbers(docs: DataFrame) -> DataFrame:
    """doc_id, text, range and mix: ranges rise with doc_id, null last, of about RANGE_ROWS rows each.

    Quantiles of the ids bound QUANTILES ranges, each cut evenly by value. An id
    that is two quantiles has a range of its own; where such a range has too many
    rows, as may that of null ids, it is cut by ``mix``, a hash of text and place.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    known = ids.where("doc_id IS NOT NULL")
    n, low, high = known.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
    total = max(RANGE_ROWS, -(-docs.count() // MOST_RANGES))
    doc_id = F.col("doc_id").cast("long")
    if n:
        inner = [int(x) for x in known.approxQuantile("doc_id", [i / QUANTILES for i in range(1, QUANTILES)], 1 / (4 * QUANTILES))]
        repeated = {a for a, b in zip(inner, inner[1:]) if a == b}
        bounds = sorted({low, *inner})
        if n <= total * len(bounds):
            bounds = bounds[:: max(1, total * len(bounds) // n)]
        bounds = sorted({*bounds, *repeated, *(x + 1 for x in repeated if x < high)})
        parts = max(1, -(-n // (total * len(bounds))))
        starts = F.array(*[F.lit(x).cast("long") for x in bounds])
        ends = F.array(*[F.lit(x).cast("long") for x in [*bounds[1:], high]])
        nth = F.size(F.filter(starts, lambda x: x <= doc_id))
        start, end = F.element_at(starts, nth), F.element_at(ends, nth)
        part = F.floor((doc_id - start).cast("double") / F.greatest(end - start, F.lit(1)).cast("double") * F.lit(parts))
        number = nth.cast("long") * F.lit(parts) + F.least(part, F.lit(parts - 1))
        number = F.when(doc_id.isNull(), F.lit((len(bounds) + 2) * parts)).otherwise(number).cast("long")
    else:
        number = F.lit(0).cast("long")
    sizes = ids.select("doc_id", number.alias("base")).groupBy("base").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    hot = sizes.where(F.col("low").eqNullSafe(F.col("high")) & (F.col("n") > 2 * total))
    # at most one for each quantile, and one for null
    split = F.broadcast(hot.select(F.col("base").alias("hot"), F.least(F.ceil(F.col("n") / F.lit(total)), F.lit(_SUB)).alias("splits")))
    rows = docs.select(doc_id.alias("doc_id"), text_or_empty().alias("text"), number.alias("base"), F.monotonically_increasing_id().alias("loc"))
    rows = rows.join(split, F.col("base") == F.col("hot"), "left")
    hash_ = F.xxhash64("text")
    mix = F.when(F.col("splits").isNull(), hash_).otherwise(F.xxhash64(hash_, "loc")).bitwiseAND(F.lit((1 << 63) - 1))
    sub = F.least(F.floor(F.col("mix") / F.lit(float(1 << 63)) * F.coalesce("splits", F.lit(1))), F.coalesce("splits", F.lit(1)) - F.lit(1))
    return rows.withColumn("mix", mix).select("doc_id", "text", "mix", (F.col("base") * F.lit(_SUB) + sub).cast("long").alias("range"))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and next_text: the text of the next row by doc_id, after the last the first.

    Rows are dealt to ranges of doc_id; the first row of each range also goes to
    the range before, as a guest at its end. Texts move once.
    """
    rows = _numbers(docs)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("mix"))
    firsts = rows.groupBy("range").agg(F.min(order).alias("first"))
    # one row for each range, of which there is a bounded number; the range before the first is the last
    by_range = Window.orderBy("range")
    host = F.coalesce(F.lag("range").over(by_range), F.max("range").over(Window.partitionBy()))
    hosts = F.broadcast(firsts.select(F.col("first.doc_id").alias("guest_id"), F.col("first.mix").alias("guest_mix"), F.col("range").alias("from_range"), host.alias("host")))
    met = (rows["range"] == hosts["from_range"]) & (rows["mix"] == hosts["guest_mix"]) & rows["doc_id"].eqNullSafe(hosts["guest_id"])
    guests = rows.join(hosts, met).select("doc_id", "text", "mix", F.col("host").alias("range"), F.lit(True).alias("guest"))
    both = rows.withColumn("guest", F.lit(False)).unionByName(guests)
    line = Window.partitionBy("range").orderBy("guest", F.col("doc_id").asc_nulls_last(), "mix")
    return both.withColumn("next_text", F.lead("text").over(line)).where(~F.col("guest")).select("doc_id", "text", "next_text")


#: Pairs of sides (own, edited, next; or nothing) whose differences ``compare_edits`` needs: likenesses, and the lists of the two fingerprints.
_PAIRS = ((0, 1), (0, 2), (0, None), (1, None))


def _items(table: DataFrame, width: int, asked: DataFrame | None) -> DataFrame:
    """Items of the pairs _PAIRS of each row of ``table`` (rid, hashes of three sides), or of those asked for."""
    every = (1 << len(_PAIRS)) - 1
    if asked is None:
        table = table.withColumn("open", F.lit(every))
    else:  # a bit for each pair
        table = table.join(asked.groupBy("rid").agg(F.sum(F.pow(F.lit(2.0), "pair")).cast("int").alias("open")), "rid")
    sizes = [F.size(F.element_at("sides", i + 1)).alias(f"n{i}") for i in range(3)]
    spread = table.repartition(width, "rid").select("rid", "open", *sizes, F.posexplode("sides").alias("side", "ks"))
    key = ["rid", "open", "n0", "n1", "n2", "side"]
    each = numbered(spread.select(*key, F.explode("ks").alias("k")), key)

    def role(i: int) -> Column:
        a, b = _PAIRS[i]
        most = F.col(f"n{a}") if b is None else F.greatest(f"n{a}", f"n{b}")
        mine = (F.col("side") == a) if b is None else F.col("side").isin(a, b)
        is_open = F.col("open").bitwiseAND(F.lit(1 << i)) != 0
        return F.when(mine & is_open, F.struct(F.lit(i).alias("pair"), F.when(F.col("side") == a, 1).otherwise(-1).alias("n"), places_for(most).alias("places")))

    roles = F.array_compact(F.array(*[role(i) for i in range(len(_PAIRS))]))
    return each.select("rid", "k", F.explode(roles).alias("r")).select("rid", "r.pair", "r.places", "r.n", "k")


def fingerprints(table: DataFrame, places: list[str], sides: list[int], width: int) -> DataFrame:
    """rid, side and body of the sketches of some sides, whose places are columns of ``table``."""
    one = [F.struct(F.lit(s).alias("side"), F.col(p).alias("places"), F.element_at("sides", s + 1).alias("ks")) for s, p in zip(sides, places)]
    each = table.repartition(width, "rid").select("rid", F.explode(F.array(*one)).alias("s"))
    digests = numbered(each.select("rid", "s.side", "s.places", F.explode("s.ks").alias("k")), ["rid", "side", "places"])
    return written(sketched(digests.withColumn("n", F.lit(1)), ["rid", "side"]), ["rid", "side"])


def compare_edits(docs: DataFrame) -> DataFrame:
    """Each document against its edited text and the next document.

    The edit replaces the last quarter of the code points (rounded down) by the
    first as many of the next document, or all it has. Likenesses are those of the
    fingerprints returned (``compare`` gives the same from their strings).
    """
    n = F.length("text")
    k = F.floor(n / F.lit(4)).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - k), F.substring("next_text", F.lit(1), k))
    rows = with_next(docs).withColumn("edited", edited)
    table = stored(
        rows.select(
            F.monotonically_increasing_id().alias("rid"),
            "doc_id",
            n.cast("long").alias("n_chars"),
            F.sha2("edited", 256).alias("edited_sha256"),
            F.array(F.xxhash64("text"), F.xxhash64("edited")).alias("hashes"),
            F.array(*[paragraphs(F.col(c)) for c in ("text", "edited", "next_text")]).alias("sides"),
        ),
        "fingerprint-sides",
    )
    size = lambda i: F.size(F.element_at("sides", i + 1))
    total = table.agg(F.coalesce(F.sum(size(0) + size(1) + size(2)), F.lit(0))).first()[0]
    width = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_DIGESTS))
    found = differences(lambda asked: _items(table.select("rid", "sides"), width, asked))
    of = lambda i, x: F.max(F.when(F.col("pair") == i, F.col(x))).alias(f"{x}{i}")
    found = found.groupBy("rid").agg(of(0, "d"), of(1, "d"), of(2, "places"), of(3, "places"))
    held = table.join(found, "rid", "left")
    for side, pair in ((0, 2), (1, 3)):  # a text without paragraphs has no pair
        held = held.withColumn(f"places{pair}", F.coalesce(f"places{pair}", F.lit(LEAST_PLACES)))
    near = lambda i: likeness(size(_PAIRS[i][0]), size(_PAIRS[i][1]), F.coalesce(f"d{i}", F.lit(0)))
    facts = held.select(
        "rid",
        "doc_id",
        "n_chars",
        "edited_sha256",
        head(size(0), F.col("places2"), F.element_at("hashes", 1)).alias("own_head"),
        head(size(1), F.col("places3"), F.element_at("hashes", 2)).alias("edited_head"),
        near(0).alias("near_edited"),
        near(1).alias("near_next"),
    )
    facts = stored(facts, "fingerprint-facts")
    bodies = fingerprints(held.select("rid", "sides", "places2", "places3"), ["places2", "places3"], [0, 1], width)
    bodies = bodies.groupBy("rid").agg(F.max(F.when(F.col("side") == 0, F.col("body"))).alias("own"), F.max(F.when(F.col("side") == 1, F.col("body"))).alias("edited"))
    whole = lambda h, body: F.concat(h, F.coalesce(body, F.lit("")))
    return facts.join(bodies, "rid", "left").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        whole("own_head", "own").alias("fingerprint"),
        whole("edited_head", "edited").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )
