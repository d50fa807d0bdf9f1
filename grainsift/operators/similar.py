"""Near-duplicate rows, and bad values snapped to the nearest allowed one, by edit distance.

No row meets every other. Texts are cut into one segment more than edits are allowed, so two
texts within the distance share a segment; segments are equi-join keys, and what they bring
together is measured by ``levenshtein`` with a threshold inside the join. Equal texts are one
node with a count before anything is compared, and copies are never expanded into pairs.

A segment that many texts share (a common prefix) would bring all of them together. Texts of
one length and at most ``WORD_CHARS`` characters that hold such a segment are therefore met by
what is left of them without the one or two places of an edit (distance 1 or 2): whatever
meets so is within the distance, and texts in which one or two characters differ are counted
per group without a pair being made. Only places in which texts of that length differ at all
are taken out. Texts of different lengths that share such a segment, the shorter one with at
most ``WORD_CHARS`` characters, meet by what is left of the longer without one (two) characters:
at distance 1 that is the shorter text itself, at distance 2 also that without a character.

For longer texts and larger distances, such a segment is dealt into blocks on both sides, so
one task compares at most ``BLOCK_ROWS`` with ``BLOCK_ROWS`` texts whatever the frequency. The
number of comparisons under it still grows with its square: name columns that must agree
(``within``) where there are any.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.edits import deletion_keys, segment_keys, substring_keys, whole_deletion_keys, within_distance
from ..functions.frames import literal_rows
from ..functions.schema import col, groupable, is_text, require, type_of
from ..session import materialized
from .skew import join_unique, key_hash

BLOCK_ROWS = 2_000
DENSE_TEXTS = 200  # a segment in more texts than this is shared by many
WORD_CHARS = 32  # texts up to this length are found by deletions (dictionaries, shared segments), longer ones by segments


def _text(df: DataFrame, column: str, fold: bool) -> Column:
    if not is_text(type_of(df, column)):
        raise ValueError(f"column {column!r} is no text")
    return _folded(col(column)) if fold else col(column)


def _folded(c: Column) -> Column:
    """Lower case, without white space at the ends and with single blanks inside."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")


def _nodes(df: DataFrame, column: str, key: str, within: Sequence[str], fold: bool) -> DataFrame:
    """One row per distinct text (and cells of ``within``): __t, __w0 ..., least key, number of rows, __id.

    The numbers in __id hold once the table is stored.
    """
    cells = [col(c).alias(f"__w{i}") for i, c in enumerate(within)]
    rows = df.select(col(key).alias("__key"), _text(df, column, fold).alias("__t"), *cells)
    rows = rows.filter("__key is not null and __t is not null")
    group = ["__t", *[f"__w{i}" for i in range(len(within))]]
    nodes = rows.groupBy(*group).agg(F.min("__key").alias("__low"), F.count(F.lit(1)).alias("__n"))
    return nodes.withColumn("__id", F.monotonically_increasing_id())


def _shared(index: DataFrame, probe: DataFrame, rows: int) -> DataFrame:
    """Keys that more than ``rows`` rows of a side hold: __hot, the counts __i and __j, and __most.

    ``__most`` is the length of the longest text of the index with that key. Counted in one
    aggregate over both sides: a join of the counts would move every key.
    """
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    both = index.select("__k", one.alias("__i"), none.alias("__j"), F.char_length("__t").alias("__most")).unionAll(
        probe.select("__k", none.alias("__i"), one.alias("__j"), F.lit(0).alias("__most")))
    counts = both.groupBy(F.col("__k").alias("__hot")).agg(
        F.sum("__i").alias("__i"), F.sum("__j").alias("__j"), F.max("__most").alias("__most"))
    return counts.filter((F.greatest("__i", "__j") > rows) & (F.least("__i", "__j") > 0))


def _dealt(index: DataFrame, probe: DataFrame, shared: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with a block (__p, __q): each pair of rows with equal __k meets in one block."""
    blocks = lambda n: F.ceil(F.col(n) / block_rows).cast("int")
    hot = shared.filter(F.greatest("__i", "__j") > block_rows).select("__hot", blocks("__i").alias("__ps"), blocks("__j").alias("__qs"))
    own = lambda parts: F.pmod(F.xxhash64("__t", "__low"), F.coalesce(parts, F.lit(1)))
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(parts), F.lit(1)) - 1))

    def deal(df: DataFrame, mine: str, mine_in: str, theirs: str, theirs_in: str) -> DataFrame:
        met = df.join(hot, df["__k"] == F.col("__hot"), "left")
        met = met.withColumn(mine, own(F.col(mine_in)).cast("int")).withColumn(theirs, every(theirs_in))
        return met.drop("__hot", "__ps", "__qs")

    return deal(index, "__p", "__ps", "__q", "__qs"), deal(probe, "__q", "__qs", "__p", "__ps")


def _second(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: f"{c}2" for c in df.columns})


def _met(index: DataFrame, probe: DataFrame, same: Column, distance: int, block_rows: int,
         shared: DataFrame | None = None) -> DataFrame:
    """Rows of both sides (probe columns end in 2) that share a key and lie within the distance."""
    shared = materialized(_shared(index, probe, block_rows), "shared") if shared is None else shared
    return _joined(*_dealt(index, probe, shared, block_rows), same, distance, ["__p", "__q"])


def _joined(index: DataFrame, probe: DataFrame, same: Column, distance: int, blocks: Sequence[str] = ()) -> DataFrame:
    probe, keys = _second(probe), F.col("__k") == F.col("__k2")
    for c in blocks:
        keys = keys & (F.col(c) == F.col(f"{c}2"))
    d = within_distance(F.col("__t"), F.col("__t2"), distance)
    # never a broadcast: Spark guesses a size from before the keys and blocks were made
    return index.hint("merge").join(probe, keys & same & d.isNotNull()).withColumn("__d", d)


def _keyed(nodes: DataFrame, keys: Column, within: int) -> DataFrame:
    """A row per key; cells that must agree are part of it."""
    rows = nodes.withColumn("__k", F.explode(keys))
    if within:
        rows = rows.withColumn("__k", F.xxhash64("__k", key_hash([f"__w{i}" for i in range(within)])))
    return rows


def _checked(distance: int) -> None:
    if distance < 0:
        raise ValueError("distance is negative")


def near_pairs(
    df: DataFrame, column: str, key: str, distance: int = 2, within: Sequence[str] = (), *,
    fold: bool = False, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Pairs of different texts within the edit distance: key_a, text_a, rows_a, key_b, ..., distance.

    The cells of ``within``, which are equal in both, follow as columns __w0, __w1, ...

    A text stands for all rows that hold it, and its key is their smallest one; ``rows_a`` says
    how many there are. The first text of a pair is the shorter one, or the smaller of two
    equal length. ``within`` names columns whose cells must be equal (NULL equals NULL). With
    ``fold`` texts are compared in lower case and with white space normalised. Rows without a
    key or a text are in no pair.
    """
    require(df, column, key)
    groupable(df, [key, *within])
    _checked(distance)
    nodes = materialized(_nodes(df, column, key, within, fold), "texts")
    met, dense = _compared(nodes, distance, len(within), block_rows)
    pairs = met.select(*PAIR, "__t", "__t2", "__d", *_cells(within))
    if dense is not None:
        pairs = pairs.unionAll(_changed_pairs(dense, distance, _cells(within)).select(*pairs.columns))
        if distance == 2:
            pairs = pairs.unionAll(_moved_pairs(dense, _cells(within)).select(*pairs.columns))
    # of two texts of one length the smaller comes first, else the shorter
    return pairs.select(
        F.col("__low").alias("key_a"), F.col("__t").alias("text_a"), F.col("__n").alias("rows_a"),
        F.col("__low2").alias("key_b"), F.col("__t2").alias("text_b"), F.col("__n2").alias("rows_b"),
        F.col("__d").alias("distance"), *_cells(within))


PAIR = ["__id", "__low", "__n", "__id2", "__low2", "__n2"]


def _cells(within: Sequence[str]) -> list[str]:
    return [f"__w{i}" for i in range(len(within))]


def _agree(names: Sequence[str]) -> Column:
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"{n}2"))
    return same


def _compared(nodes: DataFrame, distance: int, within: int, block_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Pairs of nodes within the distance, and the nodes whose pairs of one length are not among them.

    These hold a segment that many texts share (or there are none). Every pair comes once.
    """
    names, length, other = _cells(range(within)), F.char_length("__t"), F.char_length("__t2")
    if not distance:  # different texts are never at distance 0
        return nodes.crossJoin(_second(nodes)).filter(F.lit(False)).withColumn("__d", F.lit(0)), None
    short = F.when(length <= distance, deletion_keys(F.col("__t"), distance))
    near_short = F.coalesce(F.when(length <= 2 * distance, deletion_keys(F.col("__t"), distance)), F.array().cast("array<bigint>"))
    cut = F.coalesce(short, segment_keys(F.col("__t"), distance))
    found = lambda least, most: F.array_distinct(F.concat(substring_keys(F.col("__t"), distance, least, most), near_short))

    # texts of different lengths: only lengths that have a neighbour take part
    lengths = nodes.select(length.alias("__len")).distinct()
    steps = lambda sign: F.explode(F.sequence(F.col("__len") + sign, F.col("__len") + sign * distance))
    near = lambda sign: nodes.join(
        lengths.select(steps(sign).alias("__len")).distinct(), length == F.col("__len"), "left_semi")
    limit = min(block_rows, DENSE_TEXTS) if distance <= 2 else block_rows
    index, probe = _keyed(near(-1), cut, within), _keyed(near(1), found(1, distance), within)
    shared, below = materialized(_shared(index, probe, limit), "shared"), (length < other) & _agree(names)
    many = shared.filter(F.col("__most") <= WORD_CHARS)
    found_apart = None
    if distance <= 2 and not many.isEmpty():
        found_apart = _shortened_pairs(_holding(nodes, index, many), _holding(nodes, probe, many), below, distance, within, block_rows)
        index, probe = _keyed_apart(index, many), _keyed_apart(probe, many)
    met = _met(index, probe, below, distance, block_rows, shared)

    # texts of one length
    index, probe = _keyed(nodes, cut, within), _keyed(nodes, found(0, 0), within)
    shared = materialized(_shared(index, probe, limit), "shared")
    dense, same = None, (length == other) & (F.col("__t") < F.col("__t2")) & _agree(names)
    if distance <= 2 and not shared.isEmpty():
        holds = lambda df: df.filter(length <= WORD_CHARS).join(
            shared, df["__k"] == F.col("__hot"), "left_semi").select("__id")
        held = holds(index).unionAll(holds(probe)).distinct().select("__id", F.lit(True).alias("__v"))
        nodes = materialized(nodes.join(held.hint("merge"), "__id", "left"), "texts")
        dense = nodes.filter("__v").drop("__v")
        free = lambda df: df.join(shared, (df["__k"] == F.col("__hot")) & (length <= WORD_CHARS), "left_anti")
        index, probe = free(_keyed(nodes, cut, within)), free(_keyed(nodes, found(0, 0), within))
        same = same & (F.col("__v").isNull() | F.col("__v2").isNull())
    level = _met(index, probe, same, distance, block_rows, shared)
    columns = [*PAIR, "__t", "__t2", "__d", *names]
    pairs = met.select(*columns).unionAll(level.select(*columns))
    if found_apart is not None:
        pairs = pairs.unionAll(found_apart.select(*columns))
    return pairs.dropDuplicates(["__id", "__id2"]), dense  # a pair that shares several segments was found several times


def _holding(nodes: DataFrame, keyed: DataFrame, shared: DataFrame) -> DataFrame:
    """The nodes that hold one of the shared keys."""
    held = keyed.join(shared, keyed["__k"] == F.col("__hot"), "left_semi").select("__id").distinct()
    return nodes.join(held.hint("merge"), "__id", "left_semi")


def _keyed_apart(keyed: DataFrame, shared: DataFrame) -> DataFrame:
    """The rows without one of the shared keys."""
    return keyed.join(shared, keyed["__k"] == F.col("__hot"), "left_anti")


def _shortened_pairs(shorter: DataFrame, longer: DataFrame, same: Column, distance: int, within: int, block_rows: int) -> DataFrame:
    """Pairs of a shorter and a longer text within distance 1 or 2, by what is left of them without characters."""
    index = _keyed(shorter, deletion_keys(F.col("__t"), distance - 1), within)
    probe = _keyed(longer, whole_deletion_keys(F.col("__t"), distance), within)
    if distance == 1:  # one text at most is what is left of the others, so no key needs blocks
        return _joined(index, probe, same, distance)
    return _met(index, probe, same, distance, block_rows)


def _with_places(dense: DataFrame) -> DataFrame:
    """The nodes with __at: the places (from 0) in which texts of that length differ."""
    length = F.char_length("__t")
    chars = dense.filter(length > 0).select(
        length.alias("__len"), F.posexplode(F.transform(F.sequence(F.lit(1), length), lambda i: F.substr("__t", i, F.lit(1)))))
    differ = chars.groupBy("__len", "pos").agg(F.min("col").alias("low"), F.max("col").alias("high")).filter("low <> high")
    places = differ.groupBy("__len").agg(F.sort_array(F.collect_list("pos")).alias("__at"))  # at most WORD_CHARS rows
    return dense.join(F.broadcast(places), length == F.col("__len")).drop("__len")


def _without(t: str, p: str) -> Column:
    return F.expr(f"concat(left({t}, {p}), substr({t}, {p} + 2))")


def _masked(dense: DataFrame, distance: int) -> DataFrame:
    """A row per node and one (__p = __q) or two places, with the rest of the text in __rest."""
    rows = _with_places(dense).withColumn("__p", F.explode("__at"))
    rows = rows.withColumn("__q", F.expr("explode(filter(__at, q -> q >= __p))") if distance == 2 else F.col("__p"))
    two = F.expr("concat(left(__t, __p), substr(__t, __p + 2, __q - __p - 1), substr(__t, __q + 2))")
    return rows.withColumn("__rest", F.when(F.col("__p") == F.col("__q"), _without("__t", "__p")).otherwise(two))


def _differ(place: str) -> Column:
    return F.expr(f"substr(__t, {place} + 1, 1) <> substr(__t2, {place} + 1, 1)")


def _changed_pairs(dense: DataFrame, distance: int, names: Sequence[str]) -> DataFrame:
    """Pairs of texts of one length in which one or two characters differ."""
    rows = _masked(dense, distance).drop("__at")
    keys = (F.col("__p") == F.col("__p2")) & (F.col("__q") == F.col("__q2")) & (F.col("__rest") == F.col("__rest2")) & _agree(names)
    met = rows.hint("merge").join(_second(rows), keys & (F.col("__t") < F.col("__t2")) & _differ("__p") & _differ("__q"))
    return met.withColumn("__d", F.when(F.col("__p") == F.col("__q"), 1).otherwise(2))


def _moved_pairs(dense: DataFrame, names: Sequence[str]) -> DataFrame:
    """Pairs of texts of one length that are equal without a character each, but differ in more than two.

    The texts agree before the first and behind the last of the places without which they are
    equal. A pair that is equal in both directions (0101 and 1010) is taken in one.
    """
    rows = _with_places(dense).withColumn("__p", F.explode("__at")).drop("__at").withColumn("__rest", _without("__t", "__p"))
    first, last = "least(__p, __p2)", "greatest(__p, __p2)"
    between = F.expr(f"substr(__t, {first} + 2, {last} - {first} - 1) <> substr(__t2, {first} + 2, {last} - {first} - 1)")
    once = (F.col("__p") < F.col("__p2")) | (_without("__t", "__p2") != _without("__t2", "__p"))
    same = (F.col("__rest") == F.col("__rest2")) & _agree(names) & (F.col("__t") < F.col("__t2")) & (F.col("__p") != F.col("__p2"))
    met = rows.hint("merge").join(_second(rows), same & _differ(first) & _differ(last) & between & once)
    return met.withColumn("__d", F.lit(2))


def _changed_links(dense: DataFrame, distance: int, names: Sequence[str]) -> DataFrame:
    """__id, __links and __first from the texts of one length in which one or two characters differ.

    No pair is made. A group without one place holds texts in which nothing or that place
    differs, one without two places also those in which only one of them does; with n places
    each of the latter is in n - 1 groups of two and counts once.
    """
    group = Window.partitionBy("__p", "__q", "__rest", *names)
    met = _masked(dense, distance).select(
        "__id", (F.sum("__n").over(group) - F.col("__n")).alias("__others"), F.min("__low").over(group).alias("__first"),
        (F.lit(2) - F.size("__at") if distance == 2 else F.lit(1)).alias("__times"), (F.col("__p") == F.col("__q")).alias("__one"))
    weight = F.when(F.col("__one"), F.col("__times")).otherwise(1)
    return met.groupBy("__id").agg(F.sum(F.col("__others") * weight).alias("__links"), F.min("__first").alias("__first"))


def _pair_links(pairs: DataFrame) -> DataFrame:
    ends = F.array(F.struct(F.col("__id"), F.col("__n2").alias("__links"), F.col("__low2").alias("__first")),
                   F.struct(F.col("__id2").alias("__id"), F.col("__n").alias("__links"), F.col("__low").alias("__first")))
    rows = pairs.select(F.explode(ends).alias("e")).select("e.*")
    return rows.groupBy("__id").agg(F.sum("__links").alias("__links"), F.min("__first").alias("__first"))


def near_duplicates(
    df: DataFrame, column: str, key: str, distance: int = 2, within: Sequence[str] = (), *,
    fold: bool = False, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The rows with n_links and first_key.

    ``n_links`` is the number of other rows within the edit distance (copies included) and
    ``first_key`` the smallest key among these and the row's own. Rows without a key or a text
    have no links. The pairs are not expanded: links are counted per distinct text.
    """
    require(df, column, key)
    groupable(df, [key, *within])
    _checked(distance)
    for name in ("n_links", "first_key"):
        if name in df.columns:
            raise ValueError(f"there is a column {name!r} already")
    names = _cells(within)
    nodes = materialized(_nodes(df, column, key, within, fold), "texts")
    met, dense = _compared(nodes, distance, len(within), block_rows)
    links = _pair_links(met)
    if dense is not None:
        links = links.unionAll(_changed_links(dense, distance, names))
        if distance == 2:
            links = links.unionAll(_pair_links(_moved_pairs(dense, names)))
    links = links.groupBy("__id").agg(F.sum("__links").alias("__links"), F.min("__first").alias("__first"))
    per_text = nodes.join(links.hint("merge"), "__id", "left").select(
        "__t", *names, (F.coalesce("__links", F.lit(0)) + F.col("__n") - 1).alias("__links"),
        F.least("__low", "__first").alias("__first"))
    rows = df.withColumns({"__t": F.when(col(key).isNotNull(), _text(df, column, fold)),
                           **{n: col(c) for n, c in zip(names, within)}})
    return join_unique(rows, per_text.hint("merge"), ["__t", *names], "left").select(
        *[col(c) for c in df.columns], F.coalesce("__links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("__first", col(key)).alias("first_key"))


def remove_near_duplicates(
    df: DataFrame, column: str, key: str, distance: int = 2, within: Sequence[str] = (), *,
    fold: bool = False, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The rows that have no row with a smaller key within the distance.

    The rule looks at pairs of the input: of a chain in which only neighbours are similar all
    but the first row go. Rows without a key or a text stay.
    """
    marked = near_duplicates(df, column, key, distance, within, fold=fold, block_rows=block_rows)
    return marked.filter(col(key).eqNullSafe(F.col("first_key"))).select(*[col(c) for c in df.columns])


# --- dictionaries ------------------------------------------------------------


def nearest_values(
    values: DataFrame, allowed: DataFrame, distance: int = 2, *, ties: str = "least", fold: bool = False,
) -> DataFrame:
    """value, nearest and distance for the distinct values (one text column) that are not allowed.

    ``allowed`` has one text column. A value without an allowed one within the distance is
    missing in the result. Of several equally near ones the least is taken, or with
    ``ties='none'`` the value is left out. ``fold`` compares without case and extra blanks, so
    that distance 0 is an allowed value in another spelling.

    Short values meet in an index of deletions: two texts within the distance have a common
    rest after taking up to ``distance`` characters out of each. Long ones meet by segments.
    """
    if ties not in ("least", "none"):
        raise ValueError("ties must be 'least' or 'none'")
    turn = _folded if fold else (lambda c: c)
    known = allowed.select(F.col(allowed.columns[0]).alias("nearest")).dropna().distinct()
    bad = values.select(F.col(values.columns[0]).alias("value")).dropna().distinct()
    bad = bad.join(known, bad["value"] == known["nearest"], "left_anti")
    index = known.select("nearest", turn(F.col("nearest")).alias("__t")).withColumn("__low", F.col("nearest"))
    probe = bad.select("value", turn(F.col("value")).alias("__t")).withColumn("__low", F.col("value"))
    met = None
    for keys_i, keys_p in _dictionary_keys(distance):
        found = _met(index.withColumn("__k", F.explode(keys_i)), probe.withColumn("__k", F.explode(keys_p)),
                     F.lit(True), distance, BLOCK_ROWS)
        found = found.select(F.col("value2").alias("value"), "nearest", F.col("__d").alias("distance"))
        met = found if met is None else met.union(found)
    best = met.groupBy("value").agg(F.min(F.struct("distance", "nearest")).alias("one"),
                                    F.max(F.struct(-F.col("distance"), F.col("nearest"))).alias("last"))
    alone = F.col("one.nearest") == F.col("last.nearest")  # the least and the greatest of the nearest ones
    kept = best if ties == "least" else best.filter(alone)
    return kept.select("value", "one.nearest", "one.distance")


def _dictionary_keys(distance: int) -> list[tuple[Column, Column]]:
    """Pairs of (keys of allowed values, keys of bad values); together they meet all within the distance."""
    t, length = F.col("__t"), F.char_length("__t")
    none = F.array().cast("array<bigint>")
    words = F.when(length <= WORD_CHARS, deletion_keys(t, distance)).otherwise(none)
    long = length > max(WORD_CHARS - distance, distance)
    cut = F.when(long, segment_keys(t, distance)).otherwise(none)
    found = F.when(long, substring_keys(t, distance)).otherwise(none)
    return [(words, words), (cut, found), (found, cut)]


def snap_to_dictionary(
    df: DataFrame, column: str, allowed: DataFrame | Sequence[str], distance: int = 2, *,
    ties: str = "least", fold: bool = False,
) -> DataFrame:
    """The table with values of the column that are not allowed replaced by the nearest allowed one.

    Only the distinct bad values are looked up; the rows then meet a table of value and
    replacement, frequent bad values salted. Values without an allowed one within the
    distance, NULLs and (with ``ties='none'``) values between two allowed ones stay.
    """
    require(df, column)
    _text(df, column, False)
    if not isinstance(allowed, DataFrame):
        allowed = literal_rows(df.sparkSession, [(v,) for v in allowed], "allowed string")
    found = materialized(nearest_values(df.select(col(column)), allowed, distance, ties=ties, fold=fold), "nearest")
    table = found.select(F.col("value").alias(column), F.col("nearest").alias("__nearest"))
    fixed = join_unique(df, table, [column], "left").withColumn(column, F.coalesce("__nearest", col(column)))
    return fixed.select(*[col(c) for c in df.columns])
