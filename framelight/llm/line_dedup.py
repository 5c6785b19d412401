"""Line deduplication by an exact set-similarity join, in DataFrame functions only.

A line is the set of its lower-cased words (runs outside ``\\x20\\x09-\\x0D``). A
line is removed if an earlier line, in the order of documents by id and of lines
within them, has a Jaccard similarity of ``percent`` or more, whether or not
that line was itself removed. Equal sets fold into their first line; the rest
join exactly: tokens in order of rarity, only the prefix that similar sets must
share a token of, positional and length filters in the join, Jaccard verified on
whole sets. A parity mask of each set goes with its prefix: masks of two
sets differ in no more bits than the sets differ in tokens, so most pairs that
can't be similar end in the join. Groups of many similar lines are first compared
with their leaders, and the join pairs only sets of which the later one's fate is
open. Rarity is the count of a token's hash class (``CLASSES`` of them, so the
table that is passed around has a fixed size) in steps of a part of a doubling,
ties by hash: any order that all sets share keeps the prefix filter exact.

Defined results: null text stays null; lines without a word are kept; a text
that loses all its lines becomes empty; rows equal in id and text are one
document and are decided alike; rows with one id and other texts follow each
other in the order of a text hash; null ids come first; texts and lines of any
length are compared whole; columns of the input are kept as they are. Words are
compared by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelight.llm.bits import bit_set, maybe_in
from framelight.llm.storage import materialize

#: Hash classes whose counts order tokens; their table of small numbers has a fixed size and goes with the plan.
CLASSES = 1 << 16
#: Steps of a doubling in which counts are told apart.
STEPS = 4
#: Lines of so many tokens carry two masks.
LONG = 56
#: White space other than the blank and the line break.
_OTHER_WHITE = "\t\x0b\x0c\r"


def _spaced(text: Column) -> Column:
    """The text with blanks for all other white space but line breaks."""
    other = F.lit(False)
    for c in _OTHER_WHITE:
        other = other | text.contains(c)
    return F.when(other, F.translate(text, _OTHER_WHITE, " " * len(_OTHER_WHITE))).otherwise(text)


def _tokens(line: Column) -> Column:
    """The distinct token hashes of a line in lower case whose words stand between blanks."""
    hashes = F.transform(F.split(line, " "), lambda w: F.xxhash64(w))
    return F.array_remove(F.array_distinct(hashes), F.xxhash64(F.lit("")))


def _print(tokens: Column) -> Column:
    """A hash of a set, whatever the order of its tokens."""
    return F.xxhash64(F.size(tokens), F.aggregate(tokens, F.lit(0).cast("long"), lambda m, t: m.bitwiseXOR(t)))


def _mask(tokens: Column) -> Column:
    """Bit i: whether an odd number of tokens have i as their lowest six bits."""
    bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), t.bitwiseAND(F.lit(63)).cast("int"))
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda m, t: m.bitwiseXOR(bit(t)))


def _half(tokens: Column, n: Column) -> Column:
    """The mask of the tokens whose seventh bit is set, for long lines only, where one mask says too little."""
    bit = lambda t: F.call_function("shiftleft", F.shiftright(t, 6).bitwiseAND(F.lit(1)), t.bitwiseAND(F.lit(63)).cast("int"))
    return F.when(n >= LONG, F.aggregate(tokens, F.lit(0).cast("long"), lambda m, t: m.bitwiseXOR(bit(t))))


def _lines(keyed: DataFrame) -> DataFrame:
    """(id, key, line_no, print, n, tokens) of every line; a filter on n here would work the tokens out twice."""
    lines = keyed.select("id", "key", F.posexplode(F.split(F.lower(_spaced(F.col("text"))), "\n")).alias("line_no", "line"))
    # tokens stand in a projection of their own, which is compiled but for its lambda; within explode nothing would be
    lines = lines.select("id", "key", "line_no", _tokens(F.col("line")).alias("tokens"))
    return lines.select("id", "key", "line_no", _print(F.col("tokens")).alias("print"), F.size("tokens").alias("n"), "tokens")


def _rarity(lines: DataFrame) -> Column:
    """How many line tokens fall into each class, in steps of a doubling, as a constant array (subqueries can't stand in lambdas)."""
    each = lines.select(F.explode("tokens").alias("t")).groupBy(F.col("t").bitwiseAND(F.lit(CLASSES - 1)).cast("int").alias("class"))
    counted = each.agg(F.round(F.log2(F.count("*")) * STEPS).cast("int").alias("step"))
    every = lines.sparkSession.range(CLASSES, numPartitions=1).select(F.col("id").cast("int").alias("class"), F.lit(0).alias("step"))
    whole = counted.union(every).groupBy("class").agg(F.max("step").alias("step"))
    in_order = F.sort_array(F.collect_list(F.col("class") * 256 + F.col("step")))
    row = whole.agg(F.transform(in_order, lambda x: x.bitwiseAND(F.lit(255))).alias("steps")).first()  # CLASSES numbers
    return F.split(F.lit(",".join(map(str, row["steps"]))), ",").cast("array<int>")  # short numbers, as the plan is kept in many places


def _may_match(percent: int, n_a: str = "n_a", n_b: str = "n_b") -> Column:
    """What length and masks say about a pair of sets (n, mask, half of sides a and b)."""
    by_length = F.expr(f"{percent} * {n_a} <= 100 * {n_b} and {percent} * {n_b} <= 100 * {n_a}")
    # the mask of the other half of the tokens is mask ^ half
    halves = "bit_count(half_a ^ half_b) + bit_count(mask_a ^ mask_b ^ half_a ^ half_b)"
    by_mask = F.expr(f"{100 + percent} * coalesce({halves}, bit_count(mask_a ^ mask_b)) <= {100 - percent} * ({n_a} + {n_b})")
    return by_length & by_mask


def _verified(pairs: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs of prints (a, b) whose sets are similar."""
    needed = materialize(pairs.select(F.col("a").alias("print")).union(pairs.select("b")).distinct(), "line-prints")
    whole = lines.filter(maybe_in(bit_set(needed, "print"), "print")).join(needed, "print", "left_semi").groupBy("print").agg(F.first("tokens").alias("tokens"))
    whole = materialize(whole, "line-sets")
    sides = [whole.select(F.col("print").alias(s), F.col("tokens").alias(f"tokens_{s}")) for s in "ab"]
    # common >= percent of the union, with the intersection named once, as a filter works out each mention of it
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    both = F.size("tokens_a") + F.size("tokens_b")
    return pairs.join(sides[0], "a").join(sides[1], "b").filter(common * (100 + percent) >= both * percent).select("a", "b")


def similar_to_leaders(sets: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """Prints of sets that resemble an earlier leader of those with the same least or greatest token hash.

    Leaders are the earliest set and the earliest of the shortest ones, which is
    near to lines that hold a passage between words of their own. They settle
    nearly all of a large group by a few comparisons each; the join need not
    pair what is settled.
    """
    keyed = sets.select("print", "n", "mask", "half", "first", F.explode(F.array("low", "high")).alias("hash"))
    about = [F.col(c) for c in ("first", "print", "n", "mask", "half")]
    leads = [F.min(F.struct(*about)).alias("lead"), F.min(F.struct(F.floor(F.col("n") / 4).alias("short"), *about)).alias("shortest")]
    leaders = keyed.groupBy("hash").agg(*leads, F.max("print").alias("other")).filter("lead.print <> other")
    met = keyed.join(leaders, "hash")
    sides = lambda lead: [F.col(f"{lead}.first").alias("led_by"), *(F.col(f"{lead}.{c}").alias(f"{c}_a") for c in ("print", "n", "mask", "half")), "first", *(F.col(c).alias(f"{c}_b") for c in ("print", "n", "mask", "half"))]
    named = met.select(F.explode(F.array(*(F.struct(*sides(x)) for x in ("lead", "shortest")))).alias("x")).select("x.*")
    pairs = named.filter(F.expr("led_by < first")).filter(_may_match(percent)).select(F.col("print_a").alias("a"), F.col("print_b").alias("b")).distinct()
    return _verified(materialize(pairs, "leader-pairs"), lines, percent).select(F.col("b").alias("print")).distinct()


def similar_sets(sets: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """(a, b): prints of two sets with their Jaccard similarity at least ``percent``, one of them open at least.

    ``sets`` holds (print, n, mask, half, open, prefix) with the prefix in order of rarity.
    """
    # with fewer tokens than this only equal sets are similar
    least = -(-percent // (100 - percent)) if percent < 100 else 1 << 30
    tokens = sets.filter(F.col("n") >= least).select("print", F.col("first.id").alias("id"), "n", "mask", "half", "open", F.posexplode("prefix").alias("at", "token"))
    # size, place and state go in one number, as these rows are what the join moves
    columns = ["print", "id", "mask", "half", "about"]
    about = F.expr("shiftleft(cast(n as long), 32) | shiftleft(cast(at as long), 1) | cast(open as long)").alias("about")
    # the first common token stands early in the shorter set; late ones, the more frequent, needn't meet each other
    is_early = F.expr(f"{100 + percent} * (n - at) >= {2 * percent} * n")
    early, late = (tokens.filter(x).select("token", *columns[:-1], about) for x in (is_early, ~is_early))
    side = lambda rows, s: rows.select("token", *(F.col(c).alias(f"{c}_{s}") for c in columns))
    n, at, is_open = ({s: f.format(f"about_{s}") for s in "ab"} for f in ("shiftright({}, 32)", "(shiftright({}, 1) & 2147483647)", "({} & 1 = 1)"))
    by_position = F.expr(f"{100 + percent} * (1 + least({n['a']} - {at['a']} - 1, {n['b']} - {at['b']} - 1)) >= {percent} * ({n['a']} + {n['b']})")
    # only a later set can lose its lines; ids tell which of two is later unless they're equal (null ids come first)
    matters = F.expr(f"({is_open['b']} and (id_a is null or id_a <= id_b)) or ({is_open['a']} and (id_b is null or id_b <= id_a))")
    fits = by_position & F.coalesce(matters, F.lit(False)) & _may_match(percent, n["a"], n["b"])
    both_early = side(early, "a").join(side(early, "b"), "token").filter((F.col("print_a") < F.col("print_b")) & fits)
    one_late = side(early, "a").join(side(late, "b"), "token").filter((F.col("print_a") != F.col("print_b")) & F.expr(f"{n['a']} < {n['b']}") & fits)
    met = both_early.select("print_a", "print_b").union(one_late.select(F.least("print_a", "print_b"), F.greatest("print_a", "print_b")))
    pairs = materialize(met.select(F.col("print_a").alias("a"), F.col("print_b").alias("b")).distinct(), "line-pairs")
    return _verified(pairs, lines, percent)


def removed_lines(keyed: DataFrame, percent: int) -> DataFrame:
    """(key, line_no) of every line that repeats an earlier one; ``keyed`` holds (id, key, text)."""
    lines = materialize(_lines(keyed), "lines", dictionary_mb=8).filter("n > 0")
    counts = _rarity(lines)
    # count and hash in one number: its order is that of rarity, and equal tokens have equal numbers
    step = lambda t: F.get(counts, t.bitwiseAND(F.lit(CLASSES - 1))).cast("long")
    packed = lambda t: F.call_function("shiftleft", step(t), F.lit(32)).bitwiseOR(t.bitwiseAND(F.lit(0xFFFFFFFF)))
    # never null by type too (what was read could be), so that they're sorted as plain numbers
    rank = lambda t: F.coalesce(packed(t), F.lit(0).cast("long"))
    length = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1
    place = F.struct("id", "key", "line_no")
    derived = {"prefix": F.slice(F.sort_array(F.transform("tokens", rank)), 1, length), "mask": _mask(F.col("tokens")), "half": _half(F.col("tokens"), F.col("n")), "low": F.array_min("tokens"), "high": F.array_max("tokens")}
    # lines whose set occurs once, nearly all, are sets as they are
    repeated = materialize(lines.groupBy("print", "n").count().filter("count > 1").select("print"), "repeated-lines")
    some = bit_set(repeated, "print")
    described = lines.withColumns(derived)
    once = described.filter(~maybe_in(some, "print")).select("print", "n", place.alias("first"), place.alias("last"), *derived)
    # of the others only the first line of each set is described
    repeats = materialize(lines.filter(maybe_in(some, "print")).groupBy("print", "n").agg(F.min(place).alias("first"), F.max(place).alias("last")), "line-repeats")
    spots = bit_set(repeats.select(F.xxhash64("print", "first.key", "first.line_no").alias("spot")), "spot")
    found = lines.withColumn("spot", F.xxhash64("print", "key", "line_no")).filter(maybe_in(spots, "spot"))
    leading = found.join(repeats.select("print", "first", "last"), "print").filter(place == F.col("first")).dropDuplicates(["print"])
    folded = leading.withColumns(derived).select("print", "n", "first", "last", *derived)
    sets = materialize(once.unionByName(folded), "line-firsts", dictionary_mb=0)
    several = sets.filter("first <> last").select("print", "first")
    again = lines.filter(maybe_in(some, "print")).select("print", place.alias("place")).join(several, "print").filter("place <> first").select("place.key", "place.line_no")
    settled = materialize(similar_to_leaders(sets, lines, percent), "settled")
    by_leader = sets.select("print", "first").join(settled, "print", "left_semi").select("first.key", "first.line_no")
    flagged = sets.join(settled.withColumn("_settled", F.lit(True)), "print", "left").withColumn("open", F.col("_settled").isNull())
    similar = materialize(similar_sets(flagged, lines, percent), "similar-lines")
    paired = bit_set(similar.select(F.explode(F.array("a", "b")).alias("print")), "print")
    places = [sets.filter(maybe_in(paired, "print")).select(F.col("print").alias(s), F.col("first").alias(f"first_{s}")) for s in "ab"]
    ordered = similar.join(places[0], "a").join(places[1], "b")
    later = ordered.select(F.greatest("first_a", "first_b").alias("place")).distinct().select("place.key", "place.line_no").union(by_leader)
    return again.union(later).distinct()


def dedup_lines(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", counts: bool = False, drop_emptied: bool = False) -> DataFrame:
    """``docs`` without the lines that repeat earlier ones.

    ``counts`` adds n_lines and n_removed, in place of columns of those names;
    ``drop_emptied`` leaves out rows that lost all their words.
    """
    key = F.when(F.col(text_col).isNotNull(), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)))
    keyed = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), key.alias("key"), F.col(text_col).alias("text"))
    removed = materialize(removed_lines(keyed, percent).groupBy("key").agg(F.collect_list("line_no").alias("removed")), "removed-lines")
    # whole rows go as one column, so their names can't clash with those in use here
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key.alias("key"))
    packed = packed.withColumn("touched", F.coalesce(maybe_in(bit_set(removed, "key"), "key"), F.lit(False)))
    text = F.col("row")[text_col]
    lines = F.split(text, "\n")
    # rows that the bit set lets through in vain lose no line here, so that texts are joined once
    joined = packed.filter("touched").join(removed, "key", "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    # exploding an array of one keeps the lines from being split again for every use
    split = joined.select("row", "removed", F.explode(F.array(lines)).alias("lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("removed"))
    cut = split.select("row", F.size("lines").alias("n_lines"), F.size("removed").alias("n_removed"), F.explode(F.array(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))).alias("text"))
    if drop_emptied:
        cut = cut.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]") | (F.col("n_removed") == 0))
    whole = packed.filter("not touched").select("row", F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"), F.lit(0).alias("n_removed"), text.alias("text"))
    added = ["n_lines", "n_removed"] if counts else []
    columns = [F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c not in added]
    return cut.union(whole).select(*columns, *(F.when(F.col("row")[text_col].isNull(), 0).otherwise(F.col(c)).cast("long").alias(c) for c in added))
