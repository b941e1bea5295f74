"""Fuzzy line dedup with DataFrame functions only.

Lines are normalised (lower case, runs of other than letters and digits as one
blank) and identified by a 128-bit hash. Each gets a 64-bit SimHash of its
words, counted in packed lanes by one aggregation. Distinct lines whose
fingerprints differ in at most three bits agree on one of four blocks
(pigeonhole), so they meet in an equi-join on block, value and length class;
pairs are verified by the edit similarity of their words. Similar lines whose
fingerprints differ more all meet through their rarest words (``word_candidates``,
``rest_candidates``) or, short ones, by what is left without one word (``brief_pairs``).
Verified pairs form connected groups, and of each group the first occurrence
(smallest id, then line) is kept.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.llm.common import components, stored

DISTANCE, SIMILARITY = 3, 0.8
LONGEST = 1 << 14  # words; longer lines have no fingerprint and meet through their rarest words
SHORT = 127  # words up to which a count fits a lane of 8 bits
FILTER_WORDS = 1 << 18  # 64-bit words of a fixed-size filter (4 MB with their places)
CODE_POINTS = 900_000
CLASSES = 1 << 18  # hash classes of words whose frequencies order them
DIRECT = 256  # lines of a rare word that all meet each other at once; in larger groups those not yet connected do
FINER = 4096  # lines of a word from which they are dealt by a second one; also the size of a block of lines
BRIEF = 16  # words up to which lines one word apart may be looked for by what is left without one
BITS = ["b0", "b1", "b2", "b3"]  # of the words of a line
WIDE = 64  # words up to which 128 bits tell lines apart
PASSES = 4  # parts of the words whose lines are brought together one after the other, so that only one part is on disk
NO_ID = -(1 << 63)  # stands for a null id, before all others
NOT_WORD = r"[\x00-/:-`{-\x7f]+"


def line_words(line: Column) -> Column:
    """The normalised words of a line."""
    return F.array_remove(F.split(F.lower(line), NOT_WORD), "")


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def _line_ids(norm: Column) -> list[Column]:
    return [F.xxhash64(norm).alias("l1"), F.xxhash64(F.lit(7), norm).alias("l2")]


def _every(step: int) -> int:
    """A long with every ``step``-th bit set, the sign bit never."""
    return sum(1 << i for i in range(0, 64, step))


def _lane(h: Column, short: Column, j: int) -> Column:
    """What a word's hash adds to the j-th of 16 longs: 8 lanes of 8 bits for short lines, 4 of 16 else."""
    wide = F.shiftrightunsigned(h, j).bitwiseAND(F.lit(_every(16)))
    narrow = F.shiftrightunsigned(h, j).bitwiseAND(F.lit(_every(8))) if j < 8 else F.lit(0).cast("long")
    return F.when(short, narrow).otherwise(wide)


def _majority(sums: list[Column], n: Column, bits: int) -> Column:
    """The fingerprint of lane sums: bit b is set where its count is over n / 2.

    Every second lane is taken at a time, so that a lane has room to carry:
    count + (2^(bits-1) - 1 - n // 2) reaches 2^(bits-1) just then. For the few
    longer lines it is one function over an array: both written out made a
    method of 16,000 bytes, which the JVM does not compile.
    """
    room, ones = F.lit((1 << bits - 1) - 1) - F.floor(n / 2), _every(2 * bits)

    def part(s: Column, j: Column, half: int) -> Column:
        lanes = F.shiftrightunsigned(s, bits * half).bitwiseAND(F.lit(ones * ((1 << bits) - 1)))
        hit = F.shiftrightunsigned(lanes + room * F.lit(ones), bits - 1).bitwiseAND(F.lit(ones))
        return F.call_function("shiftleft", hit, j + bits * half)

    every = lambda s, j: part(s, j, 0).bitwiseOR(part(s, j, 1))
    if bits == 8:
        return reduce(lambda x, y: x.bitwiseOR(y), [every(s, F.lit(j)) for j, s in enumerate(sums[:bits])])
    return F.aggregate(F.transform(F.array(*sums[:bits]), every), F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y))


def _bits(h: Column, length: Column) -> list[Column]:
    """Of the words ``h`` of a line: one of 256 bits set for each, in lines up to ``WIDE`` words one of the first 128.

    All are set in lines without a fingerprint: those have so many words that
    a similar one lacks fewer of the bits than it may lack words.
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 40).cast("int"))
    at = F.shiftrightunsigned(h, 46).bitwiseAND(F.when(length > WIDE, F.lit(3)).otherwise(F.lit(1)))
    return [F.coalesce(F.bit_or(F.when(h.isNotNull(), F.when(at == k, bit).otherwise(F.lit(0).cast("long")))), F.lit(-1).cast("long")).alias(b)
            for k, b in enumerate(BITS)]


def fingerprinted(docs: DataFrame) -> DataFrame:
    """Every line with a word: ``did, th, line, l1, l2, len, fp, b0, b1, b2, b3``; ``len`` in words, ``fp`` null for the longest."""
    # repeated rows are counted each on its own: together their counts would run over the lanes
    rows = docs.select("did", "th", "text", F.monotonically_increasing_id().alias("copy"))
    rows = rows.select("copy", "did", "th", F.posexplode(lines_of(F.col("text"))).alias("line", "s"))
    rows = rows.select("copy", "did", "th", "line", line_words(F.col("s")).alias("w"))
    rows = rows.select("copy", "did", "th", "line", "w", F.array_join("w", " ").alias("norm"))
    rows = rows.select("copy", "did", "th", "line", *_line_ids(F.col("norm")), F.size("w").alias("len"), "w")
    # explode_outer, and a filter on an aggregate: a plain explode or a filter on
    # a key would push size(w) > 0 to the scan and split every line twice
    words = rows.select("copy", "did", "th", "line", "l1", "l2", "len", F.explode_outer(
        F.when(F.col("len") <= LONGEST, F.col("w"))).alias("word"))
    words = words.withColumn("h", F.when(F.col("word").isNotNull(), F.xxhash64("word")))
    short = F.col("len") <= SHORT
    names = [f"s{j}" for j in range(16)]
    counted = words.groupBy("copy", "did", "th", "line", "l1", "l2").agg(
        F.first("len").alias("len"), *[F.sum(_lane(F.col("h"), short, j)).alias(s) for j, s in enumerate(names)], *_bits(F.col("h"), F.col("len"))).where("len > 0")
    sums, n = [F.col(s) for s in names], F.col("len")
    fp = F.when(n > LONGEST, F.lit(None)).when(short, _majority(sums, n, 8)).otherwise(_majority(sums, n, 16))
    return counted.select("did", "th", "line", "l1", "l2", "len", fp.alias("fp"), *BITS)


def candidates(lines: DataFrame, distance: int = DISTANCE, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs of distinct lines ``a1, b1`` (their ``l1``) with near fingerprints and lengths.

    ``lines``: one row per distinct line (``l1, len, fp``; ``len`` in words). A
    similarity of s needs lengths within a factor of s, so a line meets those of
    its own power-of-two length class and, as a guest, if near its end, of the
    next. Lines that share ``l1`` by chance are both found by it.
    """
    width = 64 // (distance + 1)
    mask = (1 << width) - 1
    cls = F.floor(F.log2(F.col("len"))).cast("int")
    nxt = F.floor(F.log2(F.floor(F.col("len") / F.lit(similarity)))).cast("int")
    both = F.when(nxt > cls, F.array(cls, nxt)).otherwise(F.array(cls))
    keyed = (lines.select("l1", "len", "fp", F.explode(both).alias("cls"))
             .select("l1", "fp", "len", "cls", F.explode(F.array(*[F.lit(i) for i in range(distance + 1)])).alias("i")))
    a, b = keyed.alias("a"), keyed.alias("b")
    block = lambda t: F.expr(f"shiftrightunsigned({t}.fp, {width} * {t}.i) & {mask}L")
    home = lambda t: F.floor(F.log2(F.col(f"{t}.len"))) == F.col(f"{t}.cls")
    meet = (F.col("a.cls") == F.col("b.cls")) & (F.col("a.i") == F.col("b.i")) & (block("a") == block("b"))
    near = (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance) & \
        (F.least("a.len", "b.len") >= F.greatest("a.len", "b.len") * similarity)
    # one condition over both sides: split, its parts would filter the sides
    # differently and each would be shuffled on its own
    once = F.when(home("b"), home("a") & (F.col("a.l1") < F.col("b.l1"))).otherwise(home("a") & (F.col("a.l1") != F.col("b.l1")))
    found = a.join(b, meet & near & once)
    return found.select(F.least("a.l1", "b.l1").alias("a1"), F.greatest("a.l1", "b.l1").alias("b1")).distinct()


def frequency_classes(docs: DataFrame) -> bytes:
    """One byte per hash class of words: 4 log2 of its count in all texts."""
    # a newline parts words like any other of NOT_WORD
    words = docs.select(F.explode(line_words(F.col("text"))).alias("w"))
    counts = words.groupBy(F.pmod(F.xxhash64("w"), F.lit(CLASSES)).cast("int").alias("c")).count().collect()
    out = bytearray(CLASSES)
    for c, n in counts:
        out[c] = min(127, int(4 * math.log2(n + 1)))
    return bytes(out)


def _limit(length: Column, similarity: float) -> Column:
    """Edits that lines may differ in, the longer of ``length`` words."""
    return F.floor(length * F.lit(1 - similarity) + F.lit(1e-9)).cast("int")


def _brief(similarity: float) -> int:
    """The length up to which similar lines differ in one word at most."""
    n = 0
    while n < BRIEF and math.floor((n + 1) * (1 - similarity) + 1e-9) <= 1:
        n += 1
    return n


def rare_words(docs: DataFrame, distinct: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Every distinct line that can have a similar one: ``l1, len, b0, b1, b2, b3, keys, rests``.

    Of n words, at most ``_limit(n)`` have no partner in a similar line. So two
    similar lines share one of their first so many words and one more, in any
    order of all words; here the rarest come first, and ``keys`` has one word
    more. Short lines have few rare words and are found by ``rests`` alone:
    the line (``p`` -1) and what is left of it without its word ``p``. ``b0`` to
    ``b3`` are those of ``distinct``, which has a row per line.
    """
    can = F.floor(F.col("len") * F.lit((1 - similarity) / similarity) + F.lit(1e-9)) > 0
    low = (1 << 56) - 1
    common = F.lit(frequency_classes(docs))
    rank = lambda h: F.shiftleft(F.ascii(F.substring(
        common, F.pmod(h, F.lit(CLASSES)).cast("int") + 1, F.lit(1)).cast("string")).cast("long"), 56).bitwiseOR(h.bitwiseAND(F.lit(low)))
    rows = docs.select(F.explode(lines_of(F.col("text"))).alias("s")).select(line_words(F.col("s")).alias("w"))
    rows = rows.select(F.xxhash64(F.array_join("w", " ")).alias("l1"), F.size("w").alias("len"), "w")
    without = lambda w, i: F.concat(F.slice("w", F.lit(1), i), F.slice("w", i + 2, F.size("w")))
    rest = lambda p, r: F.struct(p.cast("int").alias("p"), r.alias("rest"))
    brief, none = _brief(similarity), F.array().cast("array<struct<p:int,rest:bigint>>")
    rests = F.when(F.col("len") > brief, none).otherwise(F.concat(
        F.array(rest(F.lit(-1), F.col("l1"))),
        F.when(_limit(F.col("len"), similarity) > 0, F.transform(
            "w", lambda w, i: rest(i, F.xxhash64(F.array_join(without(w, i), " "))))).otherwise(none)))
    rows = rows.select("l1", "len", rests.alias("rests"), F.array_distinct(F.transform("w", lambda w: F.xxhash64(w))).alias("h"))
    shortest = brief + 1 - math.floor((brief + 1) * (1 - similarity) + 1e-9)
    keys = F.when(F.col("len") >= shortest, F.slice(
        F.sort_array(F.transform("h", rank)), F.lit(1), _limit(F.col("len"), similarity) + 2)).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select("l1", "len", keys.alias("keys"), "rests")
    # a filter before the aggregation would be pushed to the scan and split every line twice
    rows = rows.groupBy("l1").agg(*[F.first(c).alias(c) for c in ("len", "keys", "rests")]).where(can)
    return rows.join(distinct.groupBy("l1").agg(*[F.first(b).alias(b) for b in BITS]), "l1").select("l1", "len", *BITS, "keys", "rests")


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a1"), F.greatest(a, b).alias("b1")]


def brief_pairs(rare: DataFrame) -> DataFrame:
    """Pairs ``a1, b1`` that connect all short lines one word apart.

    Lines that are equal without their word ``p`` are all similar to each other,
    so each meets the first of them; a line that is left of another without a word meets it.
    """
    rows = rare.select("l1", F.explode("rests").alias("r")).select("l1", "r.p", "r.rest")
    whole = Window.partitionBy("rest").orderBy("p", "l1")
    same = Window.partitionBy("rest", "p").orderBy("p", "l1")
    rows = rows.select("l1", "p", "rest", F.first("p").over(whole).alias("lead"), F.first("l1").over(same).alias("one")).where("p >= 0")
    ends = F.array(F.when(F.col("one") != F.col("l1"), F.col("one")), F.when(F.col("lead") == -1, F.col("rest")))
    met = rows.select("l1", F.explode(ends).alias("other")).where("other is not null and other <> l1")
    return met.select(*_pair(F.col("l1"), F.col("other")))


def _keyed(rare: DataFrame, similarity: float, *more: str) -> DataFrame:
    """A row per line and each of its words that a similar line may share first."""
    first = F.slice("keys", F.lit(1), _limit(F.col("len"), similarity) + 1)
    return rare.select("l1", "len", *BITS, *more, F.posexplode(first).alias("i", "key")).where("key is not null")


def _near(similarity: float) -> Column:
    """Whether the lengths and words of lines ``a`` and ``b`` allow the similarity.

    ``need`` words of the longer line at least must have a partner; each word
    that the other line has not lies among those without.
    """
    need = F.greatest("a.need", "b.need")
    without = lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))
    half = lambda t, k: F.col(f"{t}.b{k}").bitwiseOR(F.col(f"{t}.b{k + 2}"))
    # first by 128 bits of each, then, if both have them, by 256
    lost = lambda p, q: without(half(p, 0), half(q, 0)) + without(half(p, 1), half(q, 1))
    more = lambda p, q: sum(without(F.col(f"{p}.{b}"), F.col(f"{q}.{b}")) for b in BITS)
    wide = (F.col("a.len") > WIDE) & (F.col("b.len") > WIDE)
    fits = lambda f: (f("a", "b") <= F.col("a.len") - need) & (f("b", "a") <= F.col("b.len") - need)
    return (F.least("a.len", "b.len") >= need) & fits(lost) & (~wide | fits(more))


def word_candidates(rare: DataFrame, similarity: float = SIMILARITY, part: int = 0, parts: int = 1) -> DataFrame:
    """Pairs ``a1, b1`` of lines that share one of their rarest words; ``key, n`` of words left for ``rest_candidates``.

    Up to ``DIRECT`` lines of a word all meet. Where there are more, they meet
    the one of smallest hash first; such a word is listed once, with ``n``, its
    lines, and the pair of that one with itself. Only words of one of ``parts`` parts.
    """
    group = Window.partitionBy("key")
    need = F.col("len") - _limit(F.col("len"), similarity)
    keyed = _keyed(rare, similarity).where(F.pmod("key", F.lit(parts)) == part).select("key", "l1", "len", *BITS)
    known = keyed.withColumn("n", F.count("*").over(group)).where("n > 1").withColumn("need", need)
    few = known.where(F.col("n") <= DIRECT).drop("n")
    every = few.alias("a").join(few.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.l1") < F.col("b.l1")) & _near(similarity))
    line = F.struct(F.xxhash64("key", "l1").alias("at"), "l1", "len", *BITS)
    many = keyed.withColumn("n", F.count("*").over(group)).withColumn("b", F.min(line).over(group)).where(F.col("n") > DIRECT)
    many = many.select("key", "n", F.struct("l1", "len", *BITS, need.alias("need")).alias("a"),
                       F.struct("b.l1", "b.len", *[f"b.{b}" for b in BITS], (F.col("b.len") - _limit(F.col("b.len"), similarity)).alias("need")).alias("b"))
    own = F.col("a.l1") == F.col("b.l1")
    star = many.where(own | _near(similarity))
    return (every.select(*_pair(F.col("a.l1"), F.col("b.l1")), F.lit(None).cast("long").alias("key"), F.lit(None).cast("long").alias("n"))
            .unionByName(star.select(*_pair(F.col("a.l1"), F.col("b.l1")), F.when(own, F.col("key")).alias("key"),
                                     F.when(own, F.col("n")).alias("n"))))


def rest_candidates(rare: DataFrame, words: DataFrame, similarity: float = SIMILARITY, wide: bool = False) -> DataFrame:
    """All pairs ``a1, b1`` of lines not yet connected that share one of the many lines' ``words`` (``key, n``).

    ``rare`` has the ``root`` of the connected lines, null for others. Words
    are those of up to ``FINER`` lines or, if ``wide``, of more; lines of the
    latter are dealt by the next word that they share, or none. A group that is
    connected has no more to find; in others, lines of another root than one
    member's meet all of other roots, blocks of lines against blocks, so that no
    task holds a group.
    """
    limit = _limit(F.col("len"), similarity)
    rows = _maybe(_keyed(rare, similarity, "root", *(["keys"] if wide else [])), words, F.col("key"), "hit").where("hit")
    rows = rows.join(words.select("key"), "key")
    if wide:
        after = F.transform(F.slice("keys", F.col("i") + 2, F.size("keys")), lambda k: F.xxhash64("key", k))
        none = F.when(F.size("keys") <= limit + 1, F.array(F.xxhash64("key"))).otherwise(F.array().cast("array<bigint>"))
        rows = rows.select("l1", "len", *BITS, "root", F.explode(F.concat(after, none)).alias("key"))
    rows = rows.select("key", "l1", "len", *BITS, (F.col("len") - limit).alias("need"), F.coalesce("root", "l1").alias("root"))
    group = Window.partitionBy("key")
    rows = rows.select("*", F.min("root").over(group).alias("lo"), F.max("root").over(group).alias("hi"), F.count("*").over(group).alias("n"),
                       F.min(F.struct(F.xxhash64("key", "l1").alias("at"), "root")).over(group)["root"].alias("base")).where("lo <> hi")
    blocks = F.ceil(F.col("n") / FINER).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("l1"), blocks).cast("int")).withColumn("every", F.sequence(F.lit(0), blocks - 1))
    fields = ["key", "l1", "len", *BITS, "need", "root", "base"]
    a = rows.where("root <> base").select(*fields, F.col("own").alias("x"), F.explode("every").alias("y")).alias("a")
    b = rows.select(*fields, F.explode("every").alias("x"), F.col("own").alias("y")).alias("b")
    meet = (F.col("a.key") == F.col("b.key")) & (F.col("a.x") == F.col("b.x")) & (F.col("a.y") == F.col("b.y"))
    once = (F.col("b.root") == F.col("b.base")) | (F.col("a.l1") < F.col("b.l1"))
    found = a.join(b, meet & (F.col("a.root") != F.col("b.root")) & once & _near(similarity))
    return found.select(*_pair(F.col("a.l1"), F.col("b.l1"))).distinct()


def coded(words: Column) -> Column:
    """A line with each word as one character, chosen by its hash among 900,000 code points.

    Edit distances of such strings are edit distances of the word sequences,
    but for different words of equal hash (one in 900,000 comparisons).
    """
    point = lambda w: F.lpad(F.hex(F.pmod(F.xxhash64(w), F.lit(CODE_POINTS)) + 0x10000), 8, "0")
    return F.decode(F.unhex(F.array_join(F.transform(words, point), "")), "UTF-32")


def _maybe(rows: DataFrame, wanted: DataFrame, key: Column, hit: str) -> DataFrame:
    """``rows`` with a column ``hit``: whether ``key`` may be among the wanted ones.

    A filter of fixed size (one bit per key in ``FILTER_WORDS`` words), so it
    can be sent to every task; what it lets through is joined exactly.
    """
    word, bit = F.pmod(key, F.lit(FILTER_WORDS)), F.call_function(
        "shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(F.xxhash64(key), 58).cast("int"))
    filt = wanted.groupBy(word.alias("_at")).agg(F.bit_or(bit).alias("_word"))
    marked = rows.withColumn("_w", word).withColumn("_b", bit).join(F.broadcast(filt), F.col("_w") == F.col("_at"), "left")
    return marked.withColumn(hit, F.coalesce(F.col("_word").bitwiseAND(F.col("_b")) != 0, F.lit(False))).drop(
        "_w", "_b", "_at", "_word")


def _codes(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``l1, l2, code`` of the wanted lines ``did, th, line``."""
    lines = docs.select("did", "th", F.posexplode(lines_of(F.col("text"))).alias("line", "s"))
    possible = _maybe(lines, wanted, F.xxhash64("th", "line"), "hit").where("hit")
    words = possible.join(wanted, ["did", "th", "line"]).select(line_words(F.col("s")).alias("w"))
    words = words.select("w", F.array_join("w", " ").alias("norm"))
    return words.select(*_line_ids(F.col("norm")), coded(F.col("w")).alias("code")).dropDuplicates(["l1", "l2"])


def verified(pairs: DataFrame, codes: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``a, b`` whose words have an edit similarity (1 - distance / longer length) of ``similarity``."""
    ca = codes.select(F.col("node").alias("a"), F.col("code").alias("ca"))
    cb = codes.select(F.col("node").alias("b"), F.col("code").alias("cb"))
    limit = F.floor(F.greatest(F.length("ca"), F.length("cb")) * F.lit(1 - similarity) + F.lit(1e-9)).cast("int")
    return (pairs.join(ca, "a").join(cb, "b").withColumn("most", limit)
            .where(F.expr("levenshtein(ca, cb, most)") >= 0).drop("ca", "cb", "most"))


def linked(pairs: DataFrame, codes: DataFrame, similarity: float) -> DataFrame:
    """``node, root`` of the lines in groups connected by verified pairs.

    A line in a large group has many partners, and most of its pairs say
    nothing new. So each line is verified with one partner first; of the other
    pairs only those between different groups of that round are verified.
    """
    node = F.struct(F.col("l1").alias("x"), F.col("l2").alias("y"))
    codes = codes.select(node.alias("node"), "l1", "code")
    of = codes.select("l1", "node")
    every = stored(pairs.join(of.select(F.col("l1").alias("a1"), F.col("node").alias("a")), "a1")
                   .join(of.select(F.col("l1").alias("b1"), F.col("node").alias("b")), "b1").select("a", "b"), "every")
    ways = every.unionByName(every.select(F.col("b").alias("a"), F.col("a").alias("b")))
    one = ways.groupBy("a").agg(F.min("b").alias("b"))
    one = one.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    first = stored(components(stored(verified(one, codes, similarity), "alike"), "a", "b"), "first")
    ra = first.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    rb = first.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    apart = (every.join(ra, "a", "left").join(rb, "b", "left")
             .select("a", "b", F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb")).where("ra <> rb"))
    more = components(stored(verified(apart, codes, similarity).select("ra", "rb").distinct(), "apart"), "ra", "rb")
    more = more.select(F.col("node").alias("part"), F.col("root").alias("whole"))
    known = first.select("node", F.col("root").alias("part")).unionByName(
        more.select(F.col("part").alias("node"), "part")).distinct()
    return known.join(more, "part", "left").select("node", F.coalesce("whole", "part").alias("root")).distinct()


def removed_lines(docs: DataFrame, distance: int = DISTANCE, similarity: float = SIMILARITY) -> DataFrame:
    """``did, th, gone``: per document the numbers of the lines to remove (``docs``: ``did, th, text``)."""
    printed = stored(fingerprinted(docs), "lines")
    lines = printed.drop(*BITS)
    place = F.struct("did", "th", "line")
    distinct = stored(printed.groupBy("l1", "l2").agg(
        F.first("len").alias("len"), F.first("fp").alias("fp"), F.min(place).alias("at"), F.count("*").alias("n"),
        *[F.first(b).alias(b) for b in BITS]), "distinct")
    rare = stored(rare_words(docs, distinct, similarity), "rare")

    def connected(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.explode(F.array("a1", "b1")).alias("l1")).distinct()
        wanted = stored(distinct.join(ends, "l1").select("at.did", "at.th", "at.line"), "wanted")
        return linked(pairs, stored(_codes(docs, wanted), "codes"), similarity)

    near = candidates(distinct.where("fp is not null"), distance, similarity).unionByName(brief_pairs(rare))
    met = [stored(near.select("*", F.lit(None).cast("long").alias("key"), F.lit(None).cast("long").alias("n")), "near")]
    for part in range(PASSES):
        met.append(stored(word_candidates(rare, similarity, part, PASSES).distinct(), "met"))
    found = stored(reduce(DataFrame.unionByName, met).distinct(), "found")
    groups = connected(found.where("a1 <> b1").select("a1", "b1"))
    words = found.where("key is not null").select("key", "n")
    if not words.isEmpty():
        groups = stored(groups, "linked")
        roots = groups.groupBy(F.col("node.x").alias("l1")).agg(F.min("root.x").alias("root"))
        # the root once a line, before a line becomes a row per word
        rooted = stored(rare.drop("rests").join(roots, "l1", "left"), "rooted")
        part = F.pmod("key", F.lit(PASSES))
        met = [stored(rest_candidates(rooted, words.where((F.col("n") <= FINER) & (part == k)), similarity), "more") for k in range(PASSES)]
        met.append(stored(rest_candidates(rooted, words.where(F.col("n") > FINER), similarity, wide=True), "more"))
        more = stored(reduce(DataFrame.unionByName, met).distinct(), "more")
        if not more.isEmpty():
            groups = components(groups.unionByName(connected(more)), "node", "root")
    groups = groups.select(F.col("node.x").alias("l1"), F.col("node.y").alias("l2"), "root")
    node = F.struct(F.col("l1").alias("x"), F.col("l2").alias("y"))
    grouped = distinct.join(groups, ["l1", "l2"], "left").where("n > 1 or root is not null")
    grouped = stored(grouped.select("l1", "l2", "at", F.coalesce("root", node).alias("root")), "groups")
    first = grouped.groupBy("root").agg(F.min("at").alias("keep"))
    keeper = grouped.join(first, "root").select("l1", "l2", "keep")
    gone = lines.select("did", "th", "line", "l1", "l2").join(keeper, ["l1", "l2"]).where(place != F.col("keep"))
    return gone.groupBy("did", "th").agg(F.collect_set("line").alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE,
                similarity: float = SIMILARITY) -> DataFrame:
    """``row`` (the input columns), ``text`` (what is kept), ``n_lines``, ``n_removed``.

    Lines are what lies between newlines. Lines without a letter or digit are
    kept and never compared. Of equal or similar lines of any length (SimHash
    within ``distance`` bits or a rare word in common, edit similarity of the
    word sequences of at least ``similarity``; linked groups count as a whole)
    the occurrence in the smallest id, then the first line, stays; ids are integers, a null id comes before all others.
    Null texts stay null with no lines; empty texts stay. Exactly repeated rows
    share one verdict. An empty table gives no rows; input columns of any name
    are kept in ``row``.
    """
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    keys = [F.coalesce(doc_id, F.lit(NO_ID)).alias("did"), F.xxhash64(doc_id.isNull(), doc_id, text.isNull(), text).alias("th")]
    gone = stored(removed_lines(docs.select(*keys, text.alias("text")), distance, similarity), "removed")
    rows = _maybe(docs.select(F.struct("*").alias("row"), *keys, text.alias("text")), gone, F.col("th"), "hit")
    # texts without a removed line need not be shuffled
    changed = rows.where("hit").join(gone, ["did", "th"], "left")
    same = rows.where(~F.col("hit")).withColumn("gone", F.lit(None).cast(gone.schema["gone"].dataType))
    rows = changed.unionByName(same)
    rows = rows.withColumn("_lines", F.when(F.col("gone").isNotNull(), lines_of(F.col("text"))))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNotNull(), F.array_join(F.transform(left, lambda i: F.get(F.col("_lines"), i)), "\n")
                  ).otherwise(F.col("text"))
    n = F.coalesce(F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"))) + 1, F.lit(0))
    return rows.select("row", kept.alias("text"), n.cast("long").alias("n_lines"),
                       F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))
