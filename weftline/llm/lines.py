"""Near-duplicate lines by an exact set-similarity join.

A line is its set of words. Words are ordered by rarity, so a line can only be similar to one that
shares a word of its prefix; length, position of the shared word and parities of both sets rule out
most of what is left, and the rest is verified. A line goes if an earlier one is similar.

Equal lines are one class throughout: words are cut and ordered once, and each class is written
once, with its prefix only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.lineage import cut, settle
from weftline.llm.text import BLANKS, let, unused, whole

#: Similarity of 0.8 as a fraction.
SIMILARITY = (4, 5)
#: Words are counted in 2^22 cells; a cell is one byte of a table of 4 MB, however many words there are.
#: It is put together from 64 rows: Spark sorts what it collects once a task has 128 groups.
_CELL_BITS, _ROW_BITS = 22, 16
#: Bits of what is said of a cell.
_LEVEL_BITS = 6
_HASH_BITS = 56
#: Doublings from which the lines that share a word are first held against the earliest of them. A word below occurs under 1,024 times.
_OFTEN = 11


def _cell(h: Column) -> Column:
    return h.bitwiseAND((1 << _CELL_BITS) - 1).cast("int")


def _tokens(line: Column) -> Column:
    """Words of a line, which has no line feed, with empty ones between them; cheaper than a pattern or a character map.

    Few lines have other blanks than spaces, and to look for these takes less than to replace them.
    """
    others = BLANKS.replace(" ", "").replace("\n", "")
    odd, spaced = F.lit(False), line
    for blank in others:
        odd, spaced = odd | F.contains(line, F.lit(blank)), F.replace(spaced, F.lit(blank), F.lit(" "))
    return F.split(F.when(odd, spaced).otherwise(line), " ")


def _dense(parts: Column, at, width: int, size: int) -> Column:
    """Text of ``size`` places of ``width``: the pieces ``(place, text)`` that ``at`` reads from the elements of ``parts``, which are in order, and blanks between them."""
    blank = lambda n: F.repeat(F.lit(" "), n * width)

    def fill(a: Column) -> Column:
        after = lambda e: F.coalesce(at(e)[0] + 1, F.lit(0))
        filled = F.transform(a, lambda e, k: F.concat(blank(at(e)[0] - after(F.get(a, k - 1))), at(e)[1]))
        return F.concat(F.array_join(filled, ""), blank(size - after(F.try_element_at(a, F.lit(-1)))))

    return let(F.sort_array(parts), fill)


def _tally(hashes: DataFrame) -> DataFrame:
    """One row: a table with a byte for each cell, 32 plus the doublings in how many of ``hashes (h)`` fall into it."""
    counted = hashes.groupBy(_cell(F.col("h")).alias("cell")).agg(F.count("*").alias("n"))
    # place and level in one number, which is collected and sorted faster than a pair
    place = F.call_function("shiftleft", F.col("cell").bitwiseAND((1 << _ROW_BITS) - 1), F.lit(_LEVEL_BITS))
    cells = counted.select(F.call_function("shiftright", "cell", F.lit(_ROW_BITS)).alias("row"), place.bitwiseOR(F.least(F.length(F.bin("n")), F.lit(60))).alias("c"))
    of_cell = lambda c: (F.call_function("shiftright", c, F.lit(_LEVEL_BITS)), F.char(F.lit(32) + c.bitwiseAND((1 << _LEVEL_BITS) - 1)))
    rows = cells.groupBy("row").agg(_dense(F.collect_list("c"), of_cell, 1, 1 << _ROW_BITS).alias("s"))
    whole_table = rows.agg(_dense(F.collect_list(F.struct("row", "s")), lambda r: (r.row, r.s), 1 << _ROW_BITS, 1 << (_CELL_BITS - _ROW_BITS)).alias("s"))
    return cut(whole_table.select(F.encode("s", "UTF-8").alias("table")))


def _levels(hashes: DataFrame) -> DataFrame:
    """One row: the table of :func:`_tally` as an array of small numbers, which is read faster and takes the same 4 MB or so."""
    # a row hands out a copy of its bytes each time it is asked, a variable does not; no element is null, so a look-up need not ask
    level = lambda t: F.transform(F.sequence(F.lit(0), F.lit((1 << _CELL_BITS) - 1)), lambda i: F.coalesce((F.ascii(F.substring(t, i + 1, F.lit(1)).cast("string")) - 32).cast("byte"), F.lit(0).cast("byte")))
    return cut(_tally(hashes).select(let(F.col("table"), level).alias("table")))


def _level(table: Column, h: Column) -> Column:
    """What a table says of a hash: 0 for a cell that nothing falls into, 1 for one thing, then doublings."""
    return F.ascii(F.substring(table, _cell(h) + 1, F.lit(1)).cast("string")) - 32


def _hashed_set(line: Column) -> Column:
    """The set of words of a line as 64-bit hashes, in order of place."""
    return F.array_distinct(F.array_remove(F.transform(_tokens(line), lambda t: F.xxhash64(t)), F.xxhash64(F.lit(""))))


def _rarest_first(hashes: Column, levels: Column) -> Column:
    """Hashed words in order of doublings of their count, then of the hash."""
    mask = (1 << _HASH_BITS) - 1
    # never null, so that the numbers are sorted as such
    level = lambda h: F.coalesce(levels[h.bitwiseAND((1 << _CELL_BITS) - 1)], F.lit(0).cast("byte"))
    ranked = lambda h: F.call_function("shiftleft", level(h).cast("long"), F.lit(_HASH_BITS)).bitwiseOR(h.bitwiseAND(mask))
    return F.sort_array(F.transform(hashes, ranked))


def _parities(words: Column, half: int) -> Column:
    """64 of the 128 parities of a set of hashed words: two sets differ in at least as many words as their parities in bits."""
    # a fold is evaluated step by step, so its one step is to look up the bit
    bits_of = [1 << k if k < 63 else -(1 << 63) for k in range(64)]
    bit = F.array(*(F.lit(b).cast("long") for b in ([*bits_of, *[0] * 64] if half == 0 else [*[0] * 64, *bits_of])))
    return F.aggregate(words, F.lit(0).cast("long"), lambda bits, w: bits.bitwiseXOR(bit[w.bitwiseAND(127)]))


def _packed(n: Column, at: Column, settled: Column) -> Column:
    """Size of a line, place of a word in it and whether the line is settled, in one number."""
    left = lambda x, by: F.call_function("shiftleft", x.cast("long"), F.lit(by))
    return left(n, 32).bitwiseOR(left(at, 1)).bitwiseOR(settled.cast("long"))


def _may_match(x: Column, y: Column, bits: list[tuple[Column, Column]], similarity: tuple[int, int]) -> Column:
    """Length, position and parity filters on two packed places of a shared word; ``bits`` are parities of both sets."""
    p, q = similarity
    size = lambda c: F.call_function("shiftright", c, F.lit(32))
    at = lambda c: F.call_function("shiftright", c, F.lit(1)).bitwiseAND((1 << 31) - 1)
    n_x, n_y = size(x), size(y)
    in_length = (q * n_y >= p * n_x) & (q * n_x >= p * n_y)
    in_place = (p + q) * F.least(n_x - at(x), n_y - at(y)) >= p * (n_x + n_y)
    differ = sum(F.bit_count(a.bitwiseXOR(b)) for a, b in bits)
    return in_length & in_place & ((p + q) * differ <= (q - p) * (n_x + n_y))


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: tuple[int, int] = SIMILARITY, least_words: int = 5) -> DataFrame:
    """``(id, n_lines, removed)``, one row per distinct id: how many lines its texts have and the sorted numbers of those that go.

    Lines are cut at line feeds and numbered from 0; they are ordered by id, then number. A
    line goes if its words, as a set, have a Jaccard similarity of at least ``similarity`` (a
    fraction) with those of an earlier line, whether or not that one goes as well. Lines with
    under ``least_words`` words stay. A null or empty text has one empty line; texts are taken
    whole, however long. Rows that repeat an id are one document: a line number goes if it goes
    in any of them; a null id is an id of its own and comes first. Other columns are not read.
    An empty table gives an empty result.

    Equal lines are one class, named by a 64-bit hash of the text; a line whose hash meets
    that of another text stays. A hot line is added up by its hash before anything meets.
    """
    texts = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    lines = texts.select("id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    keyed = lines.where("line <> ''").select(F.xxhash64("line").alias("k"), "id", "line_no", "line")
    classes = _classes(texts, keyed, similarity, least_words)
    similar = _similar(classes, keyed, similarity)
    verdict = classes.select("k", "check", "copies", F.struct("id", "line_no").alias("first")).join(similar.withColumn("similar", F.lit(True)), "k", "left").where((F.col("copies") > 1) | F.col("similar"))
    judged = keyed.select("k", "id", "line_no", F.xxhash64(F.lit(1), "line").alias("check")).join(verdict, ["k", "check"])
    later = ~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("line_no") == F.col("first.line_no")))
    gone = judged.where(F.coalesce("similar", F.lit(False)) | later).select("id", "line_no")
    counted = texts.groupBy("id").agg(F.max(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"))
    by_doc = gone.groupBy("id").agg(F.sort_array(F.collect_set("line_no")).alias("removed")).withColumnRenamed("id", "gone_id")
    none = F.array().cast("array<int>")
    return counted.join(by_doc, F.col("id").eqNullSafe(F.col("gone_id")), "left").select("id", "n_lines", F.coalesce("removed", none).alias("removed"))


def _classes(texts: DataFrame, keyed: DataFrame, similarity: tuple[int, int], least_words: int) -> DataFrame:
    """One row per class of equal lines with enough words, written once.

    ``k`` and ``check`` are hashes of the text, ``copies`` its number, ``id`` and ``line_no`` its
    earliest place, ``n`` the size of its set of words, ``bits0`` and ``bits1`` its parities and ``prefix`` those
    words of its prefix that occur twice or more; ``skipped`` ones that do not came before.
    """
    p, q = similarity
    words = keyed.select(F.explode(_tokens(F.col("line"))).alias("t")).where("t <> ''").select(F.xxhash64("t").alias("h"))
    # a subquery may not be written inside a function over arrays, so the table is named in a column first; it
    # is used once, for the two projections to become one and the column to vanish. The set of words is used twice,
    # so it stays a projection of its own, of compiled code: what stands inside a function over arrays is interpreted
    enough = F.ltrim("line", F.lit(BLANKS)) != ""
    if least_words > 1:
        enough = enough & (F.size(F.filter(_tokens(F.col("line")), lambda t: t != "")) >= least_words)
    sets = keyed.where(enough).select("k", "id", "line_no", F.xxhash64(F.lit(1), "line").alias("check"), _hashed_set(F.col("line")).alias("s"))
    sets = sets.withColumn("n", F.size("s")).withColumn("table", _levels(words).scalar())
    ordered = sets.select("k", "id", "line_no", "check", "n", _rarest_first(F.col("s"), F.col("table")).alias("o"))
    reach = F.col("n") - F.ceil(F.col("n") * p / q).cast("int") + 1
    # a word that occurs once leads to no other line; these come first in a line
    shared = F.filter(F.slice("o", F.lit(1), reach), lambda w: F.call_function("shiftright", w, F.lit(_HASH_BITS)) > 1)
    cut_off = ordered.select("k", "id", "line_no", "check", "n", *(_parities(F.col("o"), half).alias(f"bits{half}") for half in (0, 1)), reach.alias("reach"), shared.alias("prefix"))
    row = F.struct("id", "line_no", "check", "n", "bits0", "bits1", (F.col("reach") - F.size("prefix")).alias("skipped"), "prefix")
    return settle(cut_off.groupBy("k").agg(F.min(row).alias("f"), F.count("*").alias("copies")).select("k", "copies", "f.*"), "line-classes")


def _similar(classes: DataFrame, keyed: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """``(k)`` of the classes that are similar to an earlier one.

    For a word that occurs often, the earliest line that has it in its prefix is tried first:
    where many lines are alike this settles almost all, so that a group costs about its size.
    What it does not settle meets all that share a word of its prefix.
    """
    p, q = similarity

    def later_of(pairs: DataFrame) -> DataFrame:
        """Keys of the later line of each of the pairs ``(x, y)`` that are similar.

        Only texts whose hash falls into a cell of the pairs' hashes are moved to meet them.
        """
        pairs = cut(pairs.distinct())
        listed = _tally(pairs.select(F.explode(F.array("x", "y")).alias("h")).distinct()).scalar()
        near = keyed.where(_level(listed, F.col("k")) > 0).groupBy("k").agg(F.min(F.struct("id", "line_no", "line")).alias("f"))
        sets = near.select("k", F.struct("f.id", "f.line_no").alias("place"), _hashed_set(F.col("f.line")).alias("s"))
        x, y = (sets.select(F.col("k").alias(c), F.col("place").alias(f"at_{c}"), F.col("s").alias(f"s_{c}")) for c in "xy")
        both = pairs.join(x, "x").join(y, "y")
        alike = both.where((p + q) * F.size(F.array_intersect("s_x", "s_y")) >= p * (F.size("s_x") + F.size("s_y")))
        return alike.select(F.when(F.col("at_x") > F.col("at_y"), F.col("x")).otherwise(F.col("y")).alias("k")).distinct()

    def places(of: DataFrame, words: Column, settled: Column) -> DataFrame:
        spread = of.select("*", settled.alias("settled"), F.posexplode(words).alias("i", "token"))
        return spread.withColumn("p", _packed(F.col("n"), F.col("skipped") + F.col("i"), F.col("settled")))

    occurs_often = lambda w: F.call_function("shiftright", w, F.lit(_HASH_BITS)) >= _OFTEN
    often = F.filter("prefix", occurs_often)
    # the last word of a prefix is its most frequent one
    among = places(classes.where(occurs_often(F.try_element_at("prefix", F.lit(-1)))).withColumn("skipped", F.col("skipped") + F.size("prefix") - F.size(often)), often, F.lit(False))
    heads = among.groupBy("token").agg(F.min(F.struct("id", "line_no", "k", "p", "bits0", "bits1")).alias("head"), F.count("*").alias("together")).where("together > 1")
    with_head = among.select("token", "k", "p", "bits0", "bits1").join(heads, "token").where((F.col("k") != F.col("head.k")) & _may_match(F.col("p"), F.col("head.p"), [(F.col(b), F.col(f"head.{b}")) for b in ("bits0", "bits1")], similarity))
    # written with a size that Spark knows, so that few of them don't make all classes move
    settled = settle(later_of(with_head.select(F.col("k").alias("x"), F.col("head.k").alias("y"))), "settled-lines")

    marked = classes.select("k", "n", "skipped", "bits0", "bits1", "prefix").join(settled.withColumn("gone", F.lit(True)), "k", "left")
    every = places(marked, F.col("prefix"), F.coalesce("gone", F.lit(False))).select("token", "k", "p", "bits0", "bits1")
    x, y = (every.select("token", F.col("k").alias(c), F.col("p").alias(f"p_{c}"), F.col("bits0").alias(f"bits0_{c}"), F.col("bits1").alias(f"bits1_{c}")) for c in "xy")
    # a settled line has nothing more to find, but others may be similar to it; of two that are not, one looks for the
    # other. That is asked of both at once, so that both sides of the join stay one exchange
    done_x, done_y = F.col("p_x").bitwiseAND(1), F.col("p_y").bitwiseAND(1)
    looks = (done_x < done_y) | ((done_x + done_y == 0) & (F.col("x") < F.col("y")))
    rest = x.join(y, "token").where(looks & _may_match(F.col("p_x"), F.col("p_y"), [(F.col(f"{b}_x"), F.col(f"{b}_y")) for b in ("bits0", "bits1")], similarity))
    return settled.unionByName(later_of(rest.select("x", "y"))).distinct()


def without_lines(docs: DataFrame, removed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines that :func:`removed_lines` names; other columns and their order stay.

    A null text stays null unless a line of it goes. Columns may have any names.
    """
    named, lost = unused(docs, "id", "removed")
    gone = removed.where(F.size("removed") > 0).select(F.col("id").alias(named), F.col("removed").alias(lost))

    def left(parts: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(lost))
        return F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n")

    text = F.when(F.col(lost).isNull(), F.col(text_col)).otherwise(let(F.split(whole(text_col), "\n"), left))
    joined = docs.join(gone, F.col(id_col).eqNullSafe(F.col(named)), "left")
    return joined.select(*(text.alias(c) if c == text_col else F.col(c) for c in docs.columns))
