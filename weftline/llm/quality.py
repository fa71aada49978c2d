"""Quality rules with thresholds that follow each language and source.

Every document gets integer measures. Their distribution over each (language, source) is kept as a
mergeable quantile sketch: counts in log-linear bins, 64 to a doubling, so that a quantile is exact
below 128 and off by at most a 64th above. Sketches of small groups are too thin to judge by; those
groups use the merged sketch of their language, or of everything. A document is rejected if a
measure lies several times as far from the median of its group as the middle three fifths of the
group are wide. What is usual in a source is so taken from the source: where two in five documents
have many symbols, many symbols are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftline.functions.lineage import cut, settle
from weftline.llm.text import BLANKS, let, whole, words

#: Fixed value: characters that count as symbols.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    """Fixed rules of the base, and how far from its group's median a measure may lie: ``spread``
    times the width of its middle three fifths. ``slack`` is a floor for groups in which a measure
    hardly varies, as one that is zero in most documents."""

    least_words: int = 50
    most_repeated_percent: int = 50
    least_group: int = 200
    #: groups whose bounds may be broadcast; more of them are joined by a shuffle
    most_broadcast: int = 50_000
    spread: int = 6
    #: measure: (slack, whether it may also be too low)
    slack: tuple[tuple[str, int, bool], ...] = (
        ("word_length", 50, True),
        ("symbol_rate", 100, False),
        ("dup_line_rate", 350, False),
        ("repeat_rate", 350, False),
    )


def _repeated_words(w: Column) -> Column:
    """Words that lie in a three-word window which occurs twice or more in the array ``w``.

    Windows are hashed, the place packed into the low bits, and sorted: equal windows are
    neighbours then, and are compared word by word.
    """

    def same(i: Column, j: Column) -> Column:
        return (F.get(w, i) == F.get(w, j)) & (F.get(w, i + 1) == F.get(w, j + 1)) & (F.get(w, i + 2) == F.get(w, j + 2))

    def counted(hashes: Column) -> Column:
        n = F.size(hashes)
        low = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n.cast("long")))) - 1

        def among(packed: Column, low: Column) -> Column:
            def twin(x: Column, other: Column) -> Column:
                place = lambda v: v.bitwiseAND(low).cast("int")
                return F.coalesce(x.bitwiseXOR(other).bitwiseAND(F.bitwise_not(low)) == 0, F.lit(False)) & same(place(x), place(other))

            hit = F.filter(packed, lambda x, k: twin(x, F.get(packed, k - 1)) | twin(x, F.get(packed, k + 1)))
            places = F.sort_array(F.transform(hit, lambda x: x.bitwiseAND(low)))
            start = F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("total"))
            return F.aggregate(
                places, start,
                lambda s, p: F.struct(p.alias("last"), (s.total + F.least(F.lit(3).cast("long"), p - s.last)).alias("total")),
                lambda s: s.total,
            )

        packed = lambda low: F.sort_array(F.transform(hashes, lambda h, k: h.bitwiseAND(F.bitwise_not(low)).bitwiseOR(k.cast("long"))))
        slow = let(low, lambda bits: let(packed(bits), lambda p: among(p, bits)))
        return F.when(F.size(F.array_distinct(hashes)) == n, F.lit(0).cast("long")).otherwise(slow)

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(let(windows, counted))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", rules: Rules | None = None, with_rows: bool = False) -> DataFrame:
    """``(id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed)``, one row per row.

    A null text counts as empty. ``n_lines`` counts lines that hold a word. ``with_rows`` adds
    the whole row as a struct ``row``.
    """
    row = [F.struct(*(F.col(c) for c in docs.columns)).alias("row")] if with_rows else []
    carried = ["row"] if with_rows else []
    rules = rules or Rules()
    text = whole(text_col)
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    counted = (
        docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), text.alias("text"), *row)
        .select(
            "id", "lang", "source", *carried,
            let(words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeated_words(w).alias("r"))).alias("w"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"))).alias("l"),
            F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
            (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        )
    )
    return counted.select(
        "id", "lang", "source", *carried, F.col("w.n").alias("n_words"), "word_chars", "n_symbols",
        F.col("l.d").alias("n_dup_lines"), F.col("w.r").alias("n_repeat_words"), F.col("l.n").alias("n_lines"),
        ((F.col("w.n") < rules.least_words) | (100 * F.col("w.r") > rules.most_repeated_percent * F.col("w.n"))).alias("base_failed"),
    )


def _rates() -> dict[str, Column]:
    """Whole-number measures that are compared within a group."""
    n, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    over = lambda a, b: F.floor(F.col(a) * (100 if a == "word_chars" else 1000) / b)
    return {"word_length": over("word_chars", n), "symbol_rate": over("n_symbols", n), "dup_line_rate": over("n_dup_lines", lines), "repeat_rate": over("n_repeat_words", n)}


def _bin(v: Column) -> Column:
    shift = F.greatest(F.length(F.bin(v)) - 7, F.lit(0))
    return (64 * shift + F.call_function("shiftright", v, shift)).cast("int")


def _least_of_bin(b: Column) -> Column:
    shift = F.greatest(F.floor(b / 64) - 1, F.lit(0)).cast("int")
    return F.call_function("shiftleft", (b - 64 * shift).cast("long"), shift)


def sketches(measured: DataFrame, rules: Rules | None = None) -> DataFrame:
    """``(level, lang, source, measure, bin, n)``: the sketches of all groups, languages and of everything.

    Counts are added up before the shuffle, so a source that holds most rows costs no more
    than another. The number of rows depends on groups and bins only.
    """
    rates = _rates()
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), _bin(v).alias("bin")) for k, v in rates.items())))
    one = measured.where(~F.col("base_failed")).select("lang", "source", each.alias("m")).groupBy("lang", "source", "m.measure", "m.bin").agg(F.count("*").alias("n"))
    one = cut(one)
    nothing = F.lit(None).cast("string")
    merged = lambda level, *by: one.groupBy(*by, "measure", "bin").agg(F.sum("n").alias("n")).select(
        F.lit(level).alias("level"), *(F.col(c) if c in by else nothing.alias(c) for c in ("lang", "source")), "measure", "bin", "n")
    return one.select(F.lit(0).alias("level"), "lang", "source", "measure", "bin", "n").unionByName(merged(1, "lang")).unionByName(merged(2))


def thresholds(sketched: DataFrame, rules: Rules | None = None) -> DataFrame:
    """``(level, lang, source, n, low, high)`` with a map from measure to bound; unions of sketches can be given as well."""
    rules = rules or Rules()
    key = ["level", "lang", "source", "measure"]
    merged = sketched.groupBy(*key, "bin").agg(F.sum("n").alias("n"))
    run = merged.select(*key, "bin", F.sum("n").over(W.partitionBy(*key).orderBy("bin")).alias("upto"), F.sum("n").over(W.partitionBy(*key)).alias("all"))
    at = lambda percent: _least_of_bin(F.min(F.when(100 * F.col("upto") >= percent * F.col("all"), F.col("bin"))))
    middle = run.groupBy(*key).agg(F.max("all").alias("n"), at(20).alias("low"), at(50).alias("median"), at(80).alias("high"))
    slack = F.create_map(*(x for name, s, _ in rules.slack for x in (F.lit(name), F.lit(s).cast("long"))))
    reach = F.greatest(rules.spread * (F.col("high") - F.col("low")), F.element_at(slack, F.col("measure")))
    return middle.groupBy("level", "lang", "source").agg(
        F.max("n").alias("n"),
        F.map_from_entries(F.collect_list(F.struct("measure", (F.col("median") - reach).alias("v")))).alias("low"),
        F.map_from_entries(F.collect_list(F.struct("measure", (F.col("median") + reach).alias("v")))).alias("high"),
    )


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", rules: Rules | None = None, with_rows: bool = False) -> DataFrame:
    """:func:`measures` of every row with ``kept``; with the whole row as ``row`` if asked for.

    ``kept`` is false if the base rules fail, else true unless a measure lies outside the bounds
    of the row's language and source (of its language, then of all, for groups with under
    ``least_group`` rows that pass the base). Null languages and sources are groups of their own.
    An empty table gives an empty result; very long texts are measured whole; repeated rows are
    judged alike. Measures are written once for the second use of them, with whole rows along
    with these. Bounds are broadcast while there are few groups, so that no text is moved.
    """
    rules = rules or Rules()
    measured = measures(docs, id_col, text_col, lang_col, source_col, rules, with_rows)
    measured = settle(measured, "measures") if with_rows else cut(measured)
    bounds = cut(thresholds(sketches(measured, rules), rules))
    level = lambda k: bounds.where(F.col("level") == k)
    group = level(0).select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), *(F.col(c).alias(f"g_{c}") for c in ("n", "low", "high")))
    lang = level(1).select(F.col("lang").alias("l_lang"), *(F.col(c).alias(f"l_{c}") for c in ("n", "low", "high")))
    every = level(2).select(F.col("low").alias("e_low"), F.col("high").alias("e_high"))
    chosen = lambda side: F.when(F.col("g_n") >= rules.least_group, F.col(f"g_{side}")).when(F.col("l_n") >= rules.least_group, F.col(f"l_{side}")).otherwise(F.col(f"e_{side}"))
    by_group = group.join(lang, F.col("g_lang").eqNullSafe(F.col("l_lang")), "left").join(F.broadcast(every), F.lit(True), "left").select("g_lang", "g_source", chosen("low").alias("low"), chosen("high").alias("high"))
    by_group = F.broadcast(by_group) if level(0).count() <= rules.most_broadcast else by_group
    rates = _rates()
    outside = F.lit(False)
    for name, _, both in rules.slack:
        outside = outside | (rates[name] > F.element_at("high", F.lit(name)))
        if both:
            outside = outside | (rates[name] < F.element_at("low", F.lit(name)))
    judged = measured.join(by_group, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    return judged.select(*measured.columns, (~F.col("base_failed") & ~F.coalesce(outside, F.lit(False))).alias("kept"))
