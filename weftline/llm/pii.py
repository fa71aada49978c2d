"""Personal data: base patterns, and more of it by bootstrapping from their contexts.

The base entities are seeds, and so are long mixed strings of letters and digits, as keys and
passwords are. The words next to them, in front or behind, are lexical patterns; patterns and the
instances found at them (any token with a digit or an at sign) form a bipartite graph that is
scored in rounds. A pattern is worth the share of seeds, and of likely instances, in all that ever
stands at its word in the corpus; an instance is worth its best pattern. Instances at patterns of
high confidence are new spans, wherever they stand, and seeds of further patterns. A long string
alone is no finding: it becomes one by standing at such a pattern.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.lineage import cut, settle
from weftline.llm.text import BLANKS, let, running, whole

KINDS = ("email", "ip", "card", "phone")
#: The kind of what has no base pattern; its seeds are tokens of this form.
SECRET = len(KINDS)
SECRET_SEED = r"^(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9+/_-]{32,}$"
NAMES = (*KINDS, "secret")
_LOCAL = "A-Za-z0-9._%+-"
#: The base patterns so that each place is tried once: runs are taken whole, and a run is only
#: entered at its start or where the last match ended. They match what the plain ones match.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BREAK = r"\x20\x09-\x0D=:\"'<>,;()\[\]{}|"
#: Tokens with a digit or an at sign in them.
TOKEN = rf"(?<![^{_BREAK}])[^{_BREAK}0-9@]*+[0-9@][^{_BREAK}]*+"
#: What a text needs to hold for a pattern to be worth trying.
_NEEDS = {"email": "@", "phone": "+"}


@dataclass(frozen=True)
class Bootstrap:
    """Scores are in thousandths. A pattern needs ``support`` different seeds and ``confidence``."""

    rounds: int = 3
    support: int = 3
    confidence: int = 600
    least_length: int = 6


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, k: Column) -> Column:
        d = (F.ascii(F.substring(F.reverse(digits), k, F.lit(1))) - 48) * F.when(k % 2 == 0, 2).otherwise(1)
        return (total + d - F.when(d > 9, 9).otherwise(0)).cast("int")

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _passes(kind: str, found: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda p: let(F.regexp_replace(p, "^0+(?=[0-9])", ""), lambda x: (F.length(x) <= 3) & (F.lpad(x, 3, "0") <= "255")))
    if kind == "card":
        return let(_digits(found), lambda d: F.length(d).between(14, 19) & _luhn(d))
    if kind == "phone":
        return F.length(_digits(found)).between(10, 15)
    return F.lit(True)


def _places(text: Column, pattern: str) -> Column:
    """``(start, end, found, before, after)`` of every match, in code points; the last two are up to 64 of what stands between it and its neighbours."""

    def build(pieces: Column) -> Column:
        def placed(found: Column) -> Column:
            lengths = F.transform(found, lambda hit, k: F.length(hit) + F.length(F.get(pieces, k)))

            def one(hit: Column, k: Column, at: Column) -> Column:
                gap = F.get(pieces, k)
                start = F.get(at, k) + F.length(gap)
                near = F.substring(gap, F.greatest(F.length(gap) - 63, F.lit(1)), F.lit(64))
                return F.struct(start.alias("start"), (start + F.length(hit)).alias("end"), hit.alias("found"), near.alias("before"), F.substring(F.get(pieces, k + 1), 1, 64).alias("after"))

            return let(let(lengths, lambda n: running(n, F.lit(0), lambda a, x: a + x)), lambda at: F.transform(found, lambda hit, k: one(hit, k, at)))

        return let(F.regexp_extract_all(text, F.lit(pattern), 0), placed)

    none = F.array().cast("array<struct<start:int,end:int,found:string,before:string,after:string>>")
    return let(F.split(text, pattern), lambda pieces: F.when(F.size(pieces) == 1, none).otherwise(build(pieces)))


def _spans(text: Column, k: int) -> Column:
    """Spans of one kind with what they say and what stands before them."""
    kept = F.filter(_places(text, PATTERNS[KINDS[k]]), lambda p: _passes(KINDS[k], p.found))
    return F.transform(kept, lambda p: F.struct(p.start.alias("start"), F.lit(k).alias("kind"), p.end.alias("end"), p.found.alias("found"), p.before.alias("before"), p.after.alias("after")))


def entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, mark, spans, tokens)``, one row per row: base spans ``(start, kind, end, found, before, after)`` by start, and the other tokens.

    ``mark`` is a hash of the text. Null texts are empty. Matches of one kind don't overlap;
    those of different kinds may, as each kind is searched on its own.
    """
    text = F.col("text")
    named = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    has_digit = F.length(F.translate(text, "0123456789", "")) < F.length(text)
    found = []
    for k, kind in enumerate(KINDS):
        wanted = text.contains(_NEEDS[kind]) if kind in _NEEDS else F.lit(True)
        wanted = wanted if kind == "email" else wanted & has_digit
        found.append(F.when(wanted, _spans(text, k)).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,found:string,before:string,after:string>>")))
    tokens = F.when(has_digit | text.contains("@"), _places(text, TOKEN)).otherwise(F.array().cast("array<struct<start:int,end:int,found:string,before:string,after:string>>"))
    return named.select("id", F.xxhash64("text").alias("mark"), F.array_sort(F.concat(*found)).alias("spans"), tokens.alias("tokens"))


def _plain(text: Column) -> Column:
    """Lower case, blanks for all that parts words."""
    return F.translate(F.lower(text), BLANKS + "=:\"'<>,;()[]{}|", " " * (len(BLANKS) + 16))


def _cues(before: Column, after: Column) -> Column:
    """``(side, cue)`` of the last word in front of a place and the first behind it; none where another token is next to it."""
    left = F.struct(F.lit(0).alias("side"), F.regexp_extract(_plain(before), r"([^ ]+) *$", 1).alias("cue"))
    right = F.struct(F.lit(1).alias("side"), F.regexp_extract(_plain(after), r"^ +([^ ]+) ", 1).alias("cue"))
    return F.array(left, right)


def _apart(tokens: Column, spans: Column) -> Column:
    """The tokens that meet no span, by halving: spans are sorted by start, and of those that start before a token ends, the furthest end tells."""

    def free(x: Column) -> Column:
        def meets(t: Column) -> Column:
            end = t.start + F.length(t.found)
            half = lambda s: F.floor((s.low + s.high) / 2).cast("int")
            step = lambda s, _: F.when(s.low < s.high, F.when(F.get(spans, half(s)).start < end, F.struct((half(s) + 1).alias("low"), s.high.alias("high"))).otherwise(F.struct(s.low.alias("low"), half(s).alias("high")))).otherwise(s)
            before = F.aggregate(x.halvings, F.struct(F.lit(0).alias("low"), F.size(spans).alias("high")), step, lambda s: s.low)
            # what lies before the first k spans is at k
            return F.get(x.ends, before) > t.start

        return F.filter(tokens, lambda t: ~meets(t))

    # one more element, so that there is an end before every place
    ends = running(F.concat(F.transform(spans, lambda s: s.end), F.array(F.lit(0))), F.lit(0), lambda a, e: F.greatest(a, e))
    return let(F.struct(ends.alias("ends"), F.sequence(F.lit(0), F.length(F.bin(F.size(spans).cast("long")))).alias("halvings")), free)


#: Spans of a text up to which each token is held against each span.
MANY_SPANS = 32


def mentions(found: DataFrame, rules: Bootstrap | None = None) -> DataFrame:
    """``(id, mark, cues, instance, kind, based, start, end)``: base spans are ``based``; other tokens have a kind if they are seeds, else null."""
    rules = rules or Bootstrap()
    fields = lambda x, kind, based, end: F.struct(_cues(x.before, x.after).alias("cues"), x.found.alias("instance"), kind.alias("kind"), F.lit(based).alias("based"), x.start.alias("start"), end.alias("end"))
    seeds = F.transform("spans", lambda s: fields(s, s.kind, True, s.end))
    trimmed = F.transform("tokens", lambda t: F.struct(t.start.alias("start"), t.before.alias("before"), t.after.alias("after"), F.regexp_replace(t.found, r"[^A-Za-z0-9]+$", "").alias("found")))
    long = F.filter(trimmed, lambda t: F.length(t.found) >= rules.least_length)
    free = F.filter(long, lambda t: ~F.exists("spans", lambda s: (s.start < t.start + F.length(t.found)) & (t.start < s.end)))
    free = F.when(F.size("spans") <= MANY_SPANS, free).otherwise(_apart(long, F.col("spans")))
    others = F.transform(free, lambda t: fields(t, F.when(t.found.rlike(SECRET_SEED), F.lit(SECRET)), False, t.start + F.length(t.found)))
    return found.select("id", "mark", F.explode(F.concat(seeds, others)).alias("m")).select("id", "mark", "m.*")


def confident(mentioned: DataFrame, docs: DataFrame, text_col: str = "text", rules: Bootstrap | None = None) -> DataFrame:
    """``(instance, kind)`` of the new instances: those at patterns of high confidence.

    All rounds are joins and sums over distinct (side, word, instance, kind) with their number of
    mentions. A pattern's confidence is the share of its word's occurrences in the whole corpus
    that have an instance at that side, so copies raise both sides alike. Instances above the
    threshold are seeds of new patterns in the next round.
    """
    rules = rules or Bootstrap()
    each = mentioned.select("instance", "kind", "based", F.explode("cues").alias("c")).select("c.*", "instance", "kind", "based").where("cue <> ''")
    pairs = cut(each.groupBy("side", "cue", "instance", "kind", "based").agg(F.count("*").alias("times")))
    able = pairs.groupBy("side", "cue").agg(F.countDistinct("instance").alias("n")).where(F.col("n") >= rules.support).select("cue").distinct()
    often = cut(docs.select(F.explode(F.split(_plain(whole(text_col)), " ")).alias("cue")).where("cue <> ''").groupBy("cue").agg(F.count("*").alias("often")).join(able, "cue", "left_semi"))
    base = pairs.where("kind is not null").select("side", "cue", "kind", F.lit(1).alias("seeds"), (1000 * F.col("times")).alias("s"))
    around = cut(pairs.where("not based").select("side", "cue", "instance", "times", F.col("kind").alias("seed")).join(often.select("cue"), "cue", "left_semi"))
    known, likely = base, None
    for _ in range(rules.rounds):
        if likely is not None:
            sure = likely.groupBy("instance").agg(F.max(F.struct("worth", (-F.col("kind")).alias("kind"))).alias("b")).where(F.col("b.worth") >= rules.confidence).select("instance", (-F.col("b.kind")).alias("kind"), F.lit(1).alias("seeds"))
            # what is a seed of this kind counts already
            more = around.join(likely.join(sure, ["instance", "kind"], "left"), "instance").where(~F.col("seed").eqNullSafe(F.col("kind")))
            known = base.unionByName(more.select("side", "cue", "kind", F.coalesce("seeds", F.lit(0)).alias("seeds"), (F.col("worth") * F.col("times")).alias("s")))
        score = known.groupBy("side", "cue", "kind").agg(F.sum("seeds").alias("seeds"), F.sum("s").alias("s")).where(F.col("seeds") >= rules.support).join(often, "cue")
        score = score.select("side", "cue", "kind", F.expr("least(1000, s div greatest(often, 1))").alias("confidence"))
        likely = cut(around.join(score.where(F.col("confidence") > 0), ["side", "cue"]).groupBy("instance", "kind").agg(F.max("confidence").alias("worth")))
    best = likely.groupBy("instance").agg(F.max(F.struct("worth", (-F.col("kind")).alias("kind"))).alias("b"))
    return best.where(F.col("b.worth") >= rules.confidence).select("instance", (-F.col("b.kind")).alias("kind"))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Bootstrap | None = None) -> DataFrame:
    """``(id, base, spans)``, one row per row of ``docs``: arrays of ``(start, kind, end)`` by start, kind, end.

    ``base`` has what the base patterns find, ``spans`` has that and what the method adds; a
    new span has the kind of its pattern (:data:`SECRET` after the others) and overlaps no base span. Null and empty texts have
    none. Rows that repeat id and text get the same spans; an empty table gives an empty result.
    """
    rules = rules or Bootstrap()
    found = settle(entities(docs, id_col, text_col), "entities")
    mentioned = mentions(found, rules)
    new = confident(mentioned, docs, text_col, rules)
    free = mentioned.where("not based").select("id", "mark", "instance", "start", "end").join(new, "instance")
    added = free.groupBy("id", "mark").agg(F.collect_set(F.struct("start", "kind", "end")).alias("more"))
    base = F.transform("spans", lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.end.alias("end")))
    both = found.select(F.col("id").alias("found_id"), F.col("mark").alias("found_mark"), base.alias("base")).join(
        added, F.col("found_id").eqNullSafe(F.col("id")) & (F.col("found_mark") == F.col("mark")), "left"
    )
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return both.select(F.col("found_id").alias("id"), "base", F.array_sort(F.concat("base", F.coalesce("more", none))).alias("spans"))


def spelled(spans: str) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    names = F.array(*map(F.lit, NAMES))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")
