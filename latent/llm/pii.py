"""Personal data by candidate gradient boosting, in DataFrame functions only.

Generators propose spans of four kinds: the strict pattern of each kind and looser ones, whose
spans may overlap. A split by a pattern gives the text between its matches, so lengths alone
give every match its place and the text is read once. A candidate is described by its format
and by what stands around it, in small integers. Candidates of equal description are counted
together, and boosted trees of two levels are fitted on these counts over the whole corpus: a
level is one aggregation by node, feature and value, whose histogram has a fixed bound.

Labels come from the strict rules: a candidate whose own text passes its kind's check (digit
counts, octets, Luhn) is positive, any other one negative. The checks themselves are no
features, so a score says how much a span looks like those that pass. Thresholds are
calibrated per kind on documents that no tree saw (crc32 of the id modulo 5 is 0): the lowest
score from which on the share of positives stays above ``precision``. Strict spans are always
kept; a candidate is added if its score reaches the threshold, no strict span of its kind
overlaps it, and it is the best of the candidates that overlap each other.

Nulls and ties: a null text counts as empty and has no spans; a null ``doc_id`` stays null and
belongs to the fitted part; repeated rows give repeated results; equal scores fall to the longer
span, then to the earlier one; an empty table, or one without candidates, adds nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latent.llm.common import fold_of
from latent.session import Workspace

# The kinds in their order, the patterns and bounds of the strict rules.
KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
STRICT = {
    # A match can only start where the one before ended or where a run of its first class does,
    # and nothing after a run lets it be shorter; so runs are possessive and the time linear.
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = (
    ("email", rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++(?:@|\x20?[\[(](?:at|AT)[\])]\x20?)[A-Za-z0-9-]++"
              r"(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z0-9-]++)*+"),
    ("ip", r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:(?:\.|\[\.\])[0-9]{1,3}){3}(?![0-9A-Za-z])"),
    ("card", r"(?<![0-9A-Za-z])[0-9]{12,19}(?![0-9A-Za-z])"),
    ("card", r"(?<![0-9A-Za-z])[0-9]{4}(?:[\x20.-][0-9]{4}){2}[\x20.-][0-9]{1,7}(?![0-9A-Za-z])"),
    ("phone", r"(?<![0-9A-Za-z])(?:\+?[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?"
              r"[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])"),
)
# Words before a span that speak for a kind, or for something else.
CUES = ("mail|email|contact|write", "ip|host|server|address|login", "card|visa|account|payment",
        "phone|tel|call|fax|mobile", "token|key|secret|hash|sha|id", "version|v|chapter|page|no")
MARK = {"email": "@", "phone": "+"}

GENERATORS = [(k, STRICT[k], True) for k in KINDS] + [(k, p, False) for k, p in LOOSE]
SEEN = "gen int, pos int, step long, span string, before string, after string"


def _matches(text: Column, gen: int) -> Column:
    """Array of a generator's matches: what each adds to the place, its text and surroundings."""
    kind, pattern, _ = GENERATORS[gen]
    sign = MARK.get(kind) if GENERATORS[gen][2] else None
    held = F.contains(text, F.lit(sign)) if sign else text.rlike("[0-9]") if kind != "email" else F.lit(True)
    safe = F.when(held, text).otherwise(F.lit(""))
    return F.struct(F.regexp_extract_all(safe, F.lit(pattern), F.lit(0)).alias("m"),
                    F.split(safe, pattern, -1).alias("g"))


def _seen(both: Column, gen: int) -> Column:
    m, g = both["m"], both["g"]

    def one(span: Column, i: Column) -> Column:
        before, after = g[i], g[i + 1]
        earlier = F.when(i > 0, F.length(m[i - 1])).otherwise(0)
        return F.struct(
            F.lit(gen).alias("gen"), i.alias("pos"),
            (F.length(before) + earlier).cast("long").alias("step"), span.alias("span"),
            F.right(before, F.lit(24)).alias("before"), F.left(after, F.lit(1)).alias("after"))
    return F.transform(m, one)


def proposals(docs: DataFrame) -> DataFrame:
    """(row, doc_id, seen): every row of ``docs`` with what the generators find in its text."""
    texts = docs.select(F.monotonically_increasing_id().alias("row"),
                        F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    names = [f"g{i}" for i in range(len(GENERATORS))]
    found = texts.select("row", "doc_id", *[_matches(F.col("text"), i).alias(n)
                                            for i, n in enumerate(names)])
    return found.select("row", "doc_id", F.concat(
        *[_seen(F.col(n), i) for i, n in enumerate(names)]).alias("seen"))


def _kind_of(gen: Column) -> Column:
    return F.element_at(F.array(*[F.lit(KINDS.index(k)) for k, _, _ in GENERATORS]), gen + 1)


def _digits(span: str) -> str:
    return f"regexp_replace({span}, '[^0-9]', '')"


def _luhn(d: str) -> str:
    """Whether the digits ``d`` pass Luhn's check: every second one from the right is doubled."""
    one = (f"ascii(substring({d}, -(i + 1), 1)) - 48")
    twice = f"(2 * ({one})) div 10 + (2 * ({one})) % 10"
    return (f"aggregate(sequence(0, length({d}) - 1), 0, (a, i) -> a + "
            f"cast(IF(i % 2 = 1, {twice}, {one}) AS INT)) % 10 = 0")


def _octets(span: str) -> str:
    part = "ltrim('0', x)"
    return (f"forall(split({span}, '[.]', -1), x -> length({part}) < 3 OR "
            f"(length({part}) = 3 AND {part} <= '255'))")


def passes(kind: str, span: str, whole: bool) -> Column:
    """Whether a span passes its kind's strict check, pattern included unless ``whole``."""
    shape = F.lit(True) if whole else F.col(span).rlike(
        f"^(?:{STRICT[kind].replace(r'(?:\G|', '(?:^|')})$")
    d = _digits(span)
    check = {
        "email": "true", "ip": _octets(span),
        "card": f"CASE WHEN length({d}) BETWEEN 12 AND 19 THEN {_luhn(d)} ELSE false END",
        "phone": f"length({d}) BETWEEN 9 AND 15"}[kind]
    return F.when(shape, F.expr(check)).otherwise(False)


def located(found: DataFrame) -> DataFrame:
    """A row a match: (row, doc_id, kind, strict, start, end, span, before, after, valid)."""
    each = found.select("row", "doc_id", F.explode("seen").alias("s")).select("row", "doc_id", "s.*")
    place = Window.partitionBy("row", "gen").orderBy("pos")
    spans = (each.withColumn("start", F.sum("step").over(place))
             .withColumn("end", F.col("start") + F.length("span"))
             .withColumn("kind", _kind_of(F.col("gen")))
             .withColumn("strict", F.col("gen") < len(KINDS)))
    valid = F.lit(False)
    for i, kind in enumerate(KINDS):
        valid = F.when(F.col("kind") == i, F.when(F.col("strict"), passes(kind, "span", True))
                       .otherwise(passes(kind, "span", False))).otherwise(valid)
    return (spans.withColumn("valid", valid)
            .select("row", "doc_id", "kind", "strict", "start", "end", "span", "before", "after",
                    "valid"))


def _char_class(c: Column) -> Column:
    return (F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike("[0-9]"), 2)
            .when(c.rlike(r"[\p{L}]"), 3).when(c.rlike("[\"'=:]"), 4).otherwise(5))


def features() -> dict[str, Column]:
    """Format and context of a candidate, each in 0…19."""
    span, before = F.col("span"), F.col("before")

    def count(pattern):
        return F.least(F.length(span) - F.length(F.regexp_replace(span, pattern, "")), F.lit(19))
    word = F.lower(F.regexp_extract(before, r"([A-Za-z]+)[^A-Za-z]{0,4}$", 1))
    cue = F.lit(0)
    for i, words in enumerate(CUES):
        cue = F.when(word.rlike(f"^(?:{words})$"), i + 1).otherwise(cue)
    kinds = F.size(F.array_distinct(F.split(F.regexp_replace(span, "[^0-9]", ""), "")))
    return {
        "kind": F.col("kind"), "digits": count("[0-9]"), "letters": count("[A-Za-z]"),
        "dots": count("[.]"), "gaps": count("[\\x20]"), "dashes": count("-"),
        "signs": count("[^0-9A-Za-z.\\x20-]"), "plus": F.contains(span, F.lit("+")).cast("int"),
        "unlike_digits": F.least(kinds, F.lit(19)), "before": _char_class(F.right(before, F.lit(1))),
        "after": _char_class(F.col("after")), "cue": cue}


NAMES = ("kind", "digits", "letters", "dots", "gaps", "dashes", "signs", "plus", "unlike_digits",
         "before", "after", "cue")


@dataclass
class Boosted:
    """Trees of two levels and a threshold a kind (None: nothing of the kind is added).

    A tree is (feature, value, left, right); each side (feature, value, low, high); "at most the
    value" goes left.
    """
    prior: float
    trees: list
    thresholds: dict[int, float | None]

    def margin(self) -> str:
        """SQL text of a candidate's log odds."""
        def side(s):
            name, value, low, high = s
            return f"IF({name} <= {value}, {low!r}D, {high!r}D)"
        parts = [f"IF({n} <= {v}, {side(a)}, {side(b)})" for n, v, a, b in self.trees]
        return " + ".join([f"{self.prior!r}D", *parts])

    def score(self) -> str:
        return f"1D / (1D + exp(-({self.margin()})))"


def _best_split(hist: dict, lam: float = 1.0):
    """(gain, feature, value, low, high) of the best cut of a node's histogram."""
    best = (0.0, NAMES[0], 99, 0.0, 0.0)
    for name, bins in hist.items():
        g_all = sum(g for g, _ in bins.values())
        h_all = sum(h for _, h in bins.values())
        g_low = h_low = 0.0
        whole = g_all * g_all / (h_all + lam)
        if best[2] == 99 and best[0] == 0.0:
            best = (0.0, name, 99, g_all / (h_all + lam), 0.0)
        for value in sorted(bins)[:-1]:
            g_low, h_low = g_low + bins[value][0], h_low + bins[value][1]
            g_high, h_high = g_all - g_low, h_all - h_low
            gain = g_low ** 2 / (h_low + lam) + g_high ** 2 / (h_high + lam) - whole
            if gain > best[0] + 1e-9:
                best = (gain, name, value, g_low / (h_low + lam), g_high / (h_high + lam))
    return best


def fit(counts: DataFrame, rounds: int = 12, rate: float = 0.5, precision: float = 0.9) -> Boosted:
    """Boosted trees on counted descriptions (features, n, hits, n_kept, hits_kept).

    Each round is two aggregations whose result has at most nodes × features × 20 rows.
    """
    total = counts.agg(F.sum("n"), F.sum("hits")).first()
    n, hits = float(total[0] or 0), float(total[1] or 0)
    model = Boosted(math.log((hits + 0.5) / (n - hits + 0.5)), [], dict.fromkeys(range(len(KINDS))))
    if not n:
        return model
    bins = F.array(*[F.struct(F.lit(x).alias("name"), F.col(x).cast("int").alias("value")) for x in NAMES])

    def histogram(node: Column) -> dict:
        # Sums of whole numbers first, so that the order of rows can't change a tree.
        rows = (counts.withColumn("node", node).withColumn("p", F.expr(model.score()))
                .withColumn("g", F.round((F.col("hits") - F.col("n") * F.col("p")) * 1e6).cast("long"))
                .withColumn("h", F.round(F.col("n") * F.col("p") * (1 - F.col("p")) * 1e6).cast("long"))
                .select("node", "g", "h", F.explode(bins).alias("b"))
                .groupBy("node", "b.name", "b.value").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
                .collect())
        out: dict = {}
        for r in sorted(rows, key=lambda r: (r["node"], NAMES.index(r["name"]), r["value"])):
            out.setdefault(r["node"], {}).setdefault(r["name"], {})[r["value"]] = (r["g"] / 1e6, r["h"] / 1e6)
        return out

    for _ in range(rounds):
        gain, name, value, *_ = _best_split(histogram(F.lit(0))[0])
        sides = histogram((F.col(name) > value).cast("int"))
        cut = [_best_split(sides[s])[1:] if s in sides else (NAMES[0], 99, 0.0, 0.0) for s in (0, 1)]
        left, right = [(x, v, rate * low, rate * high) for x, v, low, high in cut]
        model.trees.append((name, value, left, right))
        if gain <= 0:
            break
    model.thresholds |= _thresholds(counts, model, precision)
    return model


def _thresholds(counts: DataFrame, model: Boosted, precision: float) -> dict[int, float]:
    """Per kind the lowest score step from which on the share of positives is high enough."""
    step = F.least(F.floor(F.expr(model.score()) * 50), F.lit(49)).alias("step")
    rows = (counts.where("n_kept > 0").groupBy("kind", step)
            .agg(F.sum("n_kept").alias("n"), F.sum("hits_kept").alias("hits")).collect())
    found: dict[int, float] = {}
    for kind in range(len(KINDS)):
        n = hits = 0
        for r in sorted((r for r in rows if r["kind"] == kind), key=lambda r: -r["step"]):
            n, hits = n + r["n"], hits + r["hits"]
            if hits >= precision * n:
                found[kind] = r["step"] / 50
    return found


def _added(spans: DataFrame, model: Boosted) -> DataFrame:
    """Candidates that reach their threshold, clear of strict spans, the best of each overlap."""
    floor = F.lit(2.0)
    for kind, value in model.thresholds.items():
        floor = F.when(F.col("kind") == kind, 2.0 if value is None else value).otherwise(floor)
    scored = (spans.where(~F.col("strict")).withColumns({k: v for k, v in features().items() if k != "kind"})
              .withColumn("score", F.expr(model.score())).where(F.col("score") >= floor)
              .select("row", "kind", "start", "end", "score", F.lit(False).alias("strict")))
    strict = spans.where("strict AND valid").select(
        "row", "kind", "start", "end", F.lit(2.0).alias("score"), "strict")
    touched = scored.unionByName(strict.join(scored.select("row").distinct(), "row", "left_semi"))
    order = Window.partitionBy("row", "kind").orderBy("start", F.desc("strict"), "end", F.desc("score"))
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    ahead = order.rowsBetween(1, Window.unboundedFollowing)
    clear = (touched
             .withColumn("_to", F.max(F.when(F.col("strict"), F.col("end"))).over(past))
             .withColumn("_from", F.min(F.when(F.col("strict"), F.col("start"))).over(ahead))
             .where(~F.col("strict") & (F.coalesce("_to", F.lit(-1)) <= F.col("start"))
                    & F.coalesce(F.col("_from") >= F.col("end"), F.lit(True))))
    island = (clear.withColumn("_new", (F.coalesce(F.max("end").over(past), F.lit(-1))
                                        <= F.col("start")).cast("int"))
              .withColumn("_island", F.sum("_new").over(order)))
    best = F.max_by(F.struct("start", "end"),
                    F.struct("score", F.col("end") - F.col("start"), -F.col("start")))
    return (island.groupBy("row", "kind", "_island").agg(best.alias("_b"))
            .select("row", F.struct(F.col("_b.start").alias("start"), "kind",
                                    F.col("_b.end").alias("end")).alias("s")))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, rounds: int = 12, precision: float = 0.9) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): counts of strict spans by kind, their digest, and
    ``spans`` as kind:start:end by start, then kind (code points, end exclusive), added ones
    included; ``n_added`` counts those."""
    ws = Workspace(docs.sparkSession)
    rows = ws.cut(proposals(docs), "proposals")
    spans = ws.cut(located(rows), "spans")
    kept = fold_of("doc_id", 5) == 0
    held = spans.where(~F.col("strict")).withColumns({k: v for k, v in features().items() if k != "kind"})
    one, hit = F.lit(1), F.col("valid").cast("int")
    counts = ws.cut(held.groupBy(*NAMES).agg(
        F.sum(F.when(kept, 0).otherwise(one)).alias("n"),
        F.sum(F.when(kept, 0).otherwise(hit)).alias("hits"),
        F.sum(F.when(kept, one).otherwise(0)).alias("n_kept"),
        F.sum(F.when(kept, hit).otherwise(0)).alias("hits_kept")), "counts")
    model = fit(counts, rounds, precision=precision)
    strict = spans.where("strict AND valid").select(
        "row", F.struct("start", "kind", "end").alias("s"), F.lit(False).alias("new"))
    both = strict.unionByName(_added(spans, model).withColumn("new", F.lit(True)))
    none = F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint>>)")
    by_row = both.groupBy("row").agg(
        F.collect_list(F.when(~F.col("new"), F.col("s"))).alias("base"),
        F.collect_list("s").alias("every"))
    out = (rows.select("row", "doc_id").join(by_row, "row", "left")
           .withColumn("base", F.coalesce("base", none)).withColumn("every", F.coalesce("every", none)))

    def n_of(i):
        return F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long").alias(f"n_{KINDS[i]}")
    return out.select(
        "doc_id", *[n_of(i) for i in range(len(KINDS))],
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("every")).alias("spans"),
        (F.size("every") - F.size("base")).cast("long").alias("n_added"))
