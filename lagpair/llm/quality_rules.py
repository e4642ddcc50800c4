"""Quality rules: a learned decision list over statistics of whole texts.

Statistics are DataFrame expressions alone. From the labelled rows' statistics
a sequential covering grows threshold conjunctions by information gain on two
thirds of them, prunes each on the rest, and drops the rows a rule covers before
the next. The rules come out as one ordered Spark conditional expression, which
reads as it was learnt (:meth:`DecisionList.describe`).

The fit uses at most ``max_labelled`` labelled rows, those with the least hash
of their id; only their numbers come to the driver.

Edge cases: a null text is empty; a text without words fails the base rules.
Without labels of both classes the list has no rule and keeps all that passes
the base rules. Labels that repeat a doc_id count once, with the least quality;
null labels and ids are ignored. Repeated documents each give a row. Columns
other than doc_id, text and quality are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagpair.llm.common import stored, text_rows

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_LABELLED = 20_000
#: Thresholds tried for a statistic: so many quantiles of the labelled rows.
CUTS = 40
MAX_CONDITIONS = 4
MAX_RULES = 12
#: A rule must be right on so large a share of the rows it covers, in both parts of the labelled rows, and cover so many.
LEAST_PRECISION = 0.9
LEAST_COVER = 8

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_distinct_words", "n_upper", "n_bars")


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of ``WINDOW`` words whose like is found elsewhere in ``words``.

    Windows are hashed; if all hashes differ the answer is 0. Otherwise they are sorted with their places, those with an
    equal neighbour are put in order of place, and the lengths of the union of their spans are summed.
    """
    zero = F.lit(0).cast("long")

    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(rows: Column) -> Column:
            n = F.size(rows)
            twin = F.filter(rows, lambda r, k: ((k > 0) & (F.get(rows, k - 1)["h"] == r["h"])) | ((k < n - 1) & (F.get(rows, k + 1)["h"] == r["h"])))
            starts = F.array_sort(F.transform(twin, lambda r: r["i"].cast("long")))
            step = F.aggregate(
                starts,
                F.struct(F.lit(-WINDOW).cast("long").alias("last"), zero.alias("n")),
                lambda acc, s: F.struct(s.alias("last"), (acc["n"] + F.least(F.lit(WINDOW).cast("long"), s - acc["last"])).alias("n")),
            )
            return step["n"]

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), zero).otherwise(let(placed, repeated))

    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
        return F.when(F.size(w) <= WINDOW, zero).otherwise(let(hashes, covered))

    return of(words)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every text, as longs; no shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = text_rows(docs, "doc_id", "text").select("doc_id", text.alias("t"))
    # a blank at both ends makes the first and last part of the split empty, so that all others are words
    words = F.split(F.concat(F.lit(" "), F.col("t"), F.lit(" ")), r"[\x20\x09-\x0D]+")
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words"),
        )

    def of_lines(ls: Column) -> Column:
        return F.struct(F.size(ls).cast("long").alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"))

    return rows.select(
        "doc_id",
        let(inner, of).alias("w"),
        let(lines, of_lines).alias("l"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("t", F.lit(r"[|]")).cast("long").alias("n_bars"),
        F.regexp_count("t", F.lit(r"[A-ZÀ-ÖØ-Þ]")).cast("long").alias("n_upper"),
    ).select("doc_id", "w.*", "l.*", "n_symbols", "n_bars", "n_upper")


#: What rules test, as (numerator, denominator): shares, so that they do not depend on a text's length, and the length itself.
RATIOS = {
    "words": ("n_words", None),
    "word_length": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "bars_per_word": ("n_bars", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "distinct_share": ("n_distinct_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
}


def ratio(name: str) -> Column:
    over, under = RATIOS[name]
    return F.col(over).cast("double") if under is None else F.col(over) / F.greatest(F.col(under), F.lit(1))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    cut: float

    def holds(self, row: dict[str, float]) -> bool:
        return row[self.name] > self.cut if self.above else row[self.name] <= self.cut

    def column(self) -> Column:
        value = ratio(self.name)
        return value > self.cut if self.above else value <= self.cut

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.cut:.6g}"


@dataclass
class DecisionList:
    """Ordered rules; the first whose conditions all hold rejects a text, and one that none holds for is kept."""

    rules: list[tuple[Condition, ...]] = field(default_factory=list)

    def rejecting(self) -> Column:
        """Number (from 1) of the first rule that holds, null if none does: an ordered conditional expression."""
        out = None
        for k, rule in enumerate(self.rules, 1):
            holds = rule[0].column()
            for c in rule[1:]:
                holds = holds & c.column()
            out = F.when(holds, F.lit(k)) if out is None else out.when(holds, F.lit(k))
        return F.lit(None).cast("int") if out is None else out

    def describe(self) -> list[str]:
        return ["reject if " + " and ".join(map(str, rule)) for rule in self.rules]


def _counts(rows: list[dict], rule: tuple[Condition, ...]) -> tuple[int, int]:
    bad = good = 0
    for r in rows:
        if all(c.holds(r) for c in rule):
            if r["bad"]:
                bad += 1
            else:
                good += 1
    return bad, good


def _grow(rows: list[dict], cuts: dict[str, list[float]]) -> tuple[Condition, ...]:
    """Adds the condition of the largest information gain until no good row is covered."""
    rule: tuple[Condition, ...] = ()
    covered = rows
    while len(rule) < MAX_CONDITIONS:
        p, n = sum(r["bad"] for r in covered), sum(not r["bad"] for r in covered)
        if not p or not n:
            break
        before, best, gain = math.log2(p / (p + n)), None, 1e-9
        for name, values in cuts.items():
            slots = [[0, 0] for _ in range(len(values) + 1)]
            for r in covered:
                slots[r["slot"][name]][0 if r["bad"] else 1] += 1
            low_p = low_n = 0
            for k, cut in enumerate(values):
                low_p, low_n = low_p + slots[k][0], low_n + slots[k][1]
                for above, a, b in ((False, low_p, low_n), (True, p - low_p, n - low_n)):
                    if a >= LEAST_COVER / 2 and (g := a * (math.log2(a / (a + b)) - before)) > gain:
                        best, gain = Condition(name, above, cut), g
        if best is None:
            break
        rule += (best,)
        covered = [r for r in covered if best.holds(r)]
    return rule


def _prune(rule: tuple[Condition, ...], rows: list[dict]) -> tuple[Condition, ...]:
    """The first conditions of the rule that do best on rows it was not grown on."""
    def worth(r: tuple[Condition, ...]) -> float:
        bad, good = _counts(rows, r)
        return (bad - good) / (bad + good) if bad + good else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=worth)


def learn(rows: list[dict]) -> DecisionList:
    """Sequential covering of the rows with ``bad`` set. Each row has the values of :data:`RATIOS` and ``grown``, true for the part that rules grow on."""
    cuts = {}
    for name in RATIOS if rows else []:
        values = sorted(r[name] for r in rows)
        picked = sorted({values[min(len(values) - 1, k * len(values) // CUTS)] for k in range(1, CUTS)})
        cuts[name] = [c for c in picked if c < values[-1]]
    for r in rows:
        r["slot"] = {name: _slot(values, r[name]) for name, values in cuts.items()}
    grown, held = [r for r in rows if r["grown"]], [r for r in rows if not r["grown"]]
    out = DecisionList()
    while len(out.rules) < MAX_RULES:
        rule = _grow(grown, cuts)
        if not rule:
            break
        rule = _prune(rule, held)
        ok = all(bad + good and bad / (bad + good) >= LEAST_PRECISION for bad, good in (_counts(grown, rule), _counts(held, rule)))
        if not ok or sum(_counts(rows, rule)) < LEAST_COVER:
            break
        out.rules.append(rule)
        grown, held = ([r for r in part if not all(c.holds(r) for c in rule)] for part in (grown, held))
        rows = grown + held
    return out


def _slot(values: list[float], x: float) -> int:
    """Number of cuts under x."""
    low, high = 0, len(values)
    while low < high:
        mid = (low + high) // 2
        if values[mid] < x:
            low = mid + 1
        else:
            high = mid
    return low


def fit(stats: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DecisionList:
    """Learns from labelled rows that pass the base rules; quality 0 is what rules reject."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = stats.where(~base_failed()).join(F.broadcast(chosen), "doc_id").select(
        (F.col("quality") == 0).alias("bad"), (F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(3)) > 0).alias("grown"), *(ratio(n).alias(n) for n in RATIOS)
    )
    return learn([r.asDict() for r in rows.collect()])


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept and the number of the rule that rejects."""
    stats = stored(statistics(docs), "statistics")
    rule = fit(stats, labels).rejecting()
    return stats.select("doc_id", *BASE, base_failed().alias("base_failed"), (~base_failed() & rule.isNull()).alias("kept"), rule.alias("rule"))
