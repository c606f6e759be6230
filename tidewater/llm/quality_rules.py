"""Learned decision lists over text statistics, in DataFrame functions only.

``features`` counts what a text holds; ``learn`` runs sequential covering: a
rule for bad documents is grown literal by literal (``feature <= t`` or
``feature > t``) by information gain on two thirds of the labelled rows, pruned
on the other third, and kept while it is right there; the rows it covers leave
and the next rule follows.  ``verdict`` is the ordered list as one conditional
expression.

Null text has no words (all counts 0).  A null or repeated id is a row of its
own.  Without labelled rows of both kinds the list is empty and only the base
rules decide.  Extra columns aren't read.  Fitting reads at most ``max_rows``
labelled rows, those with the smallest hashes of their ids.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

SPACES = r"[\x20\x09-\x0D]+"
#: Bins of each feature, so candidate thresholds.
BINS = 24


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """row (all columns of docs as a struct), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and n_chars, n_upper, n_other, n_lines, n_distinct."""
    step = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    step = step.select(
        "row",
        "text",
        F.array_remove(F.split("text", SPACES), "").alias("w"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    at = lambda a, i: F.get(a, i)
    windows = F.when(F.size("w") > 2, F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(at("w", i), at("w", i + 1), at("w", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    gone = lambda pattern: (F.length("text") - F.length(F.regexp_replace("text", pattern, ""))).cast("bigint")
    step = step.select(
        "row",
        F.size("w").cast("bigint").alias("n_words"),
        F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        gone(r"[#*$%&|<>]+").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.length("text").cast("bigint").alias("n_chars"),
        gone(r"\p{Lu}+").alias("n_upper"),
        F.length(F.regexp_replace("text", r"[\p{L}\p{N}\s]+", "")).cast("bigint").alias("n_other"),
        F.size("lines").cast("bigint").alias("n_lines"),
        F.size(F.array_distinct("w")).cast("bigint").alias("n_distinct"),
        F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))).alias("s"),
    )
    twice = F.filter("s", lambda x, k: ((k > 0) & (F.get("s", k - 1)["h"] == x["h"])) | ((k + 1 < F.size("s")) & (F.get("s", k + 1)["h"] == x["h"])))
    covered = F.aggregate(
        F.sort_array(F.transform(twice, lambda x: x["i"])),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda a, i: F.struct((a["n"] + i + 3 - F.greatest(i, a["to"])).alias("n"), (i + 3).alias("to")),
        lambda a: a["n"].cast("bigint"),
    )
    return step.select("row", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"), "n_chars", "n_upper", "n_other", "n_lines", "n_distinct")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def measures() -> dict[str, Column]:
    """What literals compare: sizes and shares of the counts."""
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": share("word_chars", "n_words"),
        "symbols_per_word": share("n_symbols", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "upper_share": share("n_upper", "n_chars"),
        "other_share": share("n_other", "n_chars"),
        "words_per_line": share("n_words", "n_lines"),
        "distinct_share": share("n_distinct", "n_words"),
    }


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool
    threshold: float

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.feature] > self.threshold if self.above else of[self.feature] <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Literal, ...]


def covers(rule: Rule, of: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a & b, (x.column(of) for x in rule))


def verdict(rules: list[Rule], of: dict[str, Column]) -> Column:
    """True (good) unless some rule, tried in order, covers the row."""
    out = F.lit(True)
    for rule in reversed(rules):
        out = F.when(covers(rule, of), F.lit(False)).otherwise(out)
    return out


def _gain(p1: int, n1: int, p0: int, n0: int) -> float:
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0))) if p1 else 0.0


def learn(rows: DataFrame, label: str = "good", max_rules: int = 10, max_literals: int = 3, least_right: float = 0.9, least_covered: int = 5) -> list[Rule]:
    """The decision list for rows with the counts of ``features``, a boolean label and ``_h``, a hash that deals the rows to growing and pruning."""
    of = measures()
    names = list(of)
    rows = checkpointed(rows.select(F.col(label).alias("good"), F.pmod("_h", F.lit(3)).alias("fold"), *[c.alias(n) for n, c in of.items()]))
    edges = rows.agg(*[F.array_sort(F.array_distinct(F.percentile(n, F.array(*[F.lit(k / BINS) for k in range(BINS)])))).alias(n) for n in names]).first().asDict()
    if not edges or edges[names[0]] is None:
        return []
    of = {n: F.col(n) for n in names}
    active, rules = F.lit(True), []

    def bins(where: Column) -> dict[tuple[str, int], list[int]]:
        """[bad, good] rows of the growing part by feature and bin; bin k holds values over edge k-1 and up to edge k."""
        index = lambda n: F.size(F.filter(F.array(*[F.lit(float(t)) for t in edges[n]]), lambda t: t < F.col(n)))
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("f"), index(n).alias("b")) for n in names])).alias("x")
        got: dict[tuple[str, int], list[int]] = {}
        for r in rows.filter((F.col("fold") != 0) & where).select("good", each).groupBy("good", "x.f", "x.b").count().collect():
            got.setdefault((r["f"], r["b"]), [0, 0])[bool(r["good"])] += r["count"]
        return got

    while len(rules) < max_rules:
        rule: list[Literal] = []
        where = active
        while len(rule) < max_literals:
            held = bins(where)
            p0, n0 = (sum(v[k] for (f, _), v in held.items() if f == names[0]) for k in (0, 1))
            if not p0 or not n0:
                break
            best, chosen = 1e-9, None
            for n in names:
                p = q = 0
                for k, t in enumerate(edges[n]):
                    p, q = p + held.get((n, k), [0, 0])[0], q + held.get((n, k), [0, 0])[1]
                    for above, p1, n1 in ((False, p, q), (True, p0 - p, n0 - q)):
                        if p1 >= least_covered and (g := _gain(p1, n1, p0, n0)) > best:
                            best, chosen = g, Literal(n, above, float(t))
            if chosen is None:
                break
            rule.append(chosen)
            where = where & chosen.column(of)
        if not rule:
            break
        prefixes = [covers(tuple(rule[: k + 1]), of) for k in range(len(rule))]
        counts = rows.filter((F.col("fold") == 0) & active).agg(*[F.count_if(c & (F.col("good") == g)).alias(f"c{k}_{int(g)}") for k, c in enumerate(prefixes) for g in (False, True)]).first()
        score = lambda k: (counts[f"c{k}_0"] - counts[f"c{k}_1"]) / max(1, counts[f"c{k}_0"] + counts[f"c{k}_1"])
        k = max(range(len(rule)), key=lambda k: (round(score(k), 6), -k))
        bad, good = counts[f"c{k}_0"], counts[f"c{k}_1"]
        if not bad or bad < least_right * (bad + good):
            break
        rules.append(tuple(rule[: k + 1]))
        active = active & ~covers(rules[-1], of)
    return rules


def judge(docs: DataFrame, labels: DataFrame, max_rows: int = 50_000, **options) -> DataFrame:
    """features of every row of docs with base_failed and kept, in one pass without an exchange.

    labels: doc_id and a 0/1 column quality; of several labels of one id the
    least counts.  Rules are learned from the rows of at most max_rows labelled
    ids, those with the smallest hashes.
    """
    marks = labels.filter(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_q"))
    marks = F.broadcast(marks.withColumn("_h", F.xxhash64("doc_id")).orderBy("_h").limit(max_rows))  # max_rows small rows at most
    counted = checkpointed(features(docs.select("doc_id", "text").join(marks, "doc_id")).withColumn("good", F.col("row._q") == 1).withColumn("_h", F.col("row._h")).drop("row"))
    rules = learn(counted.filter(~base_failed()), **options)
    return features(docs).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules, measures()))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that are kept, with their columns.

    Rows leave by inline(), not by a filter, which the optimizer would push
    below the projections and so count everything again for each use.
    """
    return judge(docs, labels, **options).selectExpr("inline(IF(kept, array(row), array()))")
