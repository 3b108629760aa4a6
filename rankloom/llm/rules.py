"""Quality rules under weak supervision.

Each rule votes that a document is good (1) or bad (-1) or abstains (0). Expectation-maximisation over the
counts of vote patterns (at most 3 ** number of rules of them) estimates, per class, how often each rule
votes what (bad documents come in kinds, one for each rule); the posterior probability of the good class
decides, instead of a demand that all rules pass.

Features and votes are SQL functions only. Defined cases: a null text has no words and fails the base
rules; so does an empty one; an empty table gives no rows; repeated rows are judged alike, each for itself;
the time for a text grows as its words times their logarithm; other columns are ignored.
"""

from __future__ import annotations

from itertools import product
from math import exp, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50


def features(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to carry, then n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.btrim(text, F.lit(common.BLANKS))
    df = docs.select(*carry, text.alias("t"), bare.alias("bare"))
    df = df.withColumn("words", F.when(F.col("bare") == "", F.array().cast("array<string>")).otherwise(F.split("bare", f"[{common.BLANKS}]+")))
    df = df.withColumn("n", F.size("words"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(common.BLANKS)) != "")
    df = df.withColumn("lines", lines)
    # Hash and place of each 3-word window: one sort brings equal windows together.
    df = df.withColumn("windows", F.expr("if(n < 3, cast(array() as array<struct<h: bigint, p: int>>), sort_array(transform(slice(words, 1, n - 2), (w, i) -> struct(xxhash64(w, get(words, i + 1), get(words, i + 2)) as h, i as p))))"))
    same = "coalesce(x.h = get(windows, {}).h, false)"
    df = df.withColumn("found", F.expr(f"filter(windows, (x, i) -> {same.format('i - 1')} or {same.format('i + 1')})"))
    df = df.withColumn("places", F.expr("sort_array(transform(found, x -> cast(x.p as bigint)))"))
    covered = "if(size(places) = 0, 0L, aggregate(transform(places, (p, i) -> least(3L, coalesce(get(places, i + 1) - p, 3L))), 0L, (a, b) -> a + b))"
    return df.select(
        *carry,
        F.col("n").cast("long").alias("n_words"),
        F.length(F.translate("t", common.BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(covered).alias("n_repeat_words"),
    )


def vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes() -> dict[str, Column]:
    """The rules. Those on shares abstain where there are too few words to tell."""
    n, c = F.greatest(F.col("n_words"), F.lit(1)), F.col
    enough = c("n_words") >= 20
    return {
        "length": vote(c("n_words") < LEAST_WORDS, c("n_words") >= 80),
        "symbols": vote(c("n_symbols") > 0.2 * n, enough & (c("n_symbols") <= 0.05 * n)),
        "repeats": vote(enough & (c("n_repeat_words") > 0.35 * n), enough & (c("n_repeat_words") <= 0.2 * n)),
        "lines": vote(enough & (c("n_dup_lines") > 0.4 * c("n_lines")), c("n_dup_lines") <= 0.1 * c("n_lines")),
        "word_size": vote(enough & ((c("word_chars") > 7 * n) | (c("word_chars") < 2.5 * n)), enough & c("word_chars").between(3 * n, 6.5 * n)),
    }


#: Pseudo-counts of bad, abstain and good votes before any document is seen: of good documents, of the rule that
#: names a kind of bad documents, and of the other rules on that kind.
PRIOR_GOOD, PRIOR_OWN, PRIOR_OTHER = (0.1, 4.0, 45.9), (45.0, 2.5, 2.5), (5.0, 5.0, 40.0)
#: Pseudo-documents of the good class and of each kind of bad ones.
PRIOR_CLASSES = (18.0, 1.0)
#: A rule votes bad for at most this share of good documents.
FALSE_ALARMS = 0.005


def posterior(counts: dict[tuple[int, ...], int], rounds: int = 60) -> dict[tuple[int, ...], float]:
    """Probability of the good class for every possible pattern, by EM over the patterns' counts.

    Classes are good documents and one kind of bad ones for each rule: junk that only one rule sees would
    otherwise be drawn into the good class as soon as other junk has taken the bad one. The counts are bounded
    by 3 ** rules, so this runs on the driver at any size of the corpus.
    """
    width = len(next(iter(counts), ()))
    if not width:
        return {}
    kinds = width + 1
    total = sum(counts.values())
    prior = [[PRIOR_GOOD if c == 0 else PRIOR_OWN if c - 1 == k else PRIOR_OTHER for k in range(width)] for c in range(kinds)]
    tables = [[[x / sum(p) for x in p] for p in row] for row in prior]
    shares = [PRIOR_CLASSES[bool(c)] / (PRIOR_CLASSES[0] + width * PRIOR_CLASSES[1]) for c in range(kinds)]

    def weights(p: tuple[int, ...]) -> list[float]:
        logs = [log(shares[c]) + sum(log(tables[c][k][v + 1]) for k, v in enumerate(p)) for c in range(kinds)]
        top = max(logs)
        parts = [exp(x - top) for x in logs]
        return [x / sum(parts) for x in parts]

    for _ in range(rounds):
        held = {p: weights(p) for p in counts}
        shares = [(PRIOR_CLASSES[bool(c)] + sum(counts[p] * held[p][c] for p in counts)) / (PRIOR_CLASSES[0] + width * PRIOR_CLASSES[1] + total) for c in range(kinds)]
        for c in range(kinds):
            for k in range(width):
                seen = [prior[c][k][v + 1] + sum(counts[p] * held[p][c] for p in counts if p[k] == v) for v in (-1, 0, 1)]
                row = [x / sum(seen) for x in seen]
                if c == 0 and row[0] > FALSE_ALARMS:
                    rest = (1 - FALSE_ALARMS) / (1 - row[0])
                    row = [FALSE_ALARMS, row[1] * rest, row[2] * rest]
                tables[c][k] = row
    return {p: weights(p)[0] for p in product((-1, 0, 1), repeat=width)}


def pattern_of() -> Column:
    """The votes as one number to base 3."""
    pattern = F.lit(0)
    for rule in votes().values():
        pattern = pattern * 3 + rule + 1
    return pattern


def quality_table(df: DataFrame) -> Column:
    """The posterior as a function of the column `pattern`, estimated from the patterns of df."""
    width = len(votes())
    found = {r["pattern"]: r["count"] for r in df.groupBy("pattern").count().collect()}  # 3 ** rules rows at most
    number = lambda p: sum((v + 1) * 3**k for k, v in enumerate(reversed(p)))
    counts = {p: found[number(p)] for p in product((-1, 0, 1), repeat=width) if number(p) in found}
    table = {number(p): q for p, q in posterior(counts).items()}
    return F.get(F.array(*[F.lit(table.get(k, 0.0)) for k in range(3**width)]), F.col("pattern"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Features, votes pattern, quality (posterior probability), base_failed and kept of each row."""
    df = common.written(features(docs).withColumn("pattern", pattern_of()), "features")
    df = df.withColumn("quality", quality_table(df)).withColumn("base_failed", base_failed())
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))


def kept_rows(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that the rules keep.

    Votes go along with their rows, so no join is needed; only the counts of patterns take a pass of their own.
    """
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("text", F.col("row.text"))
    df = features(row, ("row",)).withColumn("pattern", pattern_of()).withColumn("failed", base_failed()).select("row", "pattern", "failed")
    marked = common.written(df, "votes")
    good = marked.where(~F.col("failed") & (quality_table(marked) >= least))
    return good.select("row.*")


def op4_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents judged."""
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
