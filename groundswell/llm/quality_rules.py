"""Quality rules as a short-circuit cascade, native DataFrame expressions throughout.

Each rule is a condition under which a document is rejected. On a sample that is spread over the input, the cost of
each measure (seconds a row, the least of repeated runs) and the rules that each row breaks are found out; rules then
run in order of rejection per cost, each judged by the rows that those before it let pass and by the measures that are
not known yet. A document meets no rule after the first that rejects it, and measures that only later rules read are
not taken of it. The order never changes the verdict, only the work.

Defined results: a null text has no words and is rejected for it; so are empty texts and those of white space
alone. Nulls in other columns, repeated rows and extra columns pass through untouched; a column that has the name given
to the verdict, or to a measure, is replaced by it.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import SPACES, let, scratch_path, table, unused, words_of

WINDOW = 5
SYMBOLS = "[#*$%&|<>]"


def word_chars(text: Column) -> Column:
    return F.char_length(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, "")).cast("long")


def symbol_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SYMBOLS)), F.lit(0)).cast("long")


def worded_lines(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(worded_lines(text), lambda lines: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"))


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of five words which the text holds twice or more, its first place included.

    Windows are compared by 64-bit hashes. A text without repeats costs one pass and a hash set; only others sort.
    """

    def covered(hashes: Column) -> Column:
        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twins = let(
            by_hash,
            lambda a: F.sort_array(
                F.transform(
                    F.filter(
                        F.transform(a, lambda x, k: F.struct(x["i"].alias("i"), (F.get(a, k - 1)["h"].eqNullSafe(x["h"]) | F.get(a, k + 1)["h"].eqNullSafe(x["h"])).alias("twin"))),
                        lambda x: x["twin"],
                    ),
                    lambda x: x["i"],
                )
            ),
        )
        # A window covers WINDOW words, less those that the next window covers as well.
        return let(twins, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b))

    def count(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[w[i + k] for k in range(WINDOW)]))
        return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))

    return let(words, lambda w: F.when(F.size(w) < WINDOW, F.lit(0)).otherwise(count(w))).cast("long")


#: Measures that rules are stated in; each gets the text and, computed once a row, its words.
MEASURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda text, words: F.size(words).cast("long"),
    "word_chars": lambda text, words: word_chars(text),
    "n_symbols": lambda text, words: symbol_count(text),
    "n_dup_lines": lambda text, words: duplicate_lines(text),
    "n_lines": lambda text, words: F.size(worded_lines(text)).cast("long"),
    "n_repeat_words": lambda text, words: repeated_words(words),
}
#: Those that read the words; the first of them in a cascade pays for the split.
OF_WORDS = ("n_words", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """Rejects a document where reject, of measures by name, is true."""

    name: str
    measures: tuple[str, ...]
    reject: Callable[..., Column]


BASE_RULES = (
    Rule("few_words", ("n_words",), lambda n: n < 10),
    Rule("repeated_passages", ("n_repeat_words", "n_words"), lambda r, n: 100 * r > 20 * n),
)
#: Beyond the base: symbols (over 1 to 10 words), repeated lines (over half), words too short or too long on average.
MORE_RULES = (
    Rule("symbols", ("n_symbols", "n_words"), lambda s, n: 10 * s > n),
    Rule("repeated_lines", ("n_dup_lines", "n_lines"), lambda d, n: 2 * d > n),
    Rule("word_length", ("word_chars", "n_words"), lambda c, n: (c < 2 * n) | (c > 15 * n)),
)
RULES = BASE_RULES + MORE_RULES


def with_measures(df: DataFrame, names: list[str], text: str = "text") -> DataFrame:
    """df and a column for each measure named."""
    words = unused(df, "words")
    base = df.withColumn(words, words_of(F.col(text)))
    return base.withColumns({n: MEASURES[n](F.col(text), F.col(words)) for n in names}).drop(words)


def rejects(rule: Rule, text: Column, words: Column, known: dict[str, Column] | None = None) -> Column:
    """The rule's condition; measures come from known columns, or else from the text, when the rule is reached."""
    known = known or {}
    return rule.reject(*[known[m] if m in known else MEASURES[m](text, words) for m in rule.measures])


def sample_of(df: DataFrame, text: str, rows: int, files: int = 8, seed: int = 17) -> DataFrame:
    """Texts of about so many rows, drawn at random from a few of the input's files where it reads files directly: evenly spaced
    by name, and their names prune the scan."""
    names = sorted({unquote(path.rsplit("/", 1)[-1]) for path in df.inputFiles()})
    some = df
    if len(names) > files:
        try:
            some = df.where(F.col("_metadata.file_name").isin([names[len(names) * k // files] for k in range(files)]))
        except AnalysisException:  # the input is not a plain scan
            pass
    return some.select(F.col(text).alias("text")).sample(min(1.0, rows / max(1, some.count())), seed=seed)


@dataclass(frozen=True)
class Step:
    """A rule in its place: the share that it rejects of what comes to it, and the seconds a row that it adds."""

    rule: Rule
    share: float
    cost: float


def measured_costs(sample: DataFrame, names: list[str], rows: int, repeats: int = 3) -> dict[str, float]:
    """Seconds a row of the split into words, and of each measure beyond that and beyond reading the text."""

    def seconds(*values: Column) -> float:
        took = []
        for _ in range(repeats):
            began = time.perf_counter()
            sample.agg(*[F.sum(v) for v in values]).collect()
            took.append(time.perf_counter() - began)
        return min(took)

    text, words = F.col("text"), words_of(F.col("text"))
    base = seconds(F.char_length(text))
    split = seconds(F.size(words))
    found = {"words": max(0.0, split - base)}
    for n in names:
        found[n] = max(0.0, seconds(MEASURES[n](text, words)) - (split if n in OF_WORDS else base))
    return {n: c / max(1, rows) for n, c in found.items()}


def ordered(rules: tuple[Rule, ...], broken: list[tuple[tuple[bool, ...], int]], costs: dict[str, float], known: tuple[str, ...] = ()) -> list[Step]:
    """Rules by rejection per cost. broken: which rules are broken together, and by how many rows; known: measures that are there."""
    left, out, have = list(range(len(rules))), [], set(known)

    def added(rule: Rule) -> float:
        new = set(rule.measures) - have
        return sum(costs.get(m, 0.0) for m in new) + (costs.get("words", 0.0) if "words" not in have and new & set(OF_WORDS) else 0.0)

    while left:
        rows = sum(n for _, n in broken)
        steps = [(Step(rules[k], sum(n for b, n in broken if b[k]) / max(1, rows), added(rules[k])), k) for k in left]
        step, k = min(steps, key=lambda x: (-x[0].share / max(x[0].cost, 1e-9), x[0].cost, x[0].rule.name))
        out.append(step)
        left.remove(k)
        broken = [(b, n) for b, n in broken if not b[k]]
        have |= set(step.rule.measures) | ({"words"} if set(step.rule.measures) & set(OF_WORDS) else set())
    return out


def measured_order(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = 2000, known: tuple[str, ...] = ()) -> list[Step]:
    """Rules by rejection per cost, from about sample_rows rows of the input. It steers the order alone; no verdict depends on it."""
    spark = df.sparkSession
    path = scratch_path(spark, "rule-sample")
    sample_of(df, text, sample_rows).write.parquet(path)
    sample = spark.read.schema("text string").parquet(path)
    flags = [f"r{k}" for k in range(len(rules))]
    judged = sample.select(*[F.coalesce(rejects(r, F.col("text"), words_of(F.col("text"))), F.lit(False)).alias(f) for r, f in zip(rules, flags, strict=True)])
    broken = [(tuple(r[f] for f in flags), r["n"]) for r in judged.groupBy(*flags).agg(F.count(F.lit(1)).alias("n")).collect()]  # at most 2**rules rows
    names = sorted({m for r in rules for m in r.measures} - set(known))
    return ordered(rules, broken, measured_costs(sample, names, sum(n for _, n in broken)), known)


def first_rejection(order: list[Rule], text: Column, words: Column, known: dict[str, Column] | None = None) -> Column:
    """The name of the first rule in this order that rejects, else null; CASE stops at the first."""
    out = None
    for rule in order:
        condition = rejects(rule, text, words, known)
        out = F.when(condition, F.lit(rule.name)) if out is None else out.when(condition, F.lit(rule.name))
    return out if out is not None else F.lit(None).cast("string")


def quality_rules(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = 2000, verdict: str = "rejected_by", known: tuple[str, ...] = (), order: list[Rule] | None = None) -> DataFrame:
    """df and a column that names the rule which rejected the document, null for those kept. known: measures that df has as
    columns of their names; all others are taken where a rule asks for them. order: instead of the measured one."""
    order = order if order is not None else [s.rule for s in measured_order(df, rules, text, sample_rows, known)]
    held = {k: F.col(k) for k in known}
    if any((set(r.measures) - set(known)) & set(OF_WORDS) for r in rules):  # one split, even where a filter takes the verdict's place
        return df.withColumn(verdict, let(words_of(F.col(text)), lambda words: first_rejection(order, F.col(text), words, held)))
    return df.withColumn(verdict, first_rejection(order, F.col(text), F.lit(None), held))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures of every document, whether the base fails it, and the cascade's verdict.

    The query returns five measures of every document, so the cascade has those as columns; what other rules need it
    takes only of documents that come to them.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    order = [s.rule for s in measured_order(docs, known=names)]
    judged = quality_rules(with_measures(docs, list(names)), known=names, order=order)
    failed = first_rejection(list(BASE_RULES), F.lit(None), F.lit(None), {n: F.col(n) for n in names}).isNotNull()
    return judged.select("doc_id", *names, failed.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents
), w AS (
  SELECT rid, doc_id, t,
         list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), wins AS (
  SELECT rid, i, list_aggregate(words[i:i + 4], 'string_agg', ' ') AS win
  FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)
), twice AS (
  SELECT rid, i FROM wins QUALIFY count(*) OVER (PARTITION BY rid, win) > 1
), cover AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(0, 5) r(k) GROUP BY rid
), m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cover ON w.rid = cover.rid
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM m
"""
QUERIES = {"op8_quality_rules": op8_quality_rules}
ORACLES = {"op8_quality_rules": OP8_SQL}
