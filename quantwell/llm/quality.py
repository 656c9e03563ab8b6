"""Quality rules as a short-circuit cascade of DataFrame expressions.

Each rule's cost and rejections are measured on a sample; the cascade then asks first the rule
that rejects most for its cost, and a document that one rule rejects is not asked further. The
order changes the work, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantwell.llm.common import Scratch, documents

#: Rows from which rules are timed; it bears on their order alone.
SAMPLE_ROWS = 400
WINDOW = 5
#: The white space of words, in a character class. (translate() is far slower than patterns.)
_SPACES = r"\x20\x09-\x0D"


@dataclass(frozen=True)
class Rule:
    """rejects(document) is true for a document to reject."""

    name: str
    rejects: Callable[["Document"], Column]


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once although use's own lambda functions name it often."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    """Runs of characters other than space and U+0009 to U+000D."""
    return F.array_remove(F.split(text, f"[{_SPACES}]+", -1), "")


def word_chars(found: Column) -> Column:
    return F.length(F.array_join(found, ""))


def n_symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[#*$%&|<>]"))


def solid_lines(text: Column) -> Column:
    """Lines, cut at newlines, that have a word."""
    return F.filter(F.split(text, "\n", -1), lambda line: line.rlike(f"[^{_SPACES}]"))


def n_dup_lines(lines: Column) -> Column:
    return F.size(lines) - F.size(F.array_distinct(lines))


def window_hashes(found: Column) -> Column:
    """A hash of each WINDOW-word window, in order."""
    last = F.size(found) - WINDOW
    one = F.transform(found, lambda w: F.xxhash64(w))
    each = bound(one, lambda h: F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW)))))
    return F.when(last >= 0, each).otherwise(F.array().cast("array<bigint>"))


def _marked(by_hash: Column) -> Column:
    """Positions of windows whose neighbour in hash order is equal."""
    same = F.transform(by_hash, lambda x, k: F.when((F.get(by_hash, k - 1)["h"] == x["h"]) | (F.get(by_hash, k + 1)["h"] == x["h"]), x["i"]))
    return F.filter(same, lambda i: i.isNotNull())


def covered_words(hashes: Column) -> Column:
    """Words in windows that occur twice or more: sort windows by hash, mark equal neighbours, add up."""
    by_hash = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    total = F.aggregate(
        F.array_sort(bound(by_hash, _marked)),
        F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).alias("n")),
        lambda a, i: F.struct(i.alias("at"), (a["n"] + F.least(F.lit(WINDOW), i - a["at"])).alias("n")),
        lambda a: a["n"],
    )
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(total)


def _upper(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[A-ZÀ-ÖØ-Þ]"))


def _stutters(found: Column) -> Column:
    """Words equal to the word before them."""
    return F.size(F.filter(F.transform(found, lambda w, i: F.get(found, i - 1) == w), lambda same: same))


@dataclass(frozen=True)
class Document:
    """What rules look at: columns, or expressions that a rule computes only if it is asked."""

    text: Column
    found: Column  #: the words, a plain column
    n_words: Column
    word_chars: Column
    n_symbols: Column
    lines: Column  #: lines with a word, and how many of them repeat an earlier one
    n_repeat_words: Column

    @classmethod
    def lazy(cls) -> "Document":
        """Over the columns of `worded`; all but the words is computed where a rule needs it."""
        text, found = F.col("text"), F.col("__d.found")
        lines = bound(solid_lines(text), lambda x: F.struct(F.size(x).alias("n"), n_dup_lines(x).alias("dup")))
        return cls(text, found, F.col("__d.n_words"), word_chars(found), n_symbols(text), lines, bound(window_hashes(found), covered_words))


def worded(docs: DataFrame) -> DataFrame:
    """docs with a column __d (words and their count); text is without nulls.

    Generating the column keeps the optimizer from pushing rules below it, where each would
    split the text anew.
    """
    filled = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    found = bound(words(F.col("text")), lambda w: F.struct(w.alias("found"), F.size(w).alias("n_words")))
    return filled.withColumn("__d", F.explode(F.array(found)))


#: The method's rules. Thresholds are shares of words or lines, well beyond what prose reaches.
RULES = (
    Rule("symbols", lambda d: 10 * d.n_symbols > d.n_words),
    Rule("word_length", lambda d: F.abs(d.word_chars - 8 * d.n_words) > 6 * d.n_words),
    Rule("shouting", lambda d: 2 * _upper(d.text) > d.word_chars),
    Rule("exclamations", lambda d: 10 * (F.length(d.text) - F.length(F.replace(d.text, F.lit("!"), F.lit("")))) > 4 * d.n_words),
    Rule("repeated_lines", lambda d: bound(d.lines, lambda x: (x["n"] > 3) & (10 * x["dup"] > 4 * x["n"]))),
    Rule("stutter", lambda d: (d.n_words >= 10) & (10 * _stutters(d.found) > 3 * d.n_words)),
)

#: The base rules of the contract.
BASE_RULES = (
    Rule("few_words", lambda d: d.n_words < 10),
    Rule("repeated_windows", lambda d: 100 * d.n_repeat_words > 20 * d.n_words),
)


@dataclass(frozen=True)
class Measured:
    rule: Rule
    seconds: float
    rejected: float

    @property
    def worth(self) -> float:
        return self.rejected / self.seconds


def measure(docs: DataFrame, rules: tuple[Rule, ...], scratch: Scratch, *, rows: int = SAMPLE_ROWS, repeats: int = 4) -> list[Measured]:
    """Rules by rejections per second, each on what the rules before it leave; on about `rows` documents.

    The sample is dealt by hash over the whole table; it bears on the order alone, never on a
    verdict. One pass finds which rules reject which documents; each rule is then timed.
    """
    keys = [c for c in ("doc_id", "text") if c in docs.columns]
    step = max(1, docs.count() // rows)
    dealt = docs.where(F.pmod(F.xxhash64(*keys), F.lit(step)) == 0).select("text").limit(4 * rows)  # beyond that only if many rows are one and the same
    sample = worded(scratch.keep(dealt))
    many = sample.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(repeats))))

    def timed(column: Column) -> float:
        best = float("inf")
        for _ in range(2):
            began = time.perf_counter()
            many.agg(F.count_if(column)).first()
            best = min(best, time.perf_counter() - began)
        return best

    names = [f"r{i}" for i in range(len(rules))]
    flags = sample.select(*(F.coalesce(r.rejects(Document.lazy()), F.lit(False)).alias(n) for r, n in zip(rules, names, strict=True)))
    seen = [(r[:-1], r[-1]) for r in map(tuple, flags.groupBy(*names).count().collect())]  # 2 ** rules rows at most
    total = max(1, sum(n for _, n in seen))
    idle = timed(F.length("text") < 0)
    cost = [max(timed(r.rejects(Document.lazy())) - idle, 1e-4) for r in rules]
    found, left = [], list(range(len(rules)))
    while left:
        gain = {i: sum(n for hit, n in seen if hit[i]) for i in left}
        best = max(left, key=lambda i: gain[i] / cost[i])
        found.append(Measured(rules[best], cost[best], gain[best] / total))
        left.remove(best)
        seen = [(hit, n) for hit, n in seen if not hit[best]]
    return found


def verdict(document: Document, ordered: list[Rule] | tuple[Rule, ...]) -> Column:
    """True if no rule rejects; a CASE expression that stops at the first that does."""
    out = None
    for rule in ordered:
        out = (F if out is None else out).when(rule.rejects(document), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(True)


def keep_good(docs: DataFrame, scratch: Scratch, rules: tuple[Rule, ...] = BASE_RULES + RULES) -> DataFrame:
    """The documents that no rule rejects, with their columns as they are, whatever their names.

    Null and empty texts have no words and go; null and repeated doc_id pass through, each row
    being judged by itself.
    """
    ordered = [m.rule for m in measure(docs, rules, scratch)]
    own = {c: f"__own{i}" for i, c in enumerate(docs.columns)}
    apart = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in own.items()), F.col("text"))
    kept = worded(apart).where(verdict(Document.lazy(), ordered))
    return kept.select(*(F.col(n).alias(c) for c, n in own.items()))


def quality_report(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Counts and verdict for each row of (doc_id, text): doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept.

    Null text has no words and fails; null and repeated doc_id pass through; other columns are ignored.
    """
    ordered = [m.rule for m in measure(docs, RULES, scratch)]
    d = Document.lazy()
    counted = worded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select(
        "doc_id", "text", "__d", d.n_words.alias("n_words"), d.word_chars.alias("word_chars"), d.n_symbols.alias("n_symbols"), d.lines.alias("lines"), d.n_repeat_words.alias("n_repeat_words")
    )
    seen = Document(F.col("text"), F.col("__d.found"), *(F.col(c) for c in ("n_words", "word_chars", "n_symbols", "lines", "n_repeat_words")))
    failed = verdict(seen, BASE_RULES)
    judged = counted.withColumn("base_failed", ~failed).withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(seen, ordered)))
    counts = [F.col(c).cast("long").alias(a) for c, a in (("n_words", "n_words"), ("word_chars", "word_chars"), ("n_symbols", "n_symbols"), ("lines.dup", "n_dup_lines"), ("n_repeat_words", "n_repeat_words"))]
    return judged.select("doc_id", *counts, "base_failed", "kept")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    return quality_report(documents(spark, sf_dir), Scratch(spark))


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i:i+4]) AS n FROM g),
p AS (SELECT r, least(5, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 5)) AS c FROM h WHERE n > 1),
s AS (SELECT r, sum(c) AS c FROM p GROUP BY r),
m AS (SELECT doc_id, t, ws, ls, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
  length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c, 0) AS n_repeat_words,
  length(t) - length(regexp_replace(t, '[A-ZÀ-ÖØ-Þ]', '', 'g')) AS upper_chars, length(t) - length(replace(t, '!', '')) AS marks,
  len(list_filter(range(2, len(ws) + 1), lambda k: ws[k] = ws[k - 1])) AS stutters FROM w LEFT JOIN s USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 14 * n_words OR 2 * upper_chars > word_chars
    OR 10 * marks > 4 * n_words OR (len(ls) > 3 AND 10 * n_dup_lines > 4 * len(ls)) OR (n_words >= 10 AND 10 * stutters > 3 * n_words)) AS kept
FROM b
"""
