"""Quality rules as a ledger of bits: every rule is evaluated once, policies and ablations are bit operations.

All columns are built-in functions. Nothing is exploded and nothing is shuffled: a document's words, lines and 5-word
windows are arrays of its own row, and repeated windows are found by sorting (window hash, position) pairs, so that a
text's cost is n log n in its words.

Cases. A null or empty text has no words, fails `few_words` and is not kept. Rows are judged one by one: repeated rows
and ids, and null ids, stay as they are. Columns other than `doc_id` and `text` are not read, whatever their names.
An empty table gives an empty ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadgeo.llm.common import WHITE

WINDOW = 5

#: Rule name to the condition under which it fails, on the measurements. The position in this table is the bit.
RULES = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "n_symbols >= 10 and 100 * n_symbols > 30 * n_words",
    "repeated_lines": "n_dup_lines >= 3 and 100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 15 * n_words",
    "shouting": "n_upper >= 50 and 100 * n_upper > 60 * word_chars",
    "exclamations": "n_exclaim >= 20 and 100 * n_exclaim > 50 * n_words",
}
#: Rules that every policy holds.
BASE = ("few_words", "repeated_windows")
#: Versioned policies: the rules that reject a document.
POLICIES = {
    "v1": BASE,
    "v2": (*BASE, "symbols", "repeated_lines", "word_length"),
    "v3": tuple(RULES),
}
CURRENT = "v3"


def mask(rules) -> int:
    """The bits of some rules."""
    return sum(1 << list(RULES).index(r) for r in rules)


def _count(text: Column, chars: str) -> Column:
    """Code points of a text that lie in a character class."""
    return F.length(text) - F.length(F.regexp_replace(text, chars, ""))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", text.alias("text"))
    d = d.select("*", F.transform(F.array_remove(F.split("text", WHITE + "+"), ""), lambda w: F.xxhash64(w)).alias("w"),
                 F.filter(F.split("text", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    n = F.size("w")
    windows = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get("w", i + j) for j in range(WINDOW))))
    d = d.select("*", F.when(n >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")).alias("windows"))
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    pairs = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.select("*", F.when(twice, pairs).alias("pairs"))
    h = lambda x: x.getField("h")
    starts = F.transform("pairs", lambda p, j: F.when(h(p).eqNullSafe(h(F.get("pairs", j - 1))) | h(p).eqNullSafe(h(F.get("pairs", j + 1))), p.getField("i")))
    d = d.select("*", F.sort_array(F.filter(starts, lambda i: i.isNotNull())).alias("starts"))
    covered = F.aggregate(
        F.zip_with("starts", F.slice("starts", 2, F.greatest(F.size("starts"), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW))),
        F.lit(0), lambda total, x: total + x)
    t = F.col("text")
    measured = {
        "n_words": n,
        "word_chars": F.length(F.regexp_replace(t, WHITE + "+", "")),
        "n_symbols": _count(t, r"[#*$%&|<>]+"),
        "n_lines": F.size("lines"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_upper": _count(t, r"\p{Lu}+"),
        "n_exclaim": _count(t, r"!+"),
    }
    return d.select("doc_id", *(c.cast("long").alias(k) for k, c in measured.items()))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and `failed`: a bit per rule."""
    measured = measure(docs)
    bits = [F.when(F.expr(f), F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(RULES.values())]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measured.withColumn("failed", failed.cast("long"))


def apply_policy(entries: DataFrame, version: str = CURRENT) -> DataFrame:
    """The ledger with `base_failed` and `kept` under a policy."""
    fails = lambda rules: F.col("failed").bitwiseAND(F.lit(mask(rules))) != 0
    return entries.select("*", fails(BASE).alias("base_failed"), (~fails(BASE) & ~fails(POLICIES[version])).alias("kept"), F.lit(version).alias("policy"))


def ablations(entries: DataFrame) -> DataFrame:
    """A row per policy and rule: documents it fails, and documents that the policy would keep without it.

    The ledger is summed by bit pattern first: what follows reads at most 2 ** len(RULES) rows."""
    patterns = entries.groupBy("failed").agg(F.count("*").alias("n"))
    arms = F.array(*(F.struct(F.lit(v).alias("policy"), F.lit(r).alias("rule"), F.lit(mask(rules)).alias("mask"), F.lit(mask([r])).alias("bit"))
                     for v, rules in POLICIES.items() for r in rules))
    hit = F.col("failed").bitwiseAND(F.col("bit")) != 0
    alone = F.col("failed").bitwiseAND(F.col("mask")) == F.col("bit")
    return patterns.select("*", F.inline(arms)).groupBy("policy", "rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("n_failed_alone"))
