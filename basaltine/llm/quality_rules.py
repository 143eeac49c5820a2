"""Quality rules as a bitmask ledger (native).

Every rule is evaluated once per document; the ledger holds the measurements and one failure bit per rule. A policy is
a versioned mask of rules: applying one, or finding what each of its rules does alone, reads only the bits.
All of it stays within a row: the only shuffle is that of the counts in ``ablation``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basaltine.llm.words import WORD, where_computed, whole, words

SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """A document fails the rule where ``fails``, SQL over the measurements, is true."""

    name: str
    fails: str


#: The place in this list is the rule's bit: rules are only ever added at its end.
RULES = [
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "10 * n_dup_lines > 4 * n_lines"),
    Rule("shouting", "10 * n_exclaims > 5 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
]
#: Versions of the policy, by the names of the rules that reject a document.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "repeated_lines"),
    "v2": ("few_words", "repeated_windows", "symbols", "repeated_lines", "shouting", "long_words"),
}
CURRENT = "v2"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaims"]


def mask(policy: str | tuple[str, ...]) -> int:
    """The bits of a policy, given by its version or its rules' names."""
    at = {r.name: k for k, r in enumerate(RULES)}
    return sum(1 << at[name] for name in (POLICIES[policy] if isinstance(policy, str) else policy))


def _repeat_words() -> Column:
    """Words that lie in a 3-word window which comes twice or more.

    ``windows`` has the windows' hashes. Where they are not all different, they are sorted with their places; the
    words of neighbours with one hash are compared too, and the covered words follow from the gaps of the places.
    """
    sorted_ = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def same(x: Column, y: Column) -> Column:
        w = F.col("words")
        alike = [F.get(w, x["i"] + k) == F.get(w, y["i"] + k) for k in range(3)]
        return F.coalesce((x["h"] == y["h"]) & alike[0] & alike[1] & alike[2], F.lit(False))

    def places(pairs: Column) -> Column:
        kept = F.filter(pairs, lambda x, k: same(x, F.get(pairs, k - 1)) | same(x, F.get(pairs, k + 1)))
        return F.sort_array(F.transform(kept, lambda x: x["i"]))

    return F.when(F.size(F.array_distinct("windows")) < F.size("windows"), sorted_), places


def _measured(docs: DataFrame, text: str, rules: list[Rule]) -> DataFrame:
    """d, the columns of ``docs`` as they are; the measurements; ``failed``."""
    pairs, places = _repeat_words()
    t = F.col("t")
    out = docs.select(F.struct("*").alias("d"), whole(text).alias("t"))
    out = out.select("d", "t", words(t).alias("words"), F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD)).alias("lines"))
    w = F.col("words")
    triples = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    out = out.select("*", F.when(F.size(w) >= 3, triples).otherwise(F.array().cast("array<bigint>")).alias("windows"))
    out = out.select("*", pairs.alias("pairs"))
    out = out.select("*", F.when(F.col("pairs").isNotNull(), places(F.col("pairs"))).otherwise(F.array().cast("array<int>")).alias("places"))
    p = F.col("places")
    covered = F.aggregate(
        F.transform(p, lambda x, k: F.coalesce(F.least(F.lit(3), F.get(p, k + 1) - x), F.lit(3))), F.lit(0).cast("long"), lambda a, x: a + x.cast("long")
    )
    measured = F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count(t, F.lit("!")).cast("long").alias("n_exclaims"),
    )
    # one element: the optimiser moves no filter below it, where every measurement would be computed once more
    out = out.select("d", F.explode(F.array(measured)).alias("m")).select("d", "m.*")
    bits = [F.when(F.expr(r.fails), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")) for k, r in enumerate(rules)]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return out.withColumn("failed", failed)


def ledger(docs: DataFrame, text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """``docs`` with the measurements and ``failed``, the bits of the rules that a document fails (long).

    A null text has no words; every measurement of it is 0. Columns of ``docs`` that have the name of a measurement
    or of ``failed`` are replaced, all others stay as they are. Repeated rows and an empty table need nothing special.
    """
    own = [F.col("d").getField(c).alias(c) for c in docs.columns if c not in {*MEASURES, "failed"}]
    return _measured(docs, text, rules).select(*own, *MEASURES, "failed")


def kept_documents(docs: DataFrame, policy: str | tuple[str, ...] | None = None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass a policy (the current one), with all their columns, whatever their names."""
    return where_computed(_measured(docs, text, RULES), passes(CURRENT if policy is None else policy)).select("d.*")


def passes(policy: str | tuple[str, ...]) -> Column:
    """Whether a row of the ledger passes a policy."""
    return F.col("failed").bitwiseAND(F.lit(mask(policy))) == 0


def ablation(led: DataFrame, policy: str | tuple[str, ...] = CURRENT) -> DataFrame:
    """A row per rule of the policy: how many documents it rejects, and how many only it rejects.

    The documents are first counted by their bits, of which there are at most two to the number of rules.
    """
    bits = mask(policy)
    counts = led.groupBy(F.col("failed").bitwiseAND(F.lit(bits)).alias("bits")).agg(F.count("*").alias("n"))
    rules = [(r.name, 1 << k) for k, r in enumerate(RULES) if bits >> k & 1]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in rules]))
    return (
        counts.select("bits", "n", each.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n"))), F.lit(0)).alias("rejected"),
            F.coalesce(F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n"))), F.lit(0)).alias("rejected_alone"),
        )
    )
