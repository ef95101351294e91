"""Quality rules as a bitmask ledger (DataFrame functions only).

``ledger`` measures every text once, evaluates every rule once on the measurements and stores both: the numbers and
one long whose bit k says that rule k failed. Decisions come later and never read a text again: a ``Policy`` is a
version with a mask of rules and a number of failures it tolerates, ``apply_policies`` turns bits into verdicts,
``ablations`` says for each policy and rule what would be kept without that rule, and ``rule_profile`` combines the
bits of whole groups (``bit_or``, ``bit_and``). Bits never change their meaning; a new rule takes the next bit.

Defined cases: a null text reads as empty and has no words (it fails ``few_words``); an empty text is one line without
a word; a rule about a share of nothing does not fail; windows and repeated lines count inside one text only, so
repeated rows and rows that share an id or have none are judged alike and one by one; no length is cut; an empty
table gives an empty ledger; further columns pass through, one with the name of a result is replaced.

Scale: the ledger is a projection, without any shuffle. Repeated three-word windows are found by sorting the windows'
64-bit hashes inside the row (n log n for n words). Ablations and profiles group by bit patterns (at most two to the
number of rules), combined map-side, so a source with a third of all rows is a few rows per task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: word separators, counted symbols and marks
BLANKS = " \t\n\x0b\f\r"
SYMBOLS, SHOUTS, DIGITS = "#*$%&|<>", "!?", "0123456789"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_shouts", "n_digits"]
#: rule -> when it fails, as SQL over the measurements; the position in this list is the rule's bit for ever
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "short_words": "2 * n_words > word_chars",
    "long_words": "word_chars > 12 * n_words",
    "capitals": "100 * n_upper > 30 * n_letters",
    "shouting": "10 * n_shouts > n_words",
    "few_letters": "100 * n_letters < 70 * word_chars",
    "digits": "100 * n_digits > 30 * word_chars",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
BASE_RULES = ["few_words", "repeated_words"]


@dataclass(frozen=True)
class Policy:
    """A version: which rules count, and how many of them a text may fail."""

    version: str
    rules: tuple[str, ...]
    tolerated: int = 0

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in set(self.rules))

    def keeps(self, bits: Column, without: Column | None = None) -> Column:
        """The verdict on failure bits; ``without`` is a mask of rules left out."""
        counted = bits.bitwiseAND(F.lit(self.mask).cast("long"))
        if without is not None:
            counted = counted.bitwiseAND(F.bitwise_not(without))
        return F.bit_count(counted) <= self.tolerated


POLICIES = [
    Policy("1", ("few_words", "repeated_words")),
    Policy("2", ("few_words", "repeated_words", "symbols", "repeated_lines", "short_words", "long_words")),
    Policy("3", ("few_words", "repeated_words", "symbols", "repeated_lines", "short_words", "long_words", "capitals", "shouting")),
    Policy("3-strict", tuple(RULES)),
]
CURRENT = POLICIES[2]


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, even where the optimizer copies this expression, say into a pushed-down filter."""
    return F.get(F.transform(F.array(value), body), 0)


def _windows(words: Column) -> Column:
    """(hash, place) of every three-word window, sorted, so that equal windows lie side by side."""
    window = lambda i: F.struct(F.xxhash64(*[F.get(words, i + F.lit(j)) for j in range(3)]).alias("h"), i.alias("i"))
    return F.sort_array(F.when(F.size(words) >= 3, F.transform(F.sequence(F.lit(0), F.size(words) - 3), window)))


def _covered(windows: Column) -> Column:
    """Words inside the windows that have an equal neighbour; null without windows."""
    same = lambda x, k: F.coalesce(x["h"] == F.get(windows, k)["h"], F.lit(False))
    places = F.sort_array(F.transform(F.filter(windows, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(places, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")))["n"]


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, m): the row's own columns as one struct and the measurements as another."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    text = F.col("text")
    named = lambda **counts: F.struct(*[x.cast("long").alias(c) for c, x in counts.items()])
    by_words = _let(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+", -1), lambda x: x != ""), lambda words: named(
        n_words=F.size(words), n_repeat_words=F.coalesce(_let(_windows(words), _covered), F.lit(0))))
    by_lines = _let(F.filter(F.split(text, "\n", -1), lambda x: _without(x, BLANKS) != ""), lambda lines: named(
        n_lines=F.size(lines), n_dup_lines=F.size(lines) - F.size(F.array_distinct(lines))))
    by_letters = _let(F.regexp_replace(text, "[^\\p{L}\\p{M}]+", ""), lambda letters: named(
        n_letters=F.length(letters), n_upper=F.length(letters) - F.length(F.regexp_replace(letters, "\\p{Lu}+", ""))))
    by_chars = named(word_chars=F.length(_without(text, BLANKS)), **{c: F.length(text) - F.length(_without(text, chars)) for c, chars in (
        ("n_symbols", SYMBOLS), ("n_shouts", SHOUTS), ("n_digits", DIGITS))})
    # a generator of one row keeps the optimizer from computing a struct once per field or filter that reads it
    parts = own.select("row", F.explode(F.array(F.struct(by_words.alias("w"), by_lines.alias("l"), by_letters.alias("a"), by_chars.alias("c")))).alias("p"))
    return parts.select("row", F.struct(*[F.col(f"p.{part}.{c}") for part, names in (
        ("w", ["n_words", "n_repeat_words"]), ("l", ["n_lines", "n_dup_lines"]), ("a", ["n_letters", "n_upper"]),
        ("c", ["word_chars", "n_symbols", "n_shouts", "n_digits"])) for c in names]).alias("m"))


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every measurement and ``fail_bits`` (appended, or replaced where ``docs`` has such a column)."""
    new = [*MEASURES, "fail_bits"]
    bits = F.lit(0).cast("long")
    for name, fails in RULES.items():
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long"))
    # the rules see the measurements alone, under their own names
    return measure(docs, text_col).select("row", "m.*").withColumn("fail_bits", bits).select(
        *[F.col(f"row.`{c}`") for c in docs.columns if c not in new], *new)


def apply_policies(book: DataFrame, policies: Sequence[Policy] = tuple(POLICIES)) -> DataFrame:
    """``book`` with ``verdicts``: a map from policy version to whether the text is kept; no text is read."""
    pairs = [x for p in policies for x in (F.lit(p.version), p.keeps(F.col("fail_bits")))]
    return book.withColumn("verdicts", F.create_map(*pairs))


def sole_rule(policy: Policy, bits: Column) -> Column:
    """The rule without which ``policy`` would keep a text that it rejects; null where there is no single one."""
    alone = [F.when(~policy.keeps(bits) & policy.keeps(bits, F.lit(BIT[r]).cast("long")), F.lit(r)) for r in RULES if r in policy.rules]
    only = F.array_compact(F.array(*alone))
    return F.when(F.size(only) == 1, F.get(only, 0))


def ablations(book: DataFrame, policies: Sequence[Policy] = tuple(POLICIES)) -> DataFrame:
    """(version, rule, n_docs, n_failed, n_kept, n_kept_without): each policy as it is and without each of its rules.

    One row per bit pattern is all that leaves a task; every policy and rule is then computed from those patterns.
    """
    patterns = book.groupBy("fail_bits").agg(F.count("*").alias("n"))
    bits = F.col("fail_bits")
    case = lambda p, r: F.struct(
        F.lit(p.version).alias("version"), F.lit(r).alias("rule"), (bits.bitwiseAND(F.lit(BIT[r]).cast("long")) != 0).alias("failed"),
        p.keeps(bits).alias("kept"), p.keeps(bits, F.lit(BIT[r]).cast("long")).alias("without"))
    cases = patterns.select("n", F.explode(F.array(*[case(p, r) for p in policies for r in RULES if r in p.rules])).alias("c")).select("n", "c.*")
    total = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("n"))), F.lit(0)).cast("long")
    return cases.groupBy("version", "rule").agg(F.sum("n").alias("n_docs"), total("failed").alias("n_failed"), total("kept").alias("n_kept"),
                                                total("without").alias("n_kept_without"))


def rule_profile(book: DataFrame, by: str) -> DataFrame:
    """(by, n_docs, some_bits, all_bits): rules that some text of a group fails, and rules that all its texts fail."""
    return book.groupBy(by).agg(F.count("*").alias("n_docs"), F.bit_or("fail_bits").alias("some_bits"), F.bit_and("fail_bits").alias("all_bits"))


def rule_names(bits: Column) -> Column:
    """The names of the rules whose bits are set, in bit order."""
    return F.array_compact(F.array(*[F.when(bits.bitwiseAND(F.lit(b).cast("long")) != 0, F.lit(r)) for r, b in BIT.items()]))


def op13(spark, sf_dir: str) -> DataFrame:
    book = ledger(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    bits = F.col("fail_bits")
    base = F.lit(sum(BIT[r] for r in BASE_RULES)).cast("long")
    return apply_policies(book).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (bits.bitwiseAND(base) != 0).alias("base_failed"),
        F.col("verdicts")[CURRENT.version].alias("kept"), "fail_bits", F.col("verdicts")[POLICIES[-1].version].alias("kept_strict"),
        sole_rule(CURRENT, bits).alias("sole_rule"))


_BITS = " + ".join(f"CASE WHEN {fails} THEN {BIT[name]} ELSE 0 END" for name, fails in RULES.items())
_SOLE = " ".join(f"WHEN fail_bits & {CURRENT.mask} = {BIT[r]} THEN '{r}'" for r in RULES if r in CURRENT.rules)
SQL = f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM t),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
r AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM g),
c AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM r WHERE n > 1) GROUP BY rid),
l AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l,
             regexp_replace(text, '[^\\p{{L}}\\p{{M}}]+', '', 'g') AS a FROM t),
m AS (SELECT doc_id, CAST(len(w.w) AS BIGINT) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
             length(text) - length(translate(text, '{SYMBOLS}', '')) AS n_symbols, CAST(len(l.l) AS BIGINT) AS n_lines,
             CAST(len(l.l) - len(list_distinct(l.l)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
             length(l.a) - length(regexp_replace(l.a, '\\p{{Lu}}+', '', 'g')) AS n_upper, length(l.a) AS n_letters,
             length(text) - length(translate(text, '{SHOUTS}', '')) AS n_shouts, length(text) - length(translate(text, '{DIGITS}', '')) AS n_digits
      FROM t JOIN w USING (rid) JOIN l USING (rid) LEFT JOIN c USING (rid)),
b AS (SELECT *, CAST({_BITS} AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & {sum(BIT[r] for r in BASE_RULES)} <> 0 AS base_failed,
       fail_bits & {CURRENT.mask} = 0 AS kept, fail_bits, fail_bits & {POLICIES[-1].mask} = 0 AS kept_strict, CASE {_SOLE} END AS sole_rule
FROM b
"""
