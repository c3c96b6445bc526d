"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document; its measurements and one bit per failed rule
are stored. Policies are versions of bit masks: a document is kept if it failed none of a
policy's rules. Which documents a rule alone costs is read from the bits, without a look
at the texts again.

Defined results: a null text is an empty one, with all measurements 0; it fails
``few_words``. A repeated row is judged like any other, and a very long text whole. An empty
table gives an empty ledger. Further columns are left as they are; those with the names of
measurements, ``failed``, ``_w`` or ``_l`` are replaced or dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gapweave.llm.columns import SPACES, let, words_of

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def repeated_words(words: Column, width: int = 3) -> Column:
    """Words inside windows of ``width`` words that occur at least twice."""
    last = F.size(words) - width
    grams = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct(F.array_join(F.slice(words, i + 1, width), " ").alias("gram"), i.alias("at")),
    )

    def twice(s: Column) -> Column:
        hit = lambda j, k: F.get(s, j)["gram"].eqNullSafe(F.get(s, k)["gram"])
        at = F.filter(
            F.transform(
                F.sequence(F.lit(0), F.size(s) - 1),
                lambda j: F.when(hit(j, j - 1) | hit(j, j + 1), F.get(s, j)["at"]),
            ),
            lambda x: x.isNotNull(),
        )
        covered = F.aggregate(
            F.sort_array(at),
            F.struct(F.lit(-width).alias("end"), F.lit(0).alias("n")),
            lambda a, p: F.struct(
                (p + width).alias("end"), (a["n"] + width - F.greatest(F.lit(0), a["end"] - p)).alias("n")
            ),
        )
        return covered["n"]

    return F.when(last < 0, F.lit(0)).otherwise(let(F.sort_array(grams), twice)).cast("long")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements all rules are made of."""
    body = F.coalesce(F.col(text), F.lit(""))
    plain = body
    for c in SYMBOLS:
        plain = F.replace(plain, F.lit(c), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    counted = let(
        lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))
    )
    about = let(
        words_of(body),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n"),
            F.length(F.array_join(w, "")).cast("long").alias("chars"),
            repeated_words(w).alias("rep"),
        ),
    )
    return (
        docs.drop(*MEASURES)
        .withColumns({"_w": about, "_l": counted, "n_symbols": (F.octet_length(body) - F.octet_length(plain)).cast("long")})
        .withColumns(
            {
                "n_words": F.col("_w.n"),
                "word_chars": F.col("_w.chars"),
                "n_repeat_words": F.col("_w.rep"),
                "n_lines": F.col("_l.n").cast("long"),
                "n_dup_lines": F.col("_l.dup").cast("long"),
            }
        )
        .drop("_w", "_l")
    )


def _c(name: str) -> Column:
    return F.col(name)


#: Rules by bit, the lowest first. All are made of whole numbers.
RULES = (
    ("few_words", lambda: _c("n_words") < 50),
    ("repeated_words", lambda: _c("n_repeat_words") * 100 > _c("n_words") * 50),
    ("symbols", lambda: _c("n_symbols") * 100 > _c("n_words") * 30),
    ("repeated_lines", lambda: _c("n_dup_lines") * 100 > _c("n_lines") * 30),
    ("short_words", lambda: _c("word_chars") * 10 < _c("n_words") * 15),
    ("long_words", lambda: _c("word_chars") > _c("n_words") * 25),
)
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = ("few_words", "repeated_words")


def mask_of(*names: str) -> int:
    return sum(BITS[n] for n in names)


#: Versions of the policy: the rules that reject.
POLICIES = {
    "v1": mask_of(*BASE),
    "v2": mask_of(*BASE, "symbols", "repeated_lines"),
    "v3": mask_of(*BITS),
}


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with measurements and ``failed``, the bits of all rules failed."""
    bits = F.lit(0)
    for name, rule in RULES:
        bits = bits.bitwiseOR(F.when(rule(), F.lit(BITS[name])).otherwise(F.lit(0)))
    return measured(docs, text).withColumn("failed", bits)


def kept(policy: str, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablation(book: DataFrame, policy: str) -> DataFrame:
    """Per rule of ``policy``: documents failing it, failing only it, and kept without it.

    Documents are counted per combination of bits first, of which there are 64 at most.
    """
    counts = book.groupBy((F.col("failed").bitwiseAND(F.lit(POLICIES[policy]))).alias("bits")).agg(
        F.count(F.lit(1)).alias("n")
    )
    rules = [(n, b) for n, b in BITS.items() if b & POLICIES[policy]]
    table = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(b).alias("bit")) for n, b in rules)))
    only = F.col("bits") == F.col("bit")
    return (
        counts.select("bits", "n", table.alias("r"))
        .select("bits", "n", "r.*")
        .groupBy("rule")
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(only, F.col("n")).otherwise(0)).alias("n_failed_alone"),
            F.sum(F.when(only | (F.col("bits") == 0), F.col("n")).otherwise(0)).alias("n_kept_without"),
        )
    )
