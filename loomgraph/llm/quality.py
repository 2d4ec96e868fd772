"""Quality rules: a table of thresholds compiled into one projection, evaluated by Spark expressions only.

``measure`` adds the raw counts of a text, ``compile_rules`` turns a threshold table into one boolean column per
rule and ``apply_rules`` does both. No user functions run and nothing is shuffled: every document is judged alone.

Defined results of the odd cases
* null text: as a text without words; all counts are 0, ``base_failed`` is true (fewer than 20 words).
* empty text or white space only: the same.
* very long texts: repeated windows are found by hashing and sorting inside the row, n log n in its words.
* repeated rows: each is judged by itself, so equal rows get equal verdicts.
* empty table: an empty result. Extra columns: not read by ``judged``; ``keep_good`` returns them as they are, whatever
  their names (``__m``, ``__kept`` and the like included).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import SPACE, fresh, read

#: Frequent function words of the corpus languages (English, French, German, Spanish).
STOP_WORDS = (
    "the of and to in is it on for with as that this by at from be was are or an a "
    "le la les de des du et un une en que qui est dans pour par sur au avec "
    "der die das und den dem ein eine zu von mit ist nicht im auf für sich auch als "
    "el los las y del por con una su para es se al lo como más"
).split()
SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """Reject a document of at least ``min_words`` words whose measure is outside [low, high]."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


#: The threshold table. Measures are ratios, so that long and short texts are held to the same mark.
RULES = (
    Rule("word_length", "mean_word_chars", 1.5, 25.0),
    Rule("symbols", "symbols_per_word", None, 0.2),
    Rule("shouting", "shouted_per_word", None, 0.5),
    Rule("stop_words", "stop_words_per_word", 0.005, None, 200),
    Rule("duplicate_lines", "dup_lines_per_line", None, 0.5),
    Rule("bullets", "bullet_lines_per_line", None, 0.95, 60),
    Rule("ellipses", "ellipsis_lines_per_line", None, 0.5),
    Rule("alphabetic", "letter_words_per_word", 0.5, None),
)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0e0))


def _repeated_words(hashes: Column) -> Column:
    """Words inside windows that occur twice or more; ``hashes`` has one 64-bit hash per window start.

    Most texts repeat nothing, which a distinct count over the primitive array shows at once; only others sort.
    """

    def covered(pairs: Column) -> Column:
        n = F.size(pairs)
        same = lambda i, j: F.coalesce(F.get(pairs, i)["h"] == F.get(pairs, j)["h"], F.lit(False))
        starts = F.sort_array(F.transform(F.filter(pairs, lambda x, i: same(i, i - 1) | same(i, i + 1)), lambda x: x["p"]))
        return F.when(n == 0, F.lit(0)).otherwise(_bind(starts, lambda s: F.aggregate(F.transform(s, lambda p, i: F.least(F.coalesce(F.get(s, i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda a, x: a + x)))

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_bind(pairs, covered))


def _bind(value: Column, body) -> Column:
    """``body`` over ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` (without a column that starts with ``__``) and a struct ``__m`` with the counts of each whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = text
    for s in SYMBOLS:
        bare = F.replace(bare, F.lit(s), F.lit(""))
    out = docs.withColumn("__w", F.array_remove(F.split(text, SPACE), ""))
    out = out.withColumn("__l", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    words, lines = F.col("__w"), F.col("__l")
    n = F.size(words)
    out = out.withColumn("__h", F.when(n > WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))).otherwise(F.array().cast("array<bigint>")))
    count = lambda a, f: F.size(F.filter(a, f)).cast("long")
    stop = lambda w: F.lower(w).isin(*STOP_WORDS)
    m = F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(bare)).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("__h")).cast("long").alias("n_repeat_words"),
        count(words, stop).alias("n_stop"),
        count(words, lambda w: w.rlike(r"\p{L}")).alias("n_letter_words"),
        count(words, lambda w: w.rlike(r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*!!$")).alias("n_shouted"),
        count(lines, lambda x: x.rlike(r"^[\x20\x09]*[-*•]")).alias("n_bullet"),
        count(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$")).alias("n_ellipsis"),
    )
    return out.withColumn("__m", m).drop("__w", "__l", "__h")


def _ratios(m: Column) -> dict[str, Column]:
    n, lines = m["n_words"], m["n_lines"]
    return {
        "mean_word_chars": _ratio(m["word_chars"], n),
        "symbols_per_word": _ratio(m["n_symbols"], n),
        "shouted_per_word": _ratio(m["n_shouted"], n),
        "stop_words_per_word": _ratio(m["n_stop"], n),
        "letter_words_per_word": _ratio(m["n_letter_words"], n),
        "dup_lines_per_line": _ratio(m["n_dup_lines"], lines),
        "bullet_lines_per_line": _ratio(m["n_bullet"], lines),
        "ellipsis_lines_per_line": _ratio(m["n_ellipsis"], lines),
    }


def compile_rules(rules: tuple[Rule, ...] = RULES) -> list[Column]:
    """One boolean column ``fails_<rule>`` for each row of the table, over the struct ``__m``."""
    m = F.col("__m")
    ratios = _ratios(m)
    out = []
    for r in rules:
        x, bad = ratios[r.measure], F.lit(False)
        if r.low is not None:
            bad = bad | (x < F.lit(float(r.low)))
        if r.high is not None:
            bad = bad | (x > F.lit(float(r.high)))
        out.append((bad & (m["n_words"] >= r.min_words)).alias(f"fails_{r.name}"))
    return out


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs``, the measures in ``__m``, the failed rules' names in ``__fails`` and the verdict ``__kept``."""
    out = measure(docs)
    fails = F.array_compact(F.array(*[F.when(c, F.lit(r.name)) for c, r in zip(compile_rules(rules), rules, strict=True)])) if rules else F.array().cast("array<string>")
    return out.withColumn("__fails", fails).withColumn("__kept", ~base_failed(F.col("__m")) & (F.size("__fails") == 0))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that no rule rejects, with their own columns only."""
    # a column that isn't a function of its row keeps the optimizer from pushing the filter below the projection, where
    # every use of a measure would be computed anew
    (row,) = fresh(docs, "row")
    inner = docs.select(F.col("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row))
    good = judged(inner, rules).withColumn("__fence", F.monotonically_increasing_id()).filter("__kept and __fence >= 0")
    return good.select(f"{row}.*")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("__m")
    return judged(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", *[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], base_failed(m).alias("base_failed"), F.col("__kept").alias("kept"), F.array_join("__fails", ",").alias("failed_rules")
    )
