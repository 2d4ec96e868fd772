"""License scans: ordered signature rules over a document's words.

Hundreds of hand-written regexes (``license_rules``) are gated twice: by a handful of root words over the lower-cased
text, which most documents lack, and by each rule's own keyword. Overlapping detections are resolved by priority and
containment: one that lies inside another of the same or a higher level is suppressed. The base phrases are matched
beside the rules and are never suppressed. Everything is a projection: no shuffle, no user functions.

Defined results of the odd cases
* null, empty or wordless text: ``n_words`` 0, no labels, score 0, null first and last word.
* repeated rows, equal doc_ids: each row by itself. Ties: of equal detections of one level the earlier rule stays.
* very long texts: whole; sweeps over detections go by blocks (``spans.scanned``), not by the square of their number.
* empty table: an empty result. Extra columns: not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import read
from loomgraph.llm.license_rules import rules
from loomgraph.llm.spans import bind, matches, scanned

#: Fixed by the contract: what stands between words (of a text whose A-Z may be upper case), phrases and labels.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: A text without any of these holds no keyword of any rule or base phrase.
ROOTS = ("licen", "spdx", "public", "openrail", "open rail", "creative commons", "be useful", "cc by", "cc0", "gpl", "creativecommons", "apache org", "mozilla org", "eclipse org", "gnu org", "opensource org", "mpl", "redistribut", "permission", "reserved", "confidential", "proprietary", "unauthorized", "commercial use", "commercial purposes", "academic", "no attribution", "zero clause", "terms of use", "free software foundation", "notice", "in no event", "endorse or promote", "advertising", "be used", "w3c software", "nasa open", "cc by nc", "what the fuck", "bsd zero", "1 0 universal")
_SPANS = "array<struct<start:int,until:int,level:int,rule:int,label:string>>"


def _spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def _places(norm: Column, regex: Column, level: Column, rule: Column, label: Column) -> Column:
    """Word positions: every match starts behind one blank more than it has words before it."""
    pattern = F.concat(F.lit("(?<= )(?:"), regex, F.lit(")(?= )"))
    return F.transform(matches(norm, pattern, _spaces), lambda m: F.struct((m["start"] - 1).alias("start"), m["end"].alias("until"), level.alias("level"), rule.alias("rule"), label.alias("label")))


def _unsuppressed(found: Column) -> Column:
    """Detections sorted by start, longest first, level: one is dropped if an earlier one of its level or a higher reaches as far."""
    # one that is dropped reaches no farther than what drops it, which has its level or a higher: all may count
    levels = range(4)
    zero = F.struct(*[F.lit(-1).alias(f"m{i}") for i in levels])
    add = lambda acc, d: F.struct(*[F.when(d["level"] == i, F.greatest(acc[f"m{i}"], d["until"])).otherwise(acc[f"m{i}"]).alias(f"m{i}") for i in levels])
    join = lambda a, b: F.struct(*[F.greatest(a[f"m{i}"], b[f"m{i}"]).alias(f"m{i}") for i in levels])

    def kept(sweep: Column) -> Column:
        reach = lambda d, m: F.greatest(*[F.when(d["level"] >= i, m[f"m{i}"]).otherwise(F.lit(-1)) for i in levels])
        return bind(scanned(sweep, zero, "struct<m0:int,m1:int,m2:int,m3:int>", add, join), lambda m: F.filter(sweep, lambda d, i: reach(d, F.get(m, i)) < d["until"]))

    order = F.transform(found, lambda d: F.struct(d["start"].alias("start"), (-d["until"]).alias("neg"), d["level"].alias("level"), d["rule"].alias("rule"), d["label"].alias("label")))
    back = F.transform(F.sort_array(order), lambda d: F.struct(d["start"].alias("start"), (-d["neg"]).alias("until"), d["level"].alias("level"), d["rule"].alias("rule"), d["label"].alias("label")))
    return bind(back, kept)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, ``base`` and ``found``: arrays of struct<start, until, level, rule, label> in words."""
    table = F.array(*[F.struct(F.lit(lv).alias("level"), F.lit(lb).alias("label"), F.lit(kw).alias("keyword"), F.lit(rx).alias("regex"), F.lit(i).alias("rule")) for i, (lv, lb, kw, rx) in enumerate(rules())])
    none = F.array().cast(_SPANS)
    words = F.array_remove(F.split(F.coalesce(F.col("text"), F.lit("")), GAP), "")
    out = docs.select("doc_id", words.alias("__w"))
    joined = F.concat(F.lit(" "), F.array_join("__w", " "), F.lit(" "))
    out = out.select("doc_id", F.size("__w").cast("long").alias("n_words"), joined.alias("__joined"))
    gate = F.lit(False)
    for r in ROOTS:
        gate = gate | F.contains(F.col("__low"), F.lit(r))
    out = out.withColumn("__low", F.lower("__joined")).withColumn("__norm", F.when(gate, F.translate("__joined", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))).select("doc_id", "n_words", "__norm")
    norm = F.col("__norm")
    base = F.concat(*[F.when(F.contains(norm, F.lit(f" {p} ")), _places(norm, F.lit(p), F.lit(0), F.lit(-1), F.lit(lb))).otherwise(none) for p, lb in BASE])
    tried = F.filter(table, lambda r: F.contains(norm, F.concat(F.lit(" "), r["keyword"], F.lit(" "))))
    found = F.flatten(F.transform(tried, lambda r: _places(norm, r["regex"], r["level"], r["rule"], r["label"])))
    resolved = bind(found, lambda f: F.when(F.size(f) > 0, _unsuppressed(f)).otherwise(none))
    return out.select("doc_id", "n_words", F.when(norm.isNull(), none).otherwise(base).alias("base"), F.when(norm.isNull(), none).otherwise(resolved).alias("found"))


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(read(spark, sf_dir, "documents"))
    labels = lambda c: F.array_join(F.sort_array(F.array_distinct(F.transform(c, lambda d: d["label"]))), ",")
    starts = F.transform("base", lambda d: d["start"])
    longest = F.array_max(F.transform(F.concat("base", "found"), lambda d: F.least(F.lit(1e0), (d["until"] - d["start"]).cast("double") / (4 + 2 * d["level"]))))
    return out.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        labels(F.col("base")).alias("base_labels"),
        labels(F.concat("base", "found")).alias("labels"),
        F.round(F.coalesce(longest, F.lit(0e0)), 6).alias("score"),
        F.size("found").cast("long").alias("n_found"),
    )
