"""Secret scans with corpus-wide ownership frequency.

Candidates are found by regexes inside each document. Every candidate's value is hashed, and the hashes are aggregated
over the corpus by distinct repositories and owners: a value many owners hold is a copied example (a documentation
key, a fixture), one that a single owner holds and that looks random is treated as a live credential. Only hashes,
never values, are shuffled. Distinct (hash, owner, repository) triples are taken first, with map-side combining, so a
value in a third of all documents costs one row for each task and owner.

Everything is Spark expressions: positions come from the lengths between matches (``spans.matches``).

Defined results of the odd cases
* null or empty text: no spans, ``base_sha256`` of the empty string. null doc_id: a row of its own.
* repeated rows: each row of the input gives a row; repeated ones are alike and count once in ownership.
* null owner or repository: counts as one owner (repository) named null.
* overlapping kinds: each kind is matched by itself, spans of several kinds may overlap; an added span never equals
  or lies inside a base span. Very long texts: whole. Empty table: an empty result. Extra columns: not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import cut, read
from loomgraph.llm.spans import matches

#: Fixed by the contract: kinds in order, with what a match must have.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HEAD = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
#: Detectors of this operator's own: name, regex and a substring that a text must have for the regex to be tried.
EXTRA = (
    ("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END [A-Z ]{0,30}PRIVATE KEY-----)?", "PRIVATE KEY"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "eyJ"),
    ("vendor", r"(?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{30,}|sk_live_[A-Za-z0-9]{16,}|glpat-[A-Za-z0-9_-]{16,})", "_- "),
    ("url", r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,64}:[^\s:/@]{3,64}@[A-Za-z0-9.-]+", "://"),
)
KINDS = ("assign", "access", "hex", *(e[0] for e in EXTRA))
#: A value held by this many owners or more is a copied example.
COPIED_OWNERS = 3
#: Fewest different characters of a value that looks live.
LIVE_CHARS = 8

_EMPTY = "array<struct<start:int,k:int,end:int,value:string>>"


def _kind(found: Column, k: int, value=lambda m: m["text"]) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(k).cast("int").alias("k"), m["end"].alias("end"), value(m).alias("value")))


def _when(gate: Column, spans: Column) -> Column:
    return F.when(gate, spans).otherwise(F.array().cast(_EMPTY))


def candidates(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__spans``: array<struct<start, k, end, value>> sorted by start, then kind; k indexes KINDS."""
    text, low = F.col("__text"), F.lower(F.col("__text"))
    worded = F.contains(low, F.lit("passw")) | F.contains(low, F.lit("secret")) | F.contains(low, F.lit("token")) | F.contains(low, F.lit("api"))
    assign = _kind(matches(text, F.lit(ASSIGN)), 0, lambda m: F.regexp_replace(m["text"], ASSIGN_HEAD, ""))
    base = [
        _when(worded, F.filter(assign, lambda s: F.length(s["value"]) >= 6)),
        _when(F.contains(text, F.lit("AKIA")), _kind(matches(text, F.lit(ACCESS)), 1)),
        _when(text.rlike(HEX), _kind(matches(text, F.lit(HEX)), 2)),
    ]
    extra = []
    for i, (name, regex, need) in enumerate(EXTRA):
        gate = text.rlike(regex) if name == "vendor" else F.contains(text, F.lit(need))
        extra.append(_when(gate, _kind(matches(text, F.lit(regex)), 3 + i)))
    out = docs.withColumn("__text", F.coalesce(F.col("text"), F.lit(""))).withColumn("__base", F.concat(*base)).withColumn("__extra", F.concat(*extra)).drop("__text")
    own = F.filter("__extra", lambda e: ~F.exists(F.col("__base"), lambda b: (b["start"] <= e["start"]) & (e["end"] <= b["end"])))
    return out.withColumn("__spans", F.when((F.size("__base") > 0) | (F.size("__extra") > 0), F.sort_array(F.concat("__base", own))).otherwise(F.array().cast(_EMPTY))).drop("__base", "__extra")


def ownership(found: DataFrame, owner: str, repository: str) -> DataFrame:
    """hash, n_owners, n_repositories of every candidate value of ``found`` (columns hash, owner, repository)."""
    each = found.select("hash", F.struct(owner).alias("o"), F.struct(repository, owner).alias("r")).distinct()
    by_owner = each.groupBy("hash", "o").agg(F.count("*").alias("n"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))


def scan(docs: DataFrame, owner: str = "source", repository: str = "lang") -> DataFrame:
    """One row for each row of ``docs``: doc_id, ``spans`` (array of kind, start, end) and the spans of live values.

    A repository is the pair of its owner and the column ``repository``.
    """
    found = candidates(docs.select("doc_id", "text", F.col(owner).alias("owner"), F.col(repository).alias("repository"))).drop("text")
    # texts are matched once; what follows reads spans only
    keyed = cut(found.withColumn("__key", F.xxhash64("doc_id", F.to_json("__spans"))), "spans")
    each = keyed.filter(F.size("__spans") > 0).select("doc_id", "__key", "owner", "repository", F.explode("__spans").alias("s")).distinct()
    each = each.select("doc_id", "__key", "owner", "repository", "s.start", "s.k", "s.end", F.sha2("s.value", 256).alias("hash"), F.size(F.array_distinct(F.split("s.value", ""))).alias("n_chars"))
    freq = ownership(each, "owner", "repository")
    judged = each.join(freq, "hash").withColumn("copied", F.col("n_owners") >= COPIED_OWNERS)
    per_doc = judged.groupBy("doc_id", "__key").agg(
        F.count_if("copied").alias("n_copied"),
        F.sort_array(F.collect_set(F.when(~F.col("copied") & (F.col("n_chars") >= LIVE_CHARS), F.struct("start", "k", "end")))).alias("live"),
        F.max("n_owners").alias("most_owners"),
    )
    left, right = keyed.alias("l"), per_doc.alias("r")
    on = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.__key") == F.col("r.__key"))
    return left.join(right, on, "left").select("l.doc_id", F.col("l.__spans").alias("spans"), F.coalesce("r.n_copied", F.lit(0)).alias("n_copied"), F.coalesce("r.live", F.array().cast("array<struct<start:int,k:int,end:int>>")).alias("live"), F.coalesce("r.most_owners", F.lit(0)).alias("most_owners"))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"], s["end"])), ",")


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(read(spark, sf_dir, "documents"))
    n = lambda k: F.size(F.filter("spans", lambda s: s["k"] == k)).cast("long")
    return out.select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(_joined(F.filter("spans", lambda s: s["k"] < 3)), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        F.col("n_copied").cast("long").alias("n_copied"),
        F.size("live").cast("long").alias("n_live"),
        _joined(F.col("live")).alias("live_spans"),
        F.col("most_owners").cast("long").alias("most_owners"),
    )
