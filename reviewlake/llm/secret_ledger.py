"""Secret scan over a ledger of blobs, in DataFrame operations only.

Every version of every file is addressed by the SHA-256 of its text.  The ledger holds which (blob, rule, rule version)
pairs have been scanned, and what was found in them.  A scan reads each unseen blob once, however many paths and versions
hold it, runs only the rules that the ledger lacks for it, appends to the ledger, and joins the findings of all blobs
back to all paths.  A new rule version is scanned again; nothing else is.

Spans count code points; the end is exclusive.  Matches are leftmost and do not overlap within a kind.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlake.session import scratch_path


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds candidates; those whose ``group`` has fewer than ``least`` characters are dropped.

    ``hint`` is a cheap pattern that every text with a match holds.
    """

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    hint: str


#: The first three are the base rules, in their order.
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, "[:=]"),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, "AKIA"),
    Rule("hex", 1, r"[0-9a-f]{24,}+", 0, 24, "[0-9a-f]{24}"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]+", 0, 40, "gh[pousr]_"),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]+", 0, 20, "xox[abprs]-"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", 0, 40, "eyJ"),
    Rule("private_key", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, "PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")
SCANNED = "blob string, kind string, version int"
FINDINGS = "blob string, kind string, version int, start long, end long"


def blob_of(text: Column) -> Column:
    """Address of a text; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def create_ledger(spark: SparkSession, path: str) -> None:
    """An empty ledger: two tables below ``path``."""
    spark.createDataFrame([], SCANNED).write.parquet(f"{path}/scanned")
    spark.createDataFrame([], FINDINGS).write.parquet(f"{path}/findings")


def _current(rules: tuple[Rule, ...]) -> Column:
    ok = F.lit(False)
    for r in rules:
        ok = ok | ((F.col("kind") == r.kind) & (F.col("version") == r.version))
    return ok


def unseen(docs: DataFrame, ledger: str, text: str, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, text, kinds): each blob that lacks rules once, with the kinds to scan."""
    spark = docs.sparkSession
    known = spark.read.schema(SCANNED).parquet(f"{ledger}/scanned").where(_current(rules))
    done = known.groupBy("blob").agg(F.collect_set("kind").alias("done"))
    blobs = docs.select(blob_of(F.col(text)).alias("blob"), F.coalesce(text, F.lit("")).alias("text")).dropDuplicates(["blob"])
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    todo = F.when(F.col("done").isNull(), kinds).otherwise(F.array_except(kinds, "done"))
    return blobs.join(done, "blob", "left").select("blob", "text", todo.alias("kinds")).where(F.size("kinds") > 0)


def findings_of(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Findings of (blob, text, kinds) rows.

    Matches and the pieces between them come from one pattern; starts are running sums of their lengths, taken over rows,
    so a text with very many matches is no problem.
    """
    none = F.array().cast("array<struct<gap:int,size:int,kept:boolean>>")
    found = []
    for r in rules:
        matches = F.regexp_extract_all(F.col("text"), F.lit(r.pattern), F.lit(0))
        pieces = F.split(F.col("text"), r.pattern, -1)
        entry = F.zip_with(matches, F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda m, p: F.struct(
            F.length(p).alias("gap"), F.length(m).alias("size"),
            (F.length(F.regexp_extract(m, r.pattern, r.group)) >= r.least).alias("kept")))  # noqa: B023
        wanted = F.array_contains("kinds", r.kind) & F.col("text").rlike(r.hint) & F.col("text").rlike(r.pattern)
        found.append(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"),
                              F.when(wanted, entry).otherwise(none).alias("entries")))
    rows = blobs.select("blob", F.explode(F.array(*found)).alias("f")).where(F.size("f.entries") > 0)
    rows = rows.select("blob", "f.kind", "f.version", F.posexplode("f.entries").alias("place", "e"))
    until = Window.partitionBy("blob", "kind").orderBy("place")
    end = F.sum((F.col("e.gap") + F.col("e.size")).cast("long")).over(until)
    rows = rows.select("blob", "kind", "version", "e", end.alias("end")).where("e.kept")
    return rows.select("blob", "kind", "version", (F.col("end") - F.col("e.size")).alias("start"), "end")


def scan(docs: DataFrame, ledger: str, text: str = "text", rules: tuple[Rule, ...] = RULES) -> int:
    """Bring the ledger up to date with all texts of ``docs``; returns how many blobs were scanned.

    Findings are written before the scanned pairs, under the same run folder: a run that breaks off leaves no pair marked
    without its findings, and is simply repeated (``report`` counts equal findings once).
    """
    spark = docs.sparkSession
    new = unseen(docs, ledger, text, rules)
    fresh = scratch_path(spark, "secret-scan")
    findings = findings_of(new, rules)
    findings.write.parquet(f"{fresh}/findings")
    new.select("blob", F.explode("kinds").alias("kind")).withColumn("version", F.create_map(
        *[F.lit(x) for r in rules for x in (r.kind, r.version)])[F.col("kind")]).write.parquet(f"{fresh}/scanned")
    spark.read.schema(FINDINGS).parquet(f"{fresh}/findings").write.mode("append").parquet(f"{ledger}/findings")
    done = spark.read.schema(SCANNED).parquet(f"{fresh}/scanned")
    done.write.mode("append").parquet(f"{ledger}/scanned")
    return done.select("blob").distinct().count()


def blob_report(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans): the findings of the current rules, sorted by start, then kind in rule order."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    rows = spark.read.schema(FINDINGS).parquet(f"{ledger}/findings").where(_current(rules))
    item = F.struct("start", order[F.col("kind")].alias("rank"), "end", "kind")
    return rows.groupBy("blob").agg(F.sort_array(F.collect_set(item)).alias("spans"))


def report(docs: DataFrame, ledger: str, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents without their text, with ``blob`` and ``spans`` (array of start, rank, end, kind; empty if clean).

    A null text counts as empty; repeated rows are reported each; columns named blob or spans are replaced.
    """
    rows = docs.drop("blob", "spans").withColumn("blob", blob_of(F.col(text))).drop(text)
    found = blob_report(docs.sparkSession, ledger, rules)
    empty = F.array().cast(found.schema["spans"].dataType)
    return rows.join(found, "blob", "left").withColumn("spans", F.coalesce("spans", empty))


def joined(spans: str, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of the spans, joined by commas; of ``kinds`` only, if given."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else F.col(spans)
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
