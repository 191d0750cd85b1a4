"""Merge rule findings and model findings of the same file.

The merge is greedy and depends on order: the rule findings are the first candidates; each model
finding, in order, attaches to the first similar candidate or becomes the last candidate itself.
``assignments`` computes who attaches to whom; the merge variants only differ in how they put the
text together afterwards.

Inputs: rule findings with ``ordinal``, model findings with a whole-number ``ordinal`` unique per
file; both with ``keys``, severity, category, message, suggestion, line_number, and for model
findings ``reasoning``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlake.functions.similarity import MIN_OVERLAP, distinct_words, features, is_similar, rarest_first, word_rarity
from reviewlake.operators.holders import greedy, noted
from reviewlake.session import cut_lineage

KEYS = ("run_id", "path")


def _candidates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(
        *keys,
        F.col("ordinal").cast("long").alias("ordinal"),
        features(F.col("message"), F.col("line_number"), F.col("category")).alias("f"),
    )


def _item(is_model: int) -> Column:
    return F.struct(F.lit(is_model).alias("model"), "ordinal", "f")


def _first_similar(candidates: Column, finding: Column) -> Column:
    """First similar candidate of an ordered array, or NULL."""
    return F.get(F.filter(candidates, lambda c: is_similar(c["f"], finding["f"])), F.lit(0))


def _with_class(df: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates with the class of findings that have the same features (``cls``)."""
    # No word holds a blank or a line feed, so no two different classes have one text.
    same = F.concat_ws(" ", F.col("f.line"), F.col("f.keywords"), F.sort_array("f.words"))
    category = F.coalesce(F.concat(F.lit("\n="), "f.category"), F.lit("\n-"))
    # Never NULL, as Spark can see: a join needs no test for NULL, which would compute the features once more.
    return _candidates(df, keys).withColumn("cls", F.coalesce(F.sha2(F.concat(same, category), 256), F.lit("")))


TARGET = T.StructType([T.StructField("target_model", T.IntegerType()), T.StructField("target", T.LongType())])
CONTENT = ["severity", "message", "line_number", "suggestion", "reasoning"]
BASE = ["severity", "category", "message", "line_number", "suggestion", "reasoning"]


def _sorted_findings(rules: DataFrame, models: DataFrame, keys: list[str], content: list[str]) -> tuple[DataFrame, bytes]:
    """Rows for :func:`holders.greedy`, a file's in one partition in order, and the rarity of their words.

    Files without a name have no findings to merge.
    """
    def said(df: DataFrame, kind: int) -> DataFrame:
        others = [(F.col(c) if kind else F.lit(None).cast(models.schema[c].dataType)).alias(f"_{c}") for c in content]
        return df.where(F.concat(*keys).isNotNull()).select(
            *keys, F.lit(kind).alias("kind"), F.col("ordinal").cast("long").alias("ordinal"),
            F.coalesce("message", F.lit("")).alias("said"), "line_number", "category", *others)

    known, found = said(rules, 0), said(models, 1)
    texts = known.select("said").unionByName(found.select("said")).groupBy("said").agg(F.count("*").alias("times"))
    rarity = word_rarity(texts.select(F.struct(distinct_words(F.lower("said")).alias("words")).alias("f"), "times"), F.col("times"))
    both = known.unionByName(found).withColumn("f", features(F.col("said"), F.col("line_number"), F.col("category")))
    rows = both.select(*keys, "kind", "ordinal", "f.line", "f.keywords", "category", F.array_join("f.words", " ").alias("words"),
                       *[F.col(f"_{c}").alias(c) for c in content])
    return rows.repartition(*keys).sortWithinPartitions(*keys, "kind", "ordinal"), rarity


def _placed_fields(rows: DataFrame) -> T.StructType:
    left_out = ("kind", "line", "keywords", "words")
    return T.StructType([*(f for f in rows.schema.fields if f.name not in left_out), *TARGET.fields])


def assignments(rules: DataFrame, models: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Per model finding: ``target_model`` (0 rule, 1 model) and ``target`` ordinal it belongs to.

    A finding that becomes a candidate has itself as target.  A file's findings pass through one task in order, which
    holds a first-holder index of the candidates (see :mod:`holders`) and no rows.
    """
    rows, rarity = _sorted_findings(rules, models, list(keys), [])
    placed = rows.mapInArrow(greedy(list(keys), rarity), _placed_fields(rows))
    return placed.select(*keys, "ordinal", "target_model", "target")


def _merged(rules: DataFrame, models: DataFrame, keys: list[str], note: str = "\n\nAI Analysis: ") -> DataFrame:
    """One row per merged finding, whatever their number: the notes of attached findings follow its suggestion in order.

    The pass of :func:`assignments` hands on the findings that become issues, and the notes of the others one list
    per finding and batch, so only these are shuffled again.
    """
    rows, rarity = _sorted_findings(rules, models, keys, CONTENT)
    fields = {f.name: f for f in _placed_fields(rows).fields}
    base = T.StructType([*(fields[c] for c in BASE), T.StructField("is_model", T.IntegerType())])
    notes = T.ArrayType(T.StructType([fields["ordinal"], fields["reasoning"]]))
    schema = T.StructType([*(fields[k] for k in keys), *TARGET.fields, T.StructField("base", base), T.StructField("notes", notes)])
    place, gather = greedy(keys, rarity), noted(keys, BASE, schema.names)
    found = rows.mapInArrow(lambda batches: gather(place(batches)), schema)
    own = {"reasoning": F.lit(None), "is_model": F.lit(0)}
    seed = rules.select(
        *keys, F.lit(0).alias("target_model"), F.col("ordinal").cast("long").alias("target"),
        F.struct(*[(own[f.name] if f.name in own else F.col(f.name)).cast(f.dataType).alias(f.name) for f in base]).alias("base"),
        F.lit(None).cast(notes).alias("notes"))
    issues = seed.unionByName(found).groupBy(*keys, "target_model", "target").agg(
        F.max("base").alias("base"), F.flatten(F.collect_list("notes")).alias("all"))
    said = F.array_sort(F.filter("all", lambda n: F.coalesce(n["reasoning"], F.lit("")) != ""))
    return issues.withColumn("said", said).select(
        *keys, "target_model", "target", "base", F.size("all").cast("long").alias("attached"),
        F.try_element_at("said", F.lit(-1))["reasoning"].alias("last_reasoning"),
        F.array_join(F.transform("said", lambda n: F.concat(F.lit(note), n["reasoning"])), "").alias("notes"))


def merge_findings(rules: DataFrame, models: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Merged findings: a similar model finding adds its reasoning to the finding it attaches to.

    Order within a file: ``target_model``, ``ordinal`` (rule findings first).
    """
    keys = list(keys)
    merged = _merged(rules, models, keys)
    return merged.select(
        *keys, "target_model", F.col("target").alias("ordinal"),
        "base.severity", "base.category", "base.message", "base.line_number",
        F.concat(F.coalesce("base.suggestion", F.lit("")), "notes").alias("suggestion"),
        F.coalesce("last_reasoning", "base.reasoning").alias("reasoning"),
        F.col("attached").alias("merged_count"),
    )


def merge_findings_tagged(rules: DataFrame, models: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The interactive variant: tags each finding internal, external or both and keeps no reasoning field."""
    keys = list(keys)
    merged = _merged(rules, models, keys)
    own = F.col("base.reasoning")
    added = F.when(F.coalesce(own, F.lit("")) != "", F.concat(F.lit("\n\nReasoning: "), own)).otherwise("")
    return merged.select(
        *keys, "target_model", F.col("target").alias("ordinal"),
        "base.severity", "base.category", "base.message", "base.line_number",
        F.concat(F.coalesce("base.suggestion", F.lit("")), added, "notes").alias("suggestion"),
        F.when(F.col("attached") > 0, "both").when(F.col("base.is_model") == 0, "internal")
        .otherwise("external").alias("validation_source"),
    )


def merge_batch_findings(rules: DataFrame, models: DataFrame, files: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Batch variant: a model finding matches on (line or no line, category ignoring case).

    That key is an equivalence, so the first finding per key takes all later model findings and the
    merge is one partial aggregation.  Model findings of files that are not under review are dropped.
    """
    keys = list(keys)
    match = [*keys, "match_line", "match_category"]
    columns = ["severity", "category", "message", "line_number", "suggestion"]
    seed = rules.select(*keys, F.lit(0).alias("is_model"), F.col("ordinal").cast("long").alias("ordinal"), *columns,
                        F.lit(None).cast("string").alias("reasoning"))
    known = models.join(files.select(*keys).distinct(), keys, "left_semi")
    both = seed.unionByName(
        known.select(*keys, F.lit(1).alias("is_model"), F.col("ordinal").cast("long").alias("ordinal"), *columns, "reasoning")
    ).withColumns({"match_line": F.col("line_number"), "match_category": F.lower("category")})
    place = F.struct("is_model", "ordinal")
    groups = both.groupBy(*match).agg(
        F.min(place).alias("first"),
        F.min(F.struct("is_model", "ordinal", *columns, "reasoning")).alias("base"),
        F.sum("is_model").alias("model_rows"),
        F.max_by("reasoning", F.when((F.col("is_model") == 1) & (F.col("reasoning") != ""), F.col("ordinal"))).alias("last"),
    )
    attached = F.col("model_rows") - F.col("base.is_model")
    heads = groups.select(
        *keys, "base.is_model", "base.ordinal", *[f"base.{c}" for c in columns],
        F.when(attached > 0, F.coalesce("last", "base.reasoning")).otherwise(F.col("base.reasoning")).alias("reasoning"),
        F.when(attached > 0, "both").when(F.col("base.is_model") == 0, "pattern").otherwise("ai").alias("source"),
    )
    # Further rule findings with the same key stay as they are.
    first = groups.where("first.is_model = 0").select(
        *[F.col(c).alias(f"_{c}") for c in match], F.col("first.ordinal").alias("head"))
    same = F.col("line_number").eqNullSafe(F.col("_match_line")) & F.lower("category").eqNullSafe(F.col("_match_category"))
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    more = seed.join(first, same).where(F.col("ordinal") != F.col("head"))
    return heads.unionByName(more.select(*keys, "is_model", "ordinal", *columns, "reasoning", F.lit("pattern").alias("source")))


def first_similar_rule(rules: DataFrame, models: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """For each model finding, the first similar rule finding of the same file, if any.

    A file has at most one finding per rule, so the rule side is one short array per file; the
    model side is only probed, no pair is materialised.
    """
    keys = list(keys)
    known = _candidates(rules, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(_item(0))).alias("known"))
    probed = _candidates(models, keys).join(known, keys, "left")
    hit = F.when(F.col("known").isNotNull(), _first_similar(F.col("known"), F.struct("f")))
    return probed.withColumn("hit", hit).select(
        *keys, "ordinal", F.col("hit.ordinal").alias("similar_rule"), F.col("hit").isNotNull().alias("is_similar")
    )


def similar_links(rules: DataFrame, models: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """All similar pairs among the findings of a file, as classes with link counts; one row per finding.

    Findings with equal features are one class (``class_kind``, ``class_ordinal``: its first finding; ``members``: its size).  ``links``
    is the number of other findings that are similar.  A shared line or keyword is counted from totals per line and
    per keyword set, so their cliques are never paired; only classes that are similar by their words alone meet, in a
    join on the rarest words of each (the words that an overlap above 60 % has to touch).
    """
    keys = list(keys)
    both = _with_class(rules, keys).withColumn("kind", F.lit(0)).unionByName(_with_class(models, keys).withColumn("kind", F.lit(1)))
    rarity = word_rarity(both)
    classes = cut_lineage(both.groupBy(*keys, "cls").agg(
        F.min(F.struct("kind", "ordinal")).alias("head"), F.first("f").alias("f"), F.count("*").alias("members")
    ).select(*keys, "cls", "head", "members", "f.line", "f.keywords", F.coalesce(F.concat(F.lit("="), "f.category"), F.lit("-")).alias("category"),
             rarest_first(F.col("f.words"), rarity).alias("words")))

    def totals(part: DataFrame, by: list[str], meet: Column, name: str) -> DataFrame:
        """Findings that meet each keyword set within ``by``: few sets per file or line, whatever the number of findings."""
        sets = part.groupBy(*by, "keywords").agg(F.sum("members").alias("n"))
        other = sets.withColumnsRenamed({"keywords": "other", "n": "other_n"})
        return sets.join(other, by).where(meet).groupBy(*by, "keywords").agg(F.sum("other_n").alias(name))

    shared = F.col("keywords").bitwiseAND(F.col("other"))
    on_keyword = totals(classes.where("keywords <> 0"), keys, shared != 0, "on_keyword")
    on_line = totals(classes.where("line <> 0"), [*keys, "line"], shared == 0, "on_line")

    size = F.size("words")
    prefix = F.slice("words", F.lit(1), size - F.floor(size * 3 / 5).cast("int"))
    posted = classes.select(*keys, "category", "cls", "members", "line", "keywords", "words", prefix.alias("prefix"))
    posted = posted.withColumn("word", F.explode("prefix"))
    mine = ["cls", "members", "line", "keywords", "words", "prefix"]
    other = posted.withColumnsRenamed({c: f"other_{c}" for c in mine})
    met = posted.join(other, [*keys, "category", "word"]).where(
        (F.col("cls") < F.col("other_cls"))
        & ((F.col("line") == 0) | (F.col("line") != F.col("other_line"))) & (F.col("keywords").bitwiseAND(F.col("other_keywords")) == 0)
        # A pair meets under each shared prefix word: the first one counts.
        & (F.get(F.array_intersect("prefix", "other_prefix"), F.lit(0)) == F.col("word"))
        & (F.size(F.array_intersect("words", "other_words")) / F.greatest(F.size("words"), F.size("other_words")) > MIN_OVERLAP))
    ends = F.explode(F.array(F.struct(F.col("cls"), F.col("other_members").alias("n")), F.struct(F.col("other_cls").alias("cls"), F.col("members").alias("n"))))
    on_words = met.select(*keys, ends.alias("e")).groupBy(*keys, F.col("e.cls").alias("cls")).agg(F.sum("e.n").alias("on_words"))

    linked = classes.join(on_keyword, [*keys, "keywords"], "left").join(on_line, [*keys, "line", "keywords"], "left").join(on_words, [*keys, "cls"], "left")
    own = F.when((F.col("line") == 0) & (F.col("keywords") == 0), F.col("members")).otherwise(0)
    zero = lambda c: F.coalesce(c, F.lit(0))
    linked = linked.select(*keys, "cls", F.col("head.kind").alias("class_kind"), F.col("head.ordinal").alias("class_ordinal"), "members",
                           (own + zero("on_keyword") + zero("on_line") + zero("on_words") - 1).alias("links"))
    return both.select(*keys, "kind", "ordinal", "cls").join(linked, [*keys, "cls"]).drop("cls")


def llm_findings_exact(rules: DataFrame, models: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Model findings whose message is not exactly the message of a rule finding of the same file."""
    said = rules.select(*keys, "message").distinct()
    return models.join(said, [*keys, "message"], "left_anti")


def all_findings(rules: DataFrame, models: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Rule findings and model findings in one table."""
    columns = [*keys, "ordinal", "severity", "category", "message", "suggestion", "line_number"]
    rule_rows = rules.select(*columns, F.lit(None).cast("string").alias("reasoning"), F.lit("validation").alias("kind"))
    return rule_rows.unionByName(models.select(*columns, "reasoning", F.lit("llm").alias("kind")))


def notes_union(first: Column, second: Column, dedupe: bool = True) -> Column:
    """Strengths or recommendations of two sources: without duplicates (interactive) or appended (batch)."""
    return F.array_union(first, second) if dedupe else F.concat(first, second)
