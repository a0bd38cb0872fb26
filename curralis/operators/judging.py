"""What the runs' batches place and relate, seen in a chain or each alone, and the comparison of reviewers, annotation and batches.

Batches are tables: nodes (run_id, ordinal, key, label, name) and edges (run_id, ordinal, type, source, target).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curralis.functions.text import normalize_label
from curralis.operators.evaluate import MANDATORY, MAX_ATTEMPTS, THRESHOLD, attempts, gold_names, mandatory_notions, ratio

JUDGED = ("Topic", "Concept")


def walk(nodes: DataFrame, edges: DataFrame, runs: DataFrame, reference: DataFrame, isolated: bool = False) -> DataFrame:
    """(run_id, place, key, label, name, related, unknown): what every run's batch reaches, in the order of the batch.

    First its nodes, then what only its edges name. related: reached by edges, but by none of partonomy; the others are the run's
    items. What only an edge names has the name that the reference layer (key, label, name) or, in a chain, the last accepted
    earlier run (runs: run_id, accepted) gave it; unknown: neither did. An as-of lookup by a window over each key, no join of runs.
    """
    ends = edges.select("run_id", "type", F.posexplode(F.array("source", "target")).alias("side", "key"), "ordinal")
    ends = ends.groupBy("run_id", "key").agg(F.min(2 * F.col("ordinal") + F.col("side")).alias("at"), F.max((F.col("type") == "PART_OF").cast("int")).alias("placed"))
    reached = nodes.join(ends, ["run_id", "key"], "full").join(runs.select("run_id", "accepted"), "run_id")
    base = reference.select("key", F.struct("label", "name").alias("base"))
    named = F.when(F.col("label").isNotNull(), F.struct("label", "name"))
    if not isolated:
        earlier = Window.partitionBy("key").orderBy("run_id").rangeBetween(Window.unboundedPreceding, -1)
        reached = reached.withColumn("before", F.last(F.when(F.col("accepted"), named), ignorenulls=True).over(earlier))
    else:
        reached = reached.withColumn("before", F.lit(None).cast("struct<label: string, name: string>"))
    what = F.coalesce(named, F.col("before"), F.col("base"))
    rows = reached.join(base, "key", "left").withColumn("what", what)
    place = F.row_number().over(Window.partitionBy("run_id").orderBy(F.col("ordinal").asc_nulls_last(), "at", "key"))
    rows = rows.select("run_id", place.alias("place"), "key", "what.label", "what.name", (F.coalesce("placed", F.lit(1)) == 0).alias("related"), F.col("what").isNull().alias("unknown"))
    return rows.filter(F.col("label").isin(*JUDGED) | F.col("unknown"))


def created(nodes: DataFrame, runs: DataFrame) -> DataFrame:
    """(key, run_id): the first accepted run that names a node created it."""
    return nodes.join(runs.filter("accepted").select("run_id"), "run_id", "left_semi").groupBy("key").agg(F.min("run_id").alias("run_id"))


def judged_runs(runs: DataFrame, syllabi: DataFrame) -> DataFrame:
    """(run_id, syllabus, role) of runs (run_id, syllabus, accepted) in a chain: measured, rejected (before the accepted one), late or no test case."""
    first = runs.filter("accepted").groupBy("syllabus").agg(F.min("run_id").alias("first"))
    rows = runs.join(first, "syllabus", "left").join(syllabi.select("syllabus", F.lit(True).alias("case")), "syllabus", "left")
    role = F.when(F.col("case").isNull(), "no test case").when(F.col("run_id") > F.col("first"), "late").when(F.col("accepted"), "measured").otherwise("rejected")
    return rows.select("run_id", "syllabus", role.alias("role"))


def warnings(runs: DataFrame, syllabi: DataFrame) -> DataFrame:
    """(warning, run_id, syllabus) of a chain of runs (run_id, syllabus, accepted): accepted ones of no test case, runs after the accepted one of
    theirs, syllabi that needed more than MAX_ATTEMPTS, and test cases without any run, which leave no verdict."""
    told = judged_runs(runs, syllabi).join(runs.select("run_id", "accepted"), "run_id")
    rows = told.select(F.when((F.col("role") == "no test case") & F.col("accepted"), "no test case").when(F.col("role") == "late", "late").alias("warning"), "run_id", "syllabus").filter("warning IS NOT NULL")
    many = attempts(runs).join(syllabi.select("syllabus"), "syllabus", "left_semi").filter(F.col("attempts") > MAX_ATTEMPTS).select(F.lit("attempts").alias("warning"), "run_id", "syllabus")
    none = syllabi.select("syllabus").distinct().join(runs, "syllabus", "left_anti").select(F.lit("not run").alias("warning"), F.lit(None).cast(runs.schema["run_id"].dataType).alias("run_id"), "syllabus")
    return rows.unionByName(many).unionByName(none)


def verdict_of(measures: DataFrame, runs: DataFrame, syllabi: DataFrame) -> DataFrame:
    """(precision, complete, passes) of all measures (hits, proposed); passes is null unless every test case has a run."""
    open_ = syllabi.select("syllabus").distinct().join(runs, "syllabus", "left_anti").agg((F.count("*") == 0).alias("complete"))
    sums = measures.agg(ratio(F.sum("hits"), F.sum("proposed")).alias("precision"))
    return sums.join(open_, F.lit(True)).withColumn("passes", F.when(F.col("complete"), F.col("precision") >= THRESHOLD))  # two single rows


def attempts_in(runs: DataFrame, written: DataFrame, first: int, last: int | None = None) -> DataFrame:
    """(run_id, syllabus, accepted) of the runs (run_id, syllabus, state) of a window that left something to judge: stored facts (written: run_id) or a rejection."""
    rows = runs.filter(F.col("run_id") >= first) if last is None else runs.filter(F.col("run_id").between(first, last))
    rows = rows.join(written.select("run_id", F.lit(True).alias("accepted")), "run_id", "left")
    return rows.filter("accepted OR state = 'rejected'").select("run_id", "syllabus", F.coalesce("accepted", F.lit(False)).alias("accepted"))


def with_related(measures: DataFrame) -> DataFrame:
    """measures (hits, proposed, related, related_hits) with precision_with_related: if what is only related were items. A diagnostic."""
    return measures.withColumn("precision_with_related", ratio(F.col("hits") + F.col("related_hits"), F.col("proposed") + F.col("related")))


def misses(matched: DataFrame, items: DataFrame, gold: DataFrame) -> tuple[DataFrame, DataFrame]:
    """False positives (run_id, syllabus, ordinal, label) and missed mandatory notions (run_id, syllabus, global_id, entry_id) of matched (run_id, syllabus, ordinal, entry_id)."""
    false = items.join(matched, ["run_id", "syllabus", "ordinal"], "left_anti").select("run_id", "syllabus", "ordinal", "label")
    got = matched.join(gold.select("syllabus", "entry_id", "global_id"), ["syllabus", "entry_id"]).select("run_id", "syllabus", "global_id").distinct()
    due = items.select("run_id", "syllabus").distinct().join(mandatory_notions(gold), "syllabus")
    return false, due.join(got, ["run_id", "syllabus", "global_id"], "left_anti").select("run_id", "syllabus", "global_id", "entry_id")


def fusion_counts(matched: DataFrame, compound: DataFrame, held_out: DataFrame) -> DataFrame:
    """One row of counts over matched (node, label, global_id): notions doubled within a class, surplus nodes, notions split over classes,
    nodes of several notions, excepted where compound notions (global_id) aside one is left; with held_out nodes (node) counted apart."""
    pairs = matched.select("node", "label", "global_id").distinct().join(held_out.select("node", F.lit(1).alias("held")).distinct(), "node", "left").join(compound.select("global_id", F.lit(1).alias("compound")).distinct(), "global_id", "left")
    holders = pairs.groupBy("global_id", "label").agg(F.count("*").alias("n"), F.max(F.coalesce("held", F.lit(0))).alias("held"))
    notions = holders.groupBy("global_id").agg(F.count("*").alias("classes"), F.max((F.col("n") > 1).cast("int")).alias("twice"), F.sum(F.when(F.col("n") > 1, F.col("n") - 1).otherwise(0)).alias("surplus"), F.max(F.when(F.col("n") > 1, F.col("held")).otherwise(0)).alias("held"))
    one = notions.agg(F.coalesce(F.sum("twice"), F.lit(0)).alias("duplicated_notions"), F.coalesce(F.sum("surplus"), F.lit(0)).alias("surplus_nodes"), F.count_if(F.col("classes") > 1).alias("split_notions"), F.count_if((F.col("twice") == 1) & (F.col("held") == 1)).alias("duplicated_with_held_out"))
    nodes = pairs.groupBy("node").agg(F.count("*").alias("n"), F.count_if(F.col("compound").isNull()).alias("plain"), F.max(F.coalesce("held", F.lit(0))).alias("held"))
    wrong = (F.col("n") > 1) & (F.col("plain") != 1)
    two = nodes.agg(F.count("*").alias("nodes_with_hits"), F.count_if(wrong).alias("wrong_fusions"), F.count_if((F.col("n") > 1) & (F.col("plain") == 1)).alias("excepted_fusions"), F.count_if(wrong & (F.col("held") == 1)).alias("wrong_with_held_out"))
    return one.join(two, F.lit(True))  # two single rows


def compare_review(gold: DataFrame, rows: DataFrame) -> DataFrame:
    """Per syllabus the reviewer's rows (syllabus, row_no, name, kind) against the annotation, both ways, by normalised name; counts, no shares."""
    seen = rows.withColumn("norm", normalize_label(F.col("name")))
    by = seen.groupBy("syllabus", "norm").agg(F.min_by(F.lower(F.trim("kind")), "row_no").alias("kind"), F.count("*").alias("rows"))
    called = gold.select("syllabus", "global_id", F.col("kind").alias("gold_kind")).distinct().join(gold_names(gold).withColumnRenamed("name", "norm"), "global_id")
    met = by.join(called, ["syllabus", "norm"])
    one = met.groupBy("syllabus", "norm").agg(F.first("kind").alias("kind"), F.max((F.col("kind") == F.col("gold_kind")).cast("int")).alias("same"))
    typed = F.col("kind").isin("tema", "concepto")
    registered = one.groupBy("syllabus").agg(F.count("*").alias("registered"), F.count_if(typed).alias("typed"), F.count_if(typed & (F.col("same") == 1)).alias("agreeing"))
    notions = gold.select("syllabus", "global_id").distinct().join(mandatory_notions(gold).select("syllabus", "global_id", F.lit(True).alias("must")), ["syllabus", "global_id"], "left")
    notions = notions.join(met.select("syllabus", "global_id", F.lit(True).alias("got")).distinct(), ["syllabus", "global_id"], "left")
    must, got = F.col("must").isNotNull(), F.col("got").isNotNull()
    of = notions.groupBy("syllabus").agg(F.count("*").alias("notions"), F.count_if(got).alias("extracted"), F.count_if(must).alias("mandatory"), F.count_if(must & got).alias("mandatory_extracted"))
    out = by.groupBy("syllabus").agg(F.count("*").alias("names"), (F.sum("rows") - F.count("*")).alias("repeated_rows")).join(of, "syllabus").join(registered, "syllabus", "left").na.fill(0)
    return out.withColumn("acceptable", F.col("notions") - F.col("mandatory")).withColumn("acceptable_extracted", F.col("extracted") - F.col("mandatory_extracted"))


def adjudicated(discrepancies: DataFrame, decisions: DataFrame) -> DataFrame:
    """(syllabus, side, category, n) of discrepancies (syllabus, side, name) under decisions (syllabus, side, name, category); without a category: pending."""
    rows = discrepancies.join(decisions.groupBy("syllabus", "side", "name").agg(F.max("category").alias("category")), ["syllabus", "side", "name"], "left")
    return rows.groupBy("syllabus", "side", F.coalesce(F.when(F.col("category") != "", F.col("category")), F.lit("pending")).alias("category")).agg(F.count("*").alias("n"))


def pipeline_against_review(items: DataFrame, rows: DataFrame, paired: DataFrame | None = None) -> DataFrame:
    """(syllabus, items, registered, share) of items (syllabus, key, name) that the reviewer's rows (syllabus, name) or a decision (paired: syllabus, key) have."""
    said = rows.select("syllabus", normalize_label(F.col("name")).alias("norm"), F.lit(True).alias("said")).distinct()
    found = items.withColumn("norm", normalize_label(F.col("name"))).join(said, ["syllabus", "norm"], "left")
    hit = F.col("said").isNotNull()
    if paired is not None:
        found = found.join(paired.select("syllabus", "key", F.lit(True).alias("pair")).distinct(), ["syllabus", "key"], "left")
        hit = hit | F.col("pair").isNotNull()
    out = found.groupBy("syllabus").agg(F.count("*").alias("items"), F.count_if(hit).alias("registered"))
    return out.withColumn("share", ratio(F.col("registered"), F.col("items")))


def guarded_total(shares: DataFrame, part: str, whole: str) -> DataFrame:
    """(part, whole, share) summed over all syllabi; null unless every one has the figure."""
    every = F.min((F.col(part).isNotNull() & F.col(whole).isNotNull()).cast("int")) == 1
    sums = shares.agg(F.when(every, F.sum(part)).alias("part"), F.when(every, F.sum(whole)).alias("whole"))
    return sums.withColumn("share", ratio(F.col("part"), F.col("whole")))


def notion_choices(gold: DataFrame) -> DataFrame:
    """(syllabus, global_id, choice): each notion of a syllabus as it is picked from a list, by its first entry's label."""
    first = gold.groupBy("syllabus", "global_id").agg(F.min_by("label", "entry_id").alias("label"))
    return first.select("syllabus", "global_id", F.concat_ws(" · ", "global_id", "label").alias("choice"))
