"""Scoring of extraction against a gold annotation: matching, ratios, totals, fusion and reviewers' agreement.

gold (syllabus, entry_id, global_id, kind, level, label, aliases), items (run_id, syllabus, ordinal, node, label, kind).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curralis.functions.text import normalize_label
from curralis.operators.annotation import numbered
from curralis.operators.components import connected
from curralis.plans.lineage import settled

THRESHOLD, MAX_ATTEMPTS = 0.75, 3
MANDATORY = "obligatoria"


def case_numbers(rows: DataFrame) -> DataFrame:
    """(syllabus, case): CP-01, CP-02 ... by first appearance in rows (row_no, syllabus)."""
    first = rows.groupBy("syllabus").agg(F.min("row_no").alias("at"))
    n = F.row_number().over(Window.orderBy("at"))  # a row per syllabus
    return first.select("syllabus", F.concat(F.lit("CP-"), F.when(n < 100, F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string"))).alias("case"))


def gold_names(gold: DataFrame) -> DataFrame:
    """(global_id, name): every normalised label and alias of a notion, over all syllabi."""
    each = F.explode(F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>"))))
    return gold.select("global_id", each.alias("n")).select("global_id", normalize_label(F.col("n")).alias("name")).filter("name <> ''").distinct()


def candidates(gold: DataFrame) -> DataFrame:
    """(syllabus, name, entry_id, global_id, kind, level, label): entries that a normalised name may match in a syllabus."""
    return gold.join(gold_names(gold), "global_id").select("syllabus", "name", "entry_id", "global_id", "kind", "level", normalize_label(F.col("label")).alias("own"))


def mandatory_notions(gold: DataFrame) -> DataFrame:
    """(syllabus, global_id, entry_id): each mandatory notion once, by its first entry."""
    return gold.filter(F.col("level") == MANDATORY).groupBy("syllabus", "global_id").agg(F.min("entry_id").alias("entry_id"))


def greedy_match(items: DataFrame, gold: DataFrame) -> DataFrame:
    """(run_id, syllabus, ordinal, entry_id): one entry per item, taken in the items' order; entries are used once.

    Among an item's free entries the one with exactly its label wins, then one of its kind, then the smallest id. The
    order matters, so each run is matched by one task; a run is one document's output, which is small.

    The items before the nth of a run use up at most n - 1 entries, so that the first n of those that it may match are enough: an
    item isn't met by every entry of its name. Entries with its label come first; of the others, which share only the notion's
    names, as many again are kept of each notion, as some of them may have its label.
    """
    place = F.dense_rank().over(Window.partitionBy("run_id", "syllabus").orderBy("ordinal"))
    named = settled(items.select("run_id", "syllabus", "ordinal", "kind", normalize_label(F.col("label")).alias("name"), place.alias("place")))
    most = named.agg(F.max("place")).first()[0] or 0
    asked = settled(named.select("syllabus", "name", "kind").distinct())
    names = asked.select("syllabus", "name").distinct()
    own = F.coalesce(normalize_label(F.col("label")), F.lit(""))
    entries = settled(gold.select("syllabus", "entry_id", "global_id", F.col("kind").alias("gold_kind"), own.alias("own")))

    def first(rows, n, *by):
        return rows.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("entry_id"))).filter(F.col("n") <= n).drop("n")

    near = entries.select("syllabus", F.col("own").alias("name"), "gold_kind", "entry_id").filter("name <> ''").distinct().join(names, ["syllabus", "name"], "left_semi")
    pool = first(entries, 2 * most, "syllabus", "global_id", "gold_kind")
    far = pool.join(gold_names(gold), "global_id").filter("own <> name").select("syllabus", "name", "gold_kind", "entry_id").join(names, ["syllabus", "name"], "left_semi").distinct()
    rows = [first(r, most, "syllabus", "name", "gold_kind").withColumn("far", F.lit(is_far)) for r, is_far in ((near, False), (far, True))]
    choice = F.struct("far", (F.col("kind") != F.col("gold_kind")).alias("other"), "entry_id")
    best = rows[0].unionByName(rows[1]).join(asked, ["syllabus", "name"]).groupBy("syllabus", "name", "kind").agg(F.slice(F.array_sort(F.collect_list(choice)), 1, max(most, 1)).alias("best"))
    pairs = named.join(best, ["syllabus", "name", "kind"]).select("run_id", "syllabus", "ordinal", F.explode(F.slice("best", F.lit(1), F.col("place"))).alias("c")).select("run_id", "syllabus", "ordinal", "c.entry_id", "c.far", "c.other").distinct()
    schema = pa.schema([("run_id", pa.int64()), ("syllabus", pa.string()), ("ordinal", pa.int64()), ("entry_id", pa.string())])

    def match(table: pa.Table) -> pa.Table:
        used, done, rows = set(), set(), []
        for r in sorted(table.to_pylist(), key=lambda r: (r["ordinal"], r["far"], r["other"], r["entry_id"])):
            if r["ordinal"] not in done and r["entry_id"] not in used:
                used.add(r["entry_id"])
                done.add(r["ordinal"])
                rows.append({k: r[k] for k in schema.names})
        return pa.Table.from_pylist(rows, schema=schema)

    pairs = pairs.select(F.col("run_id").cast("long"), "syllabus", F.col("ordinal").cast("long"), "entry_id", "far", "other")
    return pairs.groupBy("run_id", "syllabus").applyInArrow(match, "run_id long, syllabus string, ordinal long, entry_id string")


def maximum_hits(pairs: DataFrame) -> DataFrame:
    """(group, hits): size of a maximum one-to-one matching of pairs (group, left, right), by augmenting paths within a group."""
    out = pa.schema([("group", pa.string()), ("hits", pa.int64())])

    def match(table: pa.Table) -> pa.Table:
        near: dict = {}
        for a, b in zip(table.column("left").to_pylist(), table.column("right").to_pylist()):
            near.setdefault(a, []).append(b)
        held: dict = {}
        for start in near:
            # breadth first over alternating paths: no recursion, however long they are
            back, queue, end = {}, [start], None
            while queue and end is None:
                a = queue.pop(0)
                for b in near[a]:
                    if b in back:
                        continue
                    back[b] = a
                    if b not in held:
                        end = b
                        break
                    queue.append(held[b])
            owner = {a: b for b, a in held.items()}
            while end is not None:
                a = back[end]
                held[end], end = a, owner.get(a)
        return pa.Table.from_pylist([{"group": table.column("group")[0].as_py(), "hits": len(held)}], schema=out)

    return pairs.select(F.col("group").cast("string"), F.col("left").cast("string"), F.col("right").cast("string")).distinct().groupBy("group").applyInArrow(match, "group string, hits long")


def ratio(part: Column, whole: Column) -> Column:
    """Null, not 0, where there is nothing to divide by."""
    return F.when(whole != 0, part / whole)


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall == 0, F.lit(0.0)).otherwise(2 * precision * recall / (precision + recall))


def with_ratios(sums: DataFrame) -> DataFrame:
    """precision, recall and f1 from the sums hits, proposed, recovered, mandatory; ratios of sums, never means of ratios."""
    p, r = ratio(F.col("hits"), F.col("proposed")), ratio(F.col("recovered"), F.col("mandatory"))
    return sums.withColumn("precision", p).withColumn("recall", r).withColumn("f1", f1(p, r))


def measure(items: DataFrame, gold: DataFrame) -> DataFrame:
    """Per run: hits, proposed, recovered, mandatory, same_kind and the ratios."""
    found = greedy_match(items, gold)
    joined = found.join(gold.select("syllabus", "entry_id", "global_id", F.col("kind").alias("gold_kind")), ["syllabus", "entry_id"]).join(items.select("run_id", "syllabus", "ordinal", "kind"), ["run_id", "syllabus", "ordinal"])
    must = mandatory_notions(gold)
    got = joined.join(must.select("syllabus", "global_id"), ["syllabus", "global_id"], "left_semi").groupBy("run_id").agg(F.count_distinct("global_id").alias("recovered"))
    hits = joined.groupBy("run_id").agg(F.count("*").alias("hits"), F.count_if(F.col("kind") == F.col("gold_kind")).alias("same_kind"))
    rows = items.groupBy("run_id", "syllabus").agg(F.count("*").alias("proposed")).join(hits, "run_id", "left").join(got, "run_id", "left")
    rows = rows.join(must.groupBy("syllabus").agg(F.count("*").alias("mandatory")), "syllabus", "left").na.fill(0, ["hits", "same_kind", "recovered", "mandatory"])
    return with_ratios(rows).withColumn("type_agreement", ratio(F.col("same_kind"), F.col("hits")))


def totals(measures: DataFrame, split: Column) -> DataFrame:
    """Sums and their ratios for every value of split, and for all together."""
    sums = lambda df: df.agg(*[F.sum(c).alias(c) for c in ("hits", "proposed", "recovered", "mandatory")])
    rows = measures.withColumn("split", split)
    return with_ratios(sums(rows.groupBy("split")).unionByName(sums(rows.groupBy(F.lit("all").alias("split")))))


def fusion(matched: DataFrame) -> DataFrame:
    """(split_notions, surplus, wrong_nodes) over matched (node, global_id): notions spread over several nodes, nodes beyond the first, nodes of several notions."""
    pairs = matched.select("node", "global_id").distinct()
    notions = pairs.groupBy("global_id").agg(F.count("*").alias("n")).filter("n > 1").agg(F.count("*").alias("split_notions"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"))
    wrong = pairs.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1").agg(F.count("*").alias("wrong_nodes"))
    return notions.join(wrong, F.lit(True))  # two single rows


def attempts(runs: DataFrame) -> DataFrame:
    """(syllabus, run_id, attempts): first accepted run (run_id, syllabus, accepted) of each syllabus, and the rejected ones before it, plus one."""
    first = runs.filter("accepted").groupBy("syllabus").agg(F.min("run_id").alias("run_id"))
    before = runs.join(first.withColumnRenamed("run_id", "first"), "syllabus").filter("not accepted AND run_id < first").groupBy("syllabus").agg(F.count("*").alias("n"))
    return first.join(before, "syllabus", "left").select("syllabus", "run_id", (F.coalesce("n", F.lit(0)) + 1).alias("attempts"))


def verdict(precision: Column, complete: Column) -> Column:
    return F.when(complete, F.when(precision >= THRESHOLD, "passes").otherwise("fails")).otherwise("incomplete")


def agreement(one: DataFrame, two: DataFrame) -> DataFrame:
    """(syllabus, both, only_one, only_two, share) of two reviewers' normalised names (syllabus, name)."""
    a, b = (df.select("syllabus", normalize_label(F.col("name")).alias("norm")).distinct() for df in (one, two))
    joined = a.withColumn("x", F.lit(1)).join(b.withColumn("y", F.lit(1)), ["syllabus", "norm"], "full")
    n = lambda c: F.count(F.when(c, 1))
    x, y = F.col("x").isNotNull(), F.col("y").isNotNull()
    out = joined.groupBy("syllabus").agg(n(x & y).alias("both"), n(x & ~y).alias("only_one"), n(y & ~x).alias("only_two"))
    return out.withColumn("share", ratio(F.col("both"), F.col("both") + F.col("only_one") + F.col("only_two")))


def likeness(pairs: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """pairs with likeness: the greater of the Ratcliff-Obershelp ratio and 0.9 times the share of common words."""
    import difflib

    at, to = pairs.columns.index(left), pairs.columns.index(right)

    def task(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out = []
            for a, b in zip(batch.column(at).to_pylist(), batch.column(to).to_pylist()):
                words = set((a or "").split()), set((b or "").split())
                shared = len(words[0] & words[1]) / max(1, max(map(len, words)))
                out.append(max(difflib.SequenceMatcher(None, a or "", b or "").ratio(), 0.9 * shared))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, "likeness"])

    return pairs.mapInArrow(task, pairs.withColumn("likeness", F.lit(0.0)).schema)


def closest(pairs: DataFrame, k: int = 3, least: float = 0.5) -> DataFrame:
    """The k likest b of each a, from candidate pairs (a, b)."""
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("likeness"), "b"))
    return likeness(pairs).filter(F.col("likeness") >= least).withColumn("rank", rank).filter(F.col("rank") <= k)


def global_ids(entries: DataFrame) -> DataFrame:
    """(row_no, global_id): entries (row_no, label, aliases) that share a normalised name are one notion; G-0001 ... by first appearance."""
    each = F.explode(F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>"))))
    names = entries.select("row_no", each.alias("n")).select("row_no", normalize_label(F.col("n")).alias("name")).filter("name <> ''").distinct()
    first = names.groupBy("name").agg(F.min("row_no").alias("a"))
    found = connected(names.join(first, "name").select("a", F.col("row_no").alias("b")), entries.select(F.col("row_no").alias("node")))
    return numbered(found)


def latency_summary(times: DataFrame, limit_ms: int = 1000) -> DataFrame:
    """(pattern, executions, median_ms, p95_ms, max_ms, passes) of times (pattern, ms); p95 is the nearest rank."""
    out = times.groupBy("pattern").agg(F.count("*").alias("executions"), F.median("ms").alias("median_ms"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY ms)").alias("p95_ms"), F.max("ms").alias("max_ms"))
    return out.withColumn("passes", (F.col("median_ms") < limit_ms) & (F.col("p95_ms") < limit_ms))
