"""Consolidating the gold annotation: names, rough singulars, rulings on which entries are one notion, checks of the format.

entries (row_no, label, aliases) in the order of the annotation. Rulings are tables: compound (row_no), apart (row_no, name)
and joined (a, b), so that they are data of the annotation and not of this module.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curralis.functions.text import bare
from curralis.operators.components import connected
from curralis.plans.lineage import settled

# fixed values of the annotation's format
FIELDS = ("id", "tipo", "nivel", "etiqueta", "alias", "tema_padre", "seccion", "evidencia", "nota")
KINDS, GRADES, SECTIONS = ("tema", "concepto"), ("obligatoria", "aceptable"), ("sumilla", "contenidos", "otra")
#: Words behind which a heading's head ends; fixed values.
PREPOSITIONS = ("de", "del", "con", "en", "para", "a", "al", "por", "entre", "sobre", "y", "o", "e", "vs", "versus", "desde")
#: Endings of plurals (ending, fewest letters of the word, letters cut, what takes their place), the first that fits; fixed values.
PLURALS = (("ces", 5, 3, "z"), ("iones", 5, 5, "ión"), ("ones", 6, 4, "ón"))


def loose_name(label: Column) -> Column:
    """Folded words without punctuation, each without one s at its end. Another rule than normalize_label: no protected words, signs or further endings."""
    words = F.transform(F.split(F.regexp_replace(bare(label), r"[^\p{L}\p{N}]+", " "), " "), lambda w: F.regexp_replace(w, "s$", ""))
    return F.array_join(F.filter(words, lambda w: w != ""), " ")


def singular_word(word: Column) -> Column:
    """A Spanish word in the singular, in capitals where the letter that changes is one."""
    low, n = F.lower(word), F.length(word)
    out = None
    for ending, least, cut, put in PLURALS:
        at = F.substring(word, -cut, 1)
        new = F.concat(F.substring(word, F.lit(1), n - cut), F.when(at != F.lower(at), put.upper()).otherwise(put))
        fits = low.endswith(ending) & (n >= least)
        out = F.when(fits, new) if out is None else out.when(fits, new)
    before = lambda k: F.substring(low, -k, 1)
    out = out.when(low.endswith("es") & (n > 3) & before(3).isin(*"lnrdy"), F.substring(word, F.lit(1), n - 2))
    return out.when(low.endswith("s") & (n > 3) & before(2).isin(*"aeiouáéíóú"), F.substring(word, F.lit(1), n - 1)).otherwise(word)


def singular_head(label: Column) -> Column:
    """label with the words before the first preposition, parenthesis or colon in the singular."""
    words = F.filter(F.split(label, r"\s+"), lambda w: w != "")
    ends = F.transform(words, lambda w: F.lower(w).isin(*PREPOSITIONS) | w.contains("(") | w.contains(":"))
    first = F.array_position(ends, True)
    return F.array_join(F.transform(words, lambda w, i: F.when((first > 0) & (i + 1 >= first), w).otherwise(singular_word(w))), " ")


def linking_names(entries: DataFrame, compound: DataFrame | None = None, apart: DataFrame | None = None) -> DataFrame:
    """(row_no, name): the names by which an entry is one notion with others: of a compound heading only its label, and none that is kept apart."""
    each = F.explode(F.concat(F.array(F.struct("label", F.lit(True).alias("own"))), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(a.alias("label"), F.lit(False).alias("own")))))
    names = entries.select("row_no", each.alias("n")).select("row_no", loose_name(F.col("n.label")).alias("name"), "n.own").filter("name <> ''")
    if compound is not None:
        names = names.join(compound.select("row_no", F.lit(True).alias("compound")).distinct(), "row_no", "left").filter("own OR compound IS NULL")
    names = names.select("row_no", "name").distinct()
    return names if apart is None else names.join(apart.select("row_no", "name"), ["row_no", "name"], "left_anti")


def ruled_ids(entries: DataFrame, compound: DataFrame | None = None, apart: DataFrame | None = None, joined: DataFrame | None = None) -> DataFrame:
    """(row_no, global_id): entries that share a linking name or are joined by a ruling are one notion; G-0001 ... by first appearance."""
    names = linking_names(entries, compound, apart)
    first = names.groupBy("name").agg(F.min("row_no").alias("a"))
    links = names.join(first, "name").select("a", F.col("row_no").alias("b"))
    if joined is not None:
        links = links.unionByName(joined.select("a", "b"))
    return numbered(connected(links, entries.select(F.col("row_no").alias("node"))))


def numbered(found: DataFrame) -> DataFrame:
    """(row_no, global_id) of found (node, component), components named by their first row; the numbers follow it.

    Components are sorted by range, counted per part, and numbered from the part's offset: no task sees all of them.
    """
    # settled, as the bounds of the ranges are sampled anew by every evaluation
    parts = settled(found.select("component").distinct().repartitionByRange("component").withColumn("part", F.spark_partition_id()))
    inside = parts.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy("component")))
    sizes = parts.groupBy("part").agg(F.min("component").alias("least"), F.count("*").alias("size"))
    offsets = sizes.select("part", F.coalesce(F.sum("size").over(Window.orderBy("least").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row per part
    n = F.col("before") + F.col("n")
    ids = inside.join(offsets, "part").select("component", F.concat(F.lit("G-"), F.when(n < 10000, F.lpad(n.cast("string"), 4, "0")).otherwise(n.cast("string"))).alias("global_id"))
    return found.join(ids, "component").select(F.col("node").alias("row_no"), "global_id")


def format_problems(lines: DataFrame) -> DataFrame:
    """(file, id, problem) of annotation lines (file, line), headers and comments aside; ids and parents are looked up within a file.

    Of a line without nine fields only that is told; of lines with one id the greatest stands for it as a parent.
    """
    cells = F.split("line", "\t", -1)
    rows = lines.select("file", "line", cells.alias("f")).select("file", "line", F.size("f").alias("size"), *[F.get("f", F.lit(i)).alias(c) for i, c in enumerate(FIELDS)])
    short = rows.filter(F.col("size") != len(FIELDS)).select("file", "id", F.concat(F.lit("fields="), F.col("size").cast("string")).alias("problem"))
    whole = rows.filter(F.col("size") == len(FIELDS))
    bad = lambda column, admitted: F.when(~F.col(column).isin(*admitted), F.concat(F.lit(column + "="), F.col(column)))
    has, topic = F.col("tema_padre") != "", F.col("tipo") == "tema"
    parents = whole.groupBy("file", F.col("id").alias("tema_padre")).agg(F.max_by("tipo", "line").alias("of"))
    met = whole.join(parents, ["file", "tema_padre"], "left")
    found = F.array(
        bad("tipo", KINDS), bad("nivel", GRADES), bad("seccion", SECTIONS), F.when(F.col("nota").contains('""'), F.lit("quoted note")),
        F.when(has & F.col("of").isNull(), F.lit("no such parent")), F.when(has & (F.col("of") != "tema"), F.lit("parent is no topic")),
        F.when(has & topic, F.lit("topic with a parent")), F.when(~has & (F.col("tipo") == "concepto") & (F.col("nota") == ""), F.lit("concept without parent or note")),
    )
    return met.select("file", "id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("problem")).unionByName(short)


def header_ok(header: str) -> bool:
    return tuple(header.rstrip("\r\n").split("\t")) == FIELDS
