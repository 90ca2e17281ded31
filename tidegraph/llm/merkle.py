"""Document fingerprints: a Merkle tree over the sections, paragraphs and pieces of a text.

Sections are parted by blank lines, paragraphs by line breaks, and a piece ends with a sentence's sign or after 95
characters, so a text is its pieces with the breaks between them. Each node is the MD5 of its children's, so equal
roots mean equal texts, and where roots differ only differing branches need a look. A fingerprint writes the tree down:

    root;section:paragraph.piece.piece,paragraph.piece;section:...

with 32 hex digits for the root and 8 for any other node. Only built-in functions run.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.llm.common import bucket_of, documents, range_splits, row_key

#: A run without such signs, and the sign after it; no way back into a run, so a text is read once.
_PIECE = r"[^.!?]{1,95}+[.!?]?+|[.!?]"


def tree(text: Column) -> Column:
    """The tree of a text as nested arrays: h is a node's full hash, p a section's paragraphs, l a paragraph's leaves (8 digits)."""

    def paragraph(p: Column) -> Column:
        leaves = F.transform(F.regexp_extract_all(p, F.lit(_PIECE), F.lit(0)), F.md5)
        return F.struct(F.md5(F.array_join(leaves, "")).alias("h"), F.transform(leaves, lambda x: F.substring(x, 1, 8)).alias("l"))

    def section(s: Column) -> Column:
        return F.transform(F.split(s, "\n"), paragraph)

    sections = F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), section)
    return F.transform(sections, lambda s: F.struct(F.md5(F.array_join(s["h"], "")).alias("h"), s.alias("p")))


def written_down(tree: Column) -> Column:
    """A tree as a string."""
    paragraph = lambda p: F.concat(F.substring(p["h"], 1, 8), F.array_join(F.transform(p["l"], lambda x: F.concat(F.lit("."), x)), ""))
    section = lambda s: F.concat(F.substring(s["h"], 1, 8), F.lit(":"), F.array_join(F.transform(s["p"], paragraph), ","))
    return F.concat(F.md5(F.array_join(tree["h"], "")), F.lit(";"), F.array_join(F.transform(tree, section), ";"))


def leaves(tree: Column) -> Column:
    """The different leaves of a tree."""
    return F.array_distinct(F.flatten(F.transform(tree, lambda s: F.flatten(s["p"]["l"]))))


def fingerprint(text: Column) -> Column:
    """The tree of a text as a string; null counts as empty."""
    return written_down(tree(text))


def likeness(a: Column, b: Column, x: Column, y: Column) -> Column:
    """Twice the leaves x and y that two fingerprints a and b share over the leaves of both (equal roots: 1)."""
    both = F.size(x) + F.size(y)
    return F.when(F.substring(a, 1, 32) == F.substring(b, 1, 32), 1.0).when(both == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / both)


def changed_paragraphs(a: Column, b: Column) -> Column:
    """Positions (from 0, over the whole text) of b's paragraphs that a lacks, by descent: equal roots and equal sections are not opened."""
    of = lambda t: F.slice(F.split(t, ";"), 2, 1 << 30)
    known = F.flatten(F.transform(of(a), lambda s: F.transform(F.split(F.substring_index(s, ":", -1), ","), lambda p: F.substring(p, 1, 8))))
    same = F.transform(of(a), lambda s: F.substring_index(s, ":", 1))
    flags = F.flatten(
        F.transform(
            of(b),
            lambda s: F.transform(
                F.split(F.substring_index(s, ":", -1), ","),
                lambda p: F.when(F.array_contains(same, F.substring_index(s, ":", 1)), F.lit(False)).otherwise(~F.array_contains(known, F.substring(p, 1, 8))),
            ),
        )
    )
    at = F.filter(F.transform(flags, lambda x, i: F.when(x, i).otherwise(-1)), lambda i: i >= 0)
    return F.when(F.substring(a, 1, 32) == F.substring(b, 1, 32), F.array().cast("array<int>")).otherwise(at)


def with_next(docs: DataFrame, columns: list[str], prepare=lambda rows: rows, rows_per_bucket: int = 1000) -> DataFrame:
    """Adds next_<column> of the next row in ascending (doc_id, text hash) order; after the last comes the first.

    prepare: adds columns that depend on their row alone, once the rows are gathered.

    Rows are dealt to ranges of doc_id, and each range also gets a copy of the first row of the next one, so no
    task orders more than a range and nothing is sorted as a whole. At most 10,000 ranges: their first ids are
    the only thing that the driver holds.
    """
    spark = docs.sparkSession
    splits = range_splits(docs, "doc_id", rows_per_bucket)
    keyed = docs.withColumn("_b", bucket_of(F.col("doc_id"), splits)).withColumn("_k", row_key())
    firsts = sorted(
        ((r["_b"], r["m"]["doc_id"], r["m"]["_k"]) for r in keyed.groupBy("_b").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("_known"), "doc_id", "_k")).alias("m")).collect()),
        key=lambda r: r[0],
    )
    heads = [{"_to": firsts[i - 1][0], "_id": d, "_key": k} for i, (_, d, k) in enumerate(firsts)]
    to = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(heads)), "array<struct<_to int, _id bigint, _key bigint>>")).alias("h")).select("h.*")
    extra = keyed.join(F.broadcast(to), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_k") == F.col("_key"))).dropDuplicates(["_to"])
    extra = extra.select(*[c for c in keyed.columns if c != "_b"], F.col("_to").alias("_b"), F.lit(1).alias("_copy"))
    order = Window.partitionBy("_b").orderBy("_copy", F.col("doc_id").asc_nulls_first(), "_k")
    both = prepare(keyed.withColumn("_copy", F.lit(0)).unionByName(extra))
    return both.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).where("_copy = 0").drop("_b", "_k", "_copy")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of documents and of their edited texts, likenesses, and n_changed, the edited paragraphs located.

    Null texts count as empty, whose fingerprint has no pieces; a sole document is its own next. Rows with equal
    doc_id follow each other by text hash; null doc_ids come first. An empty table gives no rows; other columns
    are not read.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def known(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("_tree", tree(F.col("text")))
        return rows.withColumns({"fingerprint": written_down(F.col("_tree")), "leaves": leaves(F.col("_tree"))}).drop("_tree")

    rows = with_next(base, ["text", "fingerprint", "leaves"], known).withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4)
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 4) as int))"), F.substring("next_text", F.lit(1), cut.cast("int")))
    rows = rows.withColumn("_edited", edited).withColumn("_tree", tree(F.col("_edited")))
    rows = rows.withColumns({"edited_fingerprint": written_down(F.col("_tree")), "edited_leaves": leaves(F.col("_tree"))})
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), F.col("leaves"), F.col("edited_leaves")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint"), F.col("leaves"), F.col("next_leaves")).alias("near_next"),
        F.size(changed_paragraphs(F.col("fingerprint"), F.col("edited_fingerprint"))).cast("long").alias("n_changed"),
    )


def op4_merkle_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints(documents(spark, sf_dir))
