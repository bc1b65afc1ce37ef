"""The corpus pipeline: from documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before kept; all but the last return the columns of ``documents``.

Null texts are empty ones: the classifier scores them like any text, and in the
other stages they have one empty line, no shingle, no word and the end token
alone. Repeated rows are documents of their own up to near dedup, where rows of
one text are copies. Texts of any length are worked on whole. Columns beyond
those of ``documents`` stay, whatever their names, up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import decontaminate, line_dedup, neardup, packing, quality
from helixframe.llm.common import table
from helixframe.plans.scratch import cut

#: The score from which a document is kept.
KEEP = 0.3
#: Near copies share so much of their five-word shingles (Jaccard, in hundredths).
SHINGLE, PERCENT = 5, 80


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores below 0.3 go. It learns from the labels outside the held-out fifth."""
    model = quality.train(docs, table(spark, sf_dir, "labels").filter(~quality.held_out()))
    return quality.score(docs, model, score_col="__score").filter(F.col("__score") >= KEEP).select(*docs.columns)


def _with_text(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """The columns of ``docs``; n_chars follows the text."""
    return changed.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else changed.select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that 10 documents or more hold go from all; a document of which nothing is left but white space goes."""
    kept = line_dedup.drop_common_lines(docs, min_docs=10, min_chars=1)
    kept = kept.filter((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\s]"))
    return _with_text(docs, kept)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: that of the least id (none comes last), of equal ids that of the least hash, of rows alike any one."""
    names = ("__a", "__b")
    whole = [F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce(F.col("text"), F.lit(""))]
    keyed = docs.withColumn("__a", F.xxhash64(*whole)).withColumn("__b", F.xxhash64(F.lit(1), *whole))
    found = neardup.near_copies(keyed.select("doc_id", *names, "text"), shingle=SHINGLE, percent=PERCENT)
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *names)
    rows = cut(found.groupBy("root", "doc_id", *names).agg(F.count("*").alias("n")), "rows")
    first = rows.groupBy("root").agg(F.min(own).alias("first"))
    gone = cut(rows.join(first, "root").filter(~own.eqNullSafe(F.col("first"))).select(*names), "gone")
    # A list that grows with the documents isn't sent to all tasks, even where it happens to be short.
    kept = keyed.join(gone.hint("merge"), list(names), "left_anti")
    # Rows alike in id and text are told apart by nothing: only these are brought together.
    twice = cut(rows.filter("n > 1").select(*names), "twice")
    if not twice.isEmpty():
        kept = kept.join(twice, list(names), "left_anti").unionByName(kept.join(twice, list(names), "left_semi").dropDuplicates(list(names)))
    return kept.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 10 words or more that benchmark items hold are cut out; a document of which no word is left goes."""
    cleaned = decontaminate.find_benchmark(docs, table(spark, sf_dir, "benchmark"), size=10, remove=True)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return _with_text(docs, cleaned.filter((F.size("spans") == 0) | (hit < F.col("n_words"))))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence of 2048 tokens, with its ids."""
    import public_tokenizers

    found = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=True)
    return found.withColumnRenamed("doc", "doc_id")


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup_stage),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack_sequences),
]

#: A stage that learns weights and one that tokenises are beyond SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, name.replace(" ", "-"))
    return docs
