"""Corpus pipeline: toxic texts out, near-duplicates out, benchmark passages and
personal data cut, and what is left packed for training.

Each stage takes (spark, docs, sf_dir) and works on everything the stage before kept;
``run`` applies them to ``documents``.  Rows with a null text count as empty, rows with
a null ``doc_id`` are kept by the filtering stages unless their own text is rejected
or a copy of another's.  Part of the subpackage ``larkspur.llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import covering, decontaminate, packing, pii, toxicity
from larkspur.llm.common import discard, scratch_path, table, written, written_at
from larkspur.llm.token_ids import tokenizer_path
from larkspur.operators.skew import join_counted

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SHINGLE_WORDS = 5
TOKENIZER, END_ID, SEQUENCE = "word_bpe_49k.json", 2, 4096
#: Fewer than the operator's default: earlier stages have grown the executors' heaps.
REMEMBERED = 200_000


def _back(df: DataFrame) -> DataFrame:
    """The columns of documents from those an operator carried along as ``_<name>``."""
    return df.select(*[F.col(f"_{c}").alias(c) for c in COLUMNS])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts scored 0.5 or more by the toxicity operator go; a null text is scored as empty."""
    scored = toxicity.scores(docs, table(spark, sf_dir, "labels"), keep=COLUMNS)
    return _back(scored.where("score < 0.5"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by 0.8 or more of their five-word shingles the row with
    the least ``doc_id`` stays, one without a ``doc_id`` only if the group has no other;
    unlike texts that share a ``doc_id`` all stay."""
    keyed = docs.select(*COLUMNS).withColumn("text_key", covering.text_key())
    told = covering.similar_rows(keyed, SHINGLE_WORDS)
    first = told.where(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key")))
    kept = written(first.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).select(_row().alias("_row"), "n"), "kept-rows")
    named = join_counted(keyed.withColumn("_row", _row()), kept, ["_row"], keyed.count())
    # Of rows alike in id and text one stays; tasks choose first, so equal rows never meet in one.
    order = F.struct(F.col("text").isNull(), F.xxhash64("lang", "source", "n_chars"))
    return named.groupBy("_row").agg(F.min_by(F.struct(*COLUMNS), order).alias("x")).select("x.*")


def _row():
    """What stands for a row's ``doc_id`` and text."""
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.hex("text_key")).cast("binary")))


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of ten words or more that stand in the benchmark are cut.  A null text stays null."""
    return _with_length(decontaminate.cleaned(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by the name of their kind.  A null text stays null."""
    return _with_length(pii.masked_texts(docs, keep=COLUMNS))


def _with_length(df: DataFrame) -> DataFrame:
    return _back(df).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every text in sequences of at most 4096 ids; a null text is its end id alone."""
    return packing.pack_documents(docs, tokenizer_path(TOKENIZER), END_ID, SEQUENCE, REMEMBERED)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]

#: Trained models and library tokenizers have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of what the stages keep of ``documents``; a stage's table goes when the
    next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        docs = written_at(stage(spark, docs, sf_dir), path)
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
