"""The corpus pipeline: toxicity, language, repeated lines, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes each stage's rows to the shared checkpoint folder before the next one reads
them. ``ORACLE_SQL`` is None: learned models, ProbMinHash and tokenizers can't be put into SQL.

Defined results, for every stage: an empty table gives an empty table; columns beside those of ``documents``
are kept, whatever their names; texts may be of any length. Rows without an id are judged by their texts and
never near-duplicates. Null and empty texts, and texts without a letter, have no language and go at the
language stage. Equal rows stay, each, until the near-duplicate stage keeps one of them; of rows with one id
and different texts each is judged by its own text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrafold.llm import language_id, line_dedup, near_dedup, packing, toxicity
from spectrafold.llm.common import cut, table
from spectrafold.llm.queries import language, packed, toxic

#: Documents whose language is less certain than this are rejected.
LEAST_CERTAIN = 0.3


class Numbered:
    """Documents whose columns have numbers for names, so that columns which an operator adds meet none of theirs."""

    def __init__(self, docs: DataFrame) -> None:
        self.names = docs.columns
        self.docs = docs.select(*[F.col(f"`{c}`").alias(self[c]) for c in self.names])

    def __getitem__(self, name: str) -> str:
        return f"c{self.names.index(name)}"

    def back(self, docs: DataFrame) -> DataFrame:
        """The columns of the documents under their own names, without added ones."""
        return docs.select(*[F.col(self[c]).alias(c) for c in self.names])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the labelled ones among them, doesn't predict toxic.

    Without labels of both kinds the model scores all alike, by the share of toxic labels.
    """
    model = toxicity.learn(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), ~toxic.held_out())
    plain = Numbered(docs)
    return plain.back(toxicity.score(plain.docs, model, text=plain["text"]).where("predicted = 0"))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows and is certain enough of; without languages to learn from, none."""
    model = language_id.learn(docs.select("doc_id", "text", "lang"), ~language.held_out())
    plain = Numbered(docs)
    told = language_id.predict(plain.docs, model, text=plain["text"])
    return plain.back(told.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_CERTAIN)))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated windows of lines; a document that loses all of its lines goes."""
    plain = Numbered(docs)
    out = line_dedup.dedup_lines(plain.docs, doc_id=plain["doc_id"], text=plain["text"])
    left = out.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    changed = F.when(F.col("n_removed") > 0, F.char_length(plain["text"]).cast("long")).otherwise(F.col(plain["n_chars"]))
    return plain.back(left.withColumn(plain["n_chars"], changed))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the smallest id; rows without an id stay.

    Of rows equal in id and text one stays, rows of the kept id with other texts stay as well.
    """
    return near_dedup.first_of_each(docs).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return packed.digest(packing.pack(docs, public_tokenizers.path(packed.TOKENIZER)))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, applied to the documents one after another."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
