"""From the table of documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the
shared folder and reads it back as the next stage's documents. All stages but the last return the
columns of documents.

1. quality_rules: documents that the rules reject go.
2. near_dedup: one document of each group whose SimHash fingerprints (three-word shingles) are linked by
   three or fewer differing bits stays.
3. decontamination: documents that contain benchmark items go.
4. secret_scan: secrets in texts are replaced by a mark; n_chars follows.
5. source_mix: documents are repeated or left out so that sources meet their targets; copy counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cryptoscape.llm.common import stored, table
from cryptoscape.llm.decontaminate import remove_leaks
from cryptoscape.llm.mixing import mix
from cryptoscape.llm.quality import keep_good
from cryptoscape.llm.secret_scan import redact
from cryptoscape.llm.simhash import drop_near_duplicates


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the rules keep. Null and empty texts have no words and go; repeated rows share a fate;
    a text is judged whole, and an empty table stays empty.
    """
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: the smallest id, null ids last; of rows with equal id and text, one. Null and
    empty texts are one group. Whole texts count; an empty table stays empty.
    """
    return drop_near_duplicates(docs, width=3, most=3)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that hold no item of the table ``benchmark``. Null and empty texts hold none; repeated rows
    share a fate, long texts are searched to their end, and an empty table on either side changes nothing.
    """
    return remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets in their texts replaced and n_chars counted anew. Null and empty texts stay as
    they are; repeated rows change alike, and an empty table stays empty.
    """
    return redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, numbered in a last column ``copy`` (``copy_`` if there is one). Null
    texts have no words, a null source is a source; rows of equal id and text that tie share a fate, and an
    empty table stays empty.
    """
    return mix(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup),
          ("decontamination", decontamination), ("secret_scan", secret_scan),
          ("source_mix", source_mix)]

#: The stages fit models and hash texts in ways that SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the rows of the mix."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
