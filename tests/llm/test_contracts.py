"""What holds for every operator: long texts, clashing names of extra columns, ties and empty tables."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import empty, frame, rows
from tidelog.llm import decontam, langid, mixing, ngram_join, pii, quality, resharding, secrets, tokenfiles, toxicity

NAMES = ["_id", "_key", "k1", "k2", "h", "row", "label", "bucket", "block", "unit", "rank", "host", "declared", "items", "size", "token", "_tie", "a.b", "a b"]


def _items(spark):
    return spark.createDataFrame([(1, "the river ran past the old mill and the children watched it")], "item_id long, text string")


def _labels(spark):
    return spark.createDataFrame([(i, 0, int(i % 2)) for i in range(12)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "secrets": lambda s, df: secrets.scan(df, public_tokenizers.path("byte_bpe_50k.tiktoken")),
    "quality": lambda s, df: quality.judge(df),
    "language": lambda s, df: langid.identify(df),
    "tokens": lambda s, df: tokenfiles.pack(df, public_tokenizers.path("word_bpe_49k.json")),
    "jaccard": lambda s, df: ngram_join.join(df),
    "mixing": lambda s, df: mixing.plan(df),
    "decontamination": lambda s, df: decontam.find(df, _items(s)),
    "pseudonyms": lambda s, df: pii.pseudonymise(df, b"k"),
    "resharding": lambda s, df: resharding.move(df),
    "toxicity": lambda s, df: toxicity.score(df, _labels(s)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_rows_of_clashing_names_and_a_long_text(spark, name):
    """A row for each row, whatever extra columns are called and with a text of four megabytes among them."""
    long = " ".join(f"w{i % 50_021} {i * 7919 % 104_729:x}" for i in range(340_000))
    assert len(long) > 4_000_000
    own = frame(spark)
    longest = own.where("doc_id = 3").withColumn("doc_id", F.lit(77).cast("long")).withColumn("text", F.lit(long))
    df = own.unionByName(longest)
    taken = {c.lower() for c in df.columns}
    df = df.select("*", *(F.lit(7).alias(n) for n in NAMES if n.lower() not in taken))
    got = OPERATORS[name](spark, df)
    ids = [r["doc_id"] for r in got.select("doc_id").collect()]
    assert sorted(ids, key=str) == sorted([r[0] for r in rows()] + [77], key=str)
    assert OPERATORS[name](spark, empty(spark)).count() == 0
