"""Mixing sources to target weights of the total tokens."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.operators.ranges import Scan, ranged_scan
from tenure.session import checkpoint

#: Ranks of a public byte-level BPE tokenizer, one "base64 rank" per line, and the pattern by which it splits text into words.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def token_counts(docs: DataFrame, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """docs with n_tokens in place of the text: tokens of the whole text, 0 for null and empty ones.

    The driver reads the file and sends it along (a vocabulary, of bounded size): executors need not have it.
    """
    with open(tokenizer, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        table = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, ranks.value.splitlines())}
        model = tiktoken.Encoding("counts", pat_str=WORDS, mergeable_ranks=table, special_tokens={})
        for texts in batches:
            yield pd.Series([len(model.encode_ordinary(t)) for t in texts], dtype="int64")

    return docs.select(*[c for c in docs.columns if c != text], count(F.coalesce(F.col(text), F.lit(""))).alias("n_tokens"))


def plan_mixture(counted: DataFrame, source: str, weights: DataFrame) -> DataFrame:
    """Per source of weights: its tokens, the total to draw and the expected copies of each of its documents.

    weights: (source, target_share, max_repeats). A source without tokens can hold no share: the others'
    shares are scaled to sum to 1. The total is that of the corpus, or the largest at which no source needs
    more than max_repeats copies of a document: shares and repeats are kept exactly, the total gives way.
    """
    have = counted.where("n_tokens > 0").groupBy(F.col(source).alias("source")).agg(F.sum("n_tokens").alias("corpus_tokens"), F.count(F.lit(1)).alias("corpus_docs"))
    known = weights.select("source", F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats")).join(have, "source", "left")
    usable = (F.coalesce(F.col("corpus_tokens"), F.lit(0)) > 0) & (F.col("target_share") > 0)
    # three numbers over the table of sources and the counted documents
    limits = known.where(usable).agg(F.sum("target_share").alias("share"), F.min(F.col("max_repeats") * F.col("corpus_tokens") / F.col("target_share")).alias("cap")).first()
    corpus_total = counted.agg(F.sum("n_tokens")).first()[0] or 0
    usable_share = limits["share"] or 1.0
    draw_total = min(float(corpus_total), limits["cap"] * usable_share) if limits["cap"] is not None else 0.0
    wanted = F.when(usable, F.col("target_share") / F.lit(usable_share)).otherwise(0.0) * F.lit(draw_total)
    return known.select(
        "source", "target_share", "max_repeats", F.coalesce("corpus_tokens", F.lit(0)).alias("corpus_tokens"), F.coalesce("corpus_docs", F.lit(0)).alias("corpus_docs"), wanted.alias("wanted_tokens"),
        F.coalesce(F.try_divide(wanted, F.col("corpus_tokens").cast("double")), F.lit(0.0)).alias("copies"),
    )


def draw(counted: DataFrame, doc: str, source: str, plan: DataFrame, seed: int = 17) -> DataFrame:
    """(doc, source, n_tokens, copy_no): systematic sampling, one row per drawn copy.

    Documents of a source stand in order of length (ties by a hash), so a sample spread evenly over the order
    holds the source's share of tokens to within about one document. The expected copies are summed along it,
    a random offset per source is added, and a document is drawn once per whole number its interval crosses:
    so copies are the expected ones rounded down or up, never above max_repeats. The sums run in ranges,
    a source with a third of all documents is no long task. Documents without tokens or of no listed source
    are not drawn; repeated doc ids are documents of their own.
    """
    rows = counted.where("n_tokens > 0").select(F.col(doc).alias("doc"), F.col(source).alias("source"), "n_tokens")
    ordered = rows.withColumn("tie", F.xxhash64(F.lit(seed), "doc"))
    ranked = ranged_scan(ordered, ["source"], ["n_tokens", "tie", "doc"], {"rank": Scan("sum", F.lit(1))})
    offset = F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    per_source = plan.select(F.col("source").alias("__s"), "copies", "max_repeats")
    placed = ranked.join(per_source, F.col("source") == F.col("__s"))
    crossed = F.floor(offset + F.col("copies") * F.col("rank")) - F.floor(offset + F.col("copies") * (F.col("rank") - 1))
    # at a large rank the product may be rounded past a boundary
    times = F.least(crossed, F.col("max_repeats"))
    drawn = placed.withColumn("__n", times.cast("int")).where("__n > 0")
    return drawn.select(F.col("doc").alias(doc), F.col("source").alias(source), "n_tokens", F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("copy_no"))


def reached(drawn: DataFrame, source: str, plan: DataFrame) -> DataFrame:
    """The share of the drawn tokens that each source of the plan reached, and the repeats it took."""
    got = drawn.groupBy(F.col(source).alias("source")).agg(F.sum("n_tokens").alias("drawn_tokens"), F.count(F.lit(1)).alias("drawn_rows"), F.max("copy_no").alias("most_copies"))
    whole = got.agg(F.sum("drawn_tokens")).first()[0] or 0
    zero = F.lit(0)
    return plan.join(got, "source", "left").select(
        "source", "target_share", "max_repeats", "corpus_tokens", F.coalesce("drawn_tokens", zero).alias("drawn_tokens"), F.coalesce("drawn_rows", zero).alias("drawn_rows"), F.coalesce("most_copies", zero).alias("most_copies"),
        F.coalesce(F.try_divide(F.col("drawn_tokens").cast("double"), F.lit(float(whole))), F.lit(0.0)).alias("reached_share"),
    )


def counted_documents(docs: DataFrame, doc: str, source: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc, source, n_tokens), checkpointed: texts are tokenized once."""
    return checkpoint(token_counts(docs.select(doc, source, text), text, tokenizer))
