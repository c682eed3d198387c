"""The registered queries: one per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqscore.llm import langid, oracles, toxicity
from seqscore.llm.bpe import encode_documents
from seqscore.llm.common import held_out, table
from seqscore.llm.fingerprint import fingerprint_documents
from seqscore.llm.html import extract
from seqscore.llm.merkle import manifest
from seqscore.llm.minhash import near_documents
from seqscore.llm.neighbours import search
from seqscore.llm.packing import pack_documents
from seqscore.llm.runs import find_runs
from seqscore.llm.sharding import shard_documents
from seqscore.llm.simhash import near_duplicates
from seqscore.llm.suffixes import remove_repeats

QUERIES: dict = {}
ORACLE: dict[str, str] = {"op11_minhash_join": oracles.MINHASH_JOIN, 
                          "op12_periodic_runs": oracles.PERIODIC_RUNS,
                          "op13_merkle_manifest": oracles.MERKLE_MANIFEST}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op9_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 shards of near equal bytes, equal texts kept together."""
    return (shard_documents(table(spark, sf_dir, "documents"), 24)
            .withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int")))


@query
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every text by the rank file, decode the ids again, and hash both."""
    import public_tokenizers as tokenizers
    return encode_documents(table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                            tokenizers.PATTERN, digest=True)


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of 3-word shingles, linked at 3 or fewer differing bits."""
    found = near_duplicates(table(spark, sf_dir, "documents"), width=3, most=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages learned from three of four documents, predicted for all."""
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.learn(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "coverage")


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity learned from the labels of three of four documents, scored for all."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = toxicity.score(docs, toxicity.learn(docs, labels.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted", "offending")


@query
def op5_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text."""
    return fingerprint_documents(table(spark, sf_dir, "documents"))


@query
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removal of 50-byte strings that start in a document of smaller id."""
    return remove_repeats(table(spark, sf_dir, "documents"), 50)


@query
def op3_pack_first_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    import public_tokenizers as tokenizers
    return pack_documents(table(spark, sf_dir, "documents"), tokenizers.path("word_bpe_49k.json"), 2048)


@query
def op1_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every 20th vector."""
    return search(table(spark, sf_dir, "embeddings"), 20, 20)


@query
def op8_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"))


@query
def op11_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of texts whose sets of 4-word shingles have a similarity of 0.8 or more."""
    return near_documents(table(spark, sf_dir, "documents"), width=4, percent=80)


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words; some texts are made periodic first."""
    return find_runs(table(spark, sf_dir, "documents"), loop=True)


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of every row against the root, half of them with text that lost its line feeds."""
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2
    return manifest(table(spark, sf_dir, "documents"), fan=3, every=6, tampered=odd == 0)
