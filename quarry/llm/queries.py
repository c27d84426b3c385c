"""The queries of the operators: thin digests of what the operators return."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry.llm import chroma, divergence, hmm, language, line_dedup, minhash, mixing, pivot_index, sentencepiece_bpe, token_cache, toxicity, turn_repair, url_filter
from quarry.llm.common import table, write_stage
from quarry.sources.shared import shared_dir

#: (verdict, host, path): the rules that op6 judges by.
URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def tokenizer_path() -> str:
    """The SentencePiece model of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    judged = toxicity.judge(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    return judged.select("doc_id", "held_out", "score", "predicted")


def op2_hmm(spark, sf_dir):
    scored = hmm.score_held_out(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_pivot_index(spark, sf_dir):
    return pivot_index.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op4_sentencepiece(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokens = sentencepiece_bpe.encode(docs, tokenizer_path(), dropout=0.1, seed=17)
    both = sentencepiece_bpe.decode(tokens, tokenizer_path())
    return both.select("doc_id", "n_tokens", F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"), "ids")


def op5_language_id(spark, sf_dir):
    named = language.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return named.select("doc_id", "held_out", "lang_pred", "score")


def op6_url_filter(spark, sf_dir):
    """Listed are the urls that a feed handed on, known by their utm_source."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.where(F.col("url").contains("utm_source=")).select("url")
    return url_filter.judge_urls(pages, URL_RULES, listed).select("page_id", "host", "path", "rule", "verdict")


def op7_line_dedup(spark, sf_dir):
    done = line_dedup.dedupe_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.array_join(F.col("removed_positions").cast("array<string>"), ",").alias("removed_positions"), "text")


def op8_chroma(spark, sf_dir):
    """There is no table of media: `embeddings` stands in, each vector rendered as a tune. Queries are
    the rows whose id is divisible by 20, against all rows; one without a match has a null vec_id."""
    tunes = chroma.sonify(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    prints = write_stage(chroma.fingerprint(tunes).select(F.col("vec_id").alias("id"), "fingerprint"), "fingerprints")
    asked = prints.where(F.col("id") % 20 == 0)
    found = chroma.align(asked, prints).withColumnRenamed("id", "vec_id")
    return asked.select(F.col("id").alias("query_id")).join(found, "query_id", "left")


def op9_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=85)


def op10_mixing(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")


def op11_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents").select("lang", "source", "text"), least_docs=30, keep=50)


def op12_token_cache(spark, sf_dir):
    """Each call begins with a cache of its own, so that all distinct texts are misses once."""
    cache = f"{shared_dir(spark)}/quarry-token-counts/{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_cache.count_tokens(docs, token_cache.Tokenizer.load(tokenizer_path()), cache, limit=4096)


def op13_turn_repair(spark, sf_dir):
    report, marked = turn_repair.diagnose(turn_repair.damaged(table(spark, sf_dir, "conversations")))
    hashes = turn_repair.repaired_hashes(report, marked).withColumnRenamed("conv_id", "of_conv")
    return report.join(hashes, report["conv_id"].eqNullSafe(hashes["of_conv"])).drop("of_conv")


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_hmm, op3_pivot_index, op4_sentencepiece, op5_language_id, op6_url_filter, op7_line_dedup, op8_chroma, op9_minhash, op10_mixing, op11_divergence, op12_token_cache, op13_turn_repair)}
