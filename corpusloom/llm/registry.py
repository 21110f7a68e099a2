"""The queries of this subpackage, with SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontaminate, html, language, lm, mtree, pieces, quality, simhash, tokens, urls
from .cluster import table


def op1_simhash(spark, sf_dir):
    """SimHash near-duplicate groups of all documents."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_mtree(spark, sf_dir):
    """The five best inner products of every fiftieth vector."""
    return mtree.top_inner_products(table(spark, sf_dir, "embeddings"))


def op3_pieces(spark, sf_dir):
    """Ids and sampled segmentations of every document, with digests beside them."""
    return pieces.segmented(table(spark, sf_dir, "documents"), with_ids=True, with_sample_ids=True)


def op4_language(spark, sf_dir):
    """Language of every document."""
    docs = table(spark, sf_dir, "documents")
    return language.predictions(docs, language.train(docs))


def op5_url_filter(spark, sf_dir):
    """Verdict on every page's URL."""
    return urls.verdicts(table(spark, sf_dir, "pages"))


def op6_decontamination(spark, sf_dir):
    """Benchmark passages in every document."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def decontamination_near(spark, sf_dir):
    """Benchmark passages in every document, also with words up to two places from where they would stand."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), near=2).select("doc_id", "n_words", "n_hit", "n_near", "near_items")


def op7_html(spark, sf_dir):
    """Main text of every page."""
    return html.extracted(table(spark, sf_dir, "pages"))


def op8_quality(spark, sf_dir):
    """Quality of every document."""
    docs = table(spark, sf_dir, "documents")
    return quality.scores(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op9_pseudo_likelihood(spark, sf_dir):
    """Score of every document under a network trained on all of them."""
    docs = table(spark, sf_dir, "documents")
    return lm.scores(docs, *lm.train(docs))


def op10_token_counts(spark, sf_dir):
    """Tokens of every document before and after edits at hashed places, which take up the trees that the first count kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = tokens.planted(docs.withColumn("edits", tokens.hashed_edits(F.col("doc_id"), F.col("text"))), edits_col="edits")
    return tokens.edited_counts(kept, tree_col="tree")


def queries() -> dict:
    return {f.__name__: f for f in (op1_simhash, op2_mtree, op3_pieces, op4_language, op5_url_filter, op6_decontamination, op7_html, op8_quality, op9_pseudo_likelihood, op10_token_counts, decontamination_near)}


def oracle_sql() -> dict:
    return {"op2_mtree": mtree.ORACLE_SQL, "op6_decontamination": decontaminate.ORACLE_SQL}
