"""Factor groups and the signal families behind them, as plain data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

# Signal families by kind.
FAMILIES = {
    "bge": (
        "similarity",
        (
            "bge_normalized_score",
        ),
    ),
    "gemini_doc_retrieval": (
        "similarity",
        (
            "gemini_doc_retrieval_normalized_score",
        ),
    ),
    "gemini_semantic_similarity": (
        "similarity",
        (
            "gemini_semantic_similarity_normalized_score",
        ),
    ),
    "textrazor_entity_confidence_relevance": (
        "textrazor_scalar",
        (
            "textrazor_entity_confidence_score",
            "textrazor_entity_relevance_score",
        ),
    ),
    "textrazor_topic_score": (
        "textrazor_scalar",
        (
            "textrazor_topic_score",
        ),
    ),
    "textrazor_category_classifier_score": (
        "textrazor_scalar",
        (
            "textrazor_category_score",
            "textrazor_classifier_score",
        ),
    ),
    "textrazor_entailment_score_prior_context": (
        "textrazor_scalar",
        (
            "textrazor_entailment_score",
            "textrazor_entailment_prior",
            "textrazor_entailment_context",
        ),
    ),
    "textrazor_word_grammar_sense_spelling": (
        "textrazor_structural",
        (
            "textrazor_word_count",
            "textrazor_grammar_count",
            "textrazor_sense_count",
            "textrazor_spelling_count",
        ),
    ),
    "textrazor_relation_property_noun_phrase": (
        "textrazor_structural",
        (
            "textrazor_relation_count",
            "textrazor_property_count",
            "textrazor_noun_phrase_count",
        ),
    ),
    "backlinks_counts": (
        "backlinks_metric",
        (
            "backlinks_count",
            "referring_domains_count",
            "dofollow_backlinks_count",
        ),
    ),
    "onpage_content_quality": (
        "onpage_metric",
        (
            "onpage_score",
            "plain_text_word_count",
            "plain_text_rate",
            "flesch_kincaid_readability_index",
            "coleman_liau_readability_index",
            "smog_readability_index",
            "dale_chall_readability_index",
            "description_to_content_consistency",
            "title_to_content_consistency",
            "meta_keywords_to_content_consistency",
        ),
    ),
    "onpage_core_web_vitals": (
        "onpage_metric",
        (
            "connection_time_ms",
            "time_to_secure_connection_ms",
            "request_sent_time_ms",
            "download_time_ms",
            "duration_time_ms",
            "fetch_end_ms",
            "dom_complete_ms",
            "time_to_interactive_ms",
        ),
    ),
}
SOURCE_MARTS = {
    "similarity": "analysis_mart",
    "textrazor_scalar": "page_metrics",
    "textrazor_structural": "page_metrics",
    "backlinks_metric": "backlinks_analysis",
    "onpage_metric": "onpage_features",
}


def family_table(spark: SparkSession) -> DataFrame:
    """``(family, kind, source_mart, signal)``: one row per signal of a family."""
    rows = [
        (family, kind, SOURCE_MARTS[kind], signal)
        for family, (kind, signals) in FAMILIES.items()
        for signal in signals
    ]
    return spark.createDataFrame(rows, "family string, kind string, source_mart string, signal string")


def family_signals(families: Sequence[str]) -> list[str]:
    return list(dict.fromkeys(s for f in families for s in FAMILIES[f][1]))


# Families of a group and single columns added to it.
GROUP_FAMILIES = {
    "relevance": (
        "bge",
        "gemini_doc_retrieval",
        "gemini_semantic_similarity",
        "textrazor_entity_confidence_relevance",
        "textrazor_topic_score",
        "textrazor_category_classifier_score",
        "textrazor_entailment_score_prior_context",
    ),
    "content": (
        "textrazor_word_grammar_sense_spelling",
        "textrazor_relation_property_noun_phrase",
        "onpage_content_quality",
    ),
    "authority": ("backlinks_counts",),
    "performance": ("onpage_core_web_vitals",),
}
GROUP_COLUMNS = {
    "technical": (
        "is_redirect",
        "follow",
        "inbound_links_count",
        "click_depth",
        "seo_friendly_url",
        "has_valid_structured_data",
        "has_micromarkup",
        "has_micromarkup_errors",
        "flash",
        "frame",
    ),
    "content": (
        "h1_count",
        "h2_count",
        "h3_count",
        "high_content_rate",
        "high_character_count",
        "duplicate_meta_tags_count",
        "duplicate_content",
        "lorem_ipsum",
    ),
    "performance": (
        "cache_control_cachable",
        "cache_control_ttl",
    ),
    "resources": (
        "images_count",
        "images_size",
        "scripts_count",
        "stylesheets_count",
        "encoded_size",
        "small_page_size",
        "resource_warnings_count",
    ),
    "metadata_presentation": (
        "title_length",
        "description_length",
        "has_og_tags",
        "has_twitter_tags",
        "no_favicon",
        "no_image_title",
    ),
}
GROUPS = ("relevance", "content", "authority", "technical", "performance", "resources", "metadata_presentation")


def factor_columns(with_backlinks: bool = True) -> dict[str, list[str]]:
    """Columns of each factor group, families first."""
    out = {}
    for group in GROUPS:
        if group == "authority" and not with_backlinks:
            out[group] = []
            continue
        named = family_signals(GROUP_FAMILIES.get(group, ())) + list(GROUP_COLUMNS.get(group, ()))
        out[group] = list(dict.fromkeys(named))
    return out


def factor_table(spark: SparkSession, factors: dict[str, list[str]] | None = None) -> DataFrame:
    """``(factor, column_name)`` as a table."""
    rows = [(f, c) for f, columns in (factors or factor_columns()).items() for c in columns]
    return spark.createDataFrame(rows, "factor string, column_name string")
