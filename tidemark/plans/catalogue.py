"""All queries of the library's own operators by name, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import record_queries, text_oracle, text_queries

TEXT = """bm25_topk tokenize_counts corpus_tf doc_freq_idf idf_corpus_tf split_identifier suffix_stem_counts porter_stem_counts ngram_top phrase_match
substring_backoff fuzzy_terms line_windows line_hits_word_boundary line_fallback_a line_fallback_b line_fallback_c coverage_score nms_strict nms_raw_padded
nms_half pad_to_five proximity_score window_bm25_norm range_join_lines smallest_enclosing overlapping_windows best_subwindow neighbour_band
marks_by_engine marks_by_category engine_rank engine_leads category_pivot hit_at_k""".split()

RECORDS = """page_fields page_url_route page_clean_truncate page_upsert_latest page_store_stats page_anti_captured feed_batches feed_flagged_semi marker_split mask_values
content_type_dim token_bucket fixed_window_limit circuit_breaker ttl_cache sessions error_rate log_filter last_n event_history heartbeat_stale moving_tier
round_robin backoff_delay key_version message_routing buffer_until_ready presence_last stability_islands dashboard_stats order_page order_total stock_check
product_search priority_queue task_attempts stream_dedup stream_sessions stream_bucket
fixed_window_broken block_list retryable_errors service_instances service_health api_key_check validators folder_sizes""".split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: getattr(text_queries, name) for name in TEXT} | {name: getattr(record_queries, name) for name in RECORDS}
ORACLE_SQL: dict[str, str] = {**text_oracle.SQL, **record_queries.SQL}
