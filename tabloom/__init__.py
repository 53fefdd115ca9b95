"""Bring large collections of untidy tabular files into one fixed schema, on Spark."""

from .lexicon import Lexicon, default_lexicon, load_lexicon
from .operators.contextual import contextual_scores, detect_headers_contextual, detect_headers_ranked
from .operators.detect import (detect_headers, explain_choice, header_list, page_rows, preview_rows, score_choice,
                               sheet_profile)
from .operators.keywords import score_keywords
from .operators.lexical import (alias_match, bm25_blocks, bm25_documents, bm25_index, bm25_search, bm25_search_blocks, exact_matches,
                                trigram_matches)
from .operators.matching import assign, match_log, pair_ranks, pair_rows, score_sources, suggest
from .operators.reshape import masked_sample, rejected_values, reshape, reshape_plan, source_values
from .operators.review import (apply_edits, batch_report, collisions, complete_mapping, duplicate_headers, mapping_stats,
                               missing_required, report_rows, review, source_availability, unmapped_headers)
from .operators.structure import score_rows
from .plans.mapping import map_headers, map_with_fallback, onboard, reuse_or_map, save_profiles
