"""The queries of the corpus operators, and the SQL for those that SQL can express."""

from __future__ import annotations

from headway.llm.centroids import op13_centroids
from headway.llm.divergence import op11_divergence
from headway.llm.language_id import op1_language_id
from headway.llm.minhash_dedup import op12_minhash_dedup
from headway.llm.oracle import OP2, OP8, OP10, OP11, OP13
from headway.llm.packing import op6_packing
from headway.llm.piece_codec import op3_piece_codec
from headway.llm.quality_classifier import op7_quality_classifier
from headway.llm.quality_rules import op8_quality_rules
from headway.llm.quote_threads import op4_quote_threads
from headway.llm.secret_scan import op5_secret_scan
from headway.llm.simhash_dedup import op9_simhash_dedup
from headway.llm.suffix_dedup import op10_suffix_dedup
from headway.llm.topk_search import op2_topk_search

QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_topk_search, op3_piece_codec, op4_quote_threads, op5_secret_scan,
        op6_packing, op7_quality_classifier, op8_quality_rules, op9_simhash_dedup, op10_suffix_dedup,
        op11_divergence, op12_minhash_dedup, op13_centroids,
    )
}

ORACLE_SQL: dict[str, str] = {"op2_topk_search": OP2, "op8_quality_rules": OP8, "op10_suffix_dedup": OP10, "op11_divergence": OP11, "op13_centroids": OP13}
