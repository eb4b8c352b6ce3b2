"""The queries of the pipeline operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from .alignment import op13_tokenizer_alignment
from .bpe import op10_byte_bpe
from .clustering import OP11_SQL, op11_centroid_clustering
from .embedding_dedup import op1_embedding_near_dedup
from .exact_dedup import OP3_SQL, op3_exact_dedup
from .line_dedup import OP12_SQL, op12_line_dedup
from .mixing import op7_source_mixing
from .pii import op2_pii
from .quality import op5_quality
from .secrets import op9_secret_scan
from .simhash import op4_simhash_near_dedup
from .toxicity import op8_toxicity
from .url_filter import OP6_SQL, op6_url_filter

QUERIES = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_pii": op2_pii,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_quality": op5_quality,
    "op6_url_filter": op6_url_filter,
    "op7_source_mixing": op7_source_mixing,
    "op8_toxicity": op8_toxicity,
    "op9_secret_scan": op9_secret_scan,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_line_dedup": op12_line_dedup,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

SQL = {"op3_exact_dedup": OP3_SQL, "op6_url_filter": OP6_SQL, "op11_centroid_clustering": OP11_SQL, "op12_line_dedup": OP12_SQL}
