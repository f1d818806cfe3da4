"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .decontaminate import op8_prefix_join_contamination
from .fingerprints import op1_scaled_sketch
from .hmm import op10_hidden_markov
from .language import op9_subword_language
from .merkle import op13_octopus_manifest
from .neardup import op7_bagminhash_classes
from .packing import op4_differencing_pack
from .quality import op2_rule_ensemble
from .ranked import OP12_SQL, op12_geometric_blocks
from .sharding import op5_prefix_sum_shards
from .token_cache import op6_digest_cache_counts
from .trie_bpe import op11_trie_bpe
from .wavelet import op3_wavelet_shards

QUERIES = {
    f.__name__: f
    for f in (
        op1_scaled_sketch,
        op2_rule_ensemble,
        op3_wavelet_shards,
        op4_differencing_pack,
        op5_prefix_sum_shards,
        op6_digest_cache_counts,
        op7_bagminhash_classes,
        op8_prefix_join_contamination,
        op9_subword_language,
        op10_hidden_markov,
        op11_trie_bpe,
        op12_geometric_blocks,
        op13_octopus_manifest,
    )
}

#: The others are beyond DuckDB's SQL (no crc32, no tokenizer, no hash order of SHA-256 digests);
#: tests/llm holds each against a brute-force version instead.
ORACLE_SQL: dict[str, str] = {"op12_geometric_blocks": OP12_SQL}
