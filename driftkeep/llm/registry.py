"""The queries of this subpackage and, where SQL can express them, their SQL."""

from driftkeep.llm import bpe, decontaminate, exact_topk, feistel_pii, kdtree_sharding, line_dedup, minhash_dedup, suffix_dedup, toxicity, warc

QUERIES = {
    "op1_feistel_pseudonyms": feistel_pii.op1_feistel_pseudonyms,
    "op2_kdtree_sharding": kdtree_sharding.op2_kdtree_sharding,
    "op3_bpe_roundtrip": bpe.op3_bpe_roundtrip,
    "op4_suffix_array_dedup": suffix_dedup.op4_suffix_array_dedup,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_minhash_near_dedup": minhash_dedup.op6_minhash_near_dedup,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_warc_bundles": warc.op8_warc_bundles,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_exact_topk": exact_topk.op10_exact_topk,
}
ORACLE_SQL = {"op9_line_dedup": line_dedup.SQL, "op10_exact_topk": exact_topk.SQL}
