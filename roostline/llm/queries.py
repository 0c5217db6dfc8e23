"""The registered queries of these operators, and their SQL counterparts where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from roostline.llm import arc, block_naming, centroids, decontamination, langid, licenses, mixing, periodic, recompression, sharding, simhash, tool_links, toxicity

QUERIES = {
    f.__name__: f
    for f in (
        sharding.op1_shard_by_bytes,
        tool_links.op2_tool_links,
        mixing.op3_mix_to_weights,
        decontamination.op4_decontaminate,
        arc.op5_arc_to_warc,
        simhash.op6_simhash_near_dedup,
        toxicity.op7_toxicity,
        langid.op8_language_id,
        block_naming.op9_exact_dedup,
        recompression.op10_substring_dedup,
        centroids.op11_centroid_clusters,
        licenses.op12_license_scan,
        periodic.op13_periodic_runs,
    )
} | {"pipeline": corpus_pipeline.run}

ORACLE_SQL = {
    "op3_mix_to_weights": mixing.OP3_SQL,
    "op4_decontaminate": decontamination.OP4_SQL,
    "op5_arc_to_warc": arc.OP5_SQL,
    "op9_exact_dedup": block_naming.OP9_SQL,
    "op11_centroid_clusters": centroids.OP11_SQL,
    "op12_license_scan": licenses.OP12_SQL,
}
