"""The corpus queries and their SQL, for the repository's entry module."""

from vaultmill.llm import chat, grid, hosts, leaks, mix, pieces, quality, repeats, resample, shard, simhash, spelling, warc

QUERIES = {
    "op1_source_mix": mix.op1_source_mix,
    "op2_preference_pairs": chat.op2_preference_pairs,
    "op3_url_trust": hosts.op3_url_trust,
    "op4_repeated_substrings": repeats.op4_repeated_substrings,
    "op5_warc_revisits": warc.op5_warc_revisits,
    "op6_simhash_components": simhash.op6_simhash_components,
    "op7_ring_shards": shard.op7_ring_shards,
    "op8_benchmark_leaks": leaks.op8_benchmark_leaks,
    "op9_quality_posterior": quality.op9_quality_posterior,
    "op10_grid_order_join": grid.op10_grid_order_join,
    "op11_target_resample": resample.op11_target_resample,
    "op12_sentencepiece_ids": pieces.op12_sentencepiece_ids,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}
SQL = {
    "op1_source_mix": mix.OP1_SQL,
    "op2_preference_pairs": chat.OP2_SQL,
    "op3_url_trust": hosts.OP3_SQL,
    "op4_repeated_substrings": repeats.OP4_SQL,
    "op5_warc_revisits": warc.OP5_SQL,
    "op6_simhash_components": simhash.OP6_SQL,
    "op7_ring_shards": shard.OP7_SQL,
    "op10_grid_order_join": grid.OP10_SQL,
    "op11_target_resample": resample.OP11_SQL,
    "op13_spelling_variants": spelling.OP13_SQL,
}
