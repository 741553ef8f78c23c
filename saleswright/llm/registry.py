"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, forest, langid, lines, maxent, mixing, prefixtrie, repair, sharding, simhash, suffixes, topk, vptree

QUERIES = {
    "op1_projection_forest": forest.op1,
    "op2_simhash_variants": simhash.op2,
    "op3_line_winnowing": lines.op3,
    "op4_external_shuffle": sharding.op4,
    "op5_nearest_centroid": langid.op5,
    "op6_uniform_threshold": topk.op6,
    "op7_hashed_maxent": maxent.op7,
    "op8_suffix_merge": suffixes.op8,
    "op9_trie_bpe": bpe.op9,
    "op10_pivotal_mix": mixing.op10,
    "op11_block_repair": repair.op11,
    "op12_vantage_point": vptree.op12,
    "op13_truncation_peeling": prefixtrie.op13,
}
SQL = {
    "op3_line_winnowing": lines.OP3_SQL,
    "op1_projection_forest": forest.OP1_SQL,
    "op6_uniform_threshold": topk.OP6_SQL,
    "op11_block_repair": repair.OP11_SQL,
    "op12_vantage_point": vptree.OP12_SQL,
    "op13_truncation_peeling": prefixtrie.OP13_SQL,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
