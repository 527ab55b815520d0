"""One query per operator, each over its whole table."""

from __future__ import annotations

from panelyard.llm import conversations, decontamination, jaccard, lines, mixing, neighbours, oracles, packing, paragraphs, quality, sharding, suffixes, toxicity, vector_codes
from panelyard.llm.registry import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES"]


@query("op2_hash_tree_sharding", oracles.sharding_sql())
def op2(spark, folder):
    """Every document's shard in the weighted hash tree, its slot there, and its shard with one more."""
    return sharding.shard_documents(table(spark, folder, "documents"))


@query("op10_hierarchical_packing")
def op10(spark, folder):
    """Every piece of every document in sequences of at most 1,024 tokens."""
    return packing.pack(table(spark, folder, "documents"))


@query("op9_line_dedup", oracles.lines_sql())
def op9(spark, folder):
    """What line deduplication leaves of every document."""
    return lines.line_report(table(spark, folder, "documents"))


@query("op4_nearest_toxicity")
def op4(spark, folder):
    """Toxicity of every document by its nearest labelled examples."""
    return toxicity.score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op5_nb_svm_quality")
def op5(spark, folder):
    """Quality of every document by naive Bayes support vectors."""
    return quality.score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op8_ngram_jaccard_join", oracles.jaccard_sql())
def op8(spark, folder):
    """Size of every document's shingle set and the component of its links."""
    return jaccard.jaccard_components(table(spark, folder, "documents"))


@query("op3_cgk_decontamination")
def op3(spark, folder):
    """Every document and benchmark item that it holds."""
    return decontamination.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op6_paragraph_minhash")
def op6(spark, folder):
    """Every paragraph that is repeated, exactly or nearly, and whether it goes."""
    return paragraphs.repeated_paragraphs(table(spark, folder, "documents"))


@query("op7_learned_partitions")
def op7(spark, folder):
    """The 20 nearest vectors found for every twentieth vector."""
    return neighbours.search(table(spark, folder, "embeddings"))


@query("op1_suffix_array_dedup", oracles.repeats_sql())
def op1(spark, folder):
    """What the removal of repeated 200-byte strings leaves of every document."""
    return suffixes.without_repeats(table(spark, folder, "documents"))


@query("op11_curriculum_mixing", oracles.mixing_sql())
def op11(spark, folder):
    """Every document with the words the mix takes of it and the times they are due."""
    return mixing.mix_report(table(spark, folder, "documents"))


@query("op13_trie_vector_codes", oracles.vector_codes_sql())
def op13(spark, folder):
    """Every vector's code, its error, its label's error, and the digest of the codebooks."""
    return vector_codes.compress(table(spark, folder, "embeddings"))


@query("op12_conversation_repair", oracles.repair_sql())
def op12(spark, folder):
    """Faults of every damaged conversation, the cheapest edits that mend its roles, and the digest of what they leave."""
    return conversations.repaired(table(spark, folder, "conversations"))
