"""Queries of the training-data operators."""

from __future__ import annotations

from talonscan.llm import ann, bpe, chat_format, minhash, packing, pii, prefix_trie, quality_rules, secrets, simhash, suffix_dedup, token_files, turn_repair


def pipeline(spark, sf_dir):
    import corpus_pipeline  # which imports this subpackage

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_bpe": bpe.op2_bpe,
        "op3_simhash": simhash.op3_simhash,
        "op4_token_files": token_files.op4_token_files,
        "op5_pii": pii.op5_pii,
        "op6_packing": packing.op6_packing,
        "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
        "op8_chat_format": chat_format.op8_chat_format,
        "op9_ann": ann.op9_ann,
        "op10_secret_scan": secrets.op10_secret_scan,
        "op11_prefix_trie": prefix_trie.op11_prefix_trie,
        "op12_minhash": minhash.op12_minhash,
        "op13_turn_repair": turn_repair.op13_turn_repair,
        "pipeline": pipeline,
    }


def oracle_sql():
    return {
        "op1_quality_rules": quality_rules.OP1_SQL,
        "op8_chat_format": chat_format.OP8_SQL,
        "op11_prefix_trie": prefix_trie.OP11_SQL,
        "op12_minhash": minhash.OP12_SQL,
        "op13_turn_repair": turn_repair.OP13_SQL,
    }
