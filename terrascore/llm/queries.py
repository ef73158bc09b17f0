"""The queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from terrascore.llm import (chat, htmltext, langid, licenses, merkle, mixing, neardup, packing, quality, resample, topk, toxicity,
                            trie)


def queries():
    return {"op1_licenses": licenses.op1_licenses,
            "op2_neardup": neardup.op2_neardup,
            "op3_topk": topk.op3_topk,
            "op4_langid": langid.op4_langid,
            "op5_html": htmltext.op5_html,
            "op6_merkle": merkle.op6_merkle,
            "op7_mixing": mixing.op7_mixing,
            "op8_packing": packing.op8_packing,
            "op9_quality": quality.op9_quality,
            "op10_toxicity": toxicity.op10_toxicity,
            "op11_chat": chat.op11_chat,
            "op12_trie": trie.op12_trie,
            "op13_resample": resample.op13_resample}


def oracle_sql():
    return {"op1_licenses": licenses.OP1_SQL,
            "op3_topk": topk.OP3_SQL,
            "op6_merkle": merkle.OP6_SQL,
            "op7_mixing": mixing.OP7_SQL,
            "op11_chat": chat.OP11_SQL,
            "op12_trie": trie.OP12_SQL,
            "op13_resample": resample.OP13_SQL}
