"""The corpus operators' queries: opN_<name> over the whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, conversation, gru_lm, itq, jaccard_join, langid, line_dedup, packing, pii, quality, topk, warc, whitening

QUERIES = {
    "op1_packing": packing.op1,
    "op2_pii": pii.op2,
    "op3_langid": langid.op3,
    "op4_quality": quality.op4,
    "op5_warc": warc.op5,
    "op6_topk": topk.op6,
    "op7_gru_lm": gru_lm.op7,
    "op8_bpe": bpe.op8,
    "op9_jaccard_join": jaccard_join.op9,
    "op10_itq": itq.op10,
    "op11_conversation_repair": conversation.op11,
    "op12_whitening": whitening.op12,
    "op13_line_dedup": line_dedup.op13,
}

ORACLE: dict[str, str] = {
    "op5_warc": warc.OP5_SQL,
    "op6_topk": topk.OP6_SQL,
    "op9_jaccard_join": jaccard_join.OP9_SQL,
    "op10_itq": itq.OP10_SQL,
    "op11_conversation_repair": conversation.OP11_SQL,
    "op13_line_dedup": line_dedup.OP13_SQL,
}
