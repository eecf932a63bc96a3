"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from weir.llm import ann, chat, htmltext, langid, mixing, neardup, pieces, pii, quality, urlfilter

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_jaccard": neardup.op2_jaccard,
    "op3_html": htmltext.op3_html,
    "op4_urls": urlfilter.op4_urls,
    "op5_pii": pii.op5_pii,
    "op6_language": langid.op6_language,
    "op7_chat": chat.op7_chat,
    "op8_neighbours": ann.op8_neighbours,
    "op9_mixing": mixing.op9_mixing,
    "op10_sentencepiece": pieces.op10_sentencepiece,
}

SQL = {
    "op1_quality": quality.OP1_SQL,
    "op2_jaccard": neardup.OP2_SQL,
    "op4_urls": urlfilter.OP4_SQL,
    "op9_mixing": mixing.OP9_SQL,
    "op7_chat": chat.OP7_SQL,
}
