"""The registered queries of the training-data operators and, where SQL can say them, their oracles."""

from __future__ import annotations

from demandspark.llm.ann import op9_ann
from demandspark.llm.bpe import op3_bpe
from demandspark.llm.chat_repair import OP12_SQL, op12_chat_repair
from demandspark.llm.chats import OP5_SQL, op5_chat_format
from demandspark.llm.divergence import OP13_SQL, op13_divergence
from demandspark.llm.langid import op8_language_id
from demandspark.llm.licences import op2_license_scan
from demandspark.llm.lines import OP1_SQL, op1_line_dedup
from demandspark.llm.mixing import OP4_SQL, op4_mixing
from demandspark.llm.ngram_join import op7_ngram_join
from demandspark.llm.quality import op10_quality
from demandspark.llm.token_counts import op11_token_counts
from demandspark.llm.warc import OP6_SQL, op6_warc

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_bpe": op3_bpe,
    "op4_mixing": op4_mixing,
    "op5_chat_format": op5_chat_format,
    "op6_warc": op6_warc,
    "op7_ngram_join": op7_ngram_join,
    "op8_language_id": op8_language_id,
    "op9_ann": op9_ann,
    "op10_quality": op10_quality,
    "op11_token_counts": op11_token_counts,
    "op12_chat_repair": op12_chat_repair,
    "op13_divergence": op13_divergence,
}

ORACLES = {
    "op1_line_dedup": OP1_SQL,
    "op4_mixing": OP4_SQL,
    "op5_chat_format": OP5_SQL,
    "op6_warc": OP6_SQL,
    "op12_chat_repair": OP12_SQL,
    "op13_divergence": OP13_SQL,
}
