"""Registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

from tessera.llm.alignment import op12_tokenizer_alignment
from tessera.llm.conversations import OP11_SQL, op11_conversation_repair
from tessera.llm.decontamination import OP9_SQL, op9_decontamination
from tessera.llm.exact_dedup import OP6_SQL, op6_exact_dedup
from tessera.llm.html import op10_html_extraction
from tessera.llm.langid import op1_language_id
from tessera.llm.licenses import OP2_SQL, op2_license_scan
from tessera.llm.line_dedup import OP4_SQL, op4_line_dedup
from tessera.llm.mixing import OP7_SQL, op7_mixing
from tessera.llm.secrets import op3_secret_scan
from tessera.llm.sentencepieces import op13_sentencepiece
from tessera.llm.simhash import op5_simhash
from tessera.llm.toxicity import op8_toxicity

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_license_scan": op2_license_scan,
    "op3_secret_scan": op3_secret_scan,
    "op4_line_dedup": op4_line_dedup,
    "op5_simhash": op5_simhash,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_mixing": op7_mixing,
    "op8_toxicity": op8_toxicity,
    "op9_decontamination": op9_decontamination,
    "op10_html_extraction": op10_html_extraction,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_sentencepiece": op13_sentencepiece,
}
ORACLES = {
    "op2_license_scan": OP2_SQL,
    "op4_line_dedup": OP4_SQL,
    "op6_exact_dedup": OP6_SQL,
    "op7_mixing": OP7_SQL,
    "op9_decontamination": OP9_SQL,
    "op11_conversation_repair": OP11_SQL,
}
