"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from scriptorium.llm.bpe import op8_bpe_codec
from scriptorium.llm.collocations import OP13_SQL, op13_collocations
from scriptorium.llm.decontaminate import op4_decontamination
from scriptorium.llm.jaccard import OP10_SQL, op10_jaccard_join
from scriptorium.llm.langid import op5_language_id
from scriptorium.llm.lm import op6_lm_score
from scriptorium.llm.minhash import OP12_SQL, op12_minhash
from scriptorium.llm.quality import op3_quality
from scriptorium.llm.secrets import op1_secret_scan
from scriptorium.llm.tokencounts import op9_token_counts
from scriptorium.llm.topk import OP7_SQL, op7_exact_topk
from scriptorium.llm.warc import OP2_SQL, op2_warc_roundtrip
from scriptorium.llm.whitening import op11_whitening

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_warc_roundtrip": op2_warc_roundtrip,
    "op3_quality": op3_quality,
    "op4_decontamination": op4_decontamination,
    "op5_language_id": op5_language_id,
    "op6_lm_score": op6_lm_score,
    "op7_exact_topk": op7_exact_topk,
    "op8_bpe_codec": op8_bpe_codec,
    "op9_token_counts": op9_token_counts,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_whitening": op11_whitening,
    "op12_minhash": op12_minhash,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc_roundtrip": OP2_SQL,
    "op7_exact_topk": OP7_SQL,
    "op10_jaccard_join": OP10_SQL,
    "op12_minhash": OP12_SQL,
    "op13_collocations": OP13_SQL,
}
