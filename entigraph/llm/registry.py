"""The queries of this package by name, and the SQL of those that SQL can express."""

from entigraph.llm.bpe import op10_bpe
from entigraph.llm.chat import OP2_SQL, op2_chat
from entigraph.llm.contamination import OP8_SQL, op8_decontamination
from entigraph.llm.interaction import OP12_SQL, op12_interaction
from entigraph.llm.langid import op5_language_id
from entigraph.llm.passages import op9_passages
from entigraph.llm.quality import op3_quality
from entigraph.llm.repetition import op7_repetition
from entigraph.llm.secrets import op1_secrets
from entigraph.llm.simhash import op4_simhash
from entigraph.llm.tokenfile import op6_token_file
from entigraph.llm.toxicity import op11_toxicity
from entigraph.llm.whitening import op13_whitening

QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_chat": op2_chat,
    "op3_quality": op3_quality,
    "op4_simhash": op4_simhash,
    "op5_language_id": op5_language_id,
    "op6_token_file": op6_token_file,
    "op7_repetition": op7_repetition,
    "op8_decontamination": op8_decontamination,
    "op9_passages": op9_passages,
    "op10_bpe": op10_bpe,
    "op11_toxicity": op11_toxicity,
    "op12_interaction": op12_interaction,
    "op13_whitening": op13_whitening,
}
ORACLE_SQL: dict[str, str] = {
    "op2_chat": OP2_SQL,
    "op8_decontamination": OP8_SQL,
    "op12_interaction": OP12_SQL,
}
