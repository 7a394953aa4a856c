"""The registered queries of this package and the SQL that checks them."""

import corpus_pipeline
from ledgerloom.llm import (
    chat, collocations, decontam, licences, lines, minhash, mixing, quality, spelling, substrings, tokens, toxicity, warc,
)

QUERIES = {
    "op1_substrings": substrings.query,
    "op2_mixing": mixing.query,
    "op3_warc": warc.query,
    "op4_decontamination": decontam.query,
    "op5_chat": chat.query,
    "op6_licences": licences.query,
    "op7_minhash": minhash.query,
    "op8_toxicity": toxicity.query,
    "op9_tokens": tokens.query,
    "op10_quality": quality.query,
    "op11_collocations": collocations.query,
    "op12_spelling": spelling.query,
    "op13_lines": lines.query,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL = {
    "op2_mixing": mixing.SQL,
    "op3_warc": warc.SQL,
    "op4_decontamination": decontam.SQL,
    "op5_chat": chat.SQL,
    "op10_quality": quality.SQL,
    "op11_collocations": collocations.SQL,
    "op13_lines": lines.SQL,
}
