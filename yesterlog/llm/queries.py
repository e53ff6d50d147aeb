"""The operators' queries and, where SQL can express them, their SQL."""

from . import chat, decontam, divergence, media, minmax, packing, periodic, pii, simhash, suffix_dedup, token_file, toxicity, url_filter

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_chat_format": chat.op2_chat_format,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_decontaminate": decontam.op4_decontaminate,
    "op5_simhash": simhash.op5_simhash,
    "op6_media": media.op6_media,
    "op7_pii": pii.op7_pii,
    "op8_token_file": token_file.op8_token_file,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_packing": packing.op10_packing,
    "op11_divergence": divergence.op11_divergence,
    "op12_minmax": minmax.op12_minmax,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}

ORACLES = {"op2_chat_format": chat.ORACLE, "op3_url_filter": url_filter.ORACLE, "op4_decontaminate": decontam.ORACLE, "op11_divergence": divergence.ORACLE, "op12_minmax": minmax.ORACLE}
