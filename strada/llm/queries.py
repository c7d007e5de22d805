"""The queries of this subpackage and their SQL, where SQL can express them."""

from strada.llm import ann, exact_dedup, html_text, language, mixing, near_dedup, packing, token_files, toxicity, warc

QUERIES = {
    "op1_ann": ann.query,
    "op2_exact_dedup": exact_dedup.query,
    "op3_token_files": token_files.query,
    "op4_toxicity": toxicity.query,
    "op5_html_text": html_text.query,
    "op6_packing": packing.query,
    "op7_mixing": mixing.query,
    "op8_warc": warc.query,
    "op9_language_id": language.query,
    "op10_near_dedup": near_dedup.query,
}
ORACLES = {
    "op2_exact_dedup": exact_dedup.SQL,
    "op7_mixing": mixing.SQL,
    "op8_warc": warc.SQL,
    "op10_near_dedup": near_dedup.SQL,
}
