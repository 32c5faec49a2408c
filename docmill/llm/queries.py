"""The queries opN_<name> of this subpackage, and SQL for those that SQL can express."""

from docmill.llm import alignment, decontaminate, infill, language, mixing, ngram_join, pii, quality, secrets, substrings, token_files, tokens, urls

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_token_counts": tokens.op2_token_counts,
    "op3_ngram_jaccard": ngram_join.op3_ngram_jaccard,
    "op4_suffix_dedup": substrings.op4_suffix_dedup,
    "op5_pii": pii.op5_pii,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_language": language.op7_language,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_mixing": mixing.op9_mixing,
    "op10_url_filters": urls.op10_url_filters,
    "op11_cross_tokenizer": alignment.op11_cross_tokenizer,
    "op12_token_files": token_files.op12_token_files,
    "op13_fill_in_middle": infill.op13_fill_in_middle,
}

ORACLE_SQL = {
    "op3_ngram_jaccard": ngram_join.SQL,
    "op6_quality_rules": quality.SQL,
    "op8_decontamination": decontaminate.SQL,
    "op9_mixing": mixing.SQL,
    "op10_url_filters": urls.SQL,
    "op13_fill_in_middle": infill.SQL,
}
