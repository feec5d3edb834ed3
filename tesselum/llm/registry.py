"""The queries of this subpackage and their SQL, by name."""

from tesselum.llm import decontamination, pii, quality_rules, repeats, sentence_pieces, sharding, simhash, toxicity, url_filters, warc_zip

QUERIES = {
    "op1_warc_zip": warc_zip.op1_warc_zip,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_sharding": sharding.op3_sharding,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_repeats": repeats.op5_repeats,
    "op6_pii": pii.op6_pii,
    "op7_url_filters": url_filters.op7_url_filters,
    "op8_simhash": simhash.op8_simhash,
    "op9_sentence_pieces": sentence_pieces.op9_sentence_pieces,
    "op10_quality_rules": quality_rules.op10_quality_rules,
}

#: DuckDB SQL of those that SQL can express on whole tables.
ORACLES: dict[str, str] = {
    "op1_warc_zip": warc_zip.ORACLE,
    "op2_decontamination": decontamination.ORACLE,
    "op7_url_filters": url_filters.ORACLE,
}
