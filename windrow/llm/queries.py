"""The registered queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from . import decontaminate, digest, fixity, jaccard, language, lines, mixing, neighbours, personal, pitman_yor, runs, toxicity, whitening


def queries() -> dict:
    return {
        "op1_pitman_yor": pitman_yor.op1_pitman_yor,
        "op2_decontamination": decontaminate.op2_decontamination,
        "op3_warc_fixity": fixity.op3_warc_fixity,
        "op4_canonical_digest": digest.op4_canonical_digest,
        "op5_ngram_jaccard": jaccard.op5_ngram_jaccard,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_mixing": mixing.op7_mixing,
        "op8_personal_data": personal.op8_personal_data,
        "op9_language": language.op9_language,
        "op10_line_dedup": lines.op10_line_dedup,
        "op11_whitening": whitening.op11_whitening,
        "op12_nearest_neighbours": neighbours.op12_nearest_neighbours,
        "op13_periodic_runs": runs.op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontamination": decontaminate.ORACLE,
        "op3_warc_fixity": fixity.ORACLE,
        "op5_ngram_jaccard": jaccard.ORACLE,
        "op7_mixing": mixing.ORACLE,
    }
