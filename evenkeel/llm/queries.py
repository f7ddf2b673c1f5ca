"""The driver's queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import codec, counts, decontaminate, exact, language, quality, secrets, simhash, suffixes, tokenfiles


def queries() -> dict:
    return {
        "op1_suffix_dedup": suffixes.op1_suffix_dedup,
        "op2_secret_scan": secrets.op2_secret_scan,
        "op3_exact_dedup": exact.op3_exact_dedup,
        "op4_token_counts": counts.op4_token_counts,
        "op5_simhash": simhash.op5_simhash,
        "op6_bpe_codec": codec.op6_bpe_codec,
        "op7_decontamination": decontaminate.op7_decontamination,
        "op8_token_files": tokenfiles.op8_token_files,
        "op9_language_id": language.op9_language_id,
        "op10_quality": quality.op10_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": exact.OP3_SQL, "op7_decontamination": decontaminate.OP7_SQL}
