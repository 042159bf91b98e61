"""The queries of this subpackage and their SQL."""

from lumenfold.llm import bpe, byte_bpe, exact_dedup, lm_scoring, mixing, pseudonyms, quality, resampling, secrets, sharding, simhash, substring_dedup, whitening

MODULES = [substring_dedup, sharding, secrets, simhash, bpe, quality, exact_dedup, pseudonyms, lm_scoring, mixing, byte_bpe, resampling, whitening]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
