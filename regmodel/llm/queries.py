"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate, languages, licenses, manifest, near_dups, periodic, pieces, quality, secrets, sharding, token_blocks, toxicity, url_rules

QUERIES = {
    "op1_token_blocks": token_blocks.query,
    "op2_sentencepiece": pieces.query,
    "op3_decontaminate": decontaminate.query,
    "op4_toxicity": toxicity.query,
    "op5_secrets": secrets.query,
    "op6_near_dups": near_dups.query,
    "op7_quality": quality.query,
    "op8_sharding": sharding.query,
    "op9_licenses": licenses.query,
    "op10_url_rules": url_rules.query,
    "op11_periodic_runs": periodic.query,
    "op12_manifest": manifest.query,
    "op13_languages": languages.query,
}

ORACLES = {
    "op8_sharding": sharding.ORACLE,
    "op9_licenses": licenses.ORACLE,
    "op10_url_rules": url_rules.ORACLE,
    "op12_manifest": manifest.ORACLE,
}
