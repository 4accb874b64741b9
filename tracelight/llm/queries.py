"""The operators' queries, one each, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate, licenses, lm, manifest, media, neardup, packing, runs, secrets, tokens, toxicity, urlfilter, warc

QUERIES = {
    "op1_decontamination": decontaminate.query,
    "op2_media": media.query,
    "op3_warc": warc.query,
    "op4_neardup": neardup.query,
    "op5_toxicity": toxicity.query,
    "op6_token_files": tokens.query,
    "op7_packing": packing.query,
    "op8_secrets": secrets.query,
    "op9_licenses": licenses.query,
    "op10_suffix_tree": lm.query,
    "op11_periodic_runs": runs.query,
    "op12_manifest": manifest.query,
    "op13_url_filter": urlfilter.query,
    "base_secret_spans": secrets.base_query,
}

ORACLES = {
    "op1_decontamination": decontaminate.ORACLE,
    "op3_warc": warc.ORACLE,
    "op4_neardup": neardup.ORACLE,
    "op9_licenses": licenses.ORACLE,
    "op12_manifest": manifest.ORACLE,
    "op13_url_filter": urlfilter.ORACLE,
    "base_secret_spans": secrets.BASE_ORACLE,
}
