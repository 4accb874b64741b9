"""Training-data operators: decontamination, media, archives, near-duplicates,
toxicity, token files, packing, secrets, licences, language-model scores, periodic
runs, manifests and URL filters.

Nothing outside this subpackage imports it.
"""
