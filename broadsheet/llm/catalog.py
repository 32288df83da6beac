"""The package's registered queries: name -> (query, SQL or None)."""

from __future__ import annotations

from broadsheet.llm import alignment, covertree, decontaminate, exactdup, language, licences, lm, multiset, neardup, pieces, secrets, toxicity, urls

QUERIES = {
    "op1_secrets": (secrets.query, None),
    "op2_url_trees": (urls.query, None),
    "op5_licence_digests": (licences.query, licences.ORACLE_SQL),
    "op4_kneser_ney": (lm.query, None),
    "op6_decontamination": (decontaminate.query, decontaminate.ORACLE_SQL),
    "op7_setsketch_neardup": (neardup.query, neardup.ORACLE_SQL),
    "op8_language_fusion": (language.query, None),
    "op9_positive_unlabelled": (toxicity.query, None),
    "op10_multiset_hash": (multiset.query, None),
    "op3_sentencepiece": (pieces.query, None),
    "op11_alignment": (alignment.query, None),
    "op12_exact_dedup": (exactdup.query, exactdup.ORACLE_SQL),
    "op13_cover_tree": (covertree.query, None),
}
