"""The queries of the corpus operators and their SQL."""

from . import archives, chaining, decontaminate, jaccard, licenses, mixing, neighbours, pages, secrets, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_archives": archives.op2_archives,
    "op3_mixing": mixing.op3_mixing,
    "op4_chaining": chaining.op4_chaining,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_jaccard": jaccard.op6_jaccard,
    "op7_neighbours": neighbours.op7_neighbours,
    "op8_pages": pages.op8_pages,
    "op9_secrets": secrets.op9_secrets,
    "op10_licenses": licenses.op10_licenses,
}

ORACLES = {
    "op2_archives": archives.ORACLE,
    "op3_mixing": mixing.ORACLE,
    "op5_decontaminate": decontaminate.ORACLE,
    "op6_jaccard": jaccard.ORACLE,
    "op9_secrets": secrets.ORACLE,
    "op10_licenses": licenses.ORACLE,
}
