"""The operators' queries and their SQL."""

from siteweave.llm.decontaminate import OP10_SQL, op10_decontamination
from siteweave.llm.exact_duplicates import OP11_SQL, op11_exact_duplicates
from siteweave.llm.language_id import op2_language_id
from siteweave.llm.lexical_search import OP12_SQL, op12_lexical_search
from siteweave.llm.manifest import OP13_SQL, op13_manifest
from siteweave.llm.mixture import op1_mixture
from siteweave.llm.near_duplicates import OP7_SQL, op7_near_duplicates
from siteweave.llm.quality import op4_quality
from siteweave.llm.sharding import op9_sharding
from siteweave.llm.token_count import op6_token_count
from siteweave.llm.surrogates import op8_surrogates
from siteweave.llm.toxicity import op3_toxicity
from siteweave.llm.vector_duplicates import OP5_SQL, op5_vector_duplicates

QUERIES = {
    "op1_mixture": op1_mixture,
    "op2_language_id": op2_language_id,
    "op3_toxicity": op3_toxicity,
    "op4_quality": op4_quality,
    "op5_vector_duplicates": op5_vector_duplicates,
    "op6_token_count": op6_token_count,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_surrogates": op8_surrogates,
    "op9_sharding": op9_sharding,
    "op10_decontamination": op10_decontamination,
    "op11_exact_duplicates": op11_exact_duplicates,
    "op12_lexical_search": op12_lexical_search,
    "op13_manifest": op13_manifest,
}
ORACLES = {
    "op5_vector_duplicates": OP5_SQL,
    "op7_near_duplicates": OP7_SQL,
    "op10_decontamination": OP10_SQL,
    "op11_exact_duplicates": OP11_SQL,
    "op12_lexical_search": OP12_SQL,
    "op13_manifest": OP13_SQL,
}
