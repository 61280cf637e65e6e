"""The training-data operators as registered queries, with SQL where it can express them."""

from __future__ import annotations

from . import fim, lexical, quality
from .chunks import op1_chunk_dedup
from .embeddings import op8_embeddings
from .fim import op13_fim
from .gam import op12_quality_model
from .langid import op9_langid
from .lexical import op11_lexical
from .licences import op4_licences
from .minhash import op6_minhash
from .mixing import op10_mixing
from .packing import op3_packing
from .quality import op7_quality
from .secrets import op2_secrets
from .suffixes import op5_suffixes

QUERIES = {
    "op1_chunk_dedup": op1_chunk_dedup, "op2_secrets": op2_secrets, "op3_packing": op3_packing, "op4_licences": op4_licences, "op5_suffixes": op5_suffixes,
    "op6_minhash": op6_minhash, "op7_quality": op7_quality, "op8_embeddings": op8_embeddings, "op9_langid": op9_langid, "op10_mixing": op10_mixing,
    "op11_lexical": op11_lexical, "op12_quality_model": op12_quality_model, "op13_fim": op13_fim,
}
ORACLES: dict[str, str] = {"op7_quality": quality.ORACLE, "op11_lexical": lexical.ORACLE, "op13_fim": fim.ORACLE}
