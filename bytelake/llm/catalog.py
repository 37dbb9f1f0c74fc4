"""Import every operator module so the registry is complete."""

from . import bm25_decontamination, circulant_minhash, conversation_repair, crf_language, entropy_secrets, exact_dedup, golay_simhash, host_extraction, packing, phrase_mining, ring_sharding, suffix_dedup, weak_pii  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
