"""All queries of the training-data operators, each defined beside its operator."""

from patronvoice.llm import counts, decontaminate, epsilon, middle, mix, packing, quality, shards, simhash, sitetree, subvectors, urlfilter, wavelet  # noqa: F401
from patronvoice.llm.common import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
