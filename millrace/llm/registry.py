"""Imports every operator module, which registers its query."""

from millrace.llm import extendible, fair_mix, html_text, langid, lattice_lm, merkle, packing, phrase_index, quality_model, repair, simhash, syncmers, wavelet  # noqa: F401
from millrace.llm.common import ORACLES, QUERIES  # noqa: F401
