"""The queries of this folder and their SQL, as ``__spark_entry__`` adds them."""

from __future__ import annotations

from corpus_pipeline import run
from corpusprep.llm.centroids import OP13_SQL, op13_centroids
from corpusprep.llm.decontamination import op5_decontamination
from corpusprep.llm.exactcopies import OP11_SQL, op11_exact
from corpusprep.llm.language import op1_language
from corpusprep.llm.lines import op10_lines
from corpusprep.llm.neighbours import op4_neighbours
from corpusprep.llm.packing import op3_packing
from corpusprep.llm.phrases import OP12_SQL, op12_phrases
from corpusprep.llm.pii import op2_pii
from corpusprep.llm.secrets import op6_secrets
from corpusprep.llm.simhash import op9_simhash
from corpusprep.llm.substrings import OP8_SQL, op8_substrings
from corpusprep.llm.toxicity import op7_toxicity

QUERIES = {
    "op1_language": op1_language,
    "op2_pii": op2_pii,
    "op3_packing": op3_packing,
    "op4_neighbours": op4_neighbours,
    "op5_decontamination": op5_decontamination,
    "op6_secrets": op6_secrets,
    "op7_toxicity": op7_toxicity,
    "op8_substrings": op8_substrings,
    "op9_simhash": op9_simhash,
    "op10_lines": op10_lines,
    "op11_exact": op11_exact,
    "op12_phrases": op12_phrases,
    "op13_centroids": op13_centroids,
    "pipeline": run,
}
ORACLES: dict[str, str] = {
    "op8_substrings": OP8_SQL,
    "op11_exact": OP11_SQL,
    "op12_phrases": OP12_SQL,
    "op13_centroids": OP13_SQL,
}
