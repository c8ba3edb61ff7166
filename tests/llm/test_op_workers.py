import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from test_workers import run_elsewhere  # noqa: E402


def test_operators_run_on_workers_without_the_library(tmp_path):
    imports = "from recordloom.llm.queries import QUERIES\nimport corpus_pipeline\nQUERIES['pipeline'] = corpus_pipeline.run"
    run_elsewhere(tmp_path, imports, ["op1_benchmark_hits", "op2_toxicity", "op9_suffix_dedup", "op10_secret_scan", "op11_spelling_variants", "op12_chat_repair", "op13_odd_sketch_groups", "pipeline"])
