"""Functions go to the executors by value: these have no copy of the package."""

import subprocess
import sys

import public_tokenizers
import pytest
from pyspark import cloudpickle

from ordermill.llm import decontaminate, fill_in_middle, html_text, jaccard, licenses, ngram_lm, packing, quality, token_counts, toxicity, whitening

MODEL = ngram_lm.Model("/none", 2, 1, (0,), 0, 0, (ngram_lm.SMALL_CORPUS,) * 2, 0, 1.0)
COMPONENTS = whitening.Components(whitening.Scatter(1, [0], [[0]]), [0.0], [None], whitening.np.zeros((1, 1)))
FUNCTIONS = {
    "html": lambda: (html_text._parsed(), html_text._kept_text()),
    "decontaminate": lambda: (decontaminate._found("/none", "bigint", 6),),
    "fill in middle": lambda: (fill_in_middle._transform(fill_in_middle.Settings()),),
    "whitening": lambda: (whitening._partial_sums(2), whitening._remainders([[1]]), whitening._whitened(COMPONENTS)),
    "n-grams": lambda: (
        ngram_lm._count_words(1), ngram_lm._count_grams(MODEL, 2), ngram_lm._word_files("/none"), ngram_lm._gram_files(MODEL, 2),
        ngram_lm._first_files(MODEL), ngram_lm._scored(MODEL),
    ),
    "licenses": lambda: (licenses.license_scan(),),
    "jaccard": lambda: (jaccard._linked(5, 80), jaccard._unions(5), jaccard._reaches(5, 80)),
    "packing": lambda: (packing._assigned({}),),
    "tokens": lambda: (token_counts._vocabulary([]), token_counts._pieces(public_tokenizers.path("byte_bpe_50k.json"))),
    "toxicity": lambda: (toxicity._count(toxicity.Settings()), toxicity._scored(toxicity.Model(toxicity.Settings(), [], [], 0.0))),
}


@pytest.mark.parametrize("name", sorted(FUNCTIONS))
def test_functions_load_without_the_package(spark, tmp_path, name):
    for number, function in enumerate(FUNCTIONS[name]()):
        path = tmp_path / f"{number}.bin"
        path.write_bytes(cloudpickle.dumps(getattr(function, "func", function)))
        code = f"import pickle, sys; assert 'ordermill' not in sys.modules; pickle.load(open({str(path)!r}, 'rb'))"
        done = subprocess.run([sys.executable, "-I", "-c", code], cwd=tmp_path, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr[-500:]


def test_settings_are_shipped(spark):
    assert quality.Settings() == cloudpickle.loads(cloudpickle.dumps(quality.Settings()))
