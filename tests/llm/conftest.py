import sys
from pathlib import Path

import pytest
from pyspark import cloudpickle

sys.path.insert(0, str(Path(__file__).parent))

from conftest_llm import table  # noqa: E402, F401

cloudpickle.register_pickle_by_value(sys.modules["conftest_llm"])


@pytest.fixture(scope="session")
def tokenizer():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path("word_bpe_49k.json")
