import importlib.util

import pytest

if importlib.util.find_spec("public_tokenizers") is None:
    collect_ignore_glob = ["test_bpe.py", "test_chat.py", "test_packing.py", "test_align.py"]


@pytest.fixture(scope="session")
def docs_kind():
    return "doc_id long, text string, lang string, source string, n_chars long"
