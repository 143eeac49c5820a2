import public_tokenizers
import pytest


@pytest.fixture(scope="session")
def tokenizers():
    """Paths of the public vocabularies."""
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
