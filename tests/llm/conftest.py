import base64

import pytest

from tracelane.llm import byte_bpe


@pytest.fixture(scope="session")
def tiktoken_encoding():
    import public_tokenizers
    import tiktoken

    with open(byte_bpe.default_ranks(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
