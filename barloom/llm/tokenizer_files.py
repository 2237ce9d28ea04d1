"""Where the public vocabulary files lie; BARLOOM_TOKENIZERS names another folder."""

from __future__ import annotations

import os


def path(name: str) -> str:
    folder = os.environ.get("BARLOOM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


BYTE_BPE = path("byte_bpe_50k.json")
WORD_BPE = path("word_bpe_49k.json")
