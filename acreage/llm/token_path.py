"""Place of the public tokenizer files (a parameter of the operators, resolved for the queries here)."""

from __future__ import annotations

import os


def path(name: str) -> str:
    try:
        import public_tokenizers
        return public_tokenizers.path(name)
    except ModuleNotFoundError:
        return os.path.join("/opt/tokenizers", name)


BYTE_BPE = path("byte_bpe_50k.json")
PIECES_32K = path("piece_bpe_32k.model")
