from __future__ import annotations

from . import bpe
from .registry import query, table
from .tokenizer_files import BYTE_BPE


@query("op9_bpe")
def op9_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), BYTE_BPE, ("n_tokens", "ids_sha256", "decoded_sha256"))
