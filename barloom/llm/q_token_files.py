from __future__ import annotations

from . import token_files
from .registry import query, table
from .tokenizer_files import WORD_BPE


@query("op10_token_files")
def op10_token_files(spark, sf_dir):
    return token_files.read(token_files.write(table(spark, sf_dir, "documents"), WORD_BPE, end_id=1), ids=False)
