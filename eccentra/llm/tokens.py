"""Token ids of texts, inside Spark tasks.

``tokenizers`` is the measure. For the byte-level vocabulary the same merges
are also given as ranks, which ``tiktoken`` applies several times faster; it is
used for texts of letters and signs on which both split alike (tested for every
code point allowed), and ``tokenizers`` for all other texts.
"""

from __future__ import annotations

import base64
import os
import re

from eccentra.llm.common import by_value

by_value(__name__)

#: Latin letters with their signs and spaces, and general punctuation.
PLAIN = "\x00-ɏ‐-‧‰-⁞€"
SPECIAL = "<|endoftext|>"


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of whole texts without added tokens; special strings in a text become their token."""

    def __init__(self, name: str = "byte_bpe_50k.json", fast: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.name, self.quick, self.slow = name, None, None
        if name.endswith(".model"):
            import sentencepiece

            self.piece = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(name))
            return
        self.piece = None
        ranks_file = name.removesuffix(".json") + ".tiktoken"
        if fast and name.startswith("byte_bpe") and os.path.exists(tokenizer_file(ranks_file)):
            import public_tokenizers
            import tiktoken

            with open(tokenizer_file(ranks_file), "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.quick = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})
            self.odd = re.compile(f"[^{PLAIN}]")

    def _whole(self):
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(tokenizer_file(self.name))
            self.slow.no_truncation()
            self.slow.no_padding()
        return self.slow

    def ids(self, text: str | None) -> list[int]:
        text = text or ""
        if self.piece is not None:
            return self.piece.encode(text)
        if self.quick is not None and not self.odd.search(text):
            return self.quick.encode(text, allowed_special="all")
        return self._whole().encode(text, add_special_tokens=False).ids
