"""Token ids of whole texts, equal to what the tokenizers library gives."""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import numpy as np

#: Letters, digits, signs and white space that every version of the Unicode tables classes alike.
_PLAIN = re.compile("[^\x00-ɏ‐-‧€]")


class IdEncoder:
    """Encodes with a tokenizers file; a tiktoken file of the same ranks, if given, serves plain texts faster.

    A text goes to the tokenizers library itself when it holds one of the special-token strings or a
    character outside the Latin blocks, where two libraries could split words by different tables.
    """

    def __init__(self, file: str, ranks: str | None = None, pattern: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(file)
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        self.size = self.exact.get_vocab_size()
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding(ranks, pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str | None) -> np.ndarray:
        """uint32 ids; none for null or empty text."""
        if not text:
            return np.empty(0, "<u4")
        if self.fast is None or any(s in text for s in self.special) or not (text.isascii() or not _PLAIN.search(text)):
            return np.asarray(self.exact.encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, disallowed_special=())


@lru_cache(maxsize=2)
def encoder(file: str, ranks: str | None = None, pattern: str | None = None) -> IdEncoder:
    """One per Python worker."""
    return IdEncoder(file, ranks, pattern)


def byte_bpe() -> tuple[str, str, str]:
    """The arguments of `encoder` for the public byte-level vocabulary."""
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN
