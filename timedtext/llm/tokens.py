"""Token ids of whole texts under a public byte-level vocabulary.

The vocabulary file is a parameter, resolved on each machine. Ids are those of the ``tokenizers`` library with strings
of special tokens read as ordinary text. Texts whose characters all lie below U+0250 are encoded by ``tiktoken`` from
the same vocabulary's rank file, which gives the same ids (tests compare every such character in context) about four
times as fast; any other text goes through ``tokenizers`` itself.
"""

import base64
import os

import numpy as np

#: Texts below this code point take the fast path.
FAST_BELOW = 0x250


class Encoder:
    def __init__(self, vocabulary: str = "byte_bpe_50k"):
        import public_tokenizers as files

        self.json = files.path(f"{vocabulary}.json")
        self.full = None
        self.fast = None
        ranks = files.path(f"{vocabulary}.tiktoken")
        if ranks and os.path.exists(ranks):
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding(vocabulary, pat_str=files.PATTERN, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str | None) -> np.ndarray:
        """The ids as unsigned 32-bit integers."""
        if not text:
            return np.zeros(0, np.uint32)
        if self.fast is not None and (text.isascii() or max(text) < chr(FAST_BELOW)):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        if self.full is None:
            from tokenizers import Tokenizer

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            self.full = Tokenizer.from_file(self.json)
            self.full.encode_special_tokens = True
        return np.array(self.full.encode(text, add_special_tokens=False).ids, np.uint32)


def encoder(vocabulary: str = "byte_bpe_50k") -> Encoder:
    """One encoder for each worker process."""
    import sys

    kept = sys.modules.setdefault("_timedtext_encoders", type(sys)("_timedtext_encoders")).__dict__
    if vocabulary not in kept:
        kept[vocabulary] = Encoder(vocabulary)
    return kept[vocabulary]
