"""Public vocabularies: read once on the driver, sent to the executors, which need no files of their own."""

from __future__ import annotations

import base64

TOKENIZERS = "/opt/tokenizers"
#: The vocabularies in use: of fixed size, about 2 MB together.
NAMES = ("byte_bpe_50k", "byte_bpe_multi_50k")


def load(tokenizers: str = TOKENIZERS) -> dict[str, bytes]:
    """The contents of the vocabulary files in a folder, by name."""
    found = {}
    for name in NAMES:
        with open(f"{tokenizers}/{name}.tiktoken", "rb") as f:
            found[name] = f.read()
    return found


def ranks(held: dict[str, bytes], name: str = NAMES[0]) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, held[name].splitlines())}


def whole_words(held: dict[str, bytes]) -> set[str]:
    """Words that a vocabulary holds as one piece after a blank."""
    pieces = (base64.b64decode(line.split()[0]).decode(errors="ignore") for name in NAMES for line in held[name].splitlines())
    return {t[1:] for t in pieces if t[:1] == " " and t[1:].isalpha()}
