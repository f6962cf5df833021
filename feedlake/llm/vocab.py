"""Public tokenizer files as seen by tasks: every worker opens them by its own library path.

``public_tokenizers`` is an installed package, so a path it gives is valid on each machine;
the files are never copied into the repository.
"""

from __future__ import annotations

import base64
import json
import os
from array import array
from functools import lru_cache

import public_tokenizers
import regex

PATTERN = regex.compile(public_tokenizers.PATTERN)


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: the byte
    itself where Latin-1 prints it, otherwise the next free code point from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


SYMBOL = byte_symbols()
SYMBOL_TABLE = {b: s for b, s in enumerate(SYMBOL)}


@lru_cache(maxsize=4)
def load_tokenizer(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


@lru_cache(maxsize=4)
def load_ranks(name: str) -> dict[bytes, int]:
    with open(public_tokenizers.path(name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def load_merges(name: str) -> tuple[dict[str, int], list[tuple[str, str]], list[str]]:
    """(ids by piece, merges in rank order, special strings) of a ``.json`` file."""
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        spec = json.load(f)
    merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
    return spec["model"]["vocab"], merges, [t["content"] for t in spec["added_tokens"]]


#: ASCII and the precomposed letters of Latin-1: classified alike by every version of Unicode,
#: normalised to themselves and lower-cased one by one.
PLAIN = regex.compile(r"[\x00-\x7f\u00c0-\u00ff]*")
PIECE_ENTRIES = 200_000


def library_encoder(name: str, end_of_word: bool):
    """``make`` for :class:`~feedlake.llm.chunks.ChunkEncoder` over the tokenizers library.

    Plain chunks without a special string are cut into words here and go to the library's BPE
    model, each distinct word once; other chunks go through its whole pipeline.
    """
    tok = load_tokenizer(name)
    tokenize = tok.model.tokenize
    special = [t.content for t in tok.get_added_tokens_decoder().values()]
    split = (PATTERN if not end_of_word else regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")).findall
    pieces: dict[str, bytes] = {}

    def make(chunks: list[str]) -> list[bytes]:
        out, rest = [b""] * len(chunks), []
        if len(pieces) > PIECE_ENTRIES:
            pieces.clear()
        for i, c in enumerate(chunks):
            if not c:
                continue
            if not (c.isascii() or PLAIN.fullmatch(c)) or ("<" in c and any(s in c for s in special)):
                rest.append(i)
                continue
            ids = b""
            if end_of_word:
                c = c.lower()
            # letters, or a space and letters, are one word of the pattern
            for p in (c,) if c.isalpha() or (c[0] == " " and c[1:].isalpha() and not end_of_word) else split(c):
                found = pieces.get(p)
                if found is None:
                    plain = p.isascii() and p.isprintable()  # of these only the space has another symbol
                    symbols = p.replace(" ", SYMBOL[32]) if plain else p.encode().decode("latin-1").translate(SYMBOL_TABLE)
                    found = pieces[p] = array("I", [t.id for t in tokenize(symbols)]).tobytes()
                ids += found
            out[i] = ids
        if rest:
            for i, e in zip(rest, tok.encode_batch([chunks[i] for i in rest], add_special_tokens=False), strict=True):
                out[i] = array("I", e.ids).tobytes()
        return out

    return make
