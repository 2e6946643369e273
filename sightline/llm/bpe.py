"""Byte-level BPE ids for a vocabulary file of the ``tokenizers`` library.

The same ids come out of two routes: the library itself, and its vocabulary
handed to the faster ``tiktoken`` merge loop.  The second route is taken only for
files whose shape makes the two equal (byte-level pre-tokenizer with the standard
pattern, no normalizer, ids that rise with the merge rank) and for texts of
ordinary length; all else goes through the library.
"""

from __future__ import annotations

import json
import os

import numpy as np

#: Fixed value: how the byte-level pre-tokenizer splits texts.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts above this length go through the library, whose merges are linear in a long piece.
FAST_CHARS = 400_000

_LOADED: dict[str, "Bpe | Pieces"] = {}


def byte_alphabet() -> dict[str, int]:
    """Printable character -> byte, as byte-level vocabularies write bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    rest = (b for b in range(256) if b not in set(plain))
    return table | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Tokenizer of one vocabulary file; use :func:`load`."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.path = path
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        added = config.get("added_tokens") or []
        self.specials = {t["content"]: t["id"] for t in added}
        self.plain_specials = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in added)
        #: Whether :data:`PATTERN` splits texts into pieces that are tokenized one by one.
        self.splits = self._is_usual(config)
        self._fast = self._build(config) if self.splits else None

    def _is_usual(self, config: dict) -> bool:
        model, pre = config["model"], config.get("pre_tokenizer") or {}
        return bool(
            model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
            and not pre.get("add_prefix_space") and not config.get("normalizer") and not model.get("ignore_merges")
            and not model.get("dropout") and self.plain_specials
        )

    def _build(self, config: dict):
        model = config["model"]
        vocab = model["vocab"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        ids = np.array([vocab[a + b] for a, b in pairs])
        if len(ids) > 1 and (np.diff(ids) <= 0).any():
            return None
        try:
            import tiktoken
        except ImportError:
            return None
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): i for token, i in vocab.items() if token not in self.specials}
        return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.specials)

    def encode(self, text: str) -> np.ndarray:
        """Ids of ``text`` (special strings become their ids, as the library's default), as uint32."""
        if not text:
            return np.zeros(0, np.uint32)
        if self._fast is None or len(text) > FAST_CHARS:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return np.asarray(self._fast.encode_to_numpy(text, allowed_special="all"), dtype=np.uint32)

    def count_pieces(self, pieces: list[str]) -> list[int]:
        """Ids per piece, by the library."""
        return [len(e.ids) for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]


class Pieces:
    """Tokenizer of a sentencepiece model; use :func:`load`."""

    specials: dict[str, int] = {}
    splits = False

    def __init__(self, path: str):
        import sentencepiece

        self.path = path
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)

    def encode(self, text: str) -> np.ndarray:
        """Ids of ``text`` as uint32."""
        return np.array(self.library.encode(text) if text else [], dtype=np.uint32)

    def count_pieces(self, pieces: list[str]) -> list[int]:
        """Ids per piece, by the library."""
        return [len(ids) for ids in self.library.encode(pieces)] if pieces else []


def load(path: str) -> "Bpe | Pieces":
    """The tokenizer of ``path``; each process reads a file once."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path) if path.endswith(".model") else Bpe(path)
    return _LOADED[path]
